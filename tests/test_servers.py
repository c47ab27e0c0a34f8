"""Sources that need files or a server of their own: chat, tokens, snapshots, tensors, shards, items, queues, stops."""

import json
import os
import signal
import struct
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan import schemas
from quillspan.functions import udfs
from quillspan.operators import scorecard as S
from quillspan.sources import readers, server, sinks
from quillspan.streaming import logs


class Model(BaseHTTPRequestHandler):
    def do_GET(self):
        self.say({"status": "ok"} if self.path == "/health" else {"model": "tiny", "name": "ñ"})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/tokenize":
            return self.say({"tokens": body["content"].split()})
        prompt = body["messages"][-1]["content"]
        if "fail" in prompt:
            return self.send_error(500)
        said = {"content": f"{prompt} -> 7", "reasoning_content": None if "chat_template_kwargs" in body else "thinking"}
        self.say({"choices": [{"message": said, "finish_reason": "stop"}], "usage": {"prompt_tokens": len(prompt), "completion_tokens": body["max_tokens"], "other": 1}, "timings": {"predicted_per_second": 2.5}})

    def say(self, x):
        raw = json.dumps(x).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    s = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_server(spark, base, tmp_path):
    items = spark.createDataFrame([(i, "en", "7", "please fail" if i == 2 else f"ask {i}") for i in range(5)], "id long, lang string, gold string, prompt string")
    got = readers.answered(items, server.chat(base, {"max_tokens": 9}, seed=3, tag="run"), schemas.RECORD, workers=2)
    rows = {r["id"]: r for r in S.scored(S.flat_usage(got), "mgsm").collect()}
    assert sorted(rows) == [0, 1, 3, 4] and all(r["correct"] and r["completion_tokens"] == 9 and r["reasoning_content"] == "thinking" and r["tag"] == "run" and r["seed"] == 3 and r["wall"] > 0 for r in rows.values())
    assert readers.answered(items.where("id = 0"), server.chat(base, {"max_tokens": 1}, thinking=False), schemas.RECORD).first()["thinking"] == "off"
    assert [r[0] for r in items.orderBy("id").select(udfs.token_count(F.when(F.col("id") != 1, F.col("prompt")), server.tokenize(base))).collect()] == [2, 0, 2, 2, 2]
    assert server.healthy(base) and not server.healthy("http://127.0.0.1:9", seconds=2)
    props = tmp_path / "props.json"
    assert server.snapshot(base, props) and not server.snapshot(base, props) and "ñ" in props.read_text()
    assert server.chat_body("q", {"top_k": 5}, system="be brief") == {"messages": [{"role": "system", "content": "be brief"}, {"role": "user", "content": "q"}], "top_k": 5}
    gone = server.chat("http://127.0.0.1:9", {}, seconds=2)()
    assert gone({"id": 1, "prompt": "x"}) is None


def test_no_item_begins_after_the_deadline(spark):
    items = spark.range(6).withColumnRenamed("id", "k")
    ask = lambda: lambda x: {"k": x["k"]}
    assert readers.answered(items, ask, "k long", until=datetime.now() - timedelta(1)).count() == 0
    assert readers.answered(items, ask, "k long", until=datetime.now() + timedelta(1)).count() == 6


def test_tensors(spark, tmp_path):
    def write(name, tensors):
        header, at = {"__metadata__": {"format": "pt"}}, 0
        for k, (dtype, shape) in tensors.items():
            size = int(np.prod(shape)) * readers.ELEMENT_BYTES[dtype]
            header[k] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + size]}
            at += size
        raw = json.dumps(header).encode()
        (tmp_path / name).write_bytes(struct.pack("<Q", len(raw)) + raw + bytes(at))

    write("a.safetensors", {"model.visual.w": ("BF16", [3, 4]), "model.language_model.w": ("F32", [5])})
    write("b.safetensors", {"mtp.w": ("F16", [2, 2]), "lm_head": ("BF16", [])})
    t = readers.tensors(spark, str(tmp_path / "*.safetensors"))
    assert sorted((r["file"], r["name"], r["elements"], r["bytes"]) for r in t.collect()) == [("a.safetensors", "model.language_model.w", 5, 20), ("a.safetensors", "model.visual.w", 12, 24), ("b.safetensors", "lm_head", 1, 2), ("b.safetensors", "mtp.w", 4, 8)]
    part = F.when(F.col("name").startswith("model.visual."), "vision").when(F.col("name").startswith("mtp."), "mtp").otherwise("text")
    assert {r["part"]: (r["tensors"], r["elements"], r["bytes"]) for r in S.tensor_counts(t, part).collect()} == {"vision": (1, 12, 24), "mtp": (1, 4, 8), "text": (2, 6, 22)}
    assert readers.tensors(spark, str(tmp_path / "none*")).count() == 0
    np.arange(6, dtype="<i4").tofile(tmp_path / "ids.i32")
    assert [r["values"] for r in readers.number_rows(spark, str(tmp_path / "ids.i32"), 2, "int").orderBy("position").collect()] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(Exception):
        readers.number_rows(spark, str(tmp_path / "ids.i32"), 4, "int").collect()


def test_shards_hub_items(spark, tmp_path):
    for k in range(5):
        spark.range(100 * k, 100 * k + 10 + k).coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
    paths = [str(next((tmp_path / f"s{k}").glob("*.parquet")).rename(tmp_path / f"shard-{k}.parquet")) for k in range(5)]
    assert [p[-9:-8] for p in readers.evenly(paths, 2)] == ["0", "2"] and len(readers.evenly(paths, 9)) == 5
    whole = readers.shard_sample(spark, paths, 2).groupBy("shard").count().collect()
    assert sorted(tuple(r) for r in whole) == [("shard-0.parquet", 10), ("shard-2.parquet", 12)]
    got = sorted(tuple(r) for r in readers.shard_sample(spark, paths, 4, group_rows=4).select("shard", "row_group", "row", "id").collect())
    want = []
    for n, k in enumerate((0, 1, 2, 3)):
        size = 10 + k
        group = n % -(-size // 4)
        want += [(f"shard-{k}.parquet", group, r, 100 * k + 4 * group + r) for r in range(min(4, size - 4 * group))]
    assert got == want
    (tmp_path / "data.jsonl").write_text("".join(json.dumps({"q": f"text {i}", "n": 9 - i}) + "\n" for i in range(9)))
    hub = readers.hub(spark, str(tmp_path / "data.jsonl"), "order", {"q": "question", "n": "order"})
    assert [(r["id"], r["question"]) for r in hub.orderBy("id").collect()][:2] == [(1, "text 8"), (2, "text 7")]
    assert readers.first_rows(spark, str(tmp_path / "shard-1.parquet"), ["id"], "id", 3).count() == 3
    for lang in ("en", "es"):
        (tmp_path / f"mgsm.{lang}.jsonl").write_text('{"id": 1, "question": "q", "answer_number": 3}\n{"id": 2}\n')
    items = readers.items(spark, str(tmp_path / "mgsm.*.jsonl"))
    assert sorted((r["id"], r["lang"], r["answer_number"]) for r in items.collect()) == [(1, "en", 3.0), (1, "es", 3.0)]
    (tmp_path / "x_raw.t.jsonl").write_text('{"id": 1, "lang": "en"}\n\n')
    assert readers.records(spark, str(tmp_path / "x_raw.t.jsonl")).first()["tag"] == "t"
    with pytest.raises(Exception, match="blank"):
        readers.records_unbroken(spark, str(tmp_path / "x_raw.t.jsonl")).collect()
    (tmp_path / "x_raw.t.jsonl").write_text('{"id": 1, "lang": "en"}\n')
    assert readers.records_unbroken(spark, str(tmp_path / "x_raw.t.jsonl")).select("bench", "tag", "id").collect() == [("x", "t", 1)]


def test_broken_cache_is_built_anew(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"half")
    assert readers.cached(spark, str(path), lambda: spark.range(3)).count() == 3
    assert readers.cached(spark, str(path), lambda: spark.range(5)).count() == 3


def test_append_and_queue(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    threads = [threading.Thread(target=lambda k=k: [sinks.append_record({"id": k, "lang": "es", "content": "ñ" * 500}, log) for _ in range(50)]) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert readers.records(spark, str(log)).count() == 400 and "ñ" in log.read_text()
    ran = []
    jobs = {n: (lambda n=n: ran.append(n) or spark.range(n)) for n in (1, 2, 3)}
    assert sinks.run_queue({str(n): j for n, j in jobs.items()}, {"1": 1, "2": 5, "3": 3}, tmp_path) == ["2"] and ran == [1, 2, 3]
    assert sinks.run_queue({str(n): j for n, j in jobs.items()}, {"1": 1, "2": 2, "3": 3}, tmp_path) == [] and ran == [1, 2, 3, 2]


def test_stops(spark, tmp_path):
    live = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    start = lambda name: live.writeStream.format("memory").queryName(name).trigger(processingTime="100 milliseconds").start()
    q = start("until")
    began = datetime.now()
    assert not logs.stop_at(q, began + timedelta(seconds=3)) and not q.isActive and (datetime.now() - began).total_seconds() < 30
    q = start("signal")
    with logs.stopped_by_signal(q, (signal.SIGUSR1,)):
        os.kill(os.getpid(), signal.SIGUSR1)
        q.awaitTermination(30)
    assert not q.isActive
    done = spark.readStream.schema("a long").json(str(tmp_path)).writeStream.format("memory").queryName("done").trigger(availableNow=True).start()
    assert logs.stop_at(done, datetime.now() + timedelta(seconds=60))
