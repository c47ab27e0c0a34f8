"""Answers that outlive the task that got them, requests in flight, and row groups."""

import json
import subprocess
import sys
import textwrap
import threading
import time
from collections import Counter
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspan.sources import answers, rowgroups

ROOT = Path(__file__).resolve().parents[1]


def test_killed_task_asks_no_committed_item_again(tmp_path):
    """The worker is killed in the middle of its task: the next attempt asks only what no segment holds."""
    script = textwrap.dedent(f"""
        import json, os, sys
        sys.path.insert(0, {str(ROOT)!r})
        from quillspan.session import session
        from quillspan.sources import answers
        spark = session("killed", "local[2,4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
        spark.sparkContext.setLogLevel("OFF")
        out = {str(tmp_path)!r}

        def respond():
            def ask(x):
                with open(out + "/asked", "a") as f:
                    f.write(str(x["id"]) + chr(10))
                if x["id"] == 77 and not os.path.exists(out + "/killed"):
                    open(out + "/killed", "w").close()
                    os.kill(os.getpid(), 9)
                return {{"id": x["id"], "said": x["id"] * 2}}
            return ask

        answers.recorded(spark.range(200), respond, out + "/log", ["id"], workers=4, tasks=2, segment_rows=4)
        rows = answers.log(spark, out + "/log", "id long, said long", ["id"])
        got = sorted(tuple(r) for r in rows.collect())
        assert got == [(i, 2 * i) for i in range(200)], len(got)
        first = {{i: n for i, n in rows.groupBy("id").count().collect()}}
        print("segments", len(os.listdir(out + "/log")))
    """)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    asked = Counter((tmp_path / "asked").read_text().split())
    committed = Counter(json.loads(line)["id"] for f in (tmp_path / "log").glob("*.jsonl") for line in f.read_text().splitlines())
    assert set(committed) == set(range(200)) and set(committed.values()) == {1}  # what is committed is never asked, so never there twice
    again = sum(n - 1 for n in asked.values())
    assert 0 < again <= 2 + 4  # in flight, or answered and not yet in a segment
    assert not list((tmp_path / "log").glob("_*.part"))


def test_slow_answers_are_kept_one_by_one(spark, tmp_path):
    """No answer waits for the next one: its segment is there while the task still runs."""
    log = tmp_path / "log"

    def respond():
        def ask(x):
            time.sleep(0.1 if x["id"] == 0 else 2.5)
            return {"id": x["id"], "alone": len(list(log.glob("*.jsonl")))}

        return ask

    answers.recorded(spark.range(2).coalesce(1).sortWithinPartitions("id"), respond, str(log), ["id"], workers=1, tasks=1, segment_seconds=0.3)
    rows = {r["id"]: r["alone"] for r in answers.log(spark, str(log), "id long, alone long", ["id"]).collect()}
    assert sorted(rows) == [0, 1] and max(rows.values()) == 1
    before = len(list(log.glob("*.jsonl")))
    answers.recorded(spark.range(2), respond, str(log), ["id"], workers=1)
    assert len(list(log.glob("*.jsonl"))) == before  # nothing was pending


class Busy(BaseHTTPRequestHandler):
    lock, now, most = threading.Lock(), 0, 0

    def do_GET(self):
        with Busy.lock:
            Busy.now += 1
            Busy.most = max(Busy.most, Busy.now)
        time.sleep(0.15)
        with Busy.lock:
            Busy.now -= 1
        self.send_response(200)
        self.end_headers()

    def log_message(self, *_):
        pass


@pytest.fixture
def busy():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    s.daemon_threads = True
    Busy.most = 0
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_requests_in_flight(spark, busy):
    """One limit over all tasks, and close to it; a deadline still holds."""

    def respond():
        import urllib.request

        def ask(x):
            urllib.request.urlopen(busy, timeout=10).read()
            return {"id": x["id"]}

        return ask

    began = time.monotonic()
    assert answers.answered(spark.range(80), respond, "id long", workers=10, tasks=3).count() == 80
    assert 8 <= Busy.most <= 10 and time.monotonic() - began < 80 * 0.15
    Busy.most = 0
    soon = datetime.now() + timedelta(seconds=4)
    n = answers.answered(spark.range(4000), respond, "id long", workers=6, until=soon).count()
    assert 0 < n < 400 and Busy.most <= 6
    assert answers.shares(10, 3) == [4, 3, 3] and answers.shares(2, 2) == [1, 1]


def test_row_groups(spark, tmp_path):
    """Groups of uneven sizes, other columns untouched, none but the wanted bytes read."""
    for k, sizes in enumerate(([3, 5, 2], [4], [6, 1], [2, 2, 2, 2])):
        with pq.ParquetWriter(tmp_path / f"f{k}.parquet", pa.schema([("id", pa.int64()), ("text", pa.string()), ("tags", pa.list_(pa.string()))])) as w:
            at = 0
            for n in sizes:
                ids = list(range(100 * k + at, 100 * k + at + n))
                w.write_table(pa.table({"id": pa.array(ids, pa.int64()), "text": ["x" * 5000 + str(i) for i in ids], "tags": pa.array([[str(i)] if i % 2 else None for i in ids], pa.list_(pa.string()))}), row_group_size=n)
                at += n
    paths = rowgroups.files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in paths] == [f"f{k}.parquet" for k in range(4)] and rowgroups.files(spark, str(tmp_path / "f1*")) == paths[1:2]
    feet = {(r["number"], r["row_group"]): (r["rows"], r["bytes"]) for r in rowgroups.footers(spark, paths, ["id"]).collect()}
    assert {k: v[0] for k, v in feet.items()} == {(0, 0): 3, (0, 1): 5, (0, 2): 2, (1, 0): 4, (2, 0): 6, (2, 1): 1, (3, 0): 2, (3, 1): 2, (3, 2): 2, (3, 3): 2}
    whole = sum(r["bytes"] for r in rowgroups.footers(spark, paths).collect())
    rows = rowgroups.shard_groups(spark, paths, 4, ["tags", "id"])
    got = sorted((r["shard"], r["row_group"], r["row"], r["id"], r["tags"]) for r in rows.collect())
    want = [(f"f{k}.parquet", g, r, 100 * k + s + r, [str(100 * k + s + r)] if (s + r) % 2 else None) for k, g, s, n in ((0, 0, 0, 3), (1, 0, 0, 4), (2, 0, 0, 6), (3, 3, 6, 2)) for r in range(n)]
    assert got == want and rows.rdd.getNumPartitions() == 4
    assert sum(feet[k][1] for k in ((0, 0), (1, 0), (2, 0), (3, 3))) < whole / 10  # bytes of the column in these groups
    for n in (0, 1, 3, 4, 9, 10, 12, 1000):
        ids = [100 * k + i for k, m in enumerate((10, 4, 7, 8)) for i in range(m)][:n]
        assert sorted(r["id"] for r in rowgroups.head(spark, paths, n, ["id"]).collect()) == ids
    assert rowgroups.head(spark, paths, 12, ["id"]).rdd.getNumPartitions() == 4  # three groups of the first file, one of the second
    assert rowgroups.groups(spark, [(paths[0], 1)]).where(F.col("id") == 4).select("text").first()[0].endswith("x4")
