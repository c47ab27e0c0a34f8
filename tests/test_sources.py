import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspan import schemas
from quillspan.operators.scorecard import flat_usage
from quillspan.sources import readers, sinks
from quillspan.streaming import logs

LINES = '{"id": 1, "lang": "en", "gold": 7, "content": "so 7", "usage": {"prompt_tokens": 3, "completion_tokens": 5}}\n\n{"id": 1, "lang": "es", "gold": "7", "content": "8"}\n'


def test_records(spark, tmp_path):
    p = tmp_path / "mgsm_raw.run1.jsonl"
    p.write_text(LINES)
    rows = readers.records(spark, str(p)).orderBy("lang").collect()
    assert [(r["bench"], r["tag"], r["gold"]) for r in rows] == [("mgsm", "run1", "7")] * 2
    assert [r["completion_tokens"] for r in flat_usage(readers.records(spark, str(p))).orderBy("lang").collect()] == [5, 0]
    p.write_text(LINES + '{"id": 2, "lang"\n{"lang": "en"}\n')
    with pytest.raises(Exception):
        readers.records(spark, str(p)).collect()
    assert readers.records_tolerant(spark, str(p)).count() == 2


def test_lists_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 2, "ids": [4, 9]}')
    (tmp_path / "b.txt").write_text("4 9\n 11 \n")
    assert [r[0] for r in readers.id_list(spark, str(tmp_path / "a.json")).collect()] == [4, 9]
    assert sorted(r[0] for r in readers.id_list(spark, str(tmp_path / "b.txt")).collect()) == [4, 9, 11]
    (tmp_path / "gate.txt").write_text("pairs 250\nratio es/en: 1.1235 (threshold 1.15)\n")
    r = readers.scrape(spark, str(tmp_path / "gate.txt"), {"pairs": (r"pairs (\d+)", "int"), "ratio": (r"ratio es/en: ([\d.]+)", "double"), "none": ("x(y)", "string")}).first()
    assert (r["pairs"], r["ratio"], r["none"]) == (250, 1.1235, None)
    (tmp_path / "fix.md").write_text('## mgsm 7\nES: {"q": "uno"}\n## mgsm 8\nnothing\n## mgsm 9\nES: {"q": "dos"}\n')
    got = readers.headed_blocks(spark, str(tmp_path / "fix.md"), r"## (\w+) (\d+)", ["tag", "id"], r"ES: (\{.*\})", "q string").orderBy("id").collect()
    assert [(x["id"], x["value"]["q"]) for x in got] == [("7", "uno"), ("9", "dos")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert sinks.markdown(df.orderBy("id"), {"id"}) == "| id | name |\n|---:|---|\n| 1 | a |\n| 2 | n/a |\n"
    assert sinks.document(df.orderBy("id")) == '[\n {"id":1,"name":"a"},\n {"id":2}\n]\n'
    assert sinks.spliced("x\n<!-- t:start -->\nold\n<!-- t:end -->\ny", "t", "new") == "x\n<!-- t:start -->\nnew\n<!-- t:end -->\ny"
    for bad in ("none", "<!-- t:start --><!-- t:start --><!-- t:end -->"):
        with pytest.raises(ValueError):
            sinks.spliced(bad, "t", "new")
    with pytest.raises(ValueError):
        sinks.replaced_once("aa", "a", "b")
    assert not sinks.done_if(df, 3, tmp_path / "DONE") and not (tmp_path / "DONE").exists()
    assert sinks.done_if(df, 2, tmp_path / "DONE") and (tmp_path / "DONE").read_text() == "2\n"
    sinks.csv(df, str(tmp_path / "c"), gzip=True)
    assert gzip.open(next((tmp_path / "c").glob("*.gz")), "rt").readline() == "id,name\n"
    assert readers.csv(spark, str(tmp_path / "c"), "id long, name string").count() == 2
    assert "   id" in sinks.fixed_width(df, {"id": 5})


def test_answers_and_floats(spark, tmp_path):
    items = spark.createDataFrame([(1, "q"), (2, "bad")], "id long, question string")
    got = readers.answered(items, lambda: lambda x: None if x["question"] == "bad" else {"id": x["id"], "content": "A"}, "id long, content string").collect()
    assert [(r["id"], r["content"]) for r in got] == [(1, "A")]
    import numpy as np

    np.arange(6, dtype="<f4").tofile(tmp_path / "m.bin")
    assert [r["values"] for r in readers.float_rows(spark, str(tmp_path / "m.bin"), 3).orderBy("position").collect()] == [[0, 1, 2], [3, 4, 5]]
    assert len(readers.hashes(spark, str(tmp_path / "m.bin")).first()["sha256"]) == 64
    assert readers.cached(spark, str(tmp_path / "cache"), lambda: items).count() == 2 and readers.cached(spark, str(tmp_path / "cache"), lambda: 1 / 0).count() == 2


def test_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.jsonl").write_text(LINES)
    live = logs.live_scorecard(logs.first_answers(logs.log(spark, str(folder)), ["id", "lang", "repeat"]), "mgsm")
    logs.run_available(live, "live", str(tmp_path / "ck"))
    assert {r["lang"]: (r["n"], r["n_correct"]) for r in spark.table("live").collect()} == {"en": (1, 1), "es": (1, 0)}
    (folder / "b.jsonl").write_text(LINES + '{"id": 2, "lang": "en", "gold": "1", "content": "1"}\n')
    logs.run_available(live, "live", str(tmp_path / "ck"))
    assert {r["lang"]: (r["n"], r["n_correct"]) for r in spark.table("live").collect()} == {"en": (2, 2), "es": (1, 0)}
    assert logs.deadline("07:30", datetime(2026, 1, 1, 8)) == datetime(2026, 1, 2, 7, 30)
    assert schemas.KEY[0] == "tag" and F is not None


def test_headers_are_carried_over_splits(spark, tmp_path):
    """Files of many splits beside a plain reading: lines before any header, headers without lines, several lines under one."""
    import json
    import random

    rng, want = random.Random(4), []
    for f in range(3):
        lines, head, said = [], None, None
        for i in range(400):
            kind = rng.random()
            if kind < 0.05:
                if said is not None:
                    want.append((*head, said))
                head, said = (f"t{f}", str(i)), None
                lines.append(f"[{head[0]} id={i}] more words")
            elif kind < 0.15:
                said = f"{i} ñ" if head else None
                lines.append("ES: " + json.dumps({"q": f"{i} ñ"}, ensure_ascii=False))
            else:
                lines.append(rng.choice(["", "words " * rng.randint(1, 30), " ES: {}", " [x id=3]"]))
        if said is not None:
            want.append((*head, said))
        (tmp_path / f"r{f}.md").write_text("\n".join(lines))
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.headed_blocks(spark, str(tmp_path / "*.md"), r"\[(\w+) id=(\d+)\]", ["tag", "id"], r"ES: (\{.*\})", "q string").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["tag"], r["id"], r["value"]["q"]) for r in got) == sorted(want) and len(want) > 20
