"""Logs that grow: first arrivals, state that ends, totals that batches add to."""

import shutil
import time
from datetime import timedelta
from pathlib import Path

from pyspark.sql import functions as F

from quillspan.streaming import logs

SCHEMA = "id long, lang string, wall double, content string"


def sums():
    return {"n": F.lit(1).cast("long"), "wall": F.col("wall")}


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(path))


def test_first_arrival_counts(spark, tmp_path):
    """Late and repeated keys, in a batch and between batches; a batch done again changes nothing."""
    log, state, board = (str(tmp_path / x) for x in ("log", "state", "board"))

    def run():
        first = logs.first_arrivals(logs.log(spark, log, SCHEMA), ["id", "lang"], ["wall"])
        q = logs.keep_totals(first, ["lang"], sums(), board, state)
        assert q.exception() is None
        return {r["lang"]: (r["n"], r["wall"]) for r in logs.totals(spark, board).collect()}

    add(spark, log, [(1, "en", 5.0, "b"), (1, "en", 2.0, "a"), (2, "en", 3.0, "c"), (1, "es", None, "d"), (1, "es", 9.0, "e")])
    add(spark, log, [(2, "en", 1.0, "another file of the same batch")])
    assert run() == {"en": (2, 3.0), "es": (1, 9.0)}
    add(spark, log, [(1, "en", 0.5, "too late"), (3, "en", 4.0, "f"), (1, "zh", 7.0, "g")])
    assert run() == {"en": (3, 7.0), "es": (1, 9.0), "zh": (1, 7.0)}
    done = max((int(p.name) for p in Path(state, "commits").iterdir() if p.name.isdigit()))
    uncommit = lambda: [Path(state, "commits", n).unlink(missing_ok=True) for n in (str(done), f".{done}.crc")]
    uncommit()  # as if the driver had died between the table and the commit
    assert run() == {"en": (3, 7.0), "es": (1, 9.0), "zh": (1, 7.0)}
    shutil.rmtree(Path(board, f"{done:012d}"))
    uncommit()
    assert run() == {"en": (3, 7.0), "es": (1, 9.0), "zh": (1, 7.0)}


def test_state_shrinks(spark, tmp_path):
    """Keys are forgotten after their time, and then count as new."""
    log, state, board = (str(tmp_path / x) for x in ("log", "state", "board"))

    def run():
        first = logs.first_arrivals(logs.log(spark, log, SCHEMA), ["id", "lang"], ["wall"], keep=timedelta(seconds=10))
        logs.keep_totals(first, ["lang"], sums(), board, state, {"once": True})
        return spark.read.format("statestore").option("stateVarName", "seen").load(state).count(), logs.totals(spark, board).first()["n"]

    add(spark, log, [(i, "en", 1.0, "x") for i in range(300)])
    assert run() == (300, 300)
    time.sleep(11)
    add(spark, log, [(i, "en", 1.0, "x") for i in range(1000, 1010)])
    assert run() == (10, 310)
    add(spark, log, [(5, "en", 1.0, "forgotten"), (1005, "en", 1.0, "still known")])
    held, n = run()
    assert n == 311 and held <= 11


def test_other_queries_keep_their_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with logs.stateful(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before


def test_arrival_names_file_and_time(spark, tmp_path):
    add(spark, tmp_path / "log", [(1, "en", 1.0, "x")])
    with logs.stateful(spark):
        first = logs.first_arrivals(logs.log(spark, str(tmp_path / "log"), SCHEMA, arrival="came"), ["id"], ["came"])
        q = first.select("id", "came.file").writeStream.format("memory").queryName("came").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r["id"], r["file"].endswith(".json")) for r in spark.table("came").collect()] == [(1, True)]
