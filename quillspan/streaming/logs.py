"""Scorecards over a log that still grows."""

from __future__ import annotations

import signal
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspan import schemas
from quillspan.operators.scorecard import scored


#: The state store that value state with a time to live needs.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log(spark: SparkSession, path: str, schema: str = schemas.RECORD, files: int = 100, arrival: str | None = None) -> DataFrame:
    """A folder of JSON-lines files as a stream, without lines that lack id or lang. ``arrival`` names a column for when and in which file a line arrived (of files of the same moment the name decides)."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path).where("id IS NOT NULL AND lang IS NOT NULL")
    return df.withColumn(arrival, F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))) if arrival else df


def first_answers(records: DataFrame, keys: list[str], arrived: str | None = None, horizon: str | None = None) -> DataFrame:
    """A record of each key, any of the first batch that has it; ``first_arrivals`` decides which. Without ``arrived`` (a time column) and ``horizon`` all keys stay in the state, which suits finite runs; with them keys are forgotten after the horizon."""
    if arrived and horizon:
        return records.withWatermark(arrived, horizon).dropDuplicatesWithinWatermark(keys)
    return records.dropDuplicates(keys)


def first_arrivals(records: DataFrame, keys: list[str], order: list[str], keep: timedelta | None = None) -> DataFrame:
    """The first record of each key: of a batch the least in ``order`` (null last; of those alike the one whose text is smaller), and none of later batches.

    The state holds a flag a key, in a store on disk. With ``keep`` a key is
    forgotten that long after its record was handed on, so the state holds the
    keys of that time alone, and a record that comes back later still counts as
    new. Start the query with ``keep_totals`` or under ``stateful``.
    """
    keep_ms = None if keep is None else int(keep.total_seconds() * 1000)

    class First(StatefulProcessor):  # in here, so that it goes to the workers by value
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "seen boolean", keep_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            first = min(rows, key=lambda r: (tuple((r[c] is None, r[c]) for c in order), str(r)))
            if not self.seen.exists():
                self.seen.update((True,))
                yield first

        def close(self) -> None:
            pass

    return records.groupBy(*keys).transformWithState(First(), records.schema, "Append", "None" if keep is None else "ProcessingTime")


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries that start in this block have the state store that ``first_arrivals`` needs; others are as they were."""
    name, value = _STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def live_scorecard(records: DataFrame, bench: str) -> DataFrame:
    """n, correct and spent tokens by language, for ``complete`` or ``update`` mode."""
    rows = scored(records, bench)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.sum(F.coalesce("usage.completion_tokens", F.lit(0))).alias("completion_tokens"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Take in what is there now and stop; a later run with the same checkpoint goes on from here."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose totals are whole, ascending."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(hadoop.Path(f"{path}/*/_SUCCESS")) or [])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The table of totals at ``path``, as of the last whole batch."""
    have = _versions(spark, path)
    if not have:
        raise FileNotFoundError(f"no totals at {path} yet")
    return spark.read.parquet(f"{path}/{have[-1]:012d}")


def keep_totals(records: DataFrame, by: list[str], sums: dict[str, Column], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a table of sums by key up to date over a stream of new records: each batch adds its own to those before (new keys are added, known ones grow).

    ``sums``: names and what each record adds. Every batch writes the table anew
    under its number, the last two stay; a batch that is done again after a
    failure starts from the one before it and gives the same, so each record
    counts once. ``totals`` reads the table at any time. Without ``trigger`` the
    query takes in what is there now and ends; others go to ``trigger`` of the
    stream's writer, and those that end are waited for. A stream of
    ``first_arrivals`` with ``keep`` never runs dry, since empty batches let keys
    go: give it {"once": True}, or stop it.
    """
    trigger = trigger or {"availableNow": True}
    spark = records.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs

    def upsert(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.select(*by, *(c.alias(n) for n, c in sums.items()))
        before = [v for v in _versions(session, path) if v < number]
        every = new if not before else new.unionByName(session.read.parquet(f"{path}/{before[-1]:012d}"))
        whole = every.groupBy(*by).agg(*(F.sum(n).alias(n) for n in sums))
        whole.write.mode("overwrite").parquet(f"{path}/{number:012d}")
        fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for v in before[:-1]:
            fs.delete(hadoop.Path(f"{path}/{v:012d}"), True)

    with stateful(spark):
        writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(upsert)
        q = writer.trigger(**trigger).start()
        if trigger.keys() & {"availableNow", "once"}:
            q.awaitTermination()
    return q


def deadline(clock: str, now: datetime) -> datetime:
    """The next moment that the clock shows ``HH:MM``."""
    h, m = map(int, clock.split(":"))
    at = now.replace(hour=h, minute=m, second=0, microsecond=0)
    return at if at > now else at + timedelta(days=1)


def finish(query: StreamingQuery, patience: float = 60.0) -> None:
    """Stop a query after the batch in flight: what has come in since is left for the next run. Where a batch takes longer than ``patience`` seconds it is broken off, and done anew by the next run."""
    before = (query.lastProgress or {}).get("batchId")
    end = time.monotonic() + patience
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        if (query.lastProgress or {}).get("batchId") != before:
            break
        time.sleep(0.02)
    query.stop()


def stop_at(query: StreamingQuery, when: datetime, now=datetime.now) -> bool:
    """Wait for a query until a moment, then stop it after the batch in flight; whether it ended by itself."""
    left = max(0.0, (when - now()).total_seconds())
    ended = query.awaitTermination(left)
    if not ended:
        finish(query)
    return bool(ended)


@contextmanager
def stopped_by_signal(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)):
    """While the block runs, the first of these signals ends the query after its batch in flight, instead of ending the program."""
    old = {s: signal.getsignal(s) for s in signals}
    for s in signals:
        signal.signal(s, lambda *_: finish(query))
    try:
        yield query
    finally:
        for s, handler in old.items():
            signal.signal(s, handler)
