"""Answers of a responder to items: several requests in flight, each answer durable soon after it came.

A responder is made on the executor, one for each request that may be open:
``respond()`` gives a function from a dict (an item) to a dict (an answer), or
None for a failure, which stays pending.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quillspan.session import ship

Respond = Callable[[], Callable[[dict], dict | None]]


def asked(items: Iterator[dict], respond: Respond, in_flight: int, until: datetime | None = None, now: Callable[[], datetime] = datetime.now, tick: float | None = None) -> Iterator[dict | None]:
    """Answers as they come, with up to ``in_flight`` requests open. Items are begun in order; from ``until`` on none is begun, and those in flight end. With ``tick`` a None stands for so many seconds in which nothing came."""
    own = threading.local()

    def ask(item: dict) -> dict | None:
        if not hasattr(own, "ask"):
            own.ask = respond()
        return own.ask(item)

    late = lambda: until is not None and now() >= until
    flying: set[Future] = set()

    def landed() -> Iterator[dict | None]:
        nonlocal flying
        done: set[Future] = set()
        while not done:
            done, flying = wait(flying, tick, FIRST_COMPLETED)
            if not done:
                yield None
        yield from (a for f in done if (a := f.result()) is not None)

    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        for item in items:
            if len(flying) >= in_flight:
                yield from landed()
            if late():
                break
            flying.add(pool.submit(ask, item))
        while flying:
            yield from landed()


def shares(workers: int, tasks: int) -> list[int]:
    """Requests that each task may have open: ``workers`` in all."""
    return [workers // tasks + (i < workers % tasks) for i in range(tasks)]


def _dealt(items: DataFrame, workers: int, tasks: int | None, keys: list[str] | None) -> tuple[DataFrame, list[int]]:
    tasks = max(1, min(workers, tasks or items.sparkSession.sparkContext.defaultParallelism))
    return (items.repartition(tasks, *keys) if keys else items.repartition(tasks)), shares(workers, tasks)


def answered(items: DataFrame, respond: Respond, schema: str, workers: int = 4, until: datetime | None = None, now: Callable[[], datetime] = datetime.now, tasks: int | None = None) -> DataFrame:
    """Answers to items as a DataFrame, in the order in which they come.

    ``workers`` is the number of requests in flight over the whole cluster: items
    are dealt to ``tasks`` tasks (as many as there are cores, unless that is more
    than ``workers``), each of which keeps its share of requests open. From the
    moment ``until`` on no new item is begun; those in flight end. The answers of
    a task are there once it ends; ``recorded`` keeps them as they come.
    """
    ship(items.sparkSession)
    form = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)
    dealt, most = _dealt(items, workers, tasks, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (item for b in batches for item in b.to_pylist())
        for a in asked(every, respond, most[TaskContext.get().partitionId() % len(most)], until, now):
            yield pa.RecordBatch.from_pylist([a], schema=form)

    return dealt.mapInArrow(run, schema)


# A log of segments: files of a few answers each, written whole and then renamed, so a reader sees all of one or nothing.
#: A segment is closed after so many answers, or when its first one is so old.
SEGMENT_ROWS, SEGMENT_SECONDS = 64, 2.0


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (file, hdfs, s3, gs, or local) and the path within it, for tasks."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Segments:
    """The segments that one part of a run has written to a folder."""

    def __init__(self, folder: str, run: str, part: int):
        self.fs, self.folder = opened(folder)
        self.name = f"{run}-{part:06d}"

    def keys(self, keys: list[str]) -> set[tuple]:
        """Keys of the answers that an earlier attempt of this part has committed."""
        out = set()
        for info in self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.base_name.startswith(self.name) and info.base_name.endswith(".jsonl"):
                with self.fs.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        row = json.loads(line)
                        out.add(tuple(row.get(k) for k in keys))
        return out

    def commit(self, rows: list[dict]) -> None:
        name = f"{self.name}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        with self.fs.open_output_stream(f"{self.folder}/_{name}.part") as f:
            f.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in rows).encode())
        self.fs.move(f"{self.folder}/_{name}.part", f"{self.folder}/{name}.jsonl")


@dataclass
class _Written(WriterCommitMessage):
    answers: int
    skipped: int


class _AnswerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, ask: dict):
        self.folder, self.run = options["path"], options["run"]
        self.keys = json.loads(options["keys"])
        self.ask = ask

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part = TaskContext.get().partitionId()
        log, most = _Segments(self.folder, self.run, part), self.ask["shares"]
        have = log.keys(self.keys)
        skipped = 0

        def items() -> Iterator[dict]:
            nonlocal skipped
            for b in iterator:
                for item in b.to_pylist():
                    if tuple(item.get(k) for k in self.keys) in have:
                        skipped += 1
                    else:
                        yield item

        held, first, n = [], 0.0, 0
        try:
            for answer in asked(items(), self.ask["respond"], most[part % len(most)], self.ask["until"], self.ask["now"], self.ask["seconds"] / 2):
                if answer is not None:
                    first = first if held else time.monotonic()
                    held.append(answer)
                    n += 1
                if held and (len(held) >= self.ask["rows"] or time.monotonic() - first >= self.ask["seconds"]):
                    log.commit(held)
                    held = []
        finally:  # also when the task breaks: what was answered is kept
            if held:
                log.commit(held)
        return _Written(n, skipped)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass  # committed segments stay: the next run goes on from them


def recorded(items: DataFrame, respond: Respond, path: str, keys: list[str], workers: int = 4, until: datetime | None = None, now: Callable[[], datetime] = datetime.now, tasks: int | None = None, segment_rows: int = SEGMENT_ROWS, segment_seconds: float = SEGMENT_SECONDS) -> None:
    """Ask the items whose ``keys`` have no answer in the log at ``path`` and add the answers to it.

    As ``answered``, but every task commits segments of at most ``segment_rows``
    answers as they come, and no answer waits much longer than
    ``segment_seconds`` for others. A task that is run again, here or on another
    machine, passes over what its earlier attempt committed (it reads
    that part's segments alone), so no committed item is asked twice; what was
    in flight when a worker died is. Answers must hold the keys. Items are dealt
    by key, so an attempt gets the items of the one before. ``path`` is a folder
    that all machines share and pyarrow can open (file, hdfs, s3, gs).
    """
    spark = items.sparkSession
    ship(spark)
    todo = items
    if _exists(spark, path):
        done = spark.read.schema(items.select(*keys).schema).json(path, pathGlobFilter="*.jsonl").distinct()
        todo = items.join(done, keys, "left_anti")
    dealt, most = _dealt(todo, workers, tasks, keys)
    hadoop = spark._jvm.org.apache.hadoop.fs
    hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop.Path(path))
    ask = {"respond": respond, "shares": most, "until": until, "now": now, "rows": segment_rows, "seconds": segment_seconds}

    class Answers(DataSource):
        @classmethod
        def name(cls) -> str:
            return "quillspan_answers"

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return _AnswerWriter(self.options, ask)

    spark.dataSource.register(Answers)
    dealt.write.format("quillspan_answers").mode("append").option("path", path).option("run", uuid.uuid4().hex[:12]).option("keys", json.dumps(keys)).save()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(path))


def log(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The answers in a log of segments, the first of each key (two attempts that ran at the same time may both have asked it)."""
    rows = spark.read.schema(schema).json(path, pathGlobFilter="*.jsonl").withColumn("_segment", F.col("_metadata.file_modification_time")).withColumn("_name", F.col("_metadata.file_name"))
    first = Window.partitionBy(*keys).orderBy("_segment", "_name")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_segment", "_name", "_r")
