"""Session helpers shared by the operators: code shipping, shared storage, key filters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.storage import shared_folder as _shared

#: Bits of a key filter. Fixed: the broadcast stays 1 MiB whatever the input; a full filter lets rows through and the join behind it decides.
FILTER_BITS = 1 << 23
#: Keys (8 bytes each) that are broadcast at most.
BROADCAST_KEYS = 200_000

#: Bounds of what one Python worker is handed at once, whatever the length of texts.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def _give_memory_back() -> None:
    """Have the C library return large arrays to the system at once, so that a worker's size follows what it holds now."""
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 512 << 10)
        libc.mallopt(-1, 1 << 20)
    except (OSError, AttributeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_give_memory_back()


def keep_memory() -> None:
    """Have the C library keep a few megabytes of what small slices of texts use again and again; for operators whose time goes into many passing arrays."""
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 3 << 19)
        libc.mallopt(-1, 8 << 20)
    except (OSError, AttributeError):
        pass


def mapped(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: ``run`` on the Arrow batches of each task. When a task ends, its worker, which waits for other work, gives free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return lambda df: df.mapInArrow(whole, schema)


def whole_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows of ``docs`` that ``run`` keeps: it is handed (row, text), row a struct of all columns whatever they are called, and gives back rows."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    kept = named.transform(mapped(run, named.select("row").schema))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def trim() -> None:
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they run."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    sc = spark.sparkContext
    if getattr(sc, "_quillspan_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "quillspan_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(target)
    sc._quillspan_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one of our own where it is unset and the session is local (tests); elsewhere that is an error."""
    folder = _shared(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, wide: bool = False, heavy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Narrow tables (ids and counts) go to two files a core, or a sixteenth of the
    shuffle partitions where that is more (cores may still join), so that many
    partitions don't make many small files. ``wide`` ones, whose tasks do the
    work of a scan, keep their partitions; what ``heavy`` tasks find is dealt
    anew, so that the tasks stay as many as they are.
    """
    spark = df.sparkSession
    path, files = new_path(spark, name), max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    (df if wide else df.repartition(files) if heavy else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_quillspan_path", None):
            _file_system(t.sparkSession, path).delete(t.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    m = np.uint64(FILTER_BITS - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter (two probes, ``FILTER_BITS`` bits) over the single long column of ``keys``.

    Executors reduce keys to 64-bit words of the bit map and merge them with
    ``bit_or``; the driver gets at most ``FILTER_BITS / 64`` words.
    """
    name = keys.columns[0]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for s in _slots(k):
                bits[s] = True
        packed = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["i", "w"])

    parts = keys.select(F.col(name).cast("long")).transform(mapped(words, "i long, w long"))
    merged = parts.groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[merged["i"].to_numpy()] = merged["w"].to_numpy()
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are certainly not in the filter."""
    a, b = _slots(keys)
    return ((bits[a >> 6] >> (a & 63)) & 1).astype(bool) & ((bits[b >> 6] >> (b & 63)) & 1).astype(bool)


def maybe_in(spark: SparkSession, bits: np.ndarray):
    """Column function: False only for keys that are certainly not in the filter."""
    shared = spark.sparkContext.broadcast(bits)

    def test(batches):
        import pandas as pd

        table = shared.value
        for s in batches:
            yield pd.Series(passes(table, s.fillna(0).to_numpy().astype(np.int64)) & s.notna().to_numpy())

    from pyspark.sql.pandas.functions import pandas_udf

    import pandas as pd

    def wrapped(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from test(it)

    wrapped.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(wrapped, "boolean")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores until no table has such a column."""
    while any(name in t.columns for t in tables):
        name += "_"
    return name


def few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def narrowed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``keys``, or may be: what a following join would drop is mostly gone before its shuffle. Few keys are broadcast, many go through a filter of fixed size."""
    name = unused("_key", df)
    own = keys.select(F.col(keys.columns[0]).cast("long").alias(name)).where(F.col(name).isNotNull()).distinct()
    if few(own, BROADCAST_KEYS):
        return df.join(F.broadcast(own), F.col(key) == F.col(name), "left_semi")
    return df.filter(maybe_in(df.sparkSession, key_filter(own))(F.col(key)))


def without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't in the one column of ``keys``; beyond few keys only rows that may be are shuffled."""
    name = unused("_key", df)
    own = keys.select(F.col(keys.columns[0]).cast("long").alias(name)).distinct()
    same = F.col(key) == F.col(name)
    if few(own, BROADCAST_KEYS):
        return df.join(F.broadcast(own), same, "left_anti")
    maybe = maybe_in(df.sparkSession, key_filter(own))(F.col(key))
    return df.where(~maybe | F.col(key).isNull()).unionByName(df.where(maybe).join(own, same, "left_anti"))
