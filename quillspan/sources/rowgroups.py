"""Parquet by row groups: chosen groups of chosen files, a task each, and nothing read besides.

Spark's own reader has no way to name a row group. Here the footers say which
groups there are, a partition is planned for each wanted one, and its task reads
the byte ranges of the wanted columns of that group alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspan.session import ship
from quillspan.sources.answers import opened

#: Row groups that one scan plans at most: each is a partition and a line of its plan.
MOST_GROUPS = 200_000


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the Parquet files under ``path`` (a file, a folder at any depth, or a glob), sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [s.getPath() for s in fs.globStatus(hadoop.Path(path)) or []]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            elif s.getPath().getName().endswith(".parquet"):
                out.append(s.getPath().toString())
    return sorted(out)


def footers(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Row groups of files, from their footers, which tasks read: number (of the path), path, row_group, rows, bytes (compressed, of ``columns`` or of all)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, path in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = opened(path)
                with fs.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    own = [group.column(i) for i in range(group.num_columns)]
                    size = sum(c.total_compressed_size for c in own if columns is None or c.path_in_schema.split(".")[0] in columns)
                    out.append({"number": number, "path": path, "row_group": g, "rows": group.num_rows, "bytes": size})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("number", pa.int64()), ("path", pa.string()), ("row_group", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())]))

    few = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame(list(enumerate(paths)), "number long, path string").repartition(few)
    return listed.mapInArrow(run, "number long, path string, row_group long, rows long, bytes long")


class _Group(InputPartition):
    def __init__(self, path: str, group: int, most: int | None = None):
        super().__init__((path, group, most))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.groups, self.schema = json.loads(options["groups"]), schema

    def partitions(self) -> list[InputPartition]:
        return [_Group(*group) for group in self.groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, group, most = partition.value
        form = to_arrow_schema(self.schema)
        columns = [n for n in self.schema.names if n not in ("shard", "row_group", "row")]
        fs, at = opened(path)
        name, row = path.rstrip("/").rsplit("/", 1)[-1], 0
        with fs.open_input_file(at) as f:
            for b in pq.ParquetFile(f).iter_batches(4000, [group], columns):
                if most is not None:
                    b = b.slice(0, most - row)
                n = len(b)
                if not n:
                    break
                own = {c: b.column(b.schema.get_field_index(c)).cast(form.field(c).type) for c in columns}
                own |= {"shard": pa.array([name] * n, form.field("shard").type), "row_group": pa.array([group] * n, pa.int64()), "row": pa.array(range(row, row + n), pa.int64())}
                row += n
                yield pa.RecordBatch.from_arrays([own[c] for c in form.names], schema=form)


class RowGroups(DataSource):
    """Options: ``groups``, a JSON list of [path, number of the group, how many of its rows (null: all)]. The schema is that of the wanted columns with shard, row_group and row."""

    @classmethod
    def name(cls) -> str:
        return "quillspan_row_groups"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def groups(spark: SparkSession, wanted: list[tuple], columns: list[str] | None = None) -> DataFrame:
    """Rows of the given row groups (path, number, and how many rows of it where not all): ``columns`` (all if None) and shard (file name), row_group and row (within it). A partition a group."""
    if len(wanted) > MOST_GROUPS:
        raise ValueError(f"{len(wanted)} row groups are more than the {MOST_GROUPS} of one scan")
    ship(spark)
    spark.dataSource.register(RowGroups)
    whole = spark.read.parquet(wanted[0][0]).schema
    own = [whole[c] for c in (columns or whole.names)]
    schema = StructType([*own, StructField("shard", StringType()), StructField("row_group", LongType()), StructField("row", LongType())])
    return spark.read.format("quillspan_row_groups").schema(schema).option("groups", json.dumps(wanted)).load()


def evenly(paths: list[str], n: int) -> list[str]:
    """``n`` of the sorted paths at even distances, or all where they are fewer."""
    paths, n = sorted(paths), min(n, len(paths))
    return [paths[i * len(paths) // n] for i in range(n)]


def shard_groups(spark: SparkSession, paths: list[str], shards: int, columns: list[str] | None = None) -> DataFrame:
    """One row group of each of ``shards`` files at even distances in the sorted list: of the k-th its k-th group, counted on from the start where it has fewer. Columns as of ``groups``; files without row groups give none."""
    picked = evenly(paths, shards)
    counts = {r["number"]: r["n"] for r in footers(spark, picked).groupBy("number").agg(F.count("*").alias("n")).collect()}  # a row a picked file
    return groups(spark, [(p, k % counts[k]) for k, p in enumerate(picked) if counts.get(k)], columns)


def head(spark: SparkSession, paths: list[str], n: int, columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of files in the order of their sorted paths, read as far as they are needed: footers say which row groups hold them, the last one is cut. Columns as of ``groups``."""
    paths = sorted(paths)
    every = Window.partitionBy(F.lit(1)).orderBy("number", "row_group")  # a row a row group
    upto = footers(spark, paths).withColumn("before", F.sum("rows").over(every) - F.col("rows")).where((F.col("before") < n) & (F.col("rows") > 0))
    need = upto.select("path", "row_group", F.least("rows", n - F.col("before")).alias("most"), "before").orderBy("before").limit(MOST_GROUPS + 1).collect()
    if not need:
        return groups(spark, [(paths[0], 0)], columns).limit(0)
    return groups(spark, [(r["path"], r["row_group"], r["most"]) for r in need], columns)
