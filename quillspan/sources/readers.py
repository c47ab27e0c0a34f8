"""Sources: answer logs, items, id lists, tables and reports."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan import schemas
from quillspan.operators.corpus import positions
from quillspan.sources.answers import answered  # noqa: F401
from quillspan.sources.rowgroups import evenly
from quillspan.storage import stored


def records(spark: SparkSession, path: str | list[str], schema: str = schemas.RECORD) -> DataFrame:
    """JSON-lines records; blank lines are passed over, a malformed line stops the query. ``bench`` and ``tag`` come from the file name ``<bench>_raw.<tag>.jsonl`` where the record has none."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _named(df)


def records_tolerant(spark: SparkSession, path: str | list[str], schema: str = schemas.RECORD) -> DataFrame:
    """JSON-lines records without malformed lines and without those that lack id or lang: what a resumed run counts as done."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return _named(df.where("_bad IS NULL AND id IS NOT NULL AND lang IS NOT NULL").drop("_bad"))


def records_unbroken(spark: SparkSession, path: str | list[str], schema: str = schemas.RECORD) -> DataFrame:
    """JSON-lines records where every line must be one: a blank line stops the query like a malformed one."""
    lines = spark.read.text(path)
    one = F.from_json("value", schema, {"mode": "FAILFAST"})
    whole = F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line in the log")).cast("string")).otherwise(F.col("value"))
    return _named(lines.withColumn("value", whole).select(one.alias("r"), F.col("_metadata.file_path").alias("_file")).select("r.*", "_file"))


def _named(df: DataFrame) -> DataFrame:
    path = F.col("_file") if "_file" in df.columns else F.col("_metadata.file_path")
    name = F.element_at(F.split(path, "/"), -1)
    bench, tag = F.regexp_extract(name, r"^(\w+?)_raw", 1), F.regexp_extract(name, r"_raw\.(.+)\.jsonl", 1)
    cols = {"bench": F.nullif(bench, F.lit(""))}
    if "tag" in df.columns:
        cols["tag"] = F.coalesce("tag", F.nullif(tag, F.lit("")))
    return df.withColumns(cols).drop("_file")


def items(spark: SparkSession, path: str, schema: str = schemas.ITEM_NUMBER) -> DataFrame:
    """Items of all languages from files ``<name>.<lang>.jsonl`` or ``<lang>.jsonl``; rows without a question are passed over."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    df = spark.read.schema(schema).json(path)
    return df.withColumn("lang", F.regexp_extract(name, r"([a-z]{2})\.jsonl?$", 1)).where("question IS NOT NULL")


def numbered(df: DataFrame, order: Column | str, name: str = "id") -> DataFrame:
    """Rows with their position from 1 in an explicit order."""
    return positions(df, [], [order], name)


def hub(spark: SparkSession, path: str, order: str, columns: dict[str, str] | None = None, name: str = "id") -> DataFrame:
    """A local copy of a hub dataset (Parquet, or JSON lines where the path ends in .jsonl or .json), columns renamed by ``columns`` (old: new, others dropped), ids by position from 1 in ``order`` (a column of the result)."""
    df = spark.read.json(path) if path.rstrip("/").endswith((".jsonl", ".json")) else spark.read.parquet(path)
    if columns:
        df = df.select(*(F.col(old).alias(new) for old, new in columns.items()))
    return numbered(df, order, name)


def first_rows(spark: SparkSession, path: str, columns: list[str], order: str, n: int) -> DataFrame:
    """``columns`` of the first ``n`` rows of Parquet files in the order of a column; only these columns are read."""
    return spark.read.parquet(path).select(*columns).orderBy(order).limit(n)


def shard_sample(spark: SparkSession, paths: list[str], shards: int, group_rows: int | None = None) -> DataFrame:
    """Rows of ``shards`` files at even distances in the sorted list: their columns, ``shard`` (file name), ``row_group`` and ``row`` (within it).

    With ``group_rows`` each file gives one run of that many rows, the k-th file
    its k-th run, counted on from the start where the file has fewer; all rows
    are scanned for it. ``rowgroups.shard_groups`` reads the files' own groups
    and nothing else.
    """
    picked = evenly(paths, shards)
    df = spark.read.parquet(*picked)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = df.withColumns({"shard": name, "_at": F.col("_metadata.row_index")})
    if group_rows is None:
        return rows.withColumns({"row_group": F.lit(0).cast("long"), "row": F.col("_at")}).drop("_at")
    number = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1], k) for k, p in enumerate(picked)], "shard string, _k long")
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / group_rows).alias("_groups")).join(number, "shard")
    want = sizes.select("shard", (F.col("_k") % F.col("_groups")).alias("row_group"))
    group = F.floor(F.col("_at") / group_rows)
    return rows.join(F.broadcast(want), "shard").where(group == F.col("row_group")).withColumn("row", F.col("_at") % group_rows).drop("_at")  # a row a shard


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at ``path``; built first if it isn't there. It is written beside its place and moved there when whole, so a broken run leaves nothing that is taken for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(path, "_SUCCESS")):
        part = f"{path}.part-{uuid.uuid4().hex}"
        build().write.parquet(part)
        fs.delete(target, True)
        if not fs.rename(hadoop.Path(part), target):
            raise OSError(f"can't move the new table to {path}")
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document of one object or an array of objects, a row each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON document with ``ids`` or of a text separated by white space."""
    if path.endswith(".json"):
        return document(spark, path, "ids array<long>").select(F.explode("ids").alias("id"))
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("id"))
    return words.where("id <> ''").select(F.col("id").cast("long").alias("id"))


def scrape(spark: SparkSession, path: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a text report: for each name the first group of a pattern, cast to a type; null where it isn't found."""
    df = spark.read.text(path, wholetext=True)
    pick = lambda p, t: F.when(F.col("value").rlike(p), F.regexp_extract("value", p, 1)).try_cast(t)
    return df.select(*(pick(p, t).alias(n) for n, (p, t) in patterns.items()))


def headed_blocks(spark: SparkSession, path: str, header: str, names: list[str], line: str, schema: str) -> DataFrame:
    """Reports in which a header line (groups ``names``) stands above lines ``line`` (one group, JSON of ``schema``): a row for each header that has such a line under it, with the last of them.

    Files are read in splits, line by line. Lines that matter are few; each knows
    its file and its byte (the split's start, and where it stands in the split),
    and takes the last header before it. That is carried from split to split by
    two small steps: the last header of each split, and of those the last one
    before.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    is_header, is_line = F.col("value").rlike(f"^{header}"), F.col("value").rlike(f"^{line}")
    marks = stored(lines.where(is_header | is_line).select("file", "split", "at", F.when(is_header, F.col("value")).alias("header"), F.when(~is_header, F.col("value")).alias("line")), "marks")
    # within a split the last header above; before its first one, that of the splits before
    above = F.last("header", True).over(Window.partitionBy("file", "split").orderBy("at"))
    own = F.max(F.when(F.col("header").isNotNull(), F.col("at"))).over(Window.partitionBy("file", "split").orderBy("at"))
    ends = marks.where("header IS NOT NULL").groupBy("file", "split").agg(F.max_by("header", "at").alias("header"), F.max("at").alias("began"))
    splits = marks.select("file", "split").distinct().join(ends, ["file", "split"], "left")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    carried = splits.select("file", "split", F.last("header", True).over(before).alias("carried"), F.last("began", True).over(before).alias("carried_at"))
    rows = marks.withColumns({"above": above, "own": own}).where("line IS NOT NULL").join(carried, ["file", "split"])
    rows = rows.select("file", F.coalesce("above", "carried").alias("header"), F.coalesce("own", "carried_at").alias("began"), "split", "at", "line").where("header IS NOT NULL")
    last = rows.groupBy("file", "began", "header").agg(F.max_by("line", F.struct("split", "at")).alias("line"))
    parts = [F.regexp_extract("header", f"^{header}", i + 1).alias(n) for i, n in enumerate(names)]
    return last.select(*parts, F.from_json(F.regexp_extract("line", f"^{line}", 1), schema).alias("value"))


def number_rows(spark: SparkSession, path: str, width: int, kind: str = "float") -> DataFrame:
    """Little-endian 32-bit numbers (``float`` or ``int``) in rows of ``width``: file, position, values. A file that isn't whole rows stops the query."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    form = {"float": "<f4", "int": "<i4"}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                rows = np.frombuffer(raw.as_buffer(), form).reshape(-1, width)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(np.arange(len(rows))), values], ["file", "position", "values"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, f"file string, position long, values array<{kind}>")


def float_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    return number_rows(spark, path, width)


#: Bytes of one element by the type's name in a tensor file.
ELEMENT_BYTES = {"F64": 8, "I64": 8, "U64": 8, "F32": 4, "I32": 4, "U32": 4, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "F8_E4M3": 1, "F8_E5M2": 1, "I8": 1, "U8": 1, "BOOL": 1}


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """Tensors of the safetensors files that match ``path``: file, name, dtype, shape, elements, bytes. Only headers are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(hadoop.Path(path)) or []:
        stream = fs.open(status.getPath())
        try:
            size = int.from_bytes(bytes(stream.readNBytes(8)), "little")
            header = json.loads(bytes(stream.readNBytes(size)))
        finally:
            stream.close()
        for name, t in header.items():
            if name != "__metadata__":
                n = 1
                for d in t["shape"]:
                    n *= d
                rows.append((status.getPath().getName(), name, t["dtype"], t["shape"], n, t["data_offsets"][1] - t["data_offsets"][0]))
    return spark.createDataFrame(rows, "file string, name string, dtype string, shape array<long>, elements long, bytes long")


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def fixes(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of items as JSON lines; original and fixed are variants, texts or arrays alike. A malformed line stops the query."""
    return spark.read.schema(schemas.FIX).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return document(spark, path, schemas.MANIFEST)


def load_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"))
