"""The driver's tables seen as evaluation data, once as DataFrames and once as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.corpus import positions
from quillspan.storage import scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer a document, with its text: tokens follow the length, correct is the quality label. Nothing but labels is joined."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("n_chars").cast("long")
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        F.col("source").alias("category"),
        F.col("text").alias("content"),
        (F.pmod("doc_id", F.lit(50)) + 20).cast("long").alias("prompt_tokens"),
        (F.floor(n / 4) + F.pmod("doc_id", F.lit(7))).cast("long").alias("completion_tokens"),
        F.when(n > 6000, "length").otherwise("stop").alias("finish_reason"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"),
        n.alias("n_chars"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answers`` with ids that count within each language, so that languages pair up. What is read from the text (``blank``) is read before rows are numbered; the text itself stays behind."""
    rows = answers(spark, sf_dir).withColumn("blank", T.is_blank("content")).drop("content")
    return positions(rows, ["lang"], ["doc_id"], "id")


RECORDS = """records AS (
  SELECT d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS id, d.lang, d.source AS category, d.text AS content,
    (d.doc_id % 50 + 20)::BIGINT AS prompt_tokens, (d.n_chars // 4 + d.doc_id % 7)::BIGINT AS completion_tokens,
    CASE WHEN d.n_chars > 6000 THEN 'length' ELSE 'stop' END AS finish_reason, coalesce(l.quality = 1, false) AS correct, d.n_chars::BIGINT AS n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of messages in the order of their turns: row_index, messages."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy(F.col("conv_id").alias("row_index")).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


MESSAGES = """messages AS (SELECT conv_id AS row_index, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of embeddings 2k and 2k + 1 as two models' logits: position, p, q."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    even = e.where(F.col("vec_id") % 2 == 0).select(F.floor(F.col("vec_id") / 2).alias("position"), F.col("e").alias("p"))
    odd = e.where(F.col("vec_id") % 2 == 1).select(F.floor(F.col("vec_id") / 2).alias("position"), F.col("e").alias("q"))
    return even.join(odd, "position")


VECTORS = """vectors AS (SELECT a.vec_id // 2 AS position, a.embedding::DOUBLE[] AS p, b.embedding::DOUBLE[] AS q
  FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"""


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated measurements: item, condition, value, repeat (by time within item and condition)."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("item"), F.col("event_type").alias("condition"), "value", F.row_number().over(order).cast("long").alias("repeat"), "event_id")


REPEATS = """repeats AS (SELECT user_id AS item, event_type AS condition, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS repeat, event_id FROM events)"""
