"""Bounded samples of labelled texts for fitting, and the split that keeps rows out of it."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row in ``FOLDS`` is held out of all fitting.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id's text, modulo ``FOLDS``, is 0. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> pa.Table:
    """At most ``per_class`` labelled texts of each class: text, label.

    Ids are drawn from the labels alone, in the order of a hash, four times as
    many as wanted; only these few meet the documents. Of a longer text the
    sample has a window of ``most_bytes`` code points at a place that the id's
    hash gives, so long texts teach too and driver memory is bounded. An id
    whose labels disagree teaches nothing; repeated labels count once; null ids
    and labels other than 0 and 1 are left out. Of rows that share an id all may
    be drawn.
    """
    own = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    ids = own.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    drawn = [ids.where(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(4 * per_class) for c in (0, 1)]
    both = reduce(DataFrame.unionAll, drawn)
    place = F.pmod(F.xxhash64(F.lit("window"), "_id"), F.greatest(F.lit(1), F.length("text") - most_bytes + 1)).cast("int")
    window = F.when(F.octet_length("text") > most_bytes, F.substring("text", place + 1, F.lit(most_bytes))).otherwise(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(both), F.col("doc_id") == F.col("_id")).select("_id", window.alias("text"), "label")
    order = [F.xxhash64("_id"), F.col("_id"), F.col("text")]
    return pa.concat_tables([found.where(F.col("label") == c).orderBy(*order).limit(per_class).select("text", "label").toArrow() for c in (0, 1)])
