"""The corpus pipeline: quality, near-dedup, decontamination, personal data, pieces.

Each stage takes the documents that its predecessor kept, and its decisions
take effect; all but the last return the columns of documents. Between stages
documents are written as Parquet and read again.

All stages decide row by row, by text: a null or repeated doc_id changes
nothing but which of several near duplicates stays (the smallest, a null one
first). Null texts count as empty where they are judged and stay null where they
stay; texts of any length are read whole; other columns go along whatever they
are called; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import contamination, neardup, pieces, pii, quality
from quillspan.llm.runtime import new_path

#: Of the near_dedup stage; two-word shingles are op9's own.
SHINGLE_WORDS = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled ones among them, doesn't reject; equal texts go the same way."""
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, net)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8), that with the smallest doc_id; one of rows alike in doc_id and text. Texts without words link with nothing, so all of them stay under their doc_ids."""
    return neardup.deduplicated(docs, shingle_words=SHINGLE_WORDS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; of rows that share a doc_id only those whose own text holds one go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and revealing terms taken out of their texts; n_chars, where there is one, follows."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with their ids: the encoded corpus. A null or empty text has one, of no ids; rows with a null doc_id share a key of their own."""
    import public_tokenizers

    return pieces.sampled(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("pieces", pieces_stage),
]

#: Classifier, components and sampling can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
