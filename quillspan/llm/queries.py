"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import centroids, contamination, embeddings, hardneg, neardup, pieces, pii, quality, secrets, sharding, sstable, substrings, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), with_text=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sstable.token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detected(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, hardneg.relabelled())


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_decontamination": op2_decontamination,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_embeddings": op7_embeddings,
    "op8_token_ids": op8_token_ids,
    "op9_neardup": op9_neardup,
    "op10_toxicity": op10_toxicity,
    "op11_secrets": op11_secrets,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": contamination.ORACLE,
    "op3_pii": pii.ORACLE,
    "op4_substrings": substrings.ORACLE,
    "op5_sharding": sharding.oracle(),
    "op7_embeddings": embeddings.ORACLE,
    "op9_neardup": neardup.ORACLE,
    "op11_secrets": secrets.ORACLE,
    "op12_hard_negatives": hardneg.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
