"""Languages told by letters: naive Bayes over character trigrams, fitted on labelled texts and scored by joins.

A text is lower-cased, everything but letters is one blank, and a blank stands
at both ends; its trigrams are all runs of three characters of that. A language
is the distribution of its commonest trigrams, smoothed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.audit import draw_order
from quillspan.operators.corpus import small

#: Texts of a language that a model is fitted on, trigrams of a language that it keeps, and what is added to every count.
TEXTS, TRIGRAMS, SMOOTHING = 1000, 3000, 0.5
#: Rows of a model that are broadcast at most (about 40 bytes each): a trigram has one row, with its weight in each language.
BROADCAST_TRIGRAMS = 500_000


def trigrams(text: Column) -> Column:
    """All trigrams of a text, in order; none for a text without letters."""
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))
    return F.when(letters == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), letters, F.lit(" ")), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def fitted(texts: DataFrame, key: str, seed: int = 0, most: int = TEXTS, keep: int = TRIGRAMS) -> DataFrame:
    """A model from labelled ``texts`` (key, text, lang): gram, weights (map from language to logarithm of probability).

    At most ``most`` texts of a language teach, drawn by ``draw_order``; of a
    language its ``keep`` commonest trigrams stay (ties: the smaller text).
    Weights are ln((n + s) / (N + s V)): n times the trigram was seen among the N
    of the language, V trigrams are in the model, s is ``SMOOTHING``. Rows with a
    null text or language teach nothing; a language without letters has no part.
    """
    known = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "lang", "text")
    order = Window.partitionBy("lang").orderBy(*draw_order(seed, key), "text")
    drawn = known.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    counts = drawn.select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= keep).select("gram").distinct()
    seen = counts.join(top, "gram")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    size = top.agg(F.count("*").alias("size"))
    every = top.join(F.broadcast(totals.join(F.broadcast(size), F.lit(True))), F.lit(True))  # a row a language
    weight = F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.col("total") + SMOOTHING * F.col("size")))
    full = every.join(seen, ["lang", "gram"], "left")
    return full.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", weight.alias("w")))).alias("weights"))


def scores(texts: DataFrame, key: str, model: DataFrame, languages: list[str]) -> DataFrame:
    """Of each text (key, text) how much its trigrams speak for each language: key, known (trigrams of the model), a column of log probabilities a language, and ``detected``.

    ``detected`` is the language with the largest (ties: the first in
    ``languages``), ``other`` where no trigram is known and ``none`` for a text
    without letters, null and empty ones among them. The model meets the
    trigrams where they are read, and what is shuffled is one row a key and
    task. Rows that share a key count as one text.
    """
    own = model.select("gram", *(F.col("weights")[k].alias(f"w_{i}") for i, k in enumerate(languages)))
    every = texts.select(F.col(key).alias("_key"), F.explode_outer(trigrams(F.col("text"))).alias("gram"))
    met = every.join(small(own, BROADCAST_TRIGRAMS), "gram", "left")
    sums = met.groupBy("_key").agg(F.count("gram").alias("_grams"), F.count("w_0").alias("known"), *(F.coalesce(F.sum(f"w_{i}"), F.lit(0.0)).alias(k) for i, k in enumerate(languages)))
    best = F.array_max(F.array(*(F.struct(F.col(f"`{k}`").alias("w"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, k in enumerate(languages))))["lang"]
    detected = F.when(F.col("_grams") == 0, "none").when(F.col("known") == 0, "other").otherwise(best)
    return sums.select(F.col("_key").alias(key), "known", *(F.col(f"`{k}`") for k in languages), detected.alias("detected"))


def accuracy(scored: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """How often ``detected`` is the language that ``truth`` (key, lang) names: lang, n, right, share."""
    both = scored.select(key, "detected").join(truth.select(key, "lang"), key)
    right = F.count_if(F.col("detected") == F.col("lang"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), right.alias("right"), (right / F.count("*")).alias("share"))
