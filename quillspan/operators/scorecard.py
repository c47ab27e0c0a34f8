"""Scorecards: one row a language, category or pair, each from one aggregation over records.

``records`` has a row for each answer with at least id, lang, correct (boolean),
content, finish_reason, prompt_tokens and completion_tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.stats import mcnemar, ratio, share

#: Correctness by benchmark: an expression on content and gold. Others can be added.
CORRECT: dict[str, Callable[[Column, Column], Column]] = {
    "mgsm": lambda content, gold: F.coalesce(F.abs(T.last_number(content) - gold.try_cast("double")) < 1e-9, F.lit(False)),
    "belebele": lambda content, gold: F.coalesce(T.last_letter(content) == gold, F.lit(False)),
    "proxlite": lambda content, gold: F.coalesce(T.parse_letter(content) == gold, F.lit(False)),
}


#: What an answer says, by benchmark; null where nothing could be read from it.
ANSWERED: dict[str, Callable[[Column], Column]] = {
    "mgsm": lambda content: T.last_number(content).cast("string"),
    "belebele": lambda content: T.last_letter(content),
    "proxlite": lambda content: T.parse_letter(content),
}


def _by_bench(rules: dict[str, Callable], *columns: Column, otherwise: Column) -> Column:
    out = otherwise
    for name, of in rules.items():
        out = F.when(F.col("bench") == name, of(*columns)).otherwise(out)
    return out


def scored(records: DataFrame, bench: str | None = None, rule: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``records`` with ``correct``: by ``rule`` (content, gold), the rule of ``bench``, or of each row's own bench."""
    content, gold = F.col("content"), F.col("gold").cast("string")
    if rule or bench:
        return records.withColumn("correct", (rule or CORRECT[bench])(content, gold))
    return records.withColumn("correct", _by_bench(CORRECT, content, gold, otherwise=F.lit(False)))


def with_unparsed(records: DataFrame, bench: str | None = None) -> DataFrame:
    """``records`` with ``unparsed``: whether no answer could be read (such a record counts as wrong)."""
    content = F.col("content")
    answer = ANSWERED[bench](content) if bench else _by_bench(ANSWERED, content, otherwise=F.lit(None).cast("string"))
    return records.withColumn("unparsed", answer.isNull())


def flat_usage(records: DataFrame) -> DataFrame:
    """Nested usage and timings as columns; a missing struct counts as no tokens."""
    return records.withColumns(
        {
            "prompt_tokens": F.coalesce("usage.prompt_tokens", F.lit(0)),
            "completion_tokens": F.coalesce("usage.completion_tokens", F.lit(0)),
            "predicted_per_second": F.col("timings.predicted_per_second"),
            "draft_n": F.coalesce("timings.draft_n", F.lit(0)),
            "draft_n_accepted": F.coalesce("timings.draft_n_accepted", F.lit(0)),
        }
    )


def scorecard(records: DataFrame, by: str = "lang") -> DataFrame:
    """n, correct, accuracy, exact median of completion tokens, share of answers cut at the length limit."""
    return records.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        share(F.col("correct")).alias("accuracy"),
        F.median("completion_tokens").alias("median_completion"),
        (100 * share(F.col("finish_reason") == "length")).alias("pct_length"),
    )


def full_scorecard(records: DataFrame, by: str = "lang") -> DataFrame:
    """The scorecard with reasoning tokens, speed, draft acceptance and unparsed answers, from columns of ``flat_usage`` and ``with_unparsed``; medians over the records that have the figure."""
    return records.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        share(F.col("correct")).alias("accuracy"),
        F.median("completion_tokens").alias("median_completion"),
        F.median("reasoning_tokens").alias("median_reasoning"),
        F.median("predicted_per_second").alias("median_per_second"),
        ratio(F.sum("draft_n_accepted"), F.sum("draft_n")).alias("acceptance"),
        (100 * share(F.col("finish_reason") == "length")).alias("pct_length"),
        (100 * share(F.col("unparsed"))).alias("pct_unparsed"),
    )


def draft_acceptance(records: DataFrame, by: str = "lang") -> DataFrame:
    return records.groupBy(by).agg(ratio(F.sum("draft_n_accepted"), F.sum("draft_n")).alias("acceptance"), F.median("predicted_per_second").alias("median_per_second"))


def crosstab(records: DataFrame, row: str, column: Column, values: list[str]) -> DataFrame:
    """Counts of ``column`` by ``row``, a fixed column for each value, 0 where nothing was seen."""
    return records.withColumn("_v", column).groupBy(row).agg(*(F.count_if(F.col("_v") == v).alias(v) for v in values))


def efficiency(records: DataFrame, by: str = "lang", looping: Column | None = None, blank: Column | None = None) -> DataFrame:
    """The efficiency row: accuracy, mean tokens, cut, empty (and looping) answers, and successes for a thousand completion tokens. ``blank``: whether an answer is empty, where that is known without its content."""
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    good = F.count_if(F.col("correct") & (F.col("finish_reason") == "stop"))
    spent = F.sum("completion_tokens")
    more = [F.count_if(looping).alias("n_looping")] if looping is not None else []
    return records.groupBy(by).agg(
        F.count("*").alias("n"),
        share(F.col("correct")).alias("accuracy"),
        F.avg("prompt_tokens").alias("mean_prompt"),
        F.avg("completion_tokens").alias("mean_completion"),
        F.avg(total).alias("mean_total"),
        F.count_if(F.col("finish_reason") == "length").alias("n_length"),
        F.count_if(T.is_blank("content") if blank is None else blank).alias("n_empty"),
        *more,
        good.alias("n_correct_and_stop"),
        spent.alias("completion_tokens_all"),
        (ratio(good, spent) * 1000).alias("success_per_1k"),
    )


def paired(records: DataFrame, base: str, columns: list[str]) -> DataFrame:
    """Each record of another language beside that of ``base`` with the same id: id, lang, then columns and base_columns."""
    one = records.where(F.col("lang") == base).select("id", *(F.col(c).alias(f"base_{c}") for c in columns))
    return records.where(F.col("lang") != base).select("id", "lang", *columns).join(one, "id")


def efficiency_pairs(records: DataFrame, base: str = "en", blank: Column | None = None) -> DataFrame:
    """Against ``base``: success as per cent, ratio of mean total tokens, paired ids, ids that took more tokens. Without ``base`` the ratios are null."""
    rows = records.withColumn("total", F.col("prompt_tokens") + F.col("completion_tokens"))
    stats = efficiency(rows, blank=blank)
    ref = stats.where(F.col("lang") == base).select(F.col("success_per_1k").alias("b_success"), F.col("mean_total").alias("b_total"))
    pairs = paired(rows, base, ["total"]).groupBy("lang").agg(F.count("*").alias("paired_ids"), F.count_if(F.col("total") > F.col("base_total")).alias("ids_more_tokens"))
    side = stats.where(F.col("lang") != base).join(F.broadcast(ref), F.lit(True), "left")  # one row
    return side.join(pairs, "lang", "left").select(
        "lang",
        (100 * ratio(F.col("success_per_1k"), F.col("b_success"))).alias("success_pct_of_base"),
        ratio(F.col("mean_total"), F.col("b_total")).alias("total_token_ratio"),
        F.coalesce("paired_ids", F.lit(0)).alias("paired_ids"),
        F.coalesce("ids_more_tokens", F.lit(0)).alias("ids_more_tokens"),
    )


def gate(records: DataFrame, base: str = "en", threshold: float = 1.15) -> DataFrame:
    """Ratios of mean tokens on paired ids and the verdict: whether the total ratio is over the threshold."""
    rows = records.withColumn("total", F.col("prompt_tokens") + F.col("completion_tokens"))
    means = paired(rows, base, ["total", "completion_tokens"]).groupBy("lang").agg(
        F.count("*").alias("pairs"),
        ratio(F.avg("total"), F.avg("base_total")).alias("total_ratio"),
        ratio(F.avg("completion_tokens"), F.avg("base_completion_tokens")).alias("completion_ratio"),
    )
    return means.withColumn("passed", F.col("total_ratio") > threshold)


def token_means(records: DataFrame, expected: dict[str, int], base: str = "en") -> DataFrame:
    """Mean tokens by language; the ratio to ``base`` only where both have all expected ids (null for all where ``base`` is absent)."""
    stats = records.groupBy("lang").agg(F.count("*").alias("n"), F.avg("completion_tokens").alias("mean_completion"), F.avg(F.col("prompt_tokens") + F.col("completion_tokens")).alias("mean_total"))
    want = F.create_map(*(F.lit(x) for kv in expected.items() for x in kv))
    stats = stats.withColumn("complete", F.coalesce(F.col("n") == want[F.col("lang")], F.lit(False)))
    ref = stats.where(F.col("lang") == base).select(F.col("mean_total").alias("b_total"), F.col("complete").alias("b_complete"))
    whole = F.col("complete") & F.col("b_complete")
    return stats.join(F.broadcast(ref), F.lit(True), "left").select("lang", "n", "mean_completion", "mean_total", "complete", F.when(whole, ratio(F.col("mean_total"), F.col("b_total"))).alias("ratio"))  # one row


def category_accuracy(records: DataFrame, category: str = "category") -> DataFrame:
    return records.groupBy(category, "lang").agg(F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"))


def weighted_accuracy(records: DataFrame, weights: DataFrame, category: str = "category") -> DataFrame:
    """Accuracy by category, weighted by ``weights`` (category, weight) over the categories present; null if there is none."""
    rows = category_accuracy(records, category).join(weights, category)
    return rows.groupBy("lang").agg(
        ratio(F.sum(F.col("weight") * F.col("accuracy")), F.sum("weight")).alias("weighted_accuracy"), F.count("*").alias("categories"), F.min("n").alias("least_n")
    )


def paired_outcomes(records: DataFrame, base: str = "en") -> DataFrame:
    """Paired 2 x 2 counts of each language against ``base`` and the exact McNemar test."""
    a, b = F.col("base_correct"), F.col("correct")
    out = paired(records, base, ["correct"]).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("base_only"), F.count_if(~a & b).alias("other_only")
    )
    return out.withColumn("p_value", mcnemar(F.col("base_only"), F.col("other_only")))


def fertility(rows: DataFrame, base: str = "en") -> DataFrame:
    """Characters, tokens per character and tokens against ``base`` of the same source (source, lang, tokens, chars): ratio_tokens = ratio_chars * ratio_fertility."""
    sums = rows.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
    ref = sums.where(F.col("lang") == base).select("source", F.col("tokens").alias("b_tokens"), F.col("chars").alias("b_chars"))
    per, b_per = ratio(F.col("tokens"), F.col("chars")), ratio(F.col("b_tokens"), F.col("b_chars"))
    return sums.where(F.col("lang") != base).join(ref, "source").select(
        "source", "lang", ratio(F.col("chars"), F.col("b_chars")).alias("ratio_chars"), ratio(per, b_per).alias("ratio_fertility"), ratio(F.col("tokens"), F.col("b_tokens")).alias("ratio_tokens")
    )


def run_summary(records: DataFrame, base: str = "en") -> DataFrame:
    """Mean, least and most completion tokens; the ratio to ``base`` is of means already rounded to one place, null where ``base`` is absent."""
    stats = records.where(F.col("completion_tokens").isNotNull()).groupBy("lang").agg(
        F.count("*").alias("n"), F.bround(F.avg("completion_tokens"), 1).alias("mean"), F.min("completion_tokens").alias("least"), F.max("completion_tokens").alias("most")
    )
    ref = stats.where(F.col("lang") == base).select(F.col("mean").alias("b_mean"))
    return stats.join(F.broadcast(ref), F.lit(True), "left").select("lang", "n", "mean", "least", "most", F.bround(ratio(F.col("mean"), F.col("b_mean")), 3).alias("ratio"))  # one row


def token_split(records: DataFrame, base: str = "en") -> DataFrame:
    """Mean reasoning, answer and total tokens by language, over the records that have them, and their ratios to ``base``."""
    rows = records.where(F.col("reasoning_tokens").isNotNull() & F.col("answer_tokens").isNotNull())
    stats = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("reasoning_tokens").alias("reason"), F.avg("answer_tokens").alias("answer"))
    stats = stats.withColumn("total", F.col("reason") + F.col("answer"))
    ref = stats.where(F.col("lang") == base).select(*(F.col(c).alias(f"b_{c}") for c in ("reason", "answer", "total")))
    ratios = [ratio(F.col(c), F.col(f"b_{c}")).alias(f"{c}_ratio") for c in ("reason", "answer", "total")]
    return stats.join(F.broadcast(ref), F.lit(True), "left").select("lang", "n", "reason", "answer", "total", *ratios)  # one row


def against_baseline(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """This run against a baseline run on the ids and languages that both have: paired 2 x 2 counts, accuracies and the exact McNemar test by language."""
    pick = lambda df, c: df.select("id", "lang", F.col("correct").alias(c))
    a, b = F.col("base"), F.col("this")
    out = pick(theirs, "base").join(pick(ours, "this"), ["id", "lang"]).groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("base_only"), F.count_if(~a & b).alias("this_only"),
        share(a).alias("base_accuracy"), share(b).alias("accuracy"),
    )
    return out.withColumn("p_value", mcnemar(F.col("base_only"), F.col("this_only")))


def compare_models(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two runs on the ids and languages that both have: accuracies and mean tokens a language."""
    pick = lambda df, p: df.select("id", "lang", F.col("correct").alias(f"{p}_correct"), F.col("completion_tokens").alias(f"{p}_tokens"))
    both = pick(ours, "a").join(pick(theirs, "b"), ["id", "lang"])
    return both.groupBy("lang").agg(
        F.count("*").alias("n"), share(F.col("a_correct")).alias("a_accuracy"), share(F.col("b_correct")).alias("b_accuracy"), ratio(F.sum("b_tokens"), F.sum("a_tokens")).alias("token_ratio")
    )


def findings(stats: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """A row for each measure: keys, finding, value."""
    return stats.select(*keys, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(keys, measures, "finding", "value")


def repeat_stats(repeats: DataFrame, item: str, value: str) -> DataFrame:
    """n, mean and sample deviation (null for one repeat) by item."""
    return repeats.groupBy(item).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))


def repeat_outcomes(repeats: DataFrame, item: str, value: str) -> DataFrame:
    """``repeat_stats`` with how many repeats are correct, as k/n too, and how many were cut at the length limit."""
    stats = repeats.groupBy(item).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count_if("correct").alias("n_correct"), F.count_if(F.col("finish_reason") == "length").alias("n_length")
    )
    return stats.withColumn("correct_of", F.concat_ws("/", F.col("n_correct").cast("string"), F.col("n").cast("string")))


def originals_over_twice(originals: DataFrame, item: str, group: str, value: str, base: str) -> DataFrame:
    """By group the originals that are over twice their item's original in ``base``: n, n_over."""
    ref = originals.where(F.col(group) == base).select(item, F.col(value).alias("_b"))
    return originals.where(F.col(group) != base).join(ref, item).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(value) > 2 * F.col("_b")).alias("n_over"))


def over_twice(repeats: DataFrame, item: str, group: str, value: str, base: str) -> DataFrame:
    """Share of a group's repeats over twice their item's mean in ``base``, and the ratio of the sums of item means.

    A repeat of exactly twice the mean is not over it. Sums of doubles depend on
    the order of the rows, so measurements of up to eight decimals below 10^12
    are added and compared as decimals; a mean of others is one of doubles.
    """
    exact = F.col(value).try_cast("decimal(20,8)")
    same = F.coalesce(exact.cast("double") == F.col(value), F.col(value).isNull())
    means = repeats.groupBy(item, group).agg(F.avg(value).alias("m"), F.sum(exact).alias("s"), F.count(value).cast("decimal(12,0)").alias("k"), F.min(same).alias("same"))
    ref = means.where(F.col(group) == base).select(item, F.col("m").alias("b"), "s", "k", "same")
    above = F.when(F.col("same") & same, exact * F.col("k") > 2 * F.col("s")).otherwise(F.col(value) > 2 * F.col("b"))
    over = repeats.where(F.col(group) != base).join(ref, item).groupBy(group).agg(F.count("*").alias("n"), F.count_if(above).alias("n_over"))
    sums = means.where(F.col(group) != base).join(ref.select(item, "b"), item).groupBy(group).agg(ratio(F.sum("m"), F.sum("b")).alias("mean_ratio"))
    return over.join(sums, group).select(group, "n", "n_over", ratio(F.col("n_over"), F.col("n")).alias("share_over"), "mean_ratio")


def corrected_group(repeats: DataFrame, originals: DataFrame, item: str, value: str) -> DataFrame:
    """Over corrected items: mean of the originals, mean of the per-item means, ratio of their sums."""
    means = repeats.groupBy(item).agg(F.avg(value).alias("m"))
    both = means.join(originals.select(item, F.col(value).alias("o")), item)
    return both.agg(F.count("*").alias("items"), F.avg("o").alias("mean_original"), F.avg("m").alias("mean_corrected"), ratio(F.sum("o"), F.sum("m")).alias("ratio"))


def tensor_counts(tensors: DataFrame, part: Column) -> DataFrame:
    """Tensors, elements and bytes by class: ``part`` gives the class from ``name``. ``tensors`` as of ``readers.tensors``."""
    return tensors.groupBy(part.alias("part")).agg(F.count("*").alias("tensors"), F.sum("elements").alias("elements"), F.sum("bytes").alias("bytes"))


def manifest_tables(records: DataFrame, manifest: DataFrame, base: str = "en") -> DataFrame:
    """Efficiency rows of all runs that a manifest lists (model, bench, setting, tag, expected_n), by language, with the ratio of mean total tokens to ``base`` and a status.

    ``records`` has bench and tag. A run without records has one row, of no
    language, ``not run``; one in which a language has fewer records than
    expected is ``incomplete``.
    """
    keys = ["model", "bench", "setting", "tag"]
    rows = records.join(manifest.select(*keys, "expected_n"), ["bench", "tag"])
    total, good = F.col("prompt_tokens") + F.col("completion_tokens"), F.count_if(F.col("correct") & (F.col("finish_reason") == "stop"))
    stats = rows.groupBy(*keys, "expected_n", "lang").agg(
        F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"), F.avg(total).alias("mean_total"), (ratio(good, F.sum("completion_tokens")) * 1000).alias("success_per_1k")
    )
    ref = stats.where(F.col("lang") == base).select(*keys, F.col("mean_total").alias("_b"))
    whole = stats.groupBy(*keys).agg(F.min(F.col("n") >= F.col("expected_n")).alias("_whole"))
    out = manifest.select(*keys).join(stats.drop("expected_n"), keys, "left").join(ref, keys, "left").join(whole, keys, "left")
    status = F.when(F.col("n").isNull(), "not run").when(F.col("_whole"), "ok").otherwise("incomplete")
    return out.select(*keys, status.alias("status"), "lang", "n", "accuracy", "mean_total", "success_per_1k", ratio(F.col("mean_total"), F.col("_b")).alias("total_ratio"))
