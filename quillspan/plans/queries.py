"""The registered queries over the driver's tables, one an operator, each beside its SQL where SQL can tell it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import udfs
from quillspan.functions import vectors as V
from quillspan.functions.stats import mcnemar
from quillspan.operators import audit as A
from quillspan.operators import corpus as C
from quillspan.operators import scorecard as S
from quillspan.plans import views
from quillspan.plans.views import MESSAGES, RECORDS, REPEATS, VECTORS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R6 = lambda c: F.round(c, 6).alias(c)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {RECORDS} SELECT lang, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(prompt_tokens), 6) AS mean_prompt, round(avg(completion_tokens), 6) AS mean_completion,
  round(avg(prompt_tokens + completion_tokens), 6) AS mean_total, count(*) FILTER (finish_reason = 'length') AS n_length, count(*) FILTER (trim(coalesce(content, ''), E' \\n\\t') = '') AS n_empty,
  count(*) FILTER (correct AND finish_reason = 'stop') AS n_correct_and_stop, sum(completion_tokens)::BIGINT AS completion_tokens_all,
  round(1000.0 * (count(*) FILTER (correct AND finish_reason = 'stop'))::DOUBLE / sum(completion_tokens)::DOUBLE, 6) AS success_per_1k FROM records GROUP BY lang""")
def efficiency_by_lang(spark, d):
    return rounded(S.efficiency(views.answers(spark, d)))


@query(f"""WITH {RECORDS}, s AS (SELECT lang, 1000.0 * (count(*) FILTER (correct AND finish_reason = 'stop'))::DOUBLE / sum(completion_tokens)::DOUBLE AS k, avg(prompt_tokens + completion_tokens) AS m FROM records GROUP BY lang),
p AS (SELECT a.lang, count(*) AS paired_ids, count(*) FILTER (a.prompt_tokens + a.completion_tokens > b.prompt_tokens + b.completion_tokens) AS ids_more_tokens FROM records a JOIN records b ON a.id = b.id AND b.lang = 'en' AND a.lang <> 'en' GROUP BY a.lang)
SELECT s.lang, round(100 * s.k / e.k, 6) AS success_pct_of_base, round(s.m / e.m, 6) AS total_token_ratio, coalesce(paired_ids, 0) AS paired_ids, coalesce(ids_more_tokens, 0) AS ids_more_tokens
FROM s JOIN s e ON e.lang = 'en' LEFT JOIN p ON p.lang = s.lang WHERE s.lang <> 'en'""")
def efficiency_pairs(spark, d):
    return rounded(S.efficiency_pairs(views.records(spark, d), blank=F.col("blank")))


@query(f"""WITH {RECORDS} SELECT a.lang, count(*) AS pairs, round(avg(a.prompt_tokens + a.completion_tokens) / avg(b.prompt_tokens + b.completion_tokens), 6) AS total_ratio,
  round(avg(a.completion_tokens) / avg(b.completion_tokens), 6) AS completion_ratio, avg(a.prompt_tokens + a.completion_tokens) / avg(b.prompt_tokens + b.completion_tokens) > 1.15 AS passed
FROM records a JOIN records b ON a.id = b.id AND b.lang = 'en' AND a.lang <> 'en' GROUP BY a.lang""")
def gate_ratio(spark, d):
    return rounded(S.gate(A.require_unique(views.records(spark, d), ["id", "lang"])))


@query(f"""WITH {RECORDS}, s AS (SELECT lang, count(*) AS n, avg(completion_tokens) AS c, avg(prompt_tokens + completion_tokens) AS t FROM records GROUP BY lang),
f AS (SELECT *, CASE WHEN lang IN ('en', 'es') THEN n = (SELECT count(*) FROM documents WHERE lang = 'en') ELSE false END AS complete FROM s)
SELECT f.lang, f.n, round(f.c, 6) AS mean_completion, round(f.t, 6) AS mean_total, f.complete, round(CASE WHEN f.complete AND e.complete THEN f.t / e.t END, 6) AS ratio FROM f JOIN f e ON e.lang = 'en'""")
def token_means(spark, d):
    """Every language should have as many answers as there are English documents."""
    n = table(spark, d, "documents").where("lang = 'en'").count()
    return rounded(S.token_means(views.answers(spark, d), {"en": n, "es": n}))


@query(f"""WITH {RECORDS} SELECT lang, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy, median(completion_tokens)::DOUBLE AS median_completion,
  round(100 * avg((finish_reason = 'length')::INT), 6) AS pct_length FROM records GROUP BY lang""")
def scorecard(spark, d):
    return rounded(S.scorecard(views.answers(spark, d)))


_WORDS = "string_split_regex(lower(coalesce(content, '')), '[\\x20\\n]')"
_HITS = ", ".join(f"""len(list_filter({_WORDS}, lambda w: w IN ({", ".join(f"'{x}'" for x in ws)}))) AS {k}""" for k, ws in T.STOP_WORDS.items())
_DETECT = f"""h AS (SELECT *, {_HITS} FROM records), det AS (SELECT *, CASE WHEN trim(coalesce(content, ''), ' ') = '' THEN 'none' WHEN greatest(en, es, fr, de) = 0 THEN 'other'
  WHEN en = greatest(en, es, fr, de) THEN 'en' WHEN es = greatest(en, es, fr, de) THEN 'es' WHEN fr = greatest(en, es, fr, de) THEN 'fr' ELSE 'de' END AS detected FROM h)"""


@query(f"WITH {RECORDS}, {_DETECT} SELECT lang, " + ", ".join(f"count(*) FILTER (detected = '{v}') AS \"{v}\"" for v in ("en", "es", "fr", "de", "zh", "other", "none")) + " FROM det GROUP BY lang")
def lang_crosstab(spark, d):
    return S.crosstab(views.answers(spark, d), "lang", T.detect_language("content"), ["en", "es", "fr", "de", "zh", "other", "none"])


@query(f"WITH {RECORDS} SELECT category, lang, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM records GROUP BY category, lang")
def category_accuracy(spark, d):
    return rounded(S.category_accuracy(views.answers(spark, d)))


@query(f"""WITH {RECORDS}, w AS (SELECT category, count(*) AS weight FROM records GROUP BY category), c AS (SELECT category, lang, count(*) AS n, avg(correct::INT) AS a FROM records GROUP BY ALL)
SELECT lang, round(sum(weight * a) / sum(weight), 6) AS weighted_accuracy, count(*) AS categories, min(n) AS least_n FROM c JOIN w USING (category) GROUP BY lang""")
def weighted_accuracy(spark, d):
    r = views.answers(spark, d)
    return rounded(S.weighted_accuracy(r, r.groupBy("category").agg(F.count("*").alias("weight"))))


_TAIL = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


@query(f"""WITH {RECORDS}, p AS (SELECT a.lang, count(*) AS n, count(*) FILTER (a.correct AND e.correct) AS both_, count(*) FILTER (NOT a.correct AND NOT e.correct) AS neither, count(*) FILTER (e.correct AND NOT a.correct) AS b, count(*) FILTER (a.correct AND NOT e.correct) AS c
  FROM records a JOIN records e ON a.id = e.id AND e.lang = 'en' AND a.lang <> 'en' GROUP BY a.lang)
SELECT lang, n, both_ AS "both", neither, b AS base_only, c AS other_only, round({_TAIL}, 6) AS p_value FROM p""")
def mcnemar_pairs(spark, d):
    return rounded(S.paired_outcomes(views.records(spark, d)))


@query(f"""WITH {RECORDS}, s AS (SELECT category AS source, lang, sum(completion_tokens)::DOUBLE AS t, sum(n_chars)::DOUBLE AS c FROM records GROUP BY ALL)
SELECT a.source, a.lang, round(a.c / e.c, 6) AS ratio_chars, round((a.t / a.c) / (e.t / e.c), 6) AS ratio_fertility, round(a.t / e.t, 6) AS ratio_tokens FROM s a JOIN s e ON a.source = e.source AND e.lang = 'en' AND a.lang <> 'en'""")
def fertility_split(spark, d):
    return rounded(S.fertility(views.answers(spark, d).select(F.col("category").alias("source"), "lang", F.col("completion_tokens").alias("tokens"), F.col("n_chars").alias("chars"))))


@query(f"""WITH {RECORDS}, s AS (SELECT lang, count(*) AS n, round_even(avg(completion_tokens), 1) AS mean, min(completion_tokens) AS least, max(completion_tokens) AS most FROM records GROUP BY lang)
SELECT s.lang, s.n, s.mean, s.least, s.most, round_even(s.mean / e.mean, 3) AS ratio FROM s JOIN s e ON e.lang = 'en'""")
def run_summary(spark, d):
    return S.run_summary(views.answers(spark, d))


@query(f"""WITH {RECORDS} SELECT lang, count(*) AS n, round(avg(completion_tokens), 6) AS mean_completion, round(avg(prompt_tokens + completion_tokens), 6) AS mean_total,
  lang = 'es' AND count(*) = (SELECT count(*) FROM documents WHERE lang = 'es') AS complete, NULL::DOUBLE AS ratio FROM records WHERE lang <> 'en' GROUP BY lang""")
def token_means_no_base(spark, d):
    """Every language has its row, without a ratio, where the base language hasn't run yet."""
    n = table(spark, d, "documents").where("lang = 'es'").count()
    return rounded(S.token_means(views.answers(spark, d).where("lang <> 'en'"), {"en": n, "es": n}))


@query(f"WITH {RECORDS} SELECT lang, count(*) AS n, round_even(avg(completion_tokens), 1) AS mean, min(completion_tokens) AS least, max(completion_tokens) AS most, NULL::DOUBLE AS ratio FROM records WHERE lang <> 'en' GROUP BY lang")
def run_summary_no_base(spark, d):
    return S.run_summary(views.answers(spark, d).where("lang <> 'en'"))


@query("SELECT lang, NULL::DOUBLE AS ratio FROM documents WHERE lang <> 'en' GROUP BY lang")
def length_ratio_no_base(spark, d):
    return C.length_ratio(table(spark, d, "documents").where("lang <> 'en'"), "lang", "n_chars", "en")


@query(f"""WITH {RECORDS}, o AS (SELECT *, (correct OR id % 5 = 0) AS c2, completion_tokens + id % 3 AS t2 FROM records WHERE id % 4 <> 0)
SELECT r.lang, count(*) AS n, round(avg(r.correct::INT), 6) AS a_accuracy, round(avg(o.c2::INT), 6) AS b_accuracy, round(sum(o.t2)::DOUBLE / sum(r.completion_tokens)::DOUBLE, 6) AS token_ratio FROM records r JOIN o ON r.id = o.id AND r.lang = o.lang GROUP BY r.lang""")
def model_compare(spark, d):
    r = views.records(spark, d)
    other = r.where("id % 4 <> 0").withColumn("correct", F.col("correct") | (F.col("id") % 5 == 0)).withColumn("completion_tokens", F.col("completion_tokens") + F.col("id") % 3)
    return rounded(S.compare_models(r, other))


@query(f"""WITH {RECORDS}, s AS (SELECT lang, count(*)::DOUBLE AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(completion_tokens), 6) AS mean_completion FROM records GROUP BY lang)
SELECT lang, finding, value FROM (UNPIVOT s ON n, accuracy, mean_completion INTO NAME finding VALUE value)""")
def findings_unpivot(spark, d):
    return S.findings(rounded(S.efficiency(views.answers(spark, d))), ["lang"], ["n", "accuracy", "mean_completion"])


_NUMBER = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9]+)', E'\\x01\\\\1\\x02\\x02', 'g'), E'\\x02[,.]\\x01([0-9]{3})\\x02', '\\1', 'g'), E'[\\x01\\x02]', '', 'g'), '([0-9]),([0-9])', '\\1.\\2', 'g'), '([0-9]),([0-9])', '\\1.\\2', 'g')"""


@query(f"SELECT doc_id, TRY_CAST(regexp_extract_all({_NUMBER}, '-?[0-9]+(?:\\.[0-9]+)?')[-1] AS DOUBLE) AS number FROM documents")
def last_number(spark, d):
    return table(spark, d, "documents").select("doc_id", T.last_number("text").alias("number"))


@query("SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: x IN ('A', 'B', 'C', 'D'))[-1] AS letter FROM documents")
def last_letter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.last_letter("text").alias("letter"))


_ANSWERS = ["Answer: B", "**Answer:** C", "Respuesta: $\\boxed{E}$", "Answer: A then Answer: none", "no marker", "## answer : (D)", "答案：F"]
_TEXT_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ANSWERS)) + " END"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_TEXT_SQL} AS t FROM documents), m AS (SELECT *, string_split_regex(t, '(?:(?i:answer|respuesta)|答案)\\s*(?:\\*\\*|__)?\\s*[:：]') AS p FROM t)
SELECT doc_id, CASE WHEN len(p) > 1 THEN nullif(regexp_extract(p[-1], '^[\\s*_`$(\\[{{]*(?:\\\\(?:boxed|text|textbf)\\{{)?[\\s*_`$(\\[{{]*([A-J])(?:[^A-Za-z]|$)', 1), '') END AS letter FROM m""")
def parse_letter(spark, d):
    docs = table(spark, d, "documents")
    pick = F.lit(None).cast("string")
    for i, a in enumerate(_ANSWERS):
        pick = F.when(F.col("doc_id") % 7 == i, a).otherwise(pick)
    return docs.select("doc_id", T.parse_letter(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick)).alias("letter"))


@query(f"""WITH {RECORDS} SELECT lang, count(*) FILTER (trim(coalesce(content, ''), E' \\n\\t') = '') AS n_empty, count(*) FILTER (finish_reason = 'length') AS n_cut, count(*) FILTER (finish_reason = 'stop') AS n_whole, sum(length(content))::BIGINT AS chars FROM records GROUP BY lang""")
def empty_truncated(spark, d):
    return views.answers(spark, d).groupBy("lang").agg(F.count_if(T.is_blank("content")).alias("n_empty"), F.count_if(F.col("finish_reason") == "length").alias("n_cut"), F.count_if(F.col("finish_reason") == "stop").alias("n_whole"), F.sum(T.chars("content")).alias("chars"))


def _excess(spark, d) -> DataFrame:
    return S.paired(views.records(spark, d), "en", ["n_chars"]).withColumn("excess", F.col("n_chars") - F.col("base_n_chars"))


_EXCESS = "pr AS (SELECT a.id, a.lang, a.n_chars, e.n_chars AS base_n_chars, a.n_chars - e.n_chars AS excess FROM records a JOIN records e ON a.id = e.id AND e.lang = 'en' AND a.lang <> 'en'), wk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY excess DESC, id) AS rank FROM pr QUALIFY rank <= 20)"
_LABEL = "CASE WHEN id % 3 = 0 THEN 'E' WHEN id % 3 = 1 THEN 'A' ELSE 'O' END"


@query(f"WITH {RECORDS}, {_EXCESS} SELECT id, lang, n_chars, base_n_chars, excess, rank FROM wk")
def worst_k(spark, d):
    return A.worst(_excess(spark, d), "lang", "excess", "id", 20)


@query(f"WITH {RECORDS}, {_EXCESS} SELECT id, lang, excess, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || id), id) AS rank FROM pr WHERE (id, lang) NOT IN (SELECT id, lang FROM wk) QUALIFY rank <= 20")
def random_rest(spark, d):
    rows = _excess(spark, d)
    return A.random_rest(rows, A.worst(rows, "lang", "excess", "id", 20), "lang", "id", 20, 42).select("id", "lang", "excess", "rank")


@query(f"""WITH {RECORDS}, {_EXCESS}, l AS (SELECT *, {_LABEL} AS label FROM wk), g AS (SELECT lang, label, count(*) AS n, sum(n_chars) AS v, sum(base_n_chars) AS b, sum(excess) AS x FROM l GROUP BY lang, label UNION ALL SELECT lang, 'all', count(*), sum(n_chars), sum(base_n_chars), sum(excess) FROM l GROUP BY lang)
SELECT g.lang, g.label, g.n, g.v::BIGINT AS sum_value, g.b::BIGINT AS sum_base, round(g.v::DOUBLE / g.b::DOUBLE, 6) AS ratio, round(g.x::DOUBLE / a.x::DOUBLE, 6) AS share_of_group, round(g.x::DOUBLE / (SELECT sum(excess)::DOUBLE FROM pr), 6) AS share_of_whole FROM g JOIN g a ON a.lang = g.lang AND a.label = 'all'""")
def label_tally(spark, d):
    rows = _excess(spark, d)
    worst = A.worst(rows, "lang", "excess", "id", 20)
    given = worst.where("id % 3 < 2").select("id", "lang", F.when(F.col("id") % 3 == 0, "E").otherwise("A").alias("label"))
    return rounded(A.label_tally(A.with_labels(worst, given, ["id", "lang"], "O"), "lang", "label", "n_chars", "base_n_chars", rows))


@query(f"""WITH {RECORDS}, x AS (SELECT * FROM records UNION ALL SELECT * FROM records WHERE doc_id % 100 = 0), h AS (SELECT lang, count(*) AS n, count(DISTINCT id) AS k FROM x GROUP BY lang), e AS (SELECT unnest(['en', 'es', 'zh']) AS lang, unnest([10, 1000000, 5]::BIGINT[]) AS expected)
SELECT lang, coalesce(n, 0) AS n, expected, CASE WHEN expected IS NULL THEN 'UNEXPECTED' WHEN coalesce(n, 0) = expected THEN 'OK' WHEN coalesce(n, 0) < expected THEN 'MISSING' ELSE 'EXTRA' END AS status, coalesce(n, 0) - coalesce(k, 0) AS duplicates FROM h FULL JOIN e USING (lang)""")
def completeness_audit(spark, d):
    r = views.records(spark, d)
    expected = spark.createDataFrame([("en", 10), ("es", 1_000_000), ("zh", 5)], "lang string, expected long")
    return A.completeness(r.unionByName(r.where("doc_id % 100 = 0")), expected, "lang", ["id"])


@query(f"WITH {RECORDS}, x AS (SELECT * FROM records UNION ALL SELECT * FROM records WHERE doc_id % 100 = 0) SELECT id, lang, count(*) AS n FROM x GROUP BY id, lang HAVING count(*) > 1")
def duplicate_keys(spark, d):
    r = views.records(spark, d)
    return A.duplicate_keys(r.unionByName(r.where("doc_id % 100 = 0")), ["id", "lang"])


@query(f"WITH {RECORDS} SELECT id FROM records WHERE lang IN ('en', 'es', 'fr') GROUP BY id HAVING count(DISTINCT lang) = 3")
def complete_ids_division(spark, d):
    return A.in_all(views.records(spark, d), "id", "lang", ["en", "es", "fr"])


@query(f"WITH {RECORDS} SELECT id, lang FROM records WHERE NOT (doc_id % 3 = 0)")
def resume_pending(spark, d):
    r = views.records(spark, d)
    return A.pending(r.select("id", "lang"), r.where("doc_id % 3 = 0"), ["id", "lang"])


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'fixed ' || doc_id ELSE source END AS source, doc_id % 50 = 0 AS is_fixed FROM documents")
def overlay_fixes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    fixes = docs.where("doc_id % 50 = 0").select("doc_id", F.col("source").alias("original"), F.concat(F.lit("fixed "), F.col("doc_id").cast("string")).alias("fixed"))
    return A.overlaid(docs, fixes, "doc_id", "source")


@query(f"""WITH {RECORDS} SELECT id, CASE WHEN a.lang IS NULL THEN 'only right' WHEN b.lang IS NULL THEN 'only left' ELSE array_to_string(list_filter([CASE WHEN a.category IS DISTINCT FROM b.category THEN 'category' END, CASE WHEN a.finish_reason IS DISTINCT FROM b.finish_reason THEN 'finish_reason' END], lambda x: x IS NOT NULL), ',') END AS difference
FROM (SELECT * FROM records WHERE lang = 'en') a FULL JOIN (SELECT * FROM records WHERE lang = 'es') b USING (id) WHERE a.lang IS NULL OR b.lang IS NULL OR a.category IS DISTINCT FROM b.category OR a.finish_reason IS DISTINCT FROM b.finish_reason""")
def alignment_check(spark, d):
    r = views.records(spark, d)
    return A.misaligned(r.where("lang = 'en'"), r.where("lang = 'es'"), "id", ["category", "finish_reason"])


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', ' ', 'g')) AS norm FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalised("text").alias("norm"))


_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', ' ', 'g'))"
_ITEM_LANG = "['en', 'es', 'fr', 'de'][item_id % 4 + 1]"
_OVER = f"""dn AS (SELECT doc_id, lang, {_NORM} AS t FROM documents), bn AS (SELECT DISTINCT {_ITEM_LANG} AS lang, {_NORM} AS t FROM benchmark), ex AS (SELECT doc_id FROM dn JOIN bn USING (lang, t) WHERE t <> ''),
dg AS (SELECT DISTINCT doc_id, lang, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, lang, w, unnest(generate_series(1, len(w) - 12)) AS i FROM (SELECT doc_id, lang, string_split(t, ' ') AS w FROM dn))),
bg AS (SELECT DISTINCT lang, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 12)) AS i FROM (SELECT lang, string_split(t, ' ') AS w FROM bn))),
ov AS (SELECT doc_id, 'exact' AS reason FROM ex UNION ALL SELECT DISTINCT doc_id, 'ngram' FROM dg JOIN bg USING (lang, g) WHERE doc_id NOT IN (SELECT doc_id FROM ex))"""


def _benchmark(spark, d) -> DataFrame:
    """Benchmark texts, each of one language by its id."""
    pick = F.get(F.array(*map(F.lit, ("en", "es", "fr", "de"))), (F.col("item_id") % 4).cast("int"))
    return table(spark, d, "benchmark").withColumn("lang", pick)


@query(f"WITH {_OVER} SELECT doc_id, reason FROM ov")
def overlap_ngram(spark, d):
    return C.overlaps(table(spark, d, "documents"), _benchmark(spark, d), "doc_id")


@query(f"WITH {_OVER} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ov)")
def without_overlap(spark, d):
    return C.without_overlap(table(spark, d, "documents"), _benchmark(spark, d), "doc_id").select("doc_id", "lang")


@query(f"WITH {_OVER}, f AS (SELECT doc_id, ov.reason, n_chars FROM documents LEFT JOIN ov USING (doc_id)) SELECT 'exact' AS reason, count(*) AS n FROM f WHERE reason = 'exact' HAVING count(*) > 0 UNION ALL SELECT 'ngram', count(*) FROM f WHERE reason = 'ngram' HAVING count(*) > 0 UNION ALL SELECT 'too_long', count(*) FROM f WHERE n_chars > 6000 HAVING count(*) > 0 UNION ALL SELECT 'any', count(*) FROM f WHERE reason IS NOT NULL OR n_chars > 6000 HAVING count(*) > 0")
def overlap_reasons(spark, d):
    docs = table(spark, d, "documents")
    flags = docs.select("doc_id", "n_chars").join(C.overlaps(docs, _benchmark(spark, d), "doc_id"), "doc_id", "left")
    return C.reason_counts(flags, {"exact": F.col("reason") == "exact", "ngram": F.col("reason") == "ngram", "too_long": F.col("n_chars") > 6000})


@query("SELECT CASE WHEN contains(lower(source || ' ' || lang), 'src1') THEN 'one' ELSE lang END AS domain, count(*) AS n FROM documents GROUP BY 1")
def domain_counts(spark, d):
    docs = table(spark, d, "documents")
    named = docs.withColumn("domain", T.domain("lang", F.when(F.lower(F.concat_ws(" ", "source", "lang")).contains("src1"), "math").otherwise(F.col("source"))))
    return C.counts(named.withColumn("domain", F.when(F.col("domain") == "math", "one").otherwise(F.col("domain"))), "domain")


_QUOTA = """st AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source), q0 AS (SELECT *, n * 200 / (SELECT sum(n) FROM st)::DOUBLE AS x FROM st),
q AS (SELECT source, n, first, floor(x)::BIGINT + (row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, first) <= 200 - (SELECT sum(floor(x)) FROM q0))::BIGINT AS quota FROM q0)"""


def _strata(spark, d) -> DataFrame:
    return C.largest_remainder(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), 200)


@query(f"WITH {_QUOTA} SELECT source, n, first, quota FROM q")
def largest_remainder(spark, d):
    return _strata(spark, d)


@query(f"WITH {_QUOTA} SELECT source, doc_id, draw FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('20261007|' || doc_id), doc_id) AS draw FROM documents) JOIN q USING (source) WHERE draw <= quota")
def stratified_draw(spark, d):
    return C.stratified(table(spark, d, "documents").select("source", "doc_id"), _strata(spark, d), "source", "doc_id", 20261007)


@query("SELECT lang, count(*) AS n, round_even(avg(n_chars), 1) AS mean, list_sort(list(n_chars))[count(*) // 2 + 1]::BIGINT AS median, list_sort(list(n_chars))[floor(count(*) * 0.9)::BIGINT + 1]::BIGINT AS p90, max(n_chars)::BIGINT AS most, sum(n_chars)::BIGINT AS sum FROM documents GROUP BY lang")
def describe_lengths(spark, d):
    return C.described(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("long")), "lang", "n_chars")


@query("SELECT lang, round(avg((n_chars <= 1000)::INT), 6) AS within_1000, round(avg((n_chars <= 2000)::INT), 6) AS within_2000, round(avg((n_chars <= 4000)::INT), 6) AS within_4000 FROM documents GROUP BY lang")
def length_shares(spark, d):
    return rounded(C.length_shares(table(spark, d, "documents"), "lang", "n_chars", [1000, 2000, 4000]))


@query("SELECT lang, step, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 8 AS step FROM documents) GROUP BY lang, step")
def step_batches(spark, d):
    return C.batches(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "doc_id", 8).groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query(f"WITH {REPEATS} SELECT item, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM repeats GROUP BY item")
def repeat_stats(spark, d):
    return rounded(S.repeat_stats(views.repeats(spark, d), "item", "value"))


def _base(spark, d) -> str:
    return table(spark, d, "events").agg(F.min("event_type")).first()[0]  # one row


@query(f"""WITH {REPEATS}, m AS (SELECT item, condition, avg(value) AS m FROM repeats GROUP BY ALL), b AS (SELECT item, m AS b FROM m WHERE condition = (SELECT min(event_type) FROM events)),
o AS (SELECT condition, count(*) AS n, count(*) FILTER (value > 2 * b) AS n_over FROM repeats JOIN b USING (item) WHERE condition <> (SELECT min(event_type) FROM events) GROUP BY condition),
s AS (SELECT condition, sum(m) / sum(b) AS r FROM m JOIN b USING (item) WHERE condition <> (SELECT min(event_type) FROM events) GROUP BY condition)
SELECT condition, n, n_over, round(n_over / n::DOUBLE, 6) AS share_over, round(r, 6) AS mean_ratio FROM o JOIN s USING (condition)""")
def over_2x_share(spark, d):
    return rounded(S.over_twice(views.repeats(spark, d), "item", "condition", "value", _base(spark, d)))


@query(f"""WITH {REPEATS}, m AS (SELECT item, avg(value) AS m FROM repeats WHERE repeat > 1 GROUP BY item), o AS (SELECT item, max(value) AS o FROM repeats WHERE repeat = 1 GROUP BY item)
SELECT count(*) AS items, round(avg(o), 6) AS mean_original, round(avg(m), 6) AS mean_corrected, round(sum(o) / sum(m), 6) AS ratio FROM m JOIN o USING (item)""")
def fixes_group(spark, d):
    r = views.repeats(spark, d)
    return rounded(S.corrected_group(r.where("repeat > 1"), r.where("repeat = 1").groupBy("item").agg(F.max("value").alias("value")), "item", "value"))


@query(f"WITH {REPEATS} SELECT item || ':' || condition AS item, list_sort(list(repeat)) = [1, 2, 3, 4, 5] AS complete FROM repeats GROUP BY ALL")
def repeats_complete(spark, d):
    return A.complete_repeats(views.repeats(spark, d).withColumn("item", F.concat_ws(":", F.col("item").cast("string"), "condition")), "item", "repeat", 5)


@query(f"WITH {VECTORS} SELECT count(*) AS positions, count(*) FILTER (list_position(p, list_max(p)) = list_position(q, list_max(q))) AS agree, round(100.0 * count(*) FILTER (list_position(p, list_max(p)) = list_position(q, list_max(q))) / count(*), 6) AS top1_pct FROM vectors")
def vector_top1(spark, d):
    same = V.argmax(F.col("p")) == V.argmax(F.col("q"))
    return rounded(views.vectors(spark, d).agg(F.count("*").alias("positions"), F.count_if(same).alias("agree"), (100 * F.avg(same.cast("double"))).alias("top1_pct")))


_LSM = "list_transform({0}, lambda v: v - list_max({0}) - ln(list_sum(list_transform({0}, lambda u: exp(u - list_max({0}))))))"


@query(f"WITH {VECTORS}, l AS (SELECT position, {_LSM.format('p')} AS lp, {_LSM.format('q')} AS lq FROM vectors) SELECT position, round(list_sum(list_transform(list_zip(lp, lq), lambda z: exp(z[1]) * (z[1] - z[2]))), 6) AS kl FROM l")
def vector_kl(spark, d):
    return rounded(views.vectors(spark, d).select("position", V.log_softmax(F.col("p")).alias("p"), V.log_softmax(F.col("q")).alias("q")).select("position", V.kl(F.col("p"), F.col("q")).alias("kl")))


@query(f"WITH {VECTORS} SELECT position, (list_position(list_transform(list_zip(p, q), lambda z: (z[1] > 0) <> (z[2] > 0)), true) - 1)::BIGINT AS at FROM vectors")
def first_divergence(spark, d):
    sign = lambda c: F.transform(c, lambda x: x > 0)
    return views.vectors(spark, d).select("position", V.first_divergence(sign("p"), sign("q")).alias("at"))


@query(f"WITH {MESSAGES} SELECT row_index, array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), chr(10)) AS text FROM messages")
def user_turns(spark, d):
    return views.messages(spark, d).select("row_index", T.user_turns("messages").alias("text"))


@query(f"""WITH {MESSAGES}, m AS (SELECT row_index, messages[-1].content AS c, len(messages) AS n FROM messages WHERE messages[-1].role = 'assistant')
SELECT a.row_index, a.n::INT AS n_messages, 'plan ' || b.row_index || '</think>' || a.c AS last FROM m a JOIN m b ON b.row_index = a.row_index + 2 - 4 * (a.row_index // 2 % 2)""")
def arm_mix(spark, d):
    """Each conversation answers as it does and reasons as another one: ids 0 and 2, 1 and 3, 4 and 6 and so on."""
    m = views.messages(spark, d).where(F.element_at("messages", -1)["role"] == "assistant")
    head = F.slice("messages", F.lit(1), F.size("messages") - 1)
    with_thought = lambda word: F.concat(head, F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(f"{word} "), F.col("row_index").cast("string"), F.lit("</think>"), F.element_at("messages", -1)["content"]).alias("content"))))
    other = m.select((F.col("row_index") + 2 - 4 * (F.floor(F.col("row_index") / 2) % 2)).alias("row_index"), with_thought("plan").alias("other"))
    both = m.select("row_index", with_thought("think").alias("own")).join(other, "row_index")
    both = both.where(T.one_split("own") & T.one_split("other"))
    return both.select("row_index", F.size("own").alias("n_messages"), F.element_at(T.mixed_arm("own", "other"), -1)["content"].alias("last"))


@query(f"WITH {MESSAGES} SELECT row_index, (list_sum(list_transform(messages, lambda m: (length(m.content) - length(replace(m.content, 'the', ''))) // 3)))::BIGINT AS n FROM messages")
def count_mark(spark, d):
    return views.messages(spark, d).select("row_index", T.count_in_messages("messages", "the").alias("n"))


@query(f"""WITH {RECORDS}, st AS (SELECT category, lang, count(*) AS n FROM records GROUP BY ALL), mf AS (SELECT DISTINCT category, 8::BIGINT AS e FROM records UNION ALL SELECT 'absent', 8),
w AS (SELECT mf.category, count(st.n) AS seen, list_sort(list_filter(['en', 'es', 'fr'], lambda l: NOT list_contains(coalesce(list(st.lang) FILTER (st.n >= mf.e), []), l))) AS lacking FROM mf LEFT JOIN st ON st.category = mf.category GROUP BY mf.category)
SELECT category, CASE WHEN seen = 0 THEN 'not run' WHEN len(lacking) = 0 THEN 'ok' ELSE 'incomplete' END AS status, array_to_string(lacking, ',') AS missing FROM w""")
def table_status(spark, d):
    r = views.answers(spark, d)
    manifest = r.select("category").distinct().unionByName(spark.createDataFrame([("absent",)], "category string")).withColumn("expected_n", F.lit(8).cast("long"))
    return A.table_status(r.groupBy("category", "lang").agg(F.count("*").alias("n")), manifest, "category", ["en", "es", "fr"])


@query(f"WITH {RECORDS} SELECT id, lang, position FROM (SELECT id, lang, row_number() OVER (ORDER BY (id IN (SELECT id FROM records WHERE doc_id % 7 = 0))::INT DESC, id, list_position(['en', 'es', 'fr', 'de'], lang)) AS position FROM records)")
def interleave_order(spark, d):
    r = views.records(spark, d)
    return C.interleaved(r.select("id", "lang"), r.where("doc_id % 7 = 0"), "id", "lang", ["en", "es", "fr", "de"])


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def first_n(spark, d):
    return C.first_by(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 5)


@query("SELECT lang, source, sum(n_chars)::BIGINT AS sum, round(sum(n_chars)::DOUBLE / sum(sum(n_chars)) OVER (PARTITION BY lang)::DOUBLE, 6) AS share FROM documents GROUP BY lang, source")
def share_of_total(spark, d):
    return rounded(C.share_of_total(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("long")), "lang", "source", "n_chars"))


@query("SELECT lang, round_even(sum(n_chars)::DOUBLE / (SELECT sum(n_chars)::DOUBLE FROM documents WHERE lang = 'en'), 3) AS ratio FROM documents GROUP BY lang")
def length_ratio(spark, d):
    return C.length_ratio(table(spark, d, "documents"), "lang", "n_chars", "en")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def latest_value(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return A.latest(e, "user_id", "value", "at").select("user_id", "value", F.col("at.ts").alias("ts"))


@query(f"WITH {RECORDS} SELECT id, lang, 'a' AS side FROM records WHERE doc_id % 10 = 1 UNION ALL SELECT id, lang, 'b' FROM records WHERE doc_id % 10 = 2")
def key_difference(spark, d):
    r = views.records(spark, d)
    return A.key_difference(r.where("doc_id % 10 <> 2"), r.where("doc_id % 10 <> 1"), ["id", "lang"])


@query("SELECT n_nationkey AS position, n_name AS name, n_regionkey AS region, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS other_n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def zip_join(spark, d):
    """Nations that have suppliers beside their number; both sides must have the same nations and name the same region."""
    nation = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    served = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = served.groupBy(F.col("s_nationkey").alias("position"), F.col("r_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return C.zipped(nation, counts, "position", ["region"], ["n"])


@query("SELECT part.p_partkey AS item, list_filter([p_name, nullif(p_name, p_name), p_type], lambda o: o IS NOT NULL AND trim(o) <> '')[2] AS second, 'B' AS gold FROM part")
def compact_options(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array("p_name", F.lit(None).cast("string"), "p_type").alias("options"))
    return p.select(F.col("p_partkey").alias("item"), F.get(T.compacted("options"), F.lit(1)).alias("second"), T.compacted_gold("options", F.lit(2)).alias("gold"))


@query("SELECT n_nationkey AS item, 'Q: ' || n_name || chr(10) || 'A. ' || n_name || chr(10) || 'B. ' || r_name AS prompt FROM nation JOIN region ON n_regionkey = r_regionkey")
def prompt_build(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_nationkey").alias("item"), T.choice_prompt(F.col("n_name"), F.array("n_name", "r_name"), "Q: {question}\n{options}").alias("prompt"))


@query(f"""WITH {RECORDS}, w AS (SELECT id FROM records WHERE lang = 'en' AND id % 2 = 0) SELECT lang, count(*) FILTER (id IN (SELECT id FROM w)) AS wanted, (SELECT count(*) FROM w WHERE id NOT IN (SELECT id FROM records r2 WHERE r2.lang = r.lang)) AS missing FROM records r GROUP BY lang""")
def id_subset(spark, d):
    r = views.records(spark, d)
    wanted = r.where("lang = 'en' AND id % 2 = 0").select("id")
    n = wanted.agg(F.count("*").alias("all"))
    have = r.join(wanted.withColumn("hit", F.lit(1)), "id", "left").groupBy("lang").agg(F.count("hit").alias("wanted"))
    return have.crossJoin(F.broadcast(n)).select("lang", "wanted", (F.col("all") - F.col("wanted")).alias("missing"))  # one row


@query("SELECT b, c, round(" + _TAIL + ", 6) AS p FROM (SELECT n_nationkey::BIGINT AS b, (n_nationkey * 7 % 25)::BIGINT AS c FROM nation)")
def mcnemar_grid(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("b"), (F.col("n_nationkey") * 7 % 25).cast("long").alias("c"))
    return n.select("b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"WITH {RECORDS}, {_DETECT} SELECT doc_id, detected FROM det")
def detect_lang(spark, d):
    return views.answers(spark, d).select("doc_id", T.detect_language("content").alias("detected"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}]+|[0-9]+|[^\\s\\p{L}0-9]'))::BIGINT AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.token_count(F.col("text")).alias("tokens"))


# the places of each stretch of 60 characters, taken from the left; what is carried along is 2**32 times the places taken, plus the last of them
_LOOPS = """pl AS (SELECT doc_id, list(i ORDER BY i) AS ps FROM (SELECT doc_id, i, substr(text, i, 60) AS s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 59)) AS i FROM documents WHERE length(text) >= 300)) GROUP BY doc_id, s HAVING count(*) >= 5),
lp AS (SELECT DISTINCT doc_id FROM pl WHERE list_reduce(list_prepend(4294967296 + ps[1], ps[2:]), lambda a, x: CASE WHEN x - a % 4294967296 >= 60 THEN (a // 4294967296 + 1) * 4294967296 + x ELSE a END) // 4294967296 >= 5)"""


@query(f"WITH {_LOOPS} SELECT doc_id, doc_id IN (SELECT doc_id FROM lp) AS looping FROM documents")
def looping(spark, d):
    return table(spark, d, "documents").select("doc_id", udfs.looping(F.col("text")).alias("looping"))


@query(f"""WITH {RECORDS}, {_LOOPS} SELECT lang, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(prompt_tokens), 6) AS mean_prompt, round(avg(completion_tokens), 6) AS mean_completion,
  round(avg(prompt_tokens + completion_tokens), 6) AS mean_total, count(*) FILTER (finish_reason = 'length') AS n_length, count(*) FILTER (trim(coalesce(content, ''), E' \\n\\t') = '') AS n_empty, count(*) FILTER (doc_id IN (SELECT doc_id FROM lp)) AS n_looping,
  count(*) FILTER (correct AND finish_reason = 'stop') AS n_correct_and_stop, sum(completion_tokens)::BIGINT AS completion_tokens_all,
  round(1000.0 * (count(*) FILTER (correct AND finish_reason = 'stop'))::DOUBLE / sum(completion_tokens)::DOUBLE, 6) AS success_per_1k FROM records GROUP BY lang""")
def efficiency_looping(spark, d):
    """The efficiency row with the count of looping answers."""
    r = views.answers(spark, d)
    return rounded(S.efficiency(r.withColumn("_loop", udfs.looping(F.col("content"))), looping=F.col("_loop")))


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id, source FROM documents WHERE n_chars > 1000) UNION (SELECT doc_id, source FROM documents WHERE lang = 'es' EXCEPT SELECT doc_id, source FROM documents WHERE n_chars > 500)")
def set_operators(spark, d):
    docs = table(spark, d, "documents")
    pick = lambda w: docs.where(w).select("doc_id", "source")
    return pick("lang = 'en'").intersect(pick("n_chars > 1000")).union(pick("lang = 'es'").exceptAll(pick("n_chars > 500"))).distinct()


@query(f"""WITH {RECORDS}, a AS (SELECT id, category, n_chars FROM records WHERE lang = 'en' AND id % 5 <> 0), b AS (SELECT id, category, CASE WHEN id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM records WHERE lang = 'en' AND id % 6 <> 0)
SELECT id, CASE WHEN a.category IS NULL THEN 'only right' WHEN b.category IS NULL THEN 'only left' ELSE 'n_chars' END AS difference FROM a FULL JOIN b USING (id) WHERE a.category IS NULL OR b.category IS NULL OR a.n_chars <> b.n_chars""")
def structural_diff(spark, d):
    r = views.records(spark, d).where("lang = 'en'").select("id", "category", "n_chars")
    other = r.where("id % 6 <> 0").withColumn("n_chars", F.when(F.col("id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return A.misaligned(r.where("id % 5 <> 0"), other, "id", ["category", "n_chars"])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS lang, source FROM documents")
def enrichment(spark, d):
    docs = table(spark, d, "documents")
    some = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return A.enriched(some, docs.select("doc_id", F.col("source").alias("lang"), "source"), ["doc_id"], ["lang", "source"])


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars = length(text) OR (n_chars IS NULL AND text IS NULL)) AS matches, min(CASE WHEN n_chars IS DISTINCT FROM length(text) THEN length(text) END)::BIGINT AS first_miss FROM documents GROUP BY lang")
def token_match(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").cast("long").alias("got"), F.length("text").cast("long").alias("want"))
    return A.match_counts(docs, "lang", "got", "want")


@query(f"""WITH {MESSAGES}, t AS (SELECT (row_number() OVER (ORDER BY row_index) - 1) // 8 AS step, length(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS tokens, length(messages[-1].content) AS loss FROM messages)
SELECT step, sum(tokens)::BIGINT AS tokens, round(sum(loss)::DOUBLE / sum(tokens)::DOUBLE, 6) AS loss_share FROM t GROUP BY step""")
def loss_share(spark, d):
    m = views.messages(spark, d).withColumn("all", F.lit(1))
    m = m.select("all", "row_index", F.length(T.rendered_chat("messages")).cast("long").alias("tokens"), F.length(F.element_at("messages", -1)["content"]).cast("long").alias("loss"))
    return rounded(C.step_totals(C.batches(m, [], "row_index", 8), "step", "tokens", "loss"))
