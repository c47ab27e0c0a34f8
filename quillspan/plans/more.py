"""Registered queries of sources, sinks, figures of runs and orderings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import bytepair, stats, udfs
from quillspan.functions import text as T
from quillspan.functions import vectors as V
from quillspan.operators import audit as A
from quillspan.operators import corpus as C
from quillspan.operators import language as L
from quillspan.operators import scorecard as S
from quillspan.plans import views
from quillspan.plans.queries import ORACLES, QUERIES, query, rounded  # noqa: F401
from quillspan.plans.views import MESSAGES, RECORDS, REPEATS, VECTORS, table
from quillspan.sources import answers, readers, rowgroups, sinks
from quillspan.streaming import logs


# Logs written by our own sink and read again.
_LOG = """lg AS (SELECT doc_id AS id, lang, source AS gold, text AS content, 'run' || doc_id % 3 AS tag, doc_id % 50 AS prompt_tokens, n_chars // 4 AS completion_tokens FROM documents)"""


def _log(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    usage = F.when(F.col("doc_id") % 11 != 0, F.struct((F.col("doc_id") % 50).alias("prompt_tokens"), F.floor(F.col("n_chars") / 4).cast("long").alias("completion_tokens")))
    return docs.select(F.col("doc_id").alias("id"), "lang", F.col("source").alias("gold"), F.col("text").alias("content"), F.concat(F.lit("run"), (F.col("doc_id") % 3).cast("string")).alias("tag"), usage.alias("usage"))


_READ = "SELECT id, lang, gold, tag, length(content)::BIGINT AS chars, CASE WHEN id % 11 = 0 THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN id % 11 = 0 THEN 0 ELSE completion_tokens END::BIGINT AS completion_tokens FROM lg"


def _shown(df: DataFrame) -> DataFrame:
    return S.flat_usage(df).select("id", "lang", "gold", "tag", F.length("content").cast("long").alias("chars"), "prompt_tokens", "completion_tokens")


@query(f"WITH {_LOG} {_READ}")
def log_roundtrip(spark, d):
    """Appended in two parts, read strictly; missing usage counts as no tokens."""
    path, rows = views.scratch(spark, "log"), _log(spark, d)
    sinks.append_jsonl(rows.where("id % 2 = 0"), path)
    sinks.append_jsonl(rows.where("id % 2 = 1"), path)
    return _shown(readers.records(spark, path))


@query(f"WITH {_LOG} {_READ}")
def log_unbroken(spark, d):
    """Read line by line, no blank line allowed."""
    path = views.scratch(spark, "log")
    sinks.jsonl(_log(spark, d), path)
    return _shown(readers.records_unbroken(spark, path))


@query(f"WITH {_LOG} {_READ} WHERE id % 5 <> 0 AND id % 13 <> 0")
def log_tolerant(spark, d):
    """Broken lines, blank lines and records without a language are passed over."""
    path, rows = views.scratch(spark, "log"), _log(spark, d)
    line = F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "lang"), F.when(F.col("id") % 13 != 0, F.col("lang")).alias("lang")))
    broken = F.when(F.col("id") % 10 == 0, F.substring(line, 1, 20)).when(F.col("id") % 10 == 5, "").otherwise(line)
    rows.select(broken.alias("value")).write.text(path)
    return _shown(readers.records_tolerant(spark, path))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def csv_roundtrip(spark, d):
    """Written as gzip CSV with a header in every part, read with a schema."""
    path = views.scratch(spark, "csv")
    sinks.csv(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path, gzip=True)
    return readers.csv(spark, path, "doc_id long, lang string, n_chars long").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def jsonl_partitioned(spark, d):
    """JSON lines in a folder for each language."""
    path = views.scratch(spark, "jsonl")
    sinks.jsonl(table(spark, d, "documents").select("lang", "source", "doc_id"), path, by="lang")
    return spark.read.schema("source string, doc_id long, lang string").json(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def json_document(spark, d):
    """A result table as one JSON array, published and read as a document."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    path = views.scratch(spark, "document")
    spark.createDataFrame([(sinks.document(rows),)], "value string").coalesce(1).write.text(path)
    return readers.document(spark, path, "id long, name string, region long")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 9 = 4")
def id_list_filter(spark, d):
    """Ids written as a list, read again, all of them required."""
    docs, path = table(spark, d, "documents").select("doc_id", "lang"), views.scratch(spark, "ids")
    sinks.ids(docs.where("doc_id % 9 = 4"), "doc_id", path)
    return A.only_ids(docs, readers.id_list(spark, path).withColumnRenamed("id", "doc_id"), "doc_id", whole=True)


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 4 AND doc_id % 2 = 0")
def missing_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return A.missing_ids(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 9 = 4"), "doc_id")


@query("SELECT count(*)::INT AS pairs, round(max(n_chars) / 1000.0, 3)::DOUBLE AS ratio, 1.15::DOUBLE AS threshold, NULL::VARCHAR AS missing FROM documents")
def report_scrape(spark, d):
    """Figures read back from a text report."""
    most = table(spark, d, "documents").agg(F.count("*").alias("n"), F.max("n_chars").alias("m"))
    text = F.format_string("gate report\npairs %d\nratio es/en: %.3f (threshold 1.15)\n", "n", F.col("m") / 1000)
    path = views.scratch(spark, "report")
    most.select(text.alias("value")).coalesce(1).write.text(path)
    return readers.scrape(spark, path, {"pairs": (r"pairs (\d+)", "int"), "ratio": (r"ratio es/en: ([\d.]+)", "double"), "threshold": (r"threshold ([\d.]+)", "double"), "missing": (r"verdict: (\w+)", "string")})


@query("SELECT lower(r_name) AS tag, n_nationkey::VARCHAR AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def headed_blocks(spark, d):
    """Headers of a report with the last line of JSON under each; those without one are passed over."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    header = F.format_string("[%s id=%d", F.regexp_replace(F.lower("r_name"), " ", "_"), "n_nationkey")
    body = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit('ES: {"name": "an earlier one"}\nwords\nES: '), F.to_json(F.struct(F.col("n_name").alias("name"))), F.lit("\n\nmore words"))).otherwise("nothing here")
    path = views.scratch(spark, "blocks")
    n.select(F.concat(header, F.lit("]\nsome words\n"), body).alias("value")).write.text(path)
    got = readers.headed_blocks(spark, path, r"\[(\w+) id=(\d+)\]", ["tag", "id"], r"ES: (\{.*\})", "name string")
    return got.select(F.regexp_replace("tag", "_", " ").alias("tag"), "id", F.col("value.name").alias("name"))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS id FROM documents")
def hub_numbered(spark, d):
    """A local copy of a dataset, columns picked and renamed, ids by position."""
    path = views.scratch(spark, "hub")
    table(spark, d, "documents").write.parquet(path)
    return readers.hub(spark, path, "doc_id", {"doc_id": "doc_id", "lang": "lang"})


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, d):
    return readers.first_rows(spark, f"{d}/documents.parquet", ["doc_id", "source"], "doc_id", 50)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_source(spark, d):
    """Built once, then read from its place."""
    path = views.scratch(spark, "cache")
    build = lambda: table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    readers.cached(spark, path, build)
    return readers.cached(spark, path, lambda: build().where("false"))


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, sum(length(n_name) + 1)::BIGINT AS bytes FROM nation")
def file_hash(spark, d):
    """The hash of a file that was written in order."""
    path = views.scratch(spark, "hashed")
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).agg(F.sum("length").alias("bytes"))
    return readers.hashes(spark, f"{path}/part-*").select("sha256").crossJoin(F.broadcast(size))  # one row


_TABLE = "'| region | nations |' || chr(10) || '|---|---:|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name)"
_REGIONS = "rg AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)"


def _regions(spark, d) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations")).orderBy("region")


@query(f"WITH {_REGIONS}, t AS (SELECT string_split({_TABLE}, chr(10)) AS ls FROM rg) SELECT i AS number, ls[i] AS line FROM t, generate_series(1, len(ls)) AS g(i)")
def markdown_lines(spark, d):
    """A result table in Markdown, a row a line."""
    lines = sinks.markdown(_regions(spark, d), {"nations"}).rstrip("\n").split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "number long, line string")


@query(f"WITH {_REGIONS}, t AS (SELECT {_TABLE} AS b FROM rg) SELECT 'before' || chr(10) || '<!-- regions:start -->' || chr(10) || b || chr(10) || '<!-- regions:end -->' || chr(10) || 'after, rate 5' AS text FROM t")
def marked_block(spark, d):
    """A report whose marked block is replaced, and a figure in it exactly once."""
    old = "before\n<!-- regions:start -->\nold\n<!-- regions:end -->\nafter, rate 7"
    block = sinks.markdown(_regions(spark, d), {"nations"})
    return spark.createDataFrame([(sinks.replaced_once(sinks.spliced(old, "regions", block), r"rate \d", "rate 5"),)], "text string")


@query(f"WITH {_REGIONS}, t AS (SELECT [lpad('region', 12, ' ') || lpad('nations', 9, ' ')] || list(lpad(r_name, 12, ' ') || lpad(n::VARCHAR, 9, ' ') ORDER BY r_name) AS ls FROM rg) SELECT i AS number, ls[i] AS line FROM t, generate_series(1, len(ls)) AS g(i)")
def fixed_lines(spark, d):
    """The same as a console table."""
    lines = sinks.fixed_width(_regions(spark, d), {"region": 12, "nations": 9}).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "number long, line string")


# Scores by benchmark.
_SAID = "CASE doc_id % 4 WHEN 0 THEN 'so it is 1,234' WHEN 1 THEN 'I take (C)' WHEN 2 THEN '**Answer:** D' ELSE 'no idea' END"
_BENCH = "['mgsm', 'belebele', 'proxlite'][doc_id % 3 + 1]"
_SCORES = f"""sc AS (SELECT doc_id, {_BENCH} AS bench, doc_id % 4 AS k FROM documents),
pt AS (SELECT *, CASE WHEN bench = 'mgsm' THEN k = 0 WHEN bench = 'belebele' THEN k IN (1, 2) ELSE k = 2 END AS parsed, CASE WHEN bench = 'mgsm' THEN k = 0 WHEN bench = 'belebele' THEN k = 1 ELSE k = 2 END AS correct FROM sc)"""


@query(f"WITH {_SCORES} SELECT bench, count(*) AS n, count(*) FILTER (correct) AS n_correct, count(*) FILTER (NOT parsed) AS n_unparsed, round(100.0 * count(*) FILTER (NOT parsed) / count(*), 6) AS pct_unparsed FROM pt GROUP BY bench")
def scored_by_bench(spark, d):
    """Answers scored by the rule of each row's benchmark."""
    said = F.when(F.col("doc_id") % 4 == 0, "so it is 1,234").when(F.col("doc_id") % 4 == 1, "I take (C)").when(F.col("doc_id") % 4 == 2, "**Answer:** D").otherwise("no idea")
    bench = F.get(F.array(*map(F.lit, ("mgsm", "belebele", "proxlite"))), (F.col("doc_id") % 3).cast("int"))
    gold = F.when(bench == "mgsm", "1234").when(bench == "belebele", "C").otherwise("D")
    rows = table(spark, d, "documents").select(bench.alias("bench"), said.alias("content"), gold.alias("gold"))
    scores = S.with_unparsed(S.scored(rows)).groupBy("bench").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.count_if("unparsed").alias("n_unparsed"), (100 * stats.share(F.col("unparsed"))).alias("pct_unparsed"))
    return rounded(scores)


_FIGURES = """fg AS (SELECT *, CASE WHEN id % 5 > 0 THEN completion_tokens // 2 END AS reasoning_tokens, CASE WHEN id % 4 > 0 THEN completion_tokens - completion_tokens // 2 END AS answer_tokens,
  30 + id % 17 + 0.25 AS pps, CASE WHEN id % 3 > 0 THEN 10 + id % 4 ELSE 0 END AS drafted, CASE WHEN id % 3 > 0 THEN 5 + id % 4 ELSE 0 END AS accepted, id % 8 = 0 AS unparsed FROM records)"""


def _figures(spark, d) -> DataFrame:
    i, c = F.col("id"), F.col("completion_tokens")
    some = lambda cond, v: F.when(cond, v)
    return views.records(spark, d).withColumns(
        {
            "reasoning_tokens": some(i % 5 > 0, F.floor(c / 2)),
            "answer_tokens": some(i % 4 > 0, c - F.floor(c / 2)),
            "predicted_per_second": (30 + i % 17).cast("double") + 0.25,
            "draft_n": some(i % 3 > 0, 10 + i % 4),
            "draft_n_accepted": some(i % 3 > 0, 5 + i % 4),
            "unparsed": i % 8 == 0,
        }
    )


@query(f"""WITH {RECORDS}, {_FIGURES} SELECT lang, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 6) AS accuracy, median(completion_tokens)::DOUBLE AS median_completion, median(reasoning_tokens)::DOUBLE AS median_reasoning,
  median(pps)::DOUBLE AS median_per_second, round(sum(accepted)::DOUBLE / sum(drafted)::DOUBLE, 6) AS acceptance, round(100 * avg((finish_reason = 'length')::INT), 6) AS pct_length, round(100 * avg(unparsed::INT), 6) AS pct_unparsed FROM fg GROUP BY lang""")
def full_scorecard(spark, d):
    return rounded(S.full_scorecard(_figures(spark, d)))


@query(f"WITH {RECORDS}, {_FIGURES} SELECT lang, round(sum(accepted)::DOUBLE / sum(drafted)::DOUBLE, 6) AS acceptance, median(pps)::DOUBLE AS median_per_second FROM fg GROUP BY lang")
def draft_acceptance(spark, d):
    return rounded(S.draft_acceptance(_figures(spark, d)))


@query(f"""WITH {RECORDS}, {_FIGURES}, s AS (SELECT lang, count(*) AS n, avg(reasoning_tokens) AS r, avg(answer_tokens) AS a FROM fg WHERE reasoning_tokens IS NOT NULL AND answer_tokens IS NOT NULL GROUP BY lang)
SELECT s.lang, s.n, round(s.r, 6) AS reason, round(s.a, 6) AS answer, round(s.r + s.a, 6) AS total, round(s.r / e.r, 6) AS reason_ratio, round(s.a / e.a, 6) AS answer_ratio, round((s.r + s.a) / (e.r + e.a), 6) AS total_ratio FROM s LEFT JOIN s e ON e.lang = 'en'""")
def token_split(spark, d):
    return rounded(S.token_split(_figures(spark, d)))


_TAIL2 = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


@query(f"""WITH {RECORDS}, o AS (SELECT id, lang, (correct AND id % 7 <> 0) OR id % 19 = 0 AS was FROM records WHERE id % 4 <> 0),
p AS (SELECT r.lang, count(*) AS n, count(*) FILTER (was AND correct) AS both_, count(*) FILTER (NOT was AND NOT correct) AS neither, count(*) FILTER (was AND NOT correct) AS b, count(*) FILTER (correct AND NOT was) AS c, avg(was::INT) AS x, avg(correct::INT) AS y FROM records r JOIN o ON r.id = o.id AND r.lang = o.lang GROUP BY r.lang)
SELECT lang, n, both_ AS "both", neither, b AS base_only, c AS this_only, round(x, 6) AS base_accuracy, round(y, 6) AS accuracy, round({_TAIL2}, 6) AS p_value FROM p""")
def against_baseline(spark, d):
    r = views.records(spark, d)
    was = r.where("id % 4 <> 0").withColumn("correct", (F.col("correct") & (F.col("id") % 7 != 0)) | (F.col("id") % 19 == 0))
    return rounded(S.against_baseline(r, was))


@query(f"""WITH {REPEATS} SELECT item, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, count(*) FILTER (event_id % 3 = 0) AS n_correct, count(*) FILTER (event_id % 10 = 0) AS n_length, count(*) FILTER (event_id % 3 = 0) || '/' || count(*) AS correct_of FROM repeats GROUP BY item""")
def repeat_outcomes(spark, d):
    r = views.repeats(spark, d).withColumns({"correct": F.col("event_id") % 3 == 0, "finish_reason": F.when(F.col("event_id") % 10 == 0, "length").otherwise("stop")})
    return rounded(S.repeat_outcomes(r, "item", "value"))


@query(f"""WITH {REPEATS}, o AS (SELECT item, condition, value FROM repeats WHERE repeat = 1), b AS (SELECT item, value AS b FROM o WHERE condition = (SELECT min(event_type) FROM events))
SELECT condition, count(*) AS n, count(*) FILTER (value > 2 * b) AS n_over FROM o JOIN b USING (item) WHERE condition <> (SELECT min(event_type) FROM events) GROUP BY condition""")
def originals_over(spark, d):
    base = table(spark, d, "events").agg(F.min("event_type")).first()[0]  # one row
    return S.originals_over_twice(views.repeats(spark, d).where("repeat = 1"), "item", "condition", "value", base)


# Statistics of lengths.
@query("SELECT lang, count(n_chars) AS n, median(n_chars)::DOUBLE AS median, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most, sum(n_chars)::BIGINT AS sum FROM documents GROUP BY lang")
def describe_middle(spark, d):
    return C.described_middle(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("long")), "lang", "n_chars")


@query("""SELECT lang, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1]::BIGINT AS median, list_sort(list(n_chars))[floor(count(*) * 0.9::DOUBLE)::BIGINT + 1]::BIGINT AS p90, list_sort(list(n_chars))[floor(count(*) * 0.99::DOUBLE)::BIGINT + 1]::BIGINT AS p99, max(n_chars)::BIGINT AS most,
  count(*) FILTER (n_chars <= 1000) AS n_within_1000, count(*) FILTER (n_chars <= 4000) AS n_within_4000, round(avg((n_chars <= 1000)::INT), 6) AS within_1000, round(avg((n_chars <= 4000)::INT), 6) AS within_4000 FROM documents GROUP BY lang""")
def length_quantiles(spark, d):
    return rounded(C.length_quantiles(table(spark, d, "documents").withColumn("n_chars", F.col("n_chars").cast("long")), "lang", "n_chars", [1000, 4000]))


@query("""WITH f AS (SELECT CASE WHEN NOT (text IS NOT NULL AND trim(text) <> '') THEN 0 WHEN NOT (n_chars <= 6000) THEN 1 WHEN lang = 'de' THEN 2 ELSE 3 END AS fate FROM documents), s AS (SELECT unnest([0, 1, 2]) AS number, unnest(['has text', 'fits', 'language']) AS step)
SELECT number::INT AS number, step, (SELECT count(*) FROM f WHERE fate = number) AS dropped, (SELECT count(*) FROM f WHERE fate > number) AS "left" FROM s""")
def drop_accounting(spark, d):
    blank = F.col("text").isNotNull() & (F.trim("text") != "")
    return C.drop_accounting(table(spark, d, "documents"), {"has text": blank, "fits": F.col("n_chars") <= 6000, "language": F.col("lang") != "de"})


@query("SELECT doc_id FROM documents WHERE greatest(n_chars, n_chars // 2 + 900, length(source) * 400) <= 2400")
def length_cap(spark, d):
    """Documents all of whose arms fit; none is cut short."""
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("a"), (F.floor(F.col("n_chars") / 2) + 900).alias("b"), (F.length("source") * 400).cast("long").alias("c"))
    return C.within_all(rows, ["a", "b", "c"], 2400).select("doc_id")


# Seats, draws and orders.
_SEATS = """cs AS (SELECT source AS category, count(*) AS size, count(*) FILTER (doc_id % 17 = 0) AS kept FROM documents GROUP BY source),
q AS (SELECT *, greatest(1, kept) AS floor_, greatest(120, sum(greatest(1, kept)) OVER ()) AS total, sum(size) OVER () AS every FROM cs),
sh AS (SELECT *, total * size / every::DOUBLE AS share FROM q), fs AS (SELECT *, greatest(floor_, floor(share)::BIGINT) AS first_, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, category) AS rank FROM sh),
gp AS (SELECT *, total - sum(first_) OVER () AS gap FROM fs),
st AS (SELECT category, gap, unnest(generate_series(1, CASE WHEN gap > 0 THEN least(size - first_, gap) ELSE least(first_ - floor_, -gap) END::BIGINT)) AS turn, CASE WHEN gap > 0 THEN rank ELSE -rank END AS place FROM gp WHERE gap <> 0),
mv AS (SELECT category, sum(sign(gap))::BIGINT AS moved FROM (SELECT *, row_number() OVER (ORDER BY turn, place) AS k FROM st) WHERE k <= abs(gap) GROUP BY category),
seats AS (SELECT gp.category, size, kept, first_ + coalesce(moved, 0) AS seats FROM gp LEFT JOIN mv USING (category))"""


@query(f"WITH {_SEATS} SELECT category, size, kept, seats::BIGINT AS seats FROM seats")
def apportioned(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("category"), "doc_id")
    return C.apportioned(docs, "category", "doc_id", 120, docs.where("doc_id % 17 = 0").select("doc_id"))


@query(f"""WITH {_SEATS} SELECT category, doc_id FROM (SELECT source AS category, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 17 = 0) DESC, md5('7|' || doc_id), doc_id) AS r FROM documents) JOIN seats USING (category) WHERE r <= seats""")
def stratified_subset(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("category"), "doc_id")
    return C.chosen(docs, "category", "doc_id", 120, 7, docs.where("doc_id % 17 = 0").select("doc_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS position FROM documents")
def shuffled(spark, d):
    """A seeded shuffle of all rows, with their places."""
    rows = C.shuffled(table(spark, d, "documents").select("doc_id"), 42, "doc_id")
    return C.positions(rows.withColumn("_k", A.draw_order(42, "doc_id")[0]), [], ["_k", "doc_id"]).drop("_k")


@query("SELECT lang, count(*) AS n, row_number() OVER (ORDER BY (lang <> 'es')::INT, lang) AS position FROM documents GROUP BY lang")
def sorted_languages(spark, d):
    """Spanish first, then by name: the place that each language takes."""
    rows = C.sorted_by(C.counts(table(spark, d, "documents"), "lang"), "lang", ["es"]).collect()  # a row a language
    return spark.createDataFrame([(r["lang"], r["n"], i) for i, r in enumerate(rows, 1)], "lang string, n long, position long")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7")
def counts_descending(spark, d):
    return C.limited(C.counts(table(spark, d, "documents"), "source"), [F.desc("n"), "source"], 7)


@query("SELECT doc_id, lang FROM documents WHERE lang <> 'fr' ORDER BY doc_id DESC LIMIT 33")
def limited(spark, d):
    """The global limit of a run: the first of what is pending."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return C.limited(A.pending(docs, docs.where("lang = 'fr'"), ["doc_id"]), [F.desc("doc_id")], 33)


# Rows and texts.
@query("""SELECT doc_id, '{"id":' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ',"lang":"' || lang || '"' ELSE '' END || ',"tokens":{"all":' || (n_chars // 4) || '}}' AS line FROM documents""")
def record_lines(spark, d):
    """Records built from columns and written as JSON; keys without a value are left out."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"), F.struct(F.floor(F.col("n_chars") / 4).cast("long").alias("all")).alias("tokens"))
    return docs.select("doc_id", T.present_json("id", "lang", "tokens").alias("line"))


@query("SELECT ps_key, n FROM (SELECT l_orderkey || ':' || l_linenumber AS ps_key, count(*) AS n FROM lineitem GROUP BY 1)")
def composite_keys(spark, d):
    rows = table(spark, d, "lineitem").select(T.composite_key("l_orderkey", "l_linenumber").alias("ps_key"))
    return rows.groupBy("ps_key").agg(F.count("*").alias("n"))


@query("SELECT source, lang, CASE WHEN b <> 0 THEN printf('%+.2f%%', (a / b - 1) * 100) END AS change FROM (SELECT source, lang, sum(n_chars)::DOUBLE AS a, sum(sum(n_chars)) OVER (PARTITION BY source)::DOUBLE / count(*) OVER (PARTITION BY source) AS b FROM documents GROUP BY source, lang)")
def signed_change(spark, d):
    """Characters of a language against the mean of its source's languages."""
    sums = table(spark, d, "documents").groupBy("source", "lang").agg(F.sum("n_chars").cast("double").alias("a"))
    mean = sums.groupBy("source").agg((F.sum("a") / F.count("*")).alias("b"))
    return sums.join(mean, "source").select("source", "lang", stats.change_percent(F.col("a"), F.col("b")).alias("change"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Solve: ' WHEN 'es' THEN 'Resuelve: ' ELSE 'any: ' END || coalesce(text, '') AS prompt FROM documents")
def localised_prompt(spark, d):
    lead = T.localised("lang", {"en": "Solve: {question}", "es": "Resuelve: {question}"}, "any: {question}")
    return table(spark, d, "documents").select("doc_id", F.replace(lead, F.lit("{question}"), F.coalesce("text", F.lit(""))).alias("prompt"))


@query("SELECT doc_id, coalesce(length(text), 0)::BIGINT AS chars FROM documents")
def chars(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chars("text").alias("chars"))


@query(f"""WITH {MESSAGES} SELECT row_index, length(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), ''))::BIGINT AS chars,
  len(regexp_extract_all(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), ''), '[\\p{{L}}]+|[0-9]+|[^\\s\\p{{L}}0-9]'))::BIGINT AS tokens FROM messages""")
def chat_lengths(spark, d):
    """Rendered conversations with their lengths in characters and in tokens of the proxy."""
    m = views.messages(spark, d).select("row_index", T.rendered_chat("messages").alias("t"))
    return m.select("row_index", T.chars("t").alias("chars"), udfs.token_count(F.col("t")).alias("tokens"))


@query(f"""WITH {MESSAGES}, w AS (SELECT row_index, len(messages) AS n, list_transform(messages, lambda m: length(m.content)) AS ls FROM messages)
SELECT row_index, list_sum(list_transform(generate_series(1, n), lambda i: CASE WHEN i = n AND ls[i] > 0 THEN i ELSE -100 END))::BIGINT AS total, n::INT AS n FROM w""")
def loss_labels(spark, d):
    """Message numbers as token ids, message places as offsets: only the last message carries loss."""
    m = views.messages(spark, d).select("row_index", F.transform("messages", lambda x: F.length(x["content"]).cast("long")).alias("ls"))
    ends = F.transform("ls", lambda x, i: F.aggregate(F.slice("ls", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    m = m.withColumn("ends", ends).withColumn("n", F.size("ls"))
    spans = F.zip_with("ends", "ls", lambda e, x: F.struct((e - x).alias("start"), e.alias("end")))
    m = m.withColumn("ids", F.transform("ls", lambda x, i: (i + 1).cast("long"))).withColumn("spans", spans)
    last = F.element_at("spans", -1)
    labels = T.loss_labels("ids", "spans", F.when(last["end"] > last["start"], last["start"]).otherwise(last["end"] + 1), last["end"])
    return m.select("row_index", F.aggregate(labels, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), "n")


_CHAT = "ch AS (SELECT row_index, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS t FROM messages)"


def _chat_tokens(spark, d) -> DataFrame:
    import public_tokenizers

    chats = views.messages(spark, d).select("row_index", T.rendered_chat("messages").alias("t"))
    return chats.withColumn("tokens", bytepair.tokens(F.col("t"), public_tokenizers.path("byte_bpe_50k.json")))


@query(f"""WITH {MESSAGES}, {_CHAT} SELECT row_index, length(t)::BIGINT AS covered, 0::BIGINT AS gaps,
  CASE WHEN contains(t, '<|im_start|>assistant' || chr(10)) THEN length(string_split(string_split(t, '<|im_start|>assistant' || chr(10))[-1], '<|im_end|>')[1])::BIGINT + 10 ELSE 0 END AS loss_chars FROM ch""")
def token_offsets(spark, d):
    """Whole chats in tokens of a vocabulary: their places cover the text without a gap; the last assistant turn is what carries loss."""
    rows = _chat_tokens(spark, d).withColumn("turn", bytepair.last_turn(F.col("t")))
    gaps = F.aggregate("tokens", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("gaps")), lambda a, x: F.struct(x["end"].alias("at"), (a["gaps"] + F.when(x["start"] > a["at"], 1).otherwise(0)).alias("gaps")))
    return rows.select("row_index", gaps["at"].alias("covered"), gaps["gaps"].alias("gaps"), F.coalesce(F.col("turn.end") - F.col("turn.start"), F.lit(0)).alias("loss_chars"))


@query()
def token_labels(spark, d):
    """Labels of whole chats on tokens: how many tokens, how many carry loss, and a digest of all labels."""
    rows = _chat_tokens(spark, d).withColumn("labels", bytepair.labels(F.col("tokens"), bytepair.last_turn(F.col("t"))))
    return rows.select("row_index", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_loss"), F.md5(F.array_join(F.col("labels").cast("array<string>"), ",")).alias("digest"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, ''), E' \\n\\t') = '' THEN 'none' WHEN text LIKE '%the%' THEN 'en' ELSE 'other' END AS lang FROM documents")
def detector_hook(spark, d):
    """A detector of one's own in place of the heuristic."""
    return table(spark, d, "documents").select("doc_id", udfs.detected(F.col("text"), lambda: lambda t: "en" if "the" in t else None).alias("lang"))


@query("SELECT doc_id, length(text)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL AND text <> '' UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NULL OR text = ''")
def tokenizer_hook(spark, d):
    """A tokenizer of one's own: here each character is a token."""
    return table(spark, d, "documents").select("doc_id", udfs.token_count(F.col("text"), lambda: len).alias("tokens"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN upper(source) || '?' ELSE source END AS question, CASE WHEN doc_id % 4 = 0 THEN source || '|ñ|' || lang ELSE lang || '|' || source END AS options, doc_id % 5 = 0 OR doc_id % 4 = 0 AS is_fixed FROM documents""")
def overlay_fields(spark, d):
    """Fixes of texts and of arrays, from one file, in one pass."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.array("lang", "source").alias("options"))
    line = lambda field, was, now: F.to_json(F.struct(F.lit("b").alias("bench"), "id", F.lit(field).alias("field"), was.alias("original"), now.alias("fixed"))).alias("value")
    texts = items.where("id % 5 = 0").select(line("question", F.col("question"), F.concat(F.upper("question"), F.lit("?"))))
    arrays = items.where("id % 4 = 0").select(line("options", F.col("options"), F.array(F.get("options", F.lit(1)), F.lit("ñ"), F.get("options", F.lit(0)))))
    path = views.scratch(spark, "fixes")
    texts.unionByName(arrays).write.text(path)
    return A.overlaid_fields(items, readers.fixes(spark, path), "id", ["question", "options"]).withColumn("options", F.array_join("options", "|"))


# Languages by trigrams: fitted on four texts in five, scored on all.
_LANGS = ["de", "en", "es", "fr"]
_GRAMS = f"""lt AS (SELECT doc_id, lang, CASE WHEN l = '' THEN '' ELSE ' ' || l || ' ' END AS l FROM (SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'), ' ') AS l FROM documents)),
gr AS MATERIALIZED (SELECT doc_id, lang, substr(l, i, 3) AS gram, count(*) AS k FROM (SELECT doc_id, lang, l, unnest(generate_series(1, length(l) - 2)) AS i FROM lt) GROUP BY ALL),
dr AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id), doc_id) <= {L.TEXTS}),
cn AS (SELECT lang, gram, sum(k) AS n FROM gr WHERE doc_id IN (SELECT doc_id FROM dr) GROUP BY ALL),
tp AS (SELECT DISTINCT gram FROM (SELECT gram FROM cn QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) <= {L.TRIGRAMS})),
tl AS (SELECT lang, sum(n) AS total FROM cn WHERE gram IN (SELECT gram FROM tp) GROUP BY lang),
md AS MATERIALIZED (SELECT tp.gram, tl.lang, ln((coalesce(n, 0) + {L.SMOOTHING}::DOUBLE) / (total + {L.SMOOTHING}::DOUBLE * (SELECT count(*) FROM tp))) AS w FROM tp CROSS JOIN tl LEFT JOIN cn ON cn.gram = tp.gram AND cn.lang = tl.lang),
sc AS (SELECT doc_id, md.lang, sum(k * w) AS s, sum(k) AS known FROM gr JOIN md USING (gram) GROUP BY ALL)"""


def _language_scores(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    model = L.fitted(docs.where("doc_id % 5 <> 0"), "doc_id")
    return L.scores(docs, "doc_id", model, _LANGS)


@query(f"WITH {_GRAMS} SELECT lt.doc_id, coalesce(max(known), 0)::BIGINT AS known, " + ", ".join(f"round(coalesce(max(s) FILTER (sc.lang = '{k}'), 0), 4) AS {k}" for k in _LANGS) + """,
  CASE WHEN any_value(l) = '' THEN 'none' WHEN max(known) IS NULL THEN 'other' ELSE arg_max(sc.lang, s) END AS detected FROM lt LEFT JOIN sc USING (doc_id) GROUP BY lt.doc_id""")
def language_scores(spark, d):
    """What each document's trigrams say for each language."""
    return rounded(_language_scores(spark, d), 4)


@query(f"""WITH {_GRAMS}, dt AS (SELECT doc_id, arg_max(lang, s) AS detected FROM sc GROUP BY doc_id)
SELECT d.lang, count(*) AS n, count(*) FILTER (detected = d.lang) AS "right", round(count(*) FILTER (detected = d.lang)::DOUBLE / count(*), 6) AS share FROM documents d LEFT JOIN dt USING (doc_id) WHERE doc_id % 5 = 0 GROUP BY d.lang""")
def language_held_out(spark, d):
    """The share of texts, none of which the model has seen, whose language is told."""
    held = table(spark, d, "documents").where("doc_id % 5 = 0")
    return rounded(L.accuracy(_language_scores(spark, d), held, "doc_id"))


# Checks.
@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'not reviewed' WHEN doc_id % 4 = 1 THEN 'differs' WHEN doc_id % 4 = 2 THEN 'no change' END AS problem FROM documents")
def reviewed_fixes(spark, d):
    """Fixes beside the reviewed text."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 4
    fixes = docs.select("doc_id", F.col("source").alias("original"), F.when(k == 2, F.col("source")).otherwise("new").alias("fixed"))
    shown = docs.where("doc_id % 4 > 0").select("doc_id", F.when(k == 1, F.concat("source", F.lit("?"))).otherwise(F.col("source")).alias("shown"))
    return A.reviewed(fixes, shown, ["doc_id"]).select("doc_id", "problem")


@query("SELECT doc_id, n_chars::BIGINT AS got, length(text) + (doc_id % 5 = 0)::BIGINT AS want FROM documents WHERE n_chars IS DISTINCT FROM length(text) + (doc_id % 5 = 0)::BIGINT")
def mismatch_list(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("long").alias("a"), (F.length("text") + (F.col("doc_id") % 5 == 0).cast("int")).cast("long").alias("b"))
    return A.mismatches(rows, ["doc_id"], "a", "b")


@query(f"""WITH {RECORDS}, s AS (SELECT lang, count(*)::DOUBLE AS n, avg(correct::INT) AS accuracy, avg(prompt_tokens + completion_tokens) AS mean_total, 1000.0 * (count(*) FILTER (correct AND finish_reason = 'stop'))::DOUBLE / sum(completion_tokens)::DOUBLE AS success_per_1k FROM records GROUP BY lang)
SELECT lang, finding, round(value, 6) AS value FROM (UNPIVOT (SELECT * FROM s WHERE lang <> 'en') ON n, accuracy, mean_total, success_per_1k INTO NAME finding VALUE value)""")
def findings_checked(spark, d):
    """Four findings for each language beside the base; an error if they aren't that many."""
    rows = S.efficiency(views.answers(spark, d)).where("lang <> 'en'")
    measures = ["n", "accuracy", "mean_total", "success_per_1k"]
    return rounded(A.require_count(S.findings(rows, ["lang"], measures), len(measures) * rows.count()))


@query(f"WITH {RECORDS}, h AS (SELECT category, lang, count(*) AS n FROM records GROUP BY ALL), e AS (SELECT category, lang, CASE WHEN lang = 'en' THEN n ELSE n + 1 END AS expected, n FROM h) SELECT category, lang, expected, n FROM e WHERE n <> expected UNION ALL SELECT 'absent', 'en', 3, 0")
def queue_gaps(spark, d):
    """Jobs of a queue whose rows aren't as many as expected."""
    have = views.answers(spark, d).select("category", "lang")
    want = have.groupBy("category", "lang").agg(F.count("*").alias("n")).select("category", "lang", F.when(F.col("lang") == "en", F.col("n")).otherwise(F.col("n") + 1).alias("expected"))
    return sinks.missing_jobs(have, want.unionByName(spark.createDataFrame([("absent", "en", 3)], "category string, lang string, expected long")), ["category", "lang"])


@query(f"WITH {VECTORS}, l AS (SELECT position, position % 10 AS prompt, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS same FROM vectors) SELECT prompt, count(*) AS positions, count(*) FILTER (same) AS agree, round(100.0 * count(*) FILTER (same) / count(*), 6) AS top1_pct FROM l GROUP BY prompt")
def prompt_agreement(spark, d):
    """Agreement of two models by prompt."""
    same = V.argmax(F.col("p")) == V.argmax(F.col("q"))
    rows = views.vectors(spark, d).withColumn("prompt", F.col("position") % 10)
    return rounded(rows.groupBy("prompt").agg(F.count("*").alias("positions"), F.count_if(same).alias("agree"), (100 * F.avg(same.cast("double"))).alias("top1_pct")))


@query("SELECT p_brand AS part, count(*) AS tensors, sum(p_size)::BIGINT AS elements, (sum(p_size) * 2)::BIGINT AS bytes FROM part GROUP BY p_brand")
def tensor_counts(spark, d):
    """Elements and bytes of tensors by class of their names."""
    rows = table(spark, d, "part").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("elements"), (F.col("p_size") * 2).cast("long").alias("bytes"))
    return S.tensor_counts(rows, F.substring_index("name", ".", 1))


@query(f"""WITH {RECORDS}, mf AS (SELECT * FROM (VALUES ('m0', 'b', 'thinking', 'run0', 40), ('m0', 'b', 'off', 'run1', 1000000), ('m1', 'b', 'off', 'absent', 5)) AS t(model, bench, setting, tag, expected_n)),
s AS (SELECT mf.model, mf.bench, mf.setting, mf.tag, expected_n, lang, count(*) AS n, avg(correct::INT) AS a, avg(prompt_tokens + completion_tokens) AS m, 1000.0 * (count(*) FILTER (correct AND finish_reason = 'stop'))::DOUBLE / sum(completion_tokens)::DOUBLE AS k
  FROM records r JOIN mf ON mf.tag = 'run' || r.id % 3 GROUP BY ALL),
w AS (SELECT tag, bool_and(n >= expected_n) AS whole FROM s GROUP BY tag)
SELECT mf.model, mf.bench, mf.setting, mf.tag, CASE WHEN s.n IS NULL THEN 'not run' WHEN w.whole THEN 'ok' ELSE 'incomplete' END AS status, s.lang, s.n, round(s.a, 6) AS accuracy, round(s.m, 6) AS mean_total, round(s.k, 6) AS success_per_1k, round(s.m / e.m, 6) AS total_ratio
FROM mf LEFT JOIN s USING (tag) LEFT JOIN w USING (tag) LEFT JOIN s e ON e.tag = mf.tag AND e.lang = 'en'""")
def manifest_tables(spark, d):
    """The tables of all runs that a manifest lists."""
    manifest = spark.createDataFrame([("m0", "b", "thinking", "run0", 40), ("m0", "b", "off", "run1", 1_000_000), ("m1", "b", "off", "absent", 5)], "model string, bench string, setting string, tag string, expected_n long")
    rows = views.records(spark, d).withColumns({"bench": F.lit("b"), "tag": F.concat(F.lit("run"), (F.col("id") % 3).cast("string"))})
    return rounded(S.manifest_tables(rows, manifest))


# Files of eight shards whose row groups hold forty rows each.
_GROUPED = """sh AS (SELECT doc_id, lang, doc_id % 8 AS shard, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS place FROM documents),
gr AS (SELECT *, place // 40 AS row_group, place % 40 AS row FROM sh)"""


def _grouped_files(spark, d) -> list[str]:
    """Texts are long beside the columns that are read, so groups are found without them."""
    path = views.scratch(spark, "grouped")
    docs = table(spark, d, "documents").withColumn("shard", F.concat(F.lit("s"), (F.col("doc_id") % 8).cast("string")))
    dealt = docs.repartition("shard").sortWithinPartitions("shard", "doc_id")
    dealt.write.option("parquet.block.row.count.limit", 40).partitionBy("shard").parquet(path)
    return rowgroups.files(spark, path)


@query(f"""WITH {_GROUPED}, k AS (SELECT shard, shard // 2 AS k, count(DISTINCT row_group) AS n FROM gr WHERE shard % 2 = 0 GROUP BY shard)
SELECT doc_id, lang, row_group, row FROM gr JOIN k USING (shard) WHERE row_group = k.k % k.n""")
def shard_groups(spark, d):
    """One row group of every second shard, the next one each time; no other bytes are read."""
    return rowgroups.shard_groups(spark, _grouped_files(spark, d), 4, ["doc_id", "lang"]).select("doc_id", "lang", "row_group", "row")


@query(f"WITH {_GROUPED} SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY shard, place) AS n FROM gr) WHERE n <= 130")
def head_rows(spark, d):
    """The first rows of files in their order, from as many row groups as hold them."""
    return rowgroups.head(spark, _grouped_files(spark, d), 130, ["doc_id", "lang"]).select("doc_id", "lang")


@query(f"WITH {_GROUPED} SELECT shard::BIGINT AS number, row_group, count(*) AS rows FROM gr GROUP BY shard, row_group")
def row_group_footers(spark, d):
    """What the footers say of the row groups of all files."""
    return rowgroups.footers(spark, _grouped_files(spark, d), ["doc_id"]).select("number", "row_group", "rows")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::INT AS width FROM embeddings WHERE embedding IS NOT NULL")
def number_files(spark, d):
    """Vectors as files of 32-bit floats, their ids as files of integers; read back row by row, each file's rows in their order."""
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").repartition(4, "vec_id").sortWithinPartitions("vec_id")
    paths = {kind: views.scratch(spark, f"numbers-{kind}") for kind in ("float", "int")}
    sinks.number_files(rows, "embedding", paths["float"])
    sinks.number_files(rows.select(F.array(F.col("vec_id").cast("int")).alias("one")), "one", paths["int"], "int")
    stem = F.substring_index("file", ".", 1)
    ids = readers.number_rows(spark, paths["int"], 1, "int").select(stem.alias("stem"), "position", F.col("values")[0].cast("long").alias("vec_id"))
    values = readers.number_rows(spark, paths["float"], 64).select(stem.alias("stem"), "position", F.col("values").cast("array<double>").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return ids.join(values, ["stem", "position"]).select("vec_id", F.round(total, 6).alias("total"), F.size("v").alias("width"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 4 > 0) AS with_question, sum(length(text)) FILTER (doc_id % 4 > 0)::BIGINT AS chars FROM documents GROUP BY lang")
def items_by_language(spark, d):
    """Items of all languages from files named by language; rows without a question are passed over."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("question"), "lang")
    path = views.scratch(spark, "items")
    sinks.jsonl(docs, f"{path}/written", by="lang")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(f"{path}/named"))
    for n, f in enumerate(fs.globStatus(hadoop.Path(f"{path}/written/lang=*/part-*"))):
        lang = f.getPath().getParent().getName()[5:]
        fs.rename(f.getPath(), hadoop.Path(f"{path}/named/items{n}.{lang}.jsonl"))
    got = readers.items(spark, f"{path}/named").groupBy("lang").agg(F.count("*").alias("with_question"), F.sum(F.length("question")).alias("chars"))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(got, "lang").select("lang", "n", "with_question", "chars")


@query("SELECT lang, count(*) FILTER (length(coalesce(text, '')) % 3 = 0) AS n_correct, count(*) AS n FROM documents GROUP BY lang")
def own_rule(spark, d):
    """Correctness by a rule of one's own in place of the registered ones."""
    rows = table(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("content"), F.lit("3").alias("gold"))
    scored = S.scored(rows, rule=lambda content, gold: F.length(content) % gold.cast("int") == 0)
    return scored.groupBy("lang").agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n"))


# Growing logs.
@query("""SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_correct, sum(n_chars + CASE WHEN doc_id % 2 = 1 AND doc_id % 5 <> 0 THEN 1000 ELSE 0 END)::BIGINT AS completion_tokens FROM documents GROUP BY lang""")
def live_scorecard(spark, d):
    """A log taken in twice. Some records are there twice in one part, some in both parts, with other figures each time: each key counts once, as it first arrived."""
    docs = table(spark, d, "documents")
    usage = lambda more: F.struct(F.lit(1).cast("long").alias("prompt_tokens"), (F.col("n_chars") + more).cast("long").alias("completion_tokens"))
    rows = docs.select(F.col("doc_id").alias("id"), "lang", F.lit("7").alias("gold"), F.when(F.col("doc_id") % 3 == 0, "it is 7").otherwise("it is 8").alias("content"), F.lit(1.0).alias("wall"), usage(0).alias("usage"), usage(1000).alias("later"))
    again = rows.withColumns({"usage": F.col("later"), "wall": F.lit(2.0)}).drop("later")
    one = rows.drop("later").where("id % 2 = 0 OR id % 5 = 0")
    path, state, board = (views.scratch(spark, f"live-{x}") for x in ("log", "state", "board"))
    spent = F.coalesce("usage.completion_tokens", F.lit(0))
    for part in (one.unionByName(again.where("id % 4 = 0")), again.where("id % 2 = 1")):
        sinks.append_jsonl(part, path)
        first = S.scored(logs.first_arrivals(logs.log(spark, path), ["id", "lang"], ["wall"]), "mgsm")
        logs.keep_totals(first, ["lang"], {"n": F.lit(1).cast("long"), "n_correct": F.col("correct").cast("long"), "completion_tokens": spent}, board, state)
    return logs.totals(spark, board)


@query("SELECT doc_id, lang, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS run, length(text)::BIGINT AS said FROM documents WHERE doc_id % 8 <> 6")
def durable_answers(spark, d):
    """A log of segments after two runs: the second asks what failed in the first, and some of it fails again."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    path = views.scratch(spark, "answers")

    def responder(run: int, fails) -> answers.Respond:
        return lambda: lambda x: None if fails(x["doc_id"]) else {"doc_id": x["doc_id"], "lang": x["lang"], "run": run, "said": len(x["text"] or "")}

    answers.recorded(docs, responder(1, lambda i: i % 4 == 2), path, ["doc_id", "lang"], workers=16)
    answers.recorded(docs, responder(2, lambda i: i % 8 == 6), path, ["doc_id", "lang"], workers=16)
    return answers.log(spark, path, "doc_id long, lang string, run int, said long", ["doc_id", "lang"])


@query("SELECT n_nationkey::BIGINT AS id, n_name || '!' AS content FROM nation WHERE n_nationkey % 4 <> 2")
def answered(spark, d):
    """Answers of a responder; failed items are missing."""
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("question"))
    return answers.answered(items, lambda: lambda x: None if x["id"] % 4 == 2 else {"id": x["id"], "content": x["question"] + "!"}, "id long, content string", workers=2)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS question FROM nation WHERE n_nationkey % 4 = 2")
def retried(spark, d):
    """What the next run has to ask again."""
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("question"))
    done = answers.answered(items, lambda: lambda x: None if x["id"] % 4 == 2 else {"id": x["id"]}, "id long", workers=2)
    return A.pending(items, done, ["id"])

