"""Secrets and whose they are, by DataFrame functions alone.

Candidates are matches of three fixed patterns (assignments to telling names,
access keys, long hexadecimal runs) and, beside them, words of random look. What
a candidate is worth is decided by the whole corpus: candidates meet by the
SHA-256 of their value, and each value is counted by distinct repositories and
distinct owners. A value that several owners have is an example that people copy
(``EXAMPLE_OWNERS`` and more); one that a single owner has and that looks random
is a live credential. The same count settles values found without any telling
word: a random-looking word becomes a span if it is live by itself, or if it is
the live value of a fixed pattern somewhere else in the corpus.

Texts are read once and never shuffled, nor are values: what moves is hashes,
owners and positions. Counts go by (value, owner, repository) first, so a value
that a third of all rows hold is merged where it is read and never meets in one
task. Few values are broadcast to their places, more are joined by hash, where
adaptive execution cuts the partition of a value that many rows hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.pii import bound, match_starts
from quillspan.llm.runtime import few, written

#: Fixed patterns, possessive where that changes no match.
_NAME = r"(?i:password|passwd|secret|token|api_?key)"
_PATTERN = {
    "assign": _NAME + r"[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "word": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
_BEFORE_VALUE = r"^[^:=]*+[:=]\x20*+[\"']?+"
#: Kinds in the order of spans that start together; a contract fixes the first three.
BASE, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "word")
#: Distinct owners from which on a value is an example.
EXAMPLE_OWNERS = 3
#: What looks random: length and distinct characters, for the value of a fixed pattern and for a word without any.
LEAST_LENGTH, LEAST_DISTINCT, WORD_LENGTH, WORD_DISTINCT = 8, 6, 20, 12
#: What stands for a value in examples.
_STAND_IN = r"(?i)example|sample|placeholder|changeme|change_me|dummy|redacted|your[_-]|xxxx|0123456789|abcdef"
#: Values (about a hundred bytes each) that are broadcast at most.
BROADCAST_VALUES = 50_000
_SPAN = "array<struct<start:long,place:int,end:long,hash:string,random:boolean>>"


def _distinct_characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def _looks_random(kind: str, value: Column) -> Column:
    plain = value.rlike(_STAND_IN)
    if kind != "word":
        return ~plain & (F.length(value) >= LEAST_LENGTH) & (_distinct_characters(value) >= LEAST_DISTINCT)
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return ~plain & mixed & (F.length(value) >= WORD_LENGTH) & (_distinct_characters(value) >= WORD_DISTINCT)


def _candidates(place: int, kind: str) -> Column:
    """Valid matches of a kind, from columns of matches and their starts."""
    m, start = f"_m_{kind}", f"_s_{kind}"

    def value(v: Column) -> Column:
        return F.regexp_replace(v, _BEFORE_VALUE, "") if kind == "assign" else v

    every = F.zip_with(m, start, lambda v, s: F.struct(s.alias("start"), v.alias("match"), value(v).alias("value")))
    valid = {"assign": lambda c: F.length(c["value"]) >= 6, "access": lambda c: F.length(c["match"]) >= 20, "hex": lambda c: F.lit(True), "word": lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]")}[kind]
    shown = lambda c: F.struct(c["start"].alias("start"), F.lit(place).alias("place"), (c["start"] + F.length(c["match"])).alias("end"), F.sha2(c["value"], 256).alias("hash"), _looks_random(kind, c["value"]).alias("random"))
    return F.when(F.size(m) > 0, F.transform(F.filter(every, valid), shown)).otherwise(F.array().cast(_SPAN))


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (text, not null) with ``_spans``: candidates of all kinds; positions in code points, ends exclusive."""
    none = F.array().cast("array<string>")
    may = {"assign": F.col("text").contains("=") | F.col("text").contains(":"), "access": F.col("text").contains("AKIA"), "hex": F.lit(True), "word": F.col("text").rlike("[0-9]")}
    out = docs.withColumns({f"_m_{k}": F.when(may[k], F.regexp_extract_all("text", F.lit(_PATTERN[k]), F.lit(0))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("text", _PATTERN[k], -1)).otherwise(none) for k in KINDS})
    out = out.withColumns({f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, match_starts(f"_g_{k}", f"_m_{k}")).otherwise(F.array().cast("array<long>")) for k in KINDS})
    return out.withColumn("_spans", F.concat(*(_candidates(i, k) for i, k in enumerate(KINDS)))).drop(*(f"_{p}_{k}" for p in "mgs" for k in KINDS))


def ownership(candidates: DataFrame) -> DataFrame:
    """Of each value (hash) its distinct owners and repositories, and whether a row marks it as ``base``: hash, owners, repositories, known. ``candidates``: hash, base, owner, repository; a null owner or repository is one of its own; a repository belongs to its owner."""
    once = candidates.groupBy("hash", "owner", "repository").agg(F.max("base").alias("base"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("base").alias("base"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("base").alias("known"))


def _verdict(random: Column, owners: Column) -> Column:
    return F.when(owners >= EXAMPLE_OWNERS, "example").when(~random, "plain").when(owners > 1, "shared").otherwise("live")


def found(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and the columns of owner and repository): doc_id, spans array<struct<kind, start, end, hash, verdict, owners, repositories>>, by start, then kind.

    Verdicts: ``example`` (several owners), ``plain`` (doesn't look random),
    ``shared`` (two owners), ``live`` (one). Spans of the fixed patterns are all
    there; of other words those that are live, unless they overlap one of these.

    Null texts count as empty; a null doc_id stays null. Rows that share a
    doc_id each have the spans of their own text, and are one repository where
    that is what names it; repeated rows have equal ones. A null owner is one
    owner, a null repository one repository of its owner. A text of any length
    is read whole; other columns are not read; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repository}`").cast("string").alias("repository"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_candidates(rows).select("owner", "repository", "doc_id", F.col("_spans").alias("spans"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "candidates", wide=True)
    some = rows.where(F.size("spans") > 0)
    each = some.select("row", "owner", "repository", F.explode("spans").alias("s"))
    secret = (F.col("s.place") < len(BASE)) & F.col("s.random")  # found by a fixed pattern, and not a stand-in
    values = written(ownership(each.select(F.col("s.hash").alias("hash"), secret.alias("base"), "owner", "repository")), "values")
    joined = each.select("row", "s.*").join(F.broadcast(values) if few(values, BROADCAST_VALUES) else values, "hash")
    # a word must look random by itself, or be what a fixed pattern finds somewhere and looks random there
    live = F.col("owners") < F.lit(2)
    stays = (F.col("place") < len(BASE)) | (live & (F.col("random") | F.col("known")))
    verdict = F.when(F.col("place") < len(BASE), _verdict(F.col("random"), F.col("owners"))).otherwise("live")
    span = F.struct("start", "place", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("place") + 1).alias("kind"), "hash", verdict.alias("verdict"), "owners", "repositories")
    lists = joined.where(stays).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    base = lambda all_: F.filter(all_, lambda s: s["place"] < len(BASE))
    free = bound(F.col("spans"), lambda all_: bound(base(all_), lambda b: F.filter(all_, lambda s: (s["place"] < len(BASE)) | ~F.exists(b, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))))
    shown = F.transform(free, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"), s["verdict"].alias("verdict"), s["owners"].alias("owners"), s["repositories"].alias("repositories")))
    lists = lists.select("row", shown.alias("spans"))
    none = F.array().cast(lists.schema["spans"].dataType)
    with_some = some.select("row", "doc_id").join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
    return with_some.unionByName(rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def detected(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``found`` in digests: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, verdicts (of all spans, in their order)."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    verdicts = F.array_join(F.transform("spans", lambda s: s["verdict"]), ",")
    return found(docs, owner, repository).select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size(of("word")).cast("long").alias("n_added"), verdicts.alias("verdicts"))


def _oracle() -> str:
    """SQL that tells what ``detected`` returns over documents with unique ids, from the definitions above."""
    name = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    patterns = {"assign": name + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{24,}", "word": "[A-Za-z0-9+/_-]{16,}"}
    value = {"assign": r"""regexp_replace(match, '^[^:=]*[:=]\x20*["'']?', '')"""}
    valid = {"assign": "length(value) >= 6", "access": "length(match) >= 20", "hex": "true", "word": "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')"}
    stand_in, distinct = _STAND_IN, "len(list_distinct(string_split(value, '')))"
    random = f"NOT regexp_matches(value, '{stand_in}') AND length(value) >= {LEAST_LENGTH} AND {distinct} >= {LEAST_DISTINCT}"
    mixed = f"NOT regexp_matches(value, '{stand_in}') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND length(value) >= {WORD_LENGTH} AND {distinct} >= {WORD_DISTINCT}"

    def places(place: int, kind: str) -> str:
        return f"""SELECT doc_id, source, {place} AS place, '{kind}' AS kind, start::BIGINT AS start, (start + length(match))::BIGINT AS stop, value, {mixed if kind == 'word' else random} AS random FROM (
  SELECT doc_id, source, m[i] AS match, {value.get(kind, 'match')} AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, source, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, source, regexp_extract_all(text, '{patterns[kind]}') AS m, string_split_regex(text, '{patterns[kind]}') AS g FROM d) WHERE len(m) > 0)
) WHERE {valid[kind]}"""

    every = " UNION ALL ".join(places(i, k) for i, k in enumerate(KINDS))
    every = every.replace("SELECT doc_id, source, m[i] AS match, match AS value,", "SELECT doc_id, source, m[i] AS match, m[i] AS value,").replace("regexp_replace(match,", "regexp_replace(m[i],")
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), c AS MATERIALIZED ({every}),
v AS (SELECT value, count(DISTINCT coalesce(source, '<null>')) AS owners, bool_or(place < {len(BASE)} AND random) AS known FROM c GROUP BY value),
k AS (SELECT c.*, CASE WHEN place = {len(BASE)} THEN 'live' WHEN owners >= {EXAMPLE_OWNERS} THEN 'example' WHEN NOT random THEN 'plain' WHEN owners > 1 THEN 'shared' ELSE 'live' END AS verdict
  FROM c JOIN v USING (value) WHERE place < {len(BASE)} OR (owners < 2 AND (random OR known))),
s AS (SELECT * FROM k WHERE place < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM c b WHERE b.place < {len(BASE)} AND b.doc_id = k.doc_id AND b.start < k.stop AND k.start < b.stop)),
t AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, count(*) FILTER (kind = 'word') AS n_added,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans, string_agg(verdict, ',' ORDER BY start, place) AS verdicts FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(verdicts, '') AS verdicts FROM d LEFT JOIN t USING (doc_id)"""


ORACLE = _oracle()
