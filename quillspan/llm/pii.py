"""Personal data and what reveals it, by DataFrame functions alone.

Base spans are matches of four fixed patterns (emails, IP addresses, payment
cards, phone numbers). Around them works an information-theoretic
sanitisation: every distinct value found is a protected entity c, and a term t
reveals c as far as seeing t makes c likely. With token positions of the whole
corpus as the sample space,

    PMI(c; t) = ln( f(c, t) W / (f(c) f(t)) ),   IC(c) = -ln( f(c) / W ),

where W counts all words, f(t) the occurrences of t, f(c) the words within
``REACH`` code points of occurrences of c, and f(c, t) those of them that are t.
IC(c) - PMI(c; t) is what remains unknown of c once t is seen: -ln f(c, t) / f(t),
whatever the size of the corpus, so only f(c, t) and f(t) need counting. The
share f(c, t) / f(t) is smoothed by the number k of different contexts, times
k / (k + 1): one context, however often copied, is no evidence. Terms whose
disclosure, this smoothed probability, is over ``REMOVE`` are removed from all
texts, those over ``GENERALISE`` (under one bit remains) become a general word.

Only contexts, counts and hits are shuffled, never texts, as long as hits are few
enough to broadcast; all counts are partially aggregated where they are read.
Spans depend on the text alone, so hits are keyed by 128 bits of its hash: rows
that share a doc_id keep their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import few, written

REACH, GENERALISE, REMOVE = 80, 0.5, 0.8
#: Candidate or revealing terms that are broadcast at most (under 300 bytes each); beyond it the join is dealt by term.
BROADCAST_TERMS = 50_000
#: Occurrences of such terms that are broadcast at most (as much each); beyond it texts and hits are dealt by the text's hash.
BROADCAST_HITS = 100_000
#: A longer word counts as its MD5, so that what is broadcast stays bounded.
LONGEST_TERM = 64
KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, possessive where that changes no match. A run is entered at its start or where the last match ended, so no run is read twice.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": ".", "phone": "+"}
_WORD = r"[^\x20\x09-\x0D]+"
_INNER_WORD = r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row. An expression used inside a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(numbers: Column, block: int = 128) -> Column:
    """Running totals of an array of longs, in two levels, so that the cost stays near linear."""
    none = F.array().cast("array<long>")

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), none.alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"] + x)).alias("out")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, block))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<array<long>>").alias("out"))

        def add(a: Column, p: Column) -> Column:
            return F.struct((a["sum"] + F.element_at(p, -1)).alias("sum"), F.concat(a["out"], F.array(F.transform(p, lambda x: x + a["sum"]))).alias("out"))

        return F.aggregate(F.transform(cut, running), start, add, lambda a: F.flatten(a["out"]))

    return bound(numbers, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike("^" + r"\.".join([_PART] * 4) + "$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _lengths(texts: str) -> Column:
    return F.transform(texts, lambda v: F.length(v).cast("long"))


def _steps(gaps: str, matches: str) -> Column:
    """Code points from the start of each match back to the start of the one before (or of the text)."""
    n = F.size(matches)
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), _lengths(matches)), F.lit(1), n)
    return F.zip_with(F.slice(_lengths(gaps), F.lit(1), n), before, lambda g, m: g + m)


def match_starts(gaps: str, matches: str) -> Column:
    """Where each of the ``matches`` starts, in code points; ``gaps``: the text split at them."""
    return prefix_sums(_steps(gaps, matches))


def _spans(kind: str) -> Column:
    m, start = f"_m_{kind}", f"_s_{kind}"
    every = F.zip_with(m, start, lambda v, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
    return F.when(F.size(m) > 0, F.filter(every, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_SPAN))


def _of_kind(kind: str) -> Column:
    return F.filter("_base", lambda s: s["kind"] == kind)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``_base``: valid spans of all kinds, by kind and start; positions in code points, ends exclusive."""
    none = F.array().cast("array<string>")
    out = docs.withColumn("_num", F.col("text").rlike("[0-9]"))
    for k in KINDS:
        may = F.col("text").contains(_HINT[k]) if k in _HINT else F.lit(True)
        may = may if k == "email" else may & F.col("_num")
        out = out.withColumn(f"_m_{k}", F.when(may, F.regexp_extract_all("text", F.lit(_PATTERN[k]), F.lit(0))).otherwise(none))
    for k in KINDS:
        out = out.withColumn(f"_g_{k}", F.when(F.size(f"_m_{k}") > 0, F.split("text", _PATTERN[k], -1)).otherwise(none))
    for k in KINDS:
        out = out.withColumn(f"_s_{k}", F.when(F.size(f"_m_{k}") > 0, prefix_sums(_steps(f"_g_{k}", f"_m_{k}"))).otherwise(F.array().cast("array<long>")))
    return out.withColumn("_base", F.concat(*map(_spans, KINDS))).drop("_num", *(f"_{p}_{k}" for p in "mgs" for k in KINDS))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_of(word: Column) -> Column:
    """Lower case without marks at its ends; a word over ``LONGEST_TERM`` code points by its MD5."""
    term = F.btrim(F.lower(word), F.lit(_MARKS))
    return F.when(F.length(word) <= LONGEST_TERM, term).otherwise(F.when(F.length(term) <= LONGEST_TERM, term).otherwise(F.concat(F.lit("md5 "), F.md5(term))))


def _contexts() -> Column:
    """For each base span its entity and the terms of whole words within ``REACH`` code points of it."""

    def around(s: Column) -> Column:
        start = F.greatest(s["start"] - REACH, F.lit(1)).cast("int")
        left = F.concat(F.when(s["start"] <= REACH, " ").otherwise(""), F.substring("text", start, (s["start"] - start + 1).cast("int")))
        cut = F.substring("text", (s["end"] + 1).cast("int"), F.lit(REACH + 1))
        right = F.concat(cut, F.when(F.length(cut) <= REACH, " ").otherwise(""))
        words = F.concat(F.regexp_extract_all(left, F.lit(_INNER_WORD), F.lit(0)), F.regexp_extract_all(right, F.lit(_INNER_WORD), F.lit(0)))
        terms = F.filter(F.transform(words, term_of), lambda t: (F.length(t) > 1) & ~t.contains("@") & ~t.rlike("^[0-9+().-]*$"))
        value = F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
        return F.struct(F.concat_ws(":", s["kind"], value).alias("entity"), F.xxhash64(left, right).alias("context"), terms.alias("terms"))

    return F.transform("_base", around)


def revealing_terms(contexts: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Terms over a threshold (term, disclosure) from contexts (entity, context, terms) and the texts of the whole corpus; None where no pair has two contexts."""
    pairs = contexts.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    pairs = written(pairs.groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("contexts")).where("contexts > 1"), "pairs")
    if pairs.isEmpty():
        return None
    candidates = written(pairs.select("term").distinct(), "candidates")
    words = rows.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word")).select(term_of(F.col("word")).alias("term"))
    if few(candidates, BROADCAST_TERMS):
        words = words.join(F.broadcast(candidates), "term")
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"))
    joint, n, k = (F.col(x).cast("double") for x in ("joint", "n_term", "contexts"))
    disclosure = (F.least(joint, n) / n * k / (k + 1)).alias("disclosure")
    return written(pairs.join(counts, "term").select("term", disclosure).where(F.col("disclosure") > GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "revealing")


_KEY = ["key", "key2"]


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with 128 bits of hashes of their text."""
    return rows.withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64(F.lit(1), "text")})


def term_hits(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of ``terms`` per distinct text (key, key2): hits array<struct<i, term, remove>>, i the number of the word. Words meet the terms where they are read. Marked for broadcast where they are few."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    every = rows.select(*_KEY, F.posexplode(words).alias("i", "w")).select(*_KEY, "i", term_of(F.col("w")).alias("term"))
    hit = every.join(F.broadcast(terms) if few(terms, BROADCAST_TERMS) else terms, "term")
    hits = written(hit.groupBy(*_KEY).agg(F.collect_set(F.struct("i", "term", (F.col("disclosure") > REMOVE).alias("remove"))).alias("hits")), "hits")
    return F.broadcast(hits) if few(hits.select(F.explode("hits")), BROADCAST_HITS) else hits


def with_found(rows: DataFrame) -> DataFrame:
    """``rows`` (text, hits) with ``found``: places of the hits, array<struct<start, end, remove>>; null hits give null."""
    lead = lambda w: F.length(w) - F.length(F.ltrim(w, F.lit(_MARKS)))

    def spans(x: Column) -> Column:
        own = F.transform("hits", lambda h: F.struct(F.get(x["w"], h["i"]).alias("w"), F.get(x["s"], h["i"]).alias("s"), h["remove"].alias("remove")))
        return F.array_sort(F.transform(own, lambda h: F.struct((h["s"] + lead(h["w"])).alias("start"), (h["s"] + lead(h["w"]) + F.length(F.btrim(h["w"], F.lit(_MARKS)))).alias("end"), h["remove"].alias("remove"))))

    some = F.col("hits").isNotNull()
    out = rows.withColumn("w", F.when(some, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).withColumn("g", F.when(some, F.split("text", _WORD, -1)))
    out = out.withColumn("s", F.when(some, prefix_sums(_steps("g", "w"))))
    return out.withColumn("found", F.when(some, bound(F.struct("w", "s"), spans))).drop("w", "g", "s", "hits")


def _free(found: Column, base: Column) -> Column:
    """Found terms that touch no base span."""
    none = F.array().cast("array<struct<start:long,end:long,remove:boolean>>")
    return bound(base, lambda all_: F.filter(F.coalesce(found, none), lambda t: ~F.exists(all_, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))


def detected(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms.

    Null texts count as empty; a null doc_id stays null. Rows that share a
    doc_id each have the spans of their own text; repeated rows have equal
    ones. A text of any length is read whole; other columns are not read; an
    empty table gives an empty result.
    """
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    spans_only = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = written(with_base_spans(rows).select("doc_id", *_KEY, spans_only.alias("_base"), _contexts().alias("contexts")), "base", wide=True)
    terms = revealing_terms(base.select(F.explode("contexts").alias("c")).select("c.*"), rows)
    out = base.drop("contexts")
    if terms is None or terms.isEmpty():
        out = out.withColumn("found", F.lit(None).cast("array<struct<start:long,end:long,remove:boolean>>"))
    else:
        found = with_found(rows.select("text", *_KEY).join(term_hits(rows, terms), _KEY)).groupBy(*_KEY).agg(F.first("found").alias("found"))
        out = out.join(found, _KEY, "left")
    out = out.withColumn("found", _free(F.col("found"), F.col("_base")))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    text = span_text(F.col("_base"))
    more = F.array_join(F.transform("found", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string"))), ",")
    spans = F.when(F.size("found") == 0, text).when(F.size("_base") == 0, more).otherwise(F.concat_ws(",", text, more))
    return out.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), spans.alias("spans"), F.size("found").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by the kind in brackets, revealing terms removed or generalised; all other columns as they are, whatever their names.

    Null texts stay null. Where spans overlap, the first one counts and the
    next starts where it ended. Each row is changed by the spans of its own
    text, repeated rows alike, with or without a doc_id; a text of any length is
    read whole; an empty table stays empty.
    """
    rows = _keyed(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    contexts = written(with_base_spans(rows).where(F.size("_base") > 0).select(_contexts().alias("contexts")).select(F.explode("contexts").alias("c")).select("c.*"), "contexts", heavy=True)
    terms = revealing_terms(contexts, rows)
    named = [F.col(f"`{c}`") for c in docs.columns]
    out = _keyed(docs.select(F.struct(*named).alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    if terms is None or terms.isEmpty():
        out = out.withColumn("found", F.array().cast("array<struct<start:long,end:long,remove:boolean>>"))
    else:
        out = with_found(out.join(term_hits(rows, terms), _KEY, "left"))
    out = with_base_spans(out.drop(*_KEY))
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    more = F.transform(_free(F.col("found"), F.col("_base")), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["remove"], "").otherwise("[TERM]").alias("put")))
    out = out.withColumn("all", F.array_sort(F.concat(base, more)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(a: Column, s: Column) -> Column:
        gap = F.substring("text", (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.when(s["end"] <= a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, s["put"])).alias("out")))

    rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substring("text", (a["at"] + 1).cast("int"), F.length("text")))
    clean = F.when(F.size("all") == 0, F.col("text")).otherwise(F.aggregate("all", start, put, rest))
    own = lambda c: F.col("row").getField(c)
    return out.select(*(F.when(own(c).isNotNull(), clean).alias(c) if c == "text" else own(c).alias(c) for c in docs.columns))


def _oracle() -> str:
    """SQL that tells what ``detected`` returns over documents with unique ids, from the definitions above."""
    word, space = r"[^\x20\x09-\x0D]+", r"\x20\x09-\x0D"
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(generate_series(1, length({digits})), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN CASE WHEN substr({digits}, i, 1)::INT > 4 THEN 2 * substr({digits}, i, 1)::INT - 9 ELSE 2 * substr({digits}, i, 1)::INT END ELSE substr({digits}, i, 1)::INT END))"
    valid = {"email": "true", "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda p: p::HUGEINT <= 255))", "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {doubled} % 10 = 0 ELSE false END", "phone": f"length({digits}) BETWEEN 9 AND 15"}
    marks = _MARKS.replace("'", "''")

    def places(pattern: str) -> str:
        return f"""SELECT doc_id, text, i, m[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, text, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d) WHERE len(m) > 0)"""

    def term(w: str) -> str:
        t = f"trim(lower({w}), '{marks}')"
        return f"CASE WHEN length({t}) <= {LONGEST_TERM} THEN {t} ELSE 'md5 ' || md5({t}) END"

    kinds = " UNION ALL ".join(f"SELECT doc_id, text, {n} AS k, '{kind}' AS kind, value, start::BIGINT AS start, (start + length(value))::BIGINT AS stop FROM ({places(p)}) WHERE {valid[kind]}" for n, (kind, p) in enumerate(patterns.items()))
    near = f"""SELECT doc_id, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN {digits} ELSE lower(value) END AS entity,
  CASE WHEN start <= {REACH} THEN ' ' ELSE '' END || substr(text, greatest(start - {REACH}, 1), start - greatest(start - {REACH}, 1) + 1) AS lft,
  substr(text, stop + 1, {REACH + 1}) || CASE WHEN length(substr(text, stop + 1, {REACH + 1})) <= {REACH} THEN ' ' ELSE '' END AS rgt FROM base"""
    inner = lambda c: f"regexp_extract_all(regexp_replace(regexp_replace({c}, '^[^{space}]+', ''), '[^{space}]+$', ''), '{word}')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS ({kinds}), near AS ({near}),
ct AS (SELECT entity, lft, rgt, {term('w')} AS term FROM (SELECT entity, lft, rgt, unnest(list_concat({inner('lft')}, {inner('rgt')})) AS w FROM near)),
pr AS (SELECT entity, term, lft, rgt, count(*) AS n FROM ct WHERE length(term) > 1 AND NOT contains(term, '@') AND NOT regexp_full_match(term, '[0-9+().-]*') GROUP BY ALL),
pairs AS (SELECT entity, term, sum(n) AS joint, count(*) AS k FROM pr GROUP BY entity, term HAVING count(*) > 1),
words AS (SELECT doc_id, value AS w, start + length(value) - length(ltrim(value, '{marks}')) AS start, length(trim(value, '{marks}')) AS size, {term('value')} AS term FROM ({places(word)})),
counts AS (SELECT term, count(*) AS n FROM words WHERE term IN (SELECT term FROM pairs) GROUP BY term),
told AS (SELECT DISTINCT term FROM pairs JOIN counts USING (term) WHERE least(joint, n) / n::DOUBLE * k / (k + 1) > {GENERALISE}),
hits AS (SELECT doc_id, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM words w WHERE term IN (SELECT term FROM told) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.start + w.size AND w.start < b.stop)),
bs AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS s, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in patterns)} FROM base GROUP BY doc_id),
hs AS (SELECT doc_id, string_agg('term:' || start || ':' || stop, ',' ORDER BY start, stop) AS s, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in patterns)}, sha256(coalesce(bs.s, '')) AS base_sha256, concat_ws(',', bs.s, hs.s) AS spans, coalesce(hs.n, 0) AS n_terms FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN hs USING (doc_id)"""


ORACLE = _oracle()
