"""Audits: completeness, duplicates, alignment, overlays, worst cases and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.stats import ratio


def draw_order(seed: int, key: str) -> list[Column]:
    """A reproducible random order: MD5 of seed and key, then the key."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def worst(rows: DataFrame, group: str, excess: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest excess, ties by key; with their rank."""
    w = Window.partitionBy(group).orderBy(F.desc(excess), key)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def random_rest(rows: DataFrame, taken: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """``k`` rows of each group that aren't among ``taken``, drawn by ``draw_order``."""
    rest = rows.join(taken.select(group, key), [group, key], "left_anti")
    w = Window.partitionBy(group).orderBy(*draw_order(seed, key))
    return rest.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def with_labels(rows: DataFrame, labels: DataFrame, keys: list[str], default: str) -> DataFrame:
    """``rows`` with their ``label``, the default where there is none."""
    return rows.join(labels.select(*keys, F.col("label").alias("_label")), keys, "left").withColumn("label", F.coalesce("_label", F.lit(default))).drop("_label")


def stray_labels(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of rows that aren't there; must be empty."""
    return labels.join(rows.select(*keys), keys, "left_anti")


def label_tally(rows: DataFrame, group: str, label: str, value: str, base: str, whole: DataFrame) -> DataFrame:
    """By group and label, with a row ``all`` a group: n, sums, their ratio, share of the group's excess and of the excess of ``whole``."""
    excess = F.sum(F.col(value) - F.col(base))
    tally = rows.rollup(group, label).agg(F.count("*").alias("n"), F.sum(value).alias("sum_value"), F.sum(base).alias("sum_base"), excess.alias("excess"), F.grouping_id().alias("level")).where("level < 3")
    total = whole.agg(excess.alias("whole_excess"))
    own = F.max(F.when(F.col("level") == 1, F.col("excess"))).over(Window.partitionBy(group))
    return tally.withColumn("own", own).crossJoin(F.broadcast(total)).select(  # one row
        group,
        F.when(F.col("level") == 1, "all").otherwise(F.col(label)).alias("label"),
        "n",
        "sum_value",
        "sum_base",
        ratio(F.col("sum_value"), F.col("sum_base")).alias("ratio"),
        ratio(F.col("excess"), F.col("own")).alias("share_of_group"),
        ratio(F.col("excess"), F.col("whole_excess")).alias("share_of_whole"),
    )


def completeness(rows: DataFrame, expected: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Counts against ``expected`` (group, expected): OK, MISSING, EXTRA or UNEXPECTED, and repeated keys."""
    have = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("distinct_keys"))
    n, want = F.coalesce("n", F.lit(0)), F.col("expected")
    status = F.when(want.isNull(), "UNEXPECTED").when(n == want, "OK").when(n < want, "MISSING").otherwise("EXTRA")
    return have.join(expected, group, "full_outer").select(group, n.alias("n"), want.alias("expected"), status.alias("status"), (n - F.coalesce("distinct_keys", F.lit(0))).alias("duplicates"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, or an error that names a repeated key."""
    found = duplicate_keys(rows, keys).limit(1).collect()
    if found:
        raise ValueError(f"repeated key {found[0].asDict()}")
    return rows


def in_all(rows: DataFrame, key: str, over: str, values: list[str]) -> DataFrame:
    """Relational division: keys that occur with all of ``values``."""
    return rows.where(F.col(over).isin(values)).groupBy(key).agg(F.count_distinct(over).alias("_n")).where(F.col("_n") == len(values)).select(key)


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a finished record."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_ids(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).join(rows.select(key).distinct(), key, "left_anti")


def only_ids(rows: DataFrame, wanted: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """Rows of the wanted ids; with ``whole`` an error if one of them is missing."""
    if whole and (lost := missing_ids(rows, wanted, key).limit(1).collect()):
        raise ValueError(f"no row has {key} {lost[0][0]}")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def overlaid(items: DataFrame, fixes: DataFrame, key: str, field: str, strict: bool = True) -> DataFrame:
    """``items`` with ``field`` replaced where a fix (key, original, fixed) exists, and ``is_fixed``. A fix whose original isn't the item's value stops the query (``strict``) or is passed over."""
    f = fixes.select(key, F.col("original").alias("_o"), F.col("fixed").alias("_f"))
    out = items.join(f, key, "left")
    same = F.col(field).eqNullSafe(F.col("_o"))
    hit = F.col("_f").isNotNull() & same
    if strict:
        value = F.when(F.col("_f").isNull(), F.col(field)).when(same, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("the original differs at "), F.col(key).cast("string"))).cast(items.schema[field].dataType))
    else:
        value = F.when(hit, F.col("_f")).otherwise(F.col(field))
    return out.withColumns({field: value, "is_fixed": hit}).drop("_o", "_f")


def _holds(value: Column, kind: T.DataType) -> Column:
    """Whether a variant holds a value of a type, without any cast between kinds of values (an array has a text form too)."""
    name = F.schema_of_variant(value)
    if isinstance(kind, T.StringType):
        return name == "STRING"
    if isinstance(kind, T.ArrayType):
        return name.startswith("ARRAY<")
    if isinstance(kind, T.BooleanType):
        return name == "BOOLEAN"
    if isinstance(kind, T.NumericType):
        return name.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return name.startswith("OBJECT<")


def overlaid_fields(items: DataFrame, fixes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``items`` with all fixes applied in one pass, and ``is_fixed``. ``fixes``: key, field, original and fixed as variants, so that a fix may hold a text, a number or an array.

    Each field is compared in its own type. The query stops at a fix whose
    original isn't the item's value, whose value is of another type than the
    field, that names another field than ``fields``, or that is there twice for
    a field of an item. A JSON null is the field's null. Fixes of items that
    aren't there do nothing (``missing_ids`` finds them).
    """
    one = F.map_from_entries(F.collect_list(F.struct("field", F.struct("original", "fixed"))))
    f = fixes.groupBy(F.col(key).alias("_of")).agg(one.alias("_fixes"))
    out = items.join(f, F.col(key) == F.col("_of"), "left")
    named = lambda what: F.raise_error(F.concat(F.lit(what), F.lit(" at "), F.col(key).cast("string")))
    values = {}
    for field in fields:
        kind = items.schema[field].dataType
        fix = F.try_element_at("_fixes", F.lit(field))

        def typed(v: Column, kind=kind, field=field) -> Column:
            return F.when(F.is_variant_null(v), F.lit(None).cast(kind)).when(_holds(v, kind), F.try_variant_get(v, "$", kind.simpleString())).otherwise(named(f"a fix of {field} is of another type").cast(kind))

        same = F.col(field).eqNullSafe(typed(fix["original"]))
        values[field] = F.when(fix.isNull(), F.col(field)).when(same, typed(fix["fixed"])).otherwise(named(f"the original of {field} differs").cast(kind))
    stray = F.size(F.array_except(F.map_keys("_fixes"), F.array(*map(F.lit, fields)))) > 0
    hit = F.when(stray, named("a fix of another field").cast("boolean")).otherwise(F.col("_fixes").isNotNull())
    return out.select(*(values.get(c, F.col(f"`{c}`")).alias(c) for c in items.columns), hit.alias("is_fixed"))


def misaligned(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that only one side has or whose columns differ (nulls are equal)."""
    one, two = (df.select(key, F.lit(True).alias(f"_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in columns)) for df, s in ((left, "left"), (right, "right")))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), c) for c in columns)))
    why = F.when(F.col("_left").isNull(), "only right").when(F.col("_right").isNull(), "only left").when(F.size(differs) > 0, F.array_join(differs, ","))
    return one.join(two, key, "full_outer").select(key, why.alias("difference")).where("difference IS NOT NULL")


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one run that the other lacks, and which one has them; empty for equal sets."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def complete_repeats(repeats: DataFrame, item: str, repeat: str, n: int) -> DataFrame:
    """By item whether its repeats are exactly 1 to ``n``."""
    return repeats.groupBy(item).agg((F.sort_array(F.collect_list(repeat)) == F.sequence(F.lit(1), F.lit(n)).cast("array<long>")).alias("complete"))


def table_status(stats: DataFrame, manifest: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """Of each manifest entry: ok, incomplete or not run, and the languages that lack ids. ``stats`` has key, lang and n."""
    full = stats.join(manifest.select(key, "expected_n"), key).groupBy(key).agg(F.collect_set(F.when(F.col("n") >= F.col("expected_n"), F.col("lang"))).alias("whole"), F.count("*").alias("seen"))
    lacking = F.array_except(F.array(*map(F.lit, sorted(languages))), F.coalesce("whole", F.array().cast("array<string>")))
    return manifest.join(full, key, "left").select(key, F.when(F.col("seen").isNull(), "not run").when(F.size(lacking) == 0, "ok").otherwise("incomplete").alias("status"), F.array_join(lacking, ",").alias("missing"))


def latest(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each group, ties by the largest value."""
    return rows.groupBy(group).agg(F.max(F.struct(order, value)).alias("_m")).select(group, F.col(f"_m.{value}").alias(value), F.col(f"_m.{order}").alias(order))


def enriched(items: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``items`` with ``columns`` looked up by key where they lack them; a value of its own stays."""
    have = items
    for c in columns:
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast(source.schema[c].dataType))
    found = source.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return have.join(found, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def match_counts(rows: DataFrame, group: str, got: str, want: str) -> DataFrame:
    """Of each group the rows, those whose two values agree (nulls agree), and the smallest value wanted but missed."""
    same = F.col(got).eqNullSafe(F.col(want))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(same).alias("matches"), F.min(F.when(~same, F.col(want))).alias("first_miss"))


def mismatches(rows: DataFrame, keys: list[str], got: str, want: str) -> DataFrame:
    """The rows whose two values differ (nulls agree): keys, got, want."""
    return rows.where(~F.col(got).eqNullSafe(F.col(want))).select(*keys, F.col(got).alias("got"), F.col(want).alias("want"))


def reviewed(fixes: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """``fixes`` (keys, original, fixed) beside the reviewed text (keys, shown), with ``problem``: ``not reviewed``, ``differs``, ``no change``, or null where all is well."""
    out = fixes.join(shown.select(*keys, "shown"), keys, "left")
    why = F.when(F.col("shown").isNull(), "not reviewed").when(F.col("shown") != F.col("original"), "differs").when(F.col("original") == F.col("fixed"), "no change")
    return out.withColumn("problem", why).drop("shown")


def require_none(problems: DataFrame, what: str) -> None:
    """An error that names one of the rows, if there is any."""
    if found := problems.limit(1).collect():
        raise ValueError(f"{what}: {found[0].asDict()}")


def require_count(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, or an error if they aren't ``n``."""
    if (have := rows.count()) != n:
        raise ValueError(f"{have} rows, expected {n}")
    return rows
