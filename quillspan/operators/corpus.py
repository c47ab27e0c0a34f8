"""Training corpora: alignment, overlap with benchmarks, quotas, draws and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import udfs
from quillspan.functions.stats import ratio
from quillspan.operators.audit import draw_order
from quillspan.storage import stored

NGRAM = 13
#: A benchmark that is broadcast has at most so many texts and bytes in normal form; a larger one is joined by hash. With it go twelve bytes a word, at most six times the texts (words of one letter).
BROADCAST_TEXTS, BROADCAST_BYTES = 200_000, 8 << 20
#: Rows of a quota table that are broadcast at most.
BROADCAST_STRATA = 10_000


def small(table: DataFrame, most: int = BROADCAST_STRATA) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def positions(rows: DataFrame, groups: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their number from 1 in each group, in an order that should have no ties.

    Rows are dealt by ranges of group and order, cut where a sample of the rows
    says they are equally many, however the values lie; each range is sorted and
    numbered where it is written. What stands before a range is the sum of the
    sizes of those before it, and a group begins at its smallest number, so no
    task holds a group, and rows are shuffled once.
    """
    given = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = {f"k{i}": k for i, k in enumerate([*(F.col(f"`{g}`") for g in groups), *given])}
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(k.alias(n) for n, k in keys.items()))
    dealt = whole.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    own = list(keys)[: len(groups)]
    dealt = stored(dealt.select("row", *own, "at"), "numbered")
    part = F.shiftright("at", 33)  # the number of the range; the place within it is in the other bits
    sizes = dealt.groupBy(part.alias("range")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("range")) - F.col("n")  # a row a range
    placed = dealt.join(F.broadcast(sizes.select("range", before.alias("before"))), part == F.col("range"))
    placed = placed.select("row", *own, (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1).alias("number"))
    if own:
        starts = small(placed.groupBy(*(F.col(g).alias(f"of_{g}") for g in own)).agg(F.min("number").alias("start")))
        same = F.lit(True)
        for g in own:
            same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
        placed = placed.join(starts, same).withColumn("number", F.col("number") - F.col("start") + 1)
    return placed.select(*(F.col("row").getField(c).alias(c) for c in rows.columns if c != name), F.col("number").alias(name))


def zipped(a: DataFrame, b: DataFrame, position: str, check: list[str], columns: list[str]) -> DataFrame:
    """Rows of two tables by position; the query stops where ``check`` columns differ or one side has a position that the other lacks."""
    left = a.select("*", F.lit(True).alias("_left"))
    right = b.select(F.col(position).alias("_position"), F.lit(True).alias("_right"), *(F.col(c).alias(f"_{c}") for c in check), *(F.col(c).alias(f"other_{c}") for c in columns))
    same = F.lit(True)
    for c in check:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    out = left.join(right, F.col(position) == F.col("_position"), "full_outer")
    out = out.withColumn("_ok", F.assert_true(both, F.concat(F.lit("one side lacks position "), F.coalesce(F.col(position), F.col("_position")).cast("string"))))
    out = out.withColumn("_same", F.assert_true(same, F.lit("rows are not aligned")))
    return out.where(F.col("_ok").isNull() & F.col("_same").isNull()).drop("_ok", "_same", "_left", "_right", "_position", *(f"_{c}" for c in check))


def overlaps(texts: DataFrame, benchmark: DataFrame, key: str, n: int = NGRAM, lang: str | None = "lang") -> DataFrame:
    """Texts that equal a benchmark text of their language in normal form (``udfs.norm``) (``exact``), or else share an n-gram with one (``ngram``): key, reason.

    Both tables have ``lang`` (None: languages don't count) and text, ``texts``
    also the key; a key with several rows has the stronger reason. A benchmark of
    at most ``BROADCAST_TEXTS`` and ``BROADCAST_BYTES`` meets the texts where
    they are read, in one pass; a larger one is joined by the hashes of its
    n-grams, and texts that hit are confirmed on the n-grams themselves. Null
    texts match nothing.
    """
    tongue = F.col(lang) if lang else F.lit("")
    form = lambda df, *keep: df.select(*keep, tongue.alias("tongue"), udfs.norm(F.col("text")).alias("norm")).where("norm <> '' AND tongue IS NOT NULL")
    bench = form(benchmark).distinct()
    many, size = bench.agg(F.count("*"), F.sum(F.octet_length("norm"))).first()
    if many <= BROADCAST_TEXTS and (size or 0) <= BROADCAST_BYTES:
        own: dict[str, set[str]] = {}
        for r in bench.toLocalIterator():
            own.setdefault(r["tongue"], set()).add(r["norm"])
        rows = form(texts, key).select(key, udfs.overlap_reason(F.col("tongue"), F.col("norm"), own, n).alias("reason"))
        return rows.where("reason IS NOT NULL").groupBy(key).agg(F.min("reason").alias("reason"))
    words = F.split("norm", " ").alias("words")
    grams = bench.select("tongue", F.explode(udfs.grams(F.col("norm"), n)).alias("h")).distinct()
    same = form(texts, key).join(bench, ["tongue", "norm"], "left_semi").select(key)
    hashed = form(texts, key).select(key, "tongue", F.explode(udfs.grams(F.col("norm"), n)).alias("h"))
    hit = hashed.join(grams, ["tongue", "h"], "left_semi").select(key).unionByName(same).distinct()
    again = form(texts.join(hit, key, "left_semi"), key)
    exact = again.join(bench, ["tongue", "norm"], "left_semi").select(key).distinct()
    own_grams = again.select(key, "tongue", words).select(key, "tongue", F.explode(T.ngrams("words", n)).alias("gram"))
    text_grams = bench.select("tongue", words).select("tongue", F.explode(T.ngrams("words", n)).alias("gram")).distinct()
    shared = own_grams.join(text_grams, ["tongue", "gram"], "left_semi").select(key).distinct()
    return exact.withColumn("reason", F.lit("exact")).unionByName(shared.join(exact, key, "left_anti").withColumn("reason", F.lit("ngram")))


def without_overlap(texts: DataFrame, benchmark: DataFrame, key: str, n: int = NGRAM, lang: str | None = "lang") -> DataFrame:
    """Texts that overlap with no benchmark text of their language. Where a key has a row for each language, all of them go as soon as one overlaps."""
    return texts.join(overlaps(texts, benchmark, key, n, lang).select(key).distinct(), key, "left_anti")


def reason_counts(flags: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows for each reason, and rows with any: reason, n. A row may count for several."""
    marks = F.array_compact(F.array(*(F.when(c, name) for name, c in reasons.items())))
    marks = F.when(F.size(marks) > 0, F.concat(marks, F.array(F.lit("any")))).otherwise(marks)
    return flags.select(F.explode(marks).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def largest_remainder(strata: DataFrame, total: int, size: str = "n", first: str = "first") -> DataFrame:
    """Quotas in proportion to ``size`` that add up to ``total``; leftover seats go by remainder, ties to the stratum seen first. One row a stratum."""
    every = Window.partitionBy(F.lit(1))
    exact = F.col(size) * F.lit(total) / F.sum(size).over(every)
    out = strata.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(every)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), first))
    return out.withColumn("_left", left).withColumn("_rank", rank).withColumn("quota", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_exact", "_floor", "_left", "_rank")


def apportioned(items: DataFrame, category: str, key: str, total: int, keep: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Seats of each category: category, size, kept, seats.

    Seats are in proportion to size, at least ``least`` and at least as many as
    the category has ids in ``keep``, at most its size; the total grows if the
    floors need more. What is left over goes round the categories by falling
    remainder (ties by name), what floors take too much comes back the other way
    round. An error if the total doesn't fit. One row a category: small tables.
    """
    kept = keep.select(key).distinct().withColumn("_kept", F.lit(1)) if keep is not None else items.select(key).limit(0).withColumn("_kept", F.lit(1))
    sizes = items.select(category, key).join(kept, key, "left").groupBy(category).agg(F.count("*").alias("size"), F.count("_kept").alias("kept"))
    every = Window.partitionBy(F.lit(1))
    out = sizes.withColumn("floor", F.greatest(F.lit(least), F.col("kept")))
    out = out.withColumn("total", F.greatest(F.lit(total), F.sum("floor").over(every))).withColumn("share", F.col("total") * F.col("size") / F.sum("size").over(every))
    fits = (F.lit(total) >= least * F.count("*").over(every)) & (F.lit(total) <= F.sum("size").over(every))
    out = out.withColumn("share", F.when(fits, F.col("share")).otherwise(F.raise_error(F.lit("the total doesn't fit the categories")).cast("double")))
    rest = F.col("share") - F.floor("share")
    out = out.withColumn("first", F.greatest("floor", F.floor("share"))).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(rest, 9)), category)))
    out = out.withColumn("gap", F.col("total") - F.sum("first").over(every))
    room = F.when(F.col("gap") > 0, F.col("size") - F.col("first")).otherwise(F.col("first") - F.col("floor"))
    turns = F.least(room, F.abs("gap")).cast("int")
    seats = out.where((F.col("gap") != 0) & (turns > 0)).select(category, "gap", F.explode(F.sequence(F.lit(1), turns)).alias("turn"), F.when(F.col("gap") > 0, F.col("rank")).otherwise(-F.col("rank")).alias("place"))
    moved = seats.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("turn", "place"))).where(F.col("_n") <= F.abs("gap"))
    moved = moved.groupBy(category).agg(F.sum(F.signum("gap")).cast("long").alias("moved"))
    return out.join(moved, category, "left").select(category, "size", "kept", (F.col("first") + F.coalesce("moved", F.lit(0))).cast("long").alias("seats"))


def chosen(items: DataFrame, category: str, key: str, total: int, seed: int, keep: DataFrame | None = None) -> DataFrame:
    """A stratified subset of ids (category, key) by ``apportioned`` seats: all kept ids, the rest drawn by ``draw_order``."""
    seats = apportioned(items, category, key, total, keep)
    kept = keep.select(key).distinct().withColumn("_kept", F.lit(True)) if keep is not None else items.select(key).limit(0).withColumn("_kept", F.lit(True))
    rows = items.select(category, key).join(kept, key, "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    most = seats.agg(F.max("seats")).first()[0] or 0
    w = Window.partitionBy(category).orderBy(F.desc("_kept"), *draw_order(seed, key))
    drawn = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return drawn.join(small(seats.select(category, "seats")), category).where("_r <= seats").select(category, key)


def stratified(rows: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Each stratum's quota of rows in random order; ``quotas`` has stratum and quota. No task hands on more rows of a stratum than the largest quota."""
    most = quotas.agg(F.max("quota")).first()[0] or 0
    w = Window.partitionBy(stratum).orderBy(*draw_order(seed, key))
    drawn = rows.withColumn("draw", F.row_number().over(w).cast("long")).where(F.col("draw") <= most)
    return drawn.join(small(quotas.select(stratum, "quota")), stratum).where("draw <= quota").drop("quota")


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """``rows`` in a random order that seed and key fix."""
    return rows.orderBy(*draw_order(seed, key))


def sorted_by(rows: DataFrame, column: str, first: list[str]) -> DataFrame:
    """``rows`` in the order of a column, the values in ``first`` before all others."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col(column)), F.lit(0)), F.lit(len(first) + 1))
    return rows.orderBy(place, column)


def limited(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in an order: each task hands on ``n`` at most."""
    return rows.orderBy(*order).limit(n)


def first_by(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def interleaved(rows: DataFrame, started: DataFrame, key: str, lang: str, languages: list[str]) -> DataFrame:
    """Order of work: keys already started first, then by key, languages as given: adds ``position``."""
    begun = started.select(key).distinct().withColumn("_begun", F.lit(1))
    place = F.array_position(F.array(*map(F.lit, languages)), F.col(lang))
    out = rows.join(begun, key, "left")
    return positions(out, [], [F.lit(1) - F.coalesce("_begun", F.lit(0)), key, place]).drop("_begun")


def batches(rows: DataFrame, groups: list[str], order: str, size: int) -> DataFrame:
    """Rows of each group in steps of ``size``: adds ``step`` from 0."""
    return positions(rows, groups, [order], "_n").withColumn("step", F.floor((F.col("_n") - 1) / size)).drop("_n")


#: Bits that a round of ``exact_ranks`` settles: a group has at most so many counts (two to that power) for each value sought.
RANK_BITS = 16


def exact_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics of whole numbers by group: group, n, and for each name the value at an index from 0 of the group's sorted values, null values left out. ``ranks``: indices as expressions of ``n``.

    Values are never sorted or gathered. A group's range is cut into at most
    2 ** ``RANK_BITS`` equal parts; rows are counted by part where they are read,
    and only the part that holds a sought index goes on, cut anew, until parts
    are single values: one round for a range of 65,536, two for billions, four or
    five for all of 64 bits. What meets by group are counts of parts, however many distinct
    values there are.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).cast("decimal(20,0)").alias("_v"))
    stats = own.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    sought = F.array(*(F.struct(F.lit(k).alias("name"), i.cast("long").alias("at")) for k, i in ranks.items()))
    # a row for each sought index: the range that holds it, and how many of its group's rows stand below that
    state = stored(stats.select("_g", "n", "low", "high", F.explode(sought).alias("s")).select("_g", "n", "low", "high", "s.name", "s.at", F.lit(0).cast("long").alias("below")), "ranks")
    width = F.ceil((F.col("high") - F.col("low") + 1).cast("decimal(38,0)") / (1 << RANK_BITS)).cast("decimal(20,0)")
    while not state.where("high > low").isEmpty():
        open_ = state.where("high > low").select("_g", "low", "high", width.alias("width")).distinct()
        part = F.floor((F.col("_v") - F.col("low")) / F.col("width")).cast("int")
        counts = own.join(small(open_.withColumnRenamed("_g", "_of")), F.col("_g").eqNullSafe(F.col("_of")) & F.col("_v").between(F.col("low"), F.col("high"))).groupBy("_g", "low", "high", "width", part.alias("part")).agg(F.count("*").alias("k"))
        upto = F.sum("k").over(Window.partitionBy("_g", "low", "high").orderBy("part"))  # counts of parts, at most 2 ** RANK_BITS
        counts = counts.withColumn("upto", upto).select(*(F.col(c).alias(f"c_{c}") for c in ("_g", "low", "high", "width", "part", "k", "upto")))
        same = F.col("_g").eqNullSafe(F.col("c__g")) & (F.col("low") == F.col("c_low")) & (F.col("high") == F.col("c_high"))
        inside = F.col("at") - F.col("below")
        hit = state.join(counts, same & (inside < F.col("c_upto")) & (inside >= F.col("c_upto") - F.col("c_k")), "left")
        low = (F.col("low") + F.col("c_part") * F.col("c_width")).cast("decimal(20,0)")
        high = F.least(F.col("high"), (F.col("low") + (F.col("c_part") + 1) * F.col("c_width") - 1).cast("decimal(20,0)"))
        moved = F.col("c_part").isNotNull()
        state = stored(hit.select("_g", "n", F.when(moved, low).otherwise(F.col("low")).alias("low"), F.when(moved, high).otherwise(F.col("high")).alias("high"), "name", "at", F.when(moved, F.col("below") + F.col("c_upto") - F.col("c_k")).otherwise(F.col("below")).alias("below")), "ranks")
    found = state.groupBy("_g").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == k, F.col("low"))).cast("long").alias(k) for k in ranks))
    return found.withColumnRenamed("_g", group)


def described(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean (one place), upper median, 90th hundredth, largest and sum of whole numbers."""
    n = F.col("n")
    ranks = exact_ranks(rows, group, value, {"median": F.floor(n / 2), "p90": F.floor(n * F.lit(0.9))})
    sums = rows.groupBy(group).agg(F.bround(ratio(F.sum(value), F.count(value)), 1).alias("mean"), F.max(value).alias("most"), F.sum(value).alias("sum"))
    return _beside(ranks, sums, group).select(group, "n", "mean", "median", "p90", "most", "sum")


def _beside(ranks: DataFrame, sums: DataFrame, group: str) -> DataFrame:
    """Two tables of one row a group, side by side; null is a group too."""
    return ranks.join(sums.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))


def described_middle(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, true median (mean of the middle two), least, largest and sum."""
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("sum"))


def length_quantiles(rows: DataFrame, group: str, value: str, limits: list[int]) -> DataFrame:
    """n, upper median, 90th and 99th hundredths, largest of whole numbers; number and share of values within each limit."""
    n, v = F.col("n"), F.col(value)
    ranks = exact_ranks(rows, group, value, {"median": F.floor(n / 2), "p90": F.floor(n * F.lit(0.9)), "p99": F.floor(n * F.lit(0.99))})
    within = {m: F.count_if(v <= m) for m in limits}
    sums = rows.groupBy(group).agg(F.max(v).alias("most"), *(c.alias(f"n_within_{m}") for m, c in within.items()), *(ratio(c, F.count(v)).alias(f"within_{m}") for m, c in within.items()))
    return _beside(ranks, sums, group).drop("_group")


def drop_accounting(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows that each step drops and leaves, steps in order: step, dropped, left. ``steps``: what a row must fulfil to stay (null: it goes). One pass: a row counts for the first step that drops it."""
    fate = F.lit(len(steps))
    for i, c in reversed(list(enumerate(steps.values()))):
        fate = F.when(F.coalesce(c, F.lit(False)), fate).otherwise(F.lit(i))
    flags = rows.select(fate.alias("_fate"))
    sums = flags.agg(*(x for i in range(len(steps)) for x in (F.count_if(F.col("_fate") == i).alias(f"d{i}"), F.count_if(F.col("_fate") > i).alias(f"l{i}"))))
    each = F.array(*(F.struct(F.lit(i).alias("number"), F.lit(name).alias("step"), F.col(f"d{i}").alias("dropped"), F.col(f"l{i}").alias("left")) for i, name in enumerate(steps)))
    return sums.select(F.inline(each))


def length_shares(rows: DataFrame, group: str, value: str, limits: list[int]) -> DataFrame:
    """Share of values within each limit."""
    return rows.groupBy(group).agg(*(F.avg((F.col(value) <= m).cast("double")).alias(f"within_{m}") for m in limits))


def length_ratio(rows: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """Sum of each arm against that of ``base`` (three places); null for all arms where ``base`` is absent."""
    sums = rows.groupBy(arm).agg(F.sum(value).alias("s"))
    ref = sums.where(F.col(arm) == base).select(F.col("s").alias("b"))
    return sums.join(F.broadcast(ref), F.lit(True), "left").select(arm, F.bround(ratio(F.col("s"), F.col("b")), 3).alias("ratio"))  # one row


def share_of_total(rows: DataFrame, group: str, part: str, value: str) -> DataFrame:
    sums = rows.groupBy(group, part).agg(F.sum(value).alias("sum"))
    return sums.withColumn("share", ratio(F.col("sum"), F.sum("sum").over(Window.partitionBy(group))))


def within_all(rows: DataFrame, lengths: list[str], limit: int) -> DataFrame:
    """Rows whose every length is within the limit; none is cut short."""
    return rows.where(F.greatest(*lengths) <= limit)


def step_totals(rows: DataFrame, step: str, tokens: str, loss_tokens: str) -> DataFrame:
    """Tokens of each step and the share of them that carries loss."""
    return rows.groupBy(step).agg(F.sum(tokens).alias("tokens"), ratio(F.sum(loss_tokens), F.sum(tokens)).alias("loss_share"))
