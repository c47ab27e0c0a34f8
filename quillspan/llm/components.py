"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import discard, written


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each linked id: columns id, component.

    Every id hooks to its smallest linked neighbour below it; chains of hooks
    are halved until all point to their roots; links are then drawn between
    roots. Each round writes its tables to the shared folder and removes those
    of the round before. Loops and
    repeated links do no harm; an empty table has no components.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = written(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        hooks = written(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        while True:
            above = hooks.select(F.col("hi").alias("via"), F.col("lo").alias("root"))
            jumped = hooks.join(above, F.col("lo") == F.col("via"), "left")
            if jumped.where("root IS NOT NULL").isEmpty():
                break
            shorter = written(jumped.select("hi", F.coalesce("root", "lo").alias("lo")), "hooks")
            discard(hooks)
            hooks = shorter
        root = hooks.select(F.col("hi").alias("via"), F.col("lo").alias("root"))
        if labels is None:
            fresh = hooks.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        else:
            moved = labels.join(root, F.col("component") == F.col("via"), "left").select("id", F.coalesce("root", "component").alias("component"))
            fresh = moved.unionByName(hooks.join(labels.select("id"), F.col("hi") == F.col("id"), "left_anti").select(F.col("hi").alias("id"), F.col("lo").alias("component")))
        to = lambda df, c: df.join(root, F.col(c) == F.col("via"), "left").withColumn(c, F.coalesce("root", c)).drop("via", "root")
        rest = written(to(to(edges, "hi"), "lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct(), "links")
        fresh = written(fresh, "labels")
        discard(edges, hooks, labels)
        edges, labels = rest, fresh
    if labels is None:
        return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    discard(edges)
    roots = labels.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return labels.unionByName(roots)
