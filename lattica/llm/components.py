"""Connected components of a graph given as edges, with joins and groupings only: nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import discard, hot_lookup, materialize

#: Roots that more than this share of the nodes point to are broadcast: there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches.

    Rounds of smallest neighbour and pointer jumping until nothing changes; every round is written to the shared folder,
    so its lineage is short and a lost executor costs one round's tasks; the round before is then deleted. Rounds grow
    with the log of the longest path. Many nodes that point to one root don't meet in one task: such roots are looked up
    in a broadcast table of at most 1 / HOT_SHARE rows. No edges: no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = materialize(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "component-edges")
    now = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "component-roots")
    limit = max(1000, now.count() * HOT_SHARE)
    while True:
        near = both.join(now.select(F.col("node").alias("v"), F.col("root")), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = now.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = now.select(F.col("node").alias("next"), F.col("root").alias("far"))
        hot_before = not now.groupBy("root").count().filter(F.col("count") > limit / 2).isEmpty()
        if hot_before:
            step = materialize(step, "component-steps")
            moved = hot_lookup(step, jump, "next", step.groupBy("next").count().filter(F.col("count") > limit).select("next"))
        else:
            moved = step.join(jump, "next")
        after = moved.select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("changed"))
        after = materialize(after, "component-roots")
        if hot_before:
            discard(step)
        discard(now)
        now = after.select("node", "root")
        now.written_to = after.written_to
        if after.filter("changed").isEmpty():
            discard(both)
            return now
