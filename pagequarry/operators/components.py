"""Connected components of links within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.session import materialize


def connected_components(links: DataFrame, group: str = "scan_id", label: str = "components") -> DataFrame:
    """(group, node, root) of every node of ``links`` (group, a, b): root is the smallest node that can be reached.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones, and writes what is
    left, so a lost executor costs a round. Rounds grow with the logarithm of the number of nodes. Neighbours are
    aggregated before they are shuffled; a node with very many of them is a skewed join, which is split. Links of a node
    with itself and nulls are left out.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, before = materialize(links.where("a <> b").select(group, high, low).distinct(), label), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(group, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            tops = now.select(group, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(group, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
        before = state
        both = now.unionByName(now.select(group, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(group, "u").agg(F.min("v").alias("m")).select(group, "u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, [group, "u"]).select(group, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = hung.groupBy(group, "u").agg(F.min("v").alias("m"))
        moved = hung.join(first, [group, "u"]).where("v <> m").select(group, F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(first.select(group, "u", F.col("m").alias("v"))).distinct(), label)
