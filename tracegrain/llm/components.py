"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of the links u, v (longs).

    Each round links the neighbours of a node to the smallest among them, until
    nothing changes; a round is written to the shared folder.  Minima are
    combined before they are shuffled, and the joins that bring them back are
    split where a node has very many neighbours; beyond BROADCAST_ROWS rows
    they broadcast nothing.
    """
    u, v = F.least("u", "v"), F.greatest("u", "v")
    edges = common.stage(links.where("u != v").select(u.alias("root"), v.alias("node")).distinct(), "edges")
    mark = None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)")).alias("sum")).first()
        if not found.n or (found.n, found.sum) == mark:
            return edges.select("node", "root")
        mark = (found.n, found.sum)
        facts = common.by_shuffle if 2 * found.n > common.BROADCAST_ROWS else lambda df: df
        both = edges.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("node").alias("a"), F.col("root").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(facts(least), "a").select(F.col("b").alias("node"), F.col("m").alias("root")).where("node != root").distinct()
        large, before = common.stage(large, "edges"), edges
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(facts(low), "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("m").alias("root")), F.struct("node", F.col("m").alias("root")))).alias("e"))
        edges = common.stage(small.select("e.node", "e.root").where("node != root").distinct(), "edges")
        common.unstage(before)
        common.unstage(large)
