"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import HEAVY, LEAST_HEAVY, cut, join_by


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long), any direction, loops and repeats allowed -> (node, component): the smallest node it reaches.

    Nodes without an edge don't appear. Each round is two aggregations by node and joins on the node; only counts come to the driver. A round that
    changes nothing ends the loop; the number of rounds grows with the logarithm of the longest chain. No neighbour list is
    ever gathered, and the many links of one node are joined where they are (join_by), so it costs rows, not memory.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    n = before[0]
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a node with very many links is joined where they are; join_by reads its inputs several times, so they are written then
        hot = 2 * n > LEAST_HEAVY and both.groupBy("a").count().agg(F.max("count")).first()[0] > max(LEAST_HEAVY, 2 * n // HEAVY)
        held = (lambda df: cut(df, 2 * n)) if hot else lambda df: df  # noqa: B023
        join = (lambda rows, per, total: join_by(rows, per, ["a"], "n", total)) if hot else (lambda rows, per, total: rows.join(per.drop("n"), "a"))
        # large star: each node links its larger neighbours to the smallest node around it
        least = held(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = held(join(both, least, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: each node links its smaller neighbours and itself to the smallest of them
        least = held(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        moved = join(large, least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), 2 * n)
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before, n = after, after[0]


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of parts(node, component) and further links (a, b)."""
    links = cut(links)
    return parts if links.isEmpty() else connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
