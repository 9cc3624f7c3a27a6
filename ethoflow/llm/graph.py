"""Connected components by alternating stars (Kiveris et al., 2014), as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, written


def components(links: DataFrame) -> DataFrame:
    """From links(a, b) of ids: rows (node, component), component the smallest id that a node reaches.

    Each round keeps at most one row for each link; hub nodes are handled by partial minima and a join
    that Spark can split, never gathered. Nodes without links are not returned; null ids are left out.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = written(links.selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    before = None
    while True:  # every round but the last shortens a path; rounds grow with the logarithm of the longest one
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b as a", "m as b")
        large = large.where("a <> b").distinct()
        # small star: edges point from larger to smaller already
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("b as a", "m as b").union(low.selectExpr("a", "m as b"))
        after = written(small.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
        released(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.selectExpr("a as node", "b as component").union(roots.selectExpr("node", "node as component"))
