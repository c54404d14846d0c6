"""Connected components of an undirected graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import collect_garbage, cut, drop_cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node long, component long), the smallest node reachable.

    Alternates large-star and small-star contraction (Kiveris et al., 2014).
    Every round keeps at most one edge per node and neighbourhood minimum, so
    a star of any size stays linear; no neighbourhood is collected. Self loops,
    repeated edges and either direction are allowed; nodes without an edge do
    not appear. Each round is written to the shared folder.
    """
    current = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.unionAll(current.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b")  # no more rows than edges; equal ones go below
        # small star: neighbours below a node, and the node itself, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.selectExpr("b AS a", "m AS b").unionAll(least.selectExpr("a", "m AS b")).where("a <> b").distinct()
        following = cut(small, "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(current)
        current = following
        collect_garbage(edges.sparkSession)  # the round's plans and shuffle files
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = current.selectExpr("b AS node", "b AS component").distinct()
    return nodes.unionAll(roots)
