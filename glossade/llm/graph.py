"""Connected components on Spark: alternating large and small stars, each round a written table; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour above (large) or not above (small) a node to the least of the node and those neighbours."""
    if large:
        side = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        side = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = side.join(least, "a")
    if large:
        return out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return out.select(F.col("b").alias("x"), F.col("m").alias("b"), "a").select(F.explode(F.array("x", "a")).alias("a"), "b").where("a != b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b): root is the least node reachable. Nodes are of any ordered type.

    Loops and repeated edges do no harm; rows with a null end are left out; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    nodes_alone = edges.where("a = b").select(F.col("a").alias("node"))
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = written(nodes_alone.distinct(), "loops")
    mark = None
    for _ in range(rounds):
        new = written(_star(_star(now, True).distinct(), False).distinct(), "edges")
        dropped(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    found = linked.union(roots)
    return found.union(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("root")))
