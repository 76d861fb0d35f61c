"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.storage import discard, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the lowest of u and all its v. The aggregate combines before its shuffle, and the join
    that brings m back can be split where one u has very many pairs."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u above v, are stars around the lowest nodes: no node has two edges to lower ones, or one
    to a lower and others to higher ones. Another round would change nothing then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    open_ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0")
    return not open_ends.agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (two columns of one ordered type); root is the component's lowest node.

    Self-loops, repeated and reversed edges and nulls do no harm: edges with a null end are left out. No edges give
    no rows. Each round is written to the shared folder; rounds end as soon as all edges lead to the lowest nodes, so
    edges that do from the start take none.
    """
    a, b = edges.columns
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("ok"))
    now = written(ends.where("ok").select("u", "v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()
            )
        both = now.union(now.select("v", "u"))
        large = _lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _lowest(large.distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        after = written(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
