"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm._common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    out = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of long ids -> (node, component), component being the smallest id reachable.

    Only nodes with an edge come back; self loops and repeated edges are ignored, an empty table gives
    an empty result. Each round shrinks the depth of the forest by about half; only two numbers of a
    round reach the driver (its edge count and a checksum), to see that nothing changes any more.
    Raises RuntimeError if the rounds run out, rather than returning unfinished components.
    """
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    mark = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), label)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a")).distinct())
