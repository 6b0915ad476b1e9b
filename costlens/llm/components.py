"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for each node of an edge but the component ids themselves.

    ``component`` is the smallest node that can be reached. Self links and repeated or
    reversed edges change nothing; no edges give no rows. Each round is two grouped
    minima and two joins on node keys, written to the shared folder, and the number of
    rounds grows with the logarithm of the longest chain.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        print_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(print_) or print_["n"] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        seen = tuple(print_)
        now = cut(_small_star(_large_star(now)), "edges")
    raise RuntimeError("components did not settle")
