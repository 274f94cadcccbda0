"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges up to which a round is one task without any exchange.
SMALL_EDGES = 100_000


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and root, its component's smallest node, for all nodes of an edge (u, v; long) but the roots.

    Each round points neighbours at the smallest node around them, first at
    the larger and then at the smaller neighbours, until nothing changes; the
    number of rounds grows with the logarithm of the diameter. Nodes with many
    neighbours are met by partial aggregation and by joins that adaptive execution splits.
    The edges never become more; once they are few, which is checked, they are one partition.
    """
    found = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    before = mark(found)
    for _ in range(most_rounds):
        if not before[0]:
            break
        few = found.coalesce(1) if before[0] <= SMALL_EDGES else found
        found = checkpoint(_small_star(_large_star(few)))
        now = mark(found)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
