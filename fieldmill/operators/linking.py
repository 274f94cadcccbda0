"""Groups out of pairs: connected components, and the first of each group in a given order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in ``spark.checkpoint.dir``, the folder that all executors share; only a local session may lack the setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fieldmill-lineage-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b; long): root is the smallest node that it is linked to.

    Each node takes the smallest root among its own and its neighbours', then the root of its root, until no root
    changes; the second step makes the number of rounds logarithmic in the length of a chain.
    """
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    for _ in range(most_rounds):
        seen = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("__next")), "b").groupBy(F.col("a").alias("node")).agg(F.min("__next").alias("__least"))
        lower = roots.join(seen, "node").select("node", F.col("root").alias("__old"), F.least("root", "__least").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("__above"))
        moved = settled(lower.join(above, "root", "left").select("node", "__old", F.least("root", F.coalesce("__above", "root")).alias("root")))
        changed = moved.where("__old <> root").limit(1).count()
        roots = moved.select("node", "root")
        if not changed:
            return roots
    raise RuntimeError("the components have not settled")


def first_come(nodes: DataFrame, pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, home) for each of ``nodes`` (node; long, in order), as if they came one by one: a node that is near an earlier home joins the first of these, and any other becomes a home.

    ``pairs`` has near nodes (earlier, later) with earlier < later. A node is settled once all nodes before it that
    it is near are, so a round settles all nodes that wait for settled ones only; the rounds are as many as the longest chain of waiting
    nodes, not as many as there are nodes.
    """
    pairs = settled(pairs.select("earlier", "later").distinct())
    waiting = settled(pairs.select(F.col("later").alias("node")).distinct())
    homes = nodes.select("node").join(waiting, "node", "left_anti").select("node", F.lit(True).alias("is_home"))
    decided = settled(homes)
    for _ in range(most_rounds):
        open_pairs = pairs.join(waiting.select(F.col("node").alias("later")), "later").join(decided.select(F.col("node").alias("earlier"), "is_home"), "earlier", "left")
        # a home before it settles a node at once; it is a home itself when all before it are settled as others
        state = open_pairs.groupBy(F.col("later").alias("node")).agg(F.coalesce(F.max("is_home"), F.lit(False)).alias("joins"), F.count_if(F.col("is_home").isNull()).alias("left"))
        now = settled(state.where("joins OR left = 0").select("node", (~F.col("joins")).alias("is_home")))
        if not now.limit(1).count():
            break
        decided = settled(decided.union(now))
        waiting = settled(waiting.join(now.select("node"), "node", "left_anti"))
    if waiting.limit(1).count():
        raise RuntimeError("the order has not settled")
    joined = pairs.join(decided.where("is_home").select(F.col("node").alias("earlier")), "earlier").groupBy(F.col("later").alias("node")).agg(F.min("earlier").alias("__home"))
    return decided.join(joined, "node", "left").select("node", F.when(F.col("is_home"), F.col("node")).otherwise(F.col("__home")).alias("home"))
