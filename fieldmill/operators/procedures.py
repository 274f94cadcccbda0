"""Procedure graphs: canonical steps, edges between them, and walks."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import components, settled

#: Fixed: the cosine from which two steps are one, and how many of the nearest clusters are looked at.
SAME_STEP, NEAREST = 0.893, 5
MAX_ATTRIBUTES, MAX_SOURCES = 3, 5


def collect_steps(traces: DataFrame) -> DataFrame:
    """Traces with their steps in order, without those under five characters, if two remain. ``steps`` is an array of (step, action, why)."""
    ordered = F.array_sort("steps", lambda a, b: F.coalesce(a["step"], F.lit(0)) - F.coalesce(b["step"], F.lit(0)))
    kept = F.filter(F.transform(ordered, lambda s: F.struct(F.trim(s["action"]).alias("action"), F.trim(F.coalesce(s["why"], F.lit(""))).alias("why"))), lambda s: F.length(s["action"]) >= 5)
    return traces.withColumn("steps", kept).where(F.size("steps") >= 2)


#: Random projections for the vectors that may be near: how likely a pair at the threshold meets in no band, and the most signs of a key.
MISSED, MOST_BITS = 5e-5, 15
#: Vectors that share a key on average, those that are compared at once, rows of a product at once, and vectors that a group holds or so.
SHARE_KEY, TILE, ROWS, PACKED = 8192, 16384, 1024, 16384
#: Near pairs at once, or those of a row.
PAIRS = 1_000_000
#: Keys of all bands that are broadcast at most.
MOST_KEYS = 1_000_000


def _bands(n: int, threshold: float) -> tuple[int, int]:
    """(bands, bits) for n vectors: as few signs a key as leave some thousand vectors together, as vectors are moved once for each band and short keys need fewer bands."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, n) / SHARE_KEY))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return (math.ceil(math.log(MISSED) / math.log(1 - meet)), bits) if bits and meet < 1 else (1, bits)


def _projection_keys(vectors: DataFrame, bands: int, bits: int) -> DataFrame:
    """``vectors`` (with ``vector``) once for each band, with the signs of a few random projections as ``key``.

    Vectors at the threshold agree in a projection's sign with probability 1 - acos(threshold) / pi, so they meet in no band with
    probability ``MISSED`` at most; nearer ones less.
    """
    weights = (1 << np.arange(bits)).astype(np.int64)

    @F.pandas_udf("array<long>")
    def keys(vector: pd.Series) -> pd.Series:
        x = np.stack(vector.to_numpy()).astype(np.float64)
        planes = np.random.Generator(np.random.PCG64(77)).standard_normal((x.shape[1], bands * bits))
        return pd.Series(list(((x @ planes > 0).reshape(len(x), bands, bits) * weights).sum(axis=2)))

    return vectors.select("*", F.posexplode(keys("vector")).alias("band", "key"))


def _near_links(vectors: DataFrame, threshold: float, across: bool) -> DataFrame:
    """(a, b) that connect all of ``vectors`` (id, root, vector, begins, ends) that are near each other, as few as connect them.

    With ``across``, a pair counts if its roots differ and one's id lies in the other's span (begins, ends], and the roots are
    linked. A key's vectors are dealt into tiles by a hash, and each pair of tiles is a cell; cells are packed by a hash into groups of some
    thousand vectors, so that memory is bounded. Work grows with the square of the vectors that share a key. The table of keys is
    broadcast up to ``MOST_KEYS``, so that vectors' keys aren't shuffled to be counted.
    """
    total = vectors.count()
    bands, bits = _bands(total, threshold)
    keyed = _projection_keys(vectors.select("id", "root", "vector"), bands, bits).drop("vector")
    tiles = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("n > 1 AND r <> s").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    packs = max(1, total * bands // PACKED)
    # bands of few keys: their table is small however many vectors there are
    few = F.broadcast if bands << bits <= MOST_KEYS else (lambda t: t)
    # the bands in which a vector meets others are found without it, so that it is only moved for these
    met = keyed.join(few(tiles.select("band", "key", "tiles")), ["band", "key"]).groupBy("id").agg(F.collect_list(F.struct("band", "key", "tiles")).alias("met"))
    dealt = vectors.join(met, "id").withColumn("vector", F.transform("vector", lambda x: x.cast("float"))).withColumn("met", F.explode("met")).select("*", "met.*")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pair = lambda k: F.struct(F.least("tile", k).alias("i"), F.greatest("tile", k).alias("j"))
    dealt = dealt.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair))).withColumn("cell", F.xxhash64("band", "key", "p"))
    dealt = dealt.select(F.pmod("cell", F.lit(packs)).alias("pack"), "cell", (F.col("p.i") != F.col("p.j")).alias("mixed"), "tile", "id", "root", "vector", "begins", "ends")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cell", kind="stable")
        vector = np.stack(group["vector"].to_numpy())
        ids, root, tile, mixed, begins, ends = (group[c].to_numpy() for c in ("id", "root", "tile", "mixed", "begins", "ends"))
        names, own = np.unique(root, return_inverse=True)
        part, kept = np.arange(len(names)), []

        def top(k: int) -> int:
            while part[k] != k:
                k = int(part[k])
            return k

        def link(p: np.ndarray, q: np.ndarray) -> None:
            """Keeps one pair for each two parts that weren't linked."""
            nonlocal part
            apart = part[own[p]] != part[own[q]]
            p, q = p[apart], q[apart]
            s, t = part[own[p]], part[own[q]]
            for i in np.unique(np.minimum(s, t) * len(names) + np.maximum(s, t), return_index=True)[1].tolist():
                x, y = top(int(s[i])), top(int(t[i]))
                if x != y:
                    part[max(x, y)] = min(x, y)
                    kept.append(sorted((int(root[p[i]]), int(root[q[i]]))))
            while (part[part] != part).any():
                part = part[part]

        cuts = np.flatnonzero(np.diff(group["cell"].to_numpy())) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
            for k in range(a, b, ROWS):
                near = vector[k : min(k + ROWS, b)] @ vector[k:b].T >= threshold - 1e-5  # a link too many does no harm
                # some rows at a time, so that pairs are bounded where everything is near everything
                steps = np.cumsum(near.sum(axis=1)) // PAIRS
                for rows in np.split(np.arange(len(near)), np.flatnonzero(np.diff(steps)) + 1):
                    p, q = np.nonzero(near[rows])
                    p = p + rows[0]
                    p, q = p[q > p] + k, q[q > p] + k
                    met = root[p] != root[q]
                    if mixed[a]:
                        met &= tile[p] != tile[q]
                    if across:
                        met &= (ids[q] > begins[p]) & (ids[q] <= ends[p]) | (ids[p] > begins[q]) & (ids[p] <= ends[q])
                    link(p[met], q[met])
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("pack").applyInPandas(run, "a long, b long").distinct()


def _one_by_one(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The greedy pass over a canopy: each step's node, label and the span for which the centre that it left behind stood."""
    group = group.sort_values("pos")
    e = np.stack(group["embedding"].to_numpy()).astype(np.float64)
    guards, positions = group["guard"].tolist(), group["pos"].tolist()
    centres, members, home, after = np.empty_like(e), [], [], np.empty_like(e)
    for i in range(len(e)):
        near = centres[: len(members)] @ e[i]
        at = -1
        for j in np.argsort(-near, kind="stable")[:NEAREST]:
            if near[j] < threshold:
                break
            if guards[members[j][0]] == guards[i]:
                at = int(j)
                break
        if at < 0:
            at = len(members)
            centres[at] = e[i]
            members.append([i])
        else:
            members[at].append(i)
            centres[at] += (e[i] - centres[at]) / len(members[at])
            centres[at] /= np.linalg.norm(centres[at])
        home.append(at)
        after[i] = centres[at]
    actions = group["action"].tolist()
    labels = [Counter(actions[i] for i in m).most_common(1)[0][0] for m in members]
    until = np.full(len(e), np.iinfo(np.int64).max)
    for m in members:
        until[m[:-1]] = [positions[i] for i in m[1:]]
    return pd.DataFrame({"root": group["root"].to_numpy(), "pos": positions, "node": [positions[members[h][0]] for h in home], "label": [labels[h] for h in home], "vector": list(after), "begins": positions, "ends": until})


def canonical_steps(steps: DataFrame, threshold: float = SAME_STEP) -> DataFrame:
    """(pos, node, label, canopy): steps in the order of pos, each in the first of the five nearest clusters that is near enough and has its guard, else in a new one.

    ``steps`` has pos (unique), action, guard and embedding of unit length; a node is named by its first step's pos. The result is
    that of one pass over all steps, but steps that can't touch each other never share a task: near steps, found by signed random
    projections, are linked, the connected ones are a canopy, and the pass runs within each. A cluster's centre moves, so afterwards every step is held
    against the centres that other canopies had at its time; canopies that would have touched become one and run again.
    ``canopy`` is the group's smallest pos, so that the largest group can be read off.
    """
    rows = settled(steps.select("pos", "guard", "action", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
    # of equal vectors one stands for all
    same = rows.groupBy("embedding").agg(F.min("pos").alias("id"), F.collect_list("pos").alias("all"))
    own = same.select("id", F.col("id").alias("root"), F.col("embedding").alias("vector"), F.lit(0).cast("long").alias("begins"), F.lit(0).cast("long").alias("ends"))
    copies = rows.join(same.select("embedding", "id"), "embedding").select(F.col("pos").alias("a"), F.col("id").alias("b")).where("a <> b")
    links = settled(_near_links(own, threshold, across=False).union(copies))
    plain = rows.select(F.col("pos").alias("id"), F.col("embedding").alias("vector"))

    def one_by_one(group: pd.DataFrame) -> pd.DataFrame:
        return _one_by_one(group, threshold)

    schema = "root long, pos long, node long, label string, vector array<double>, begins long, ends long"
    while True:
        roots = components(links)
        placed = rows.join(roots.select(F.col("node").alias("pos"), "root"), "pos", "left").withColumn("root", F.coalesce("root", "pos"))
        found = settled(placed.groupBy("root").applyInPandas(one_by_one, schema))
        # centres of one step are that step, which was compared already
        centres = found.where("node <> pos").select((-F.col("pos") - 1).alias("id"), "root", "vector", "begins", "ends")
        singles = plain.join(found.select(F.col("pos").alias("id"), "root"), "id").select("id", "root", "vector", F.lit(0).cast("long").alias("begins"), F.lit(0).cast("long").alias("ends"))
        touching = settled(_near_links(singles.union(centres), threshold, across=True))
        if not touching.limit(1).count():
            return found.select("pos", "node", "label", F.col("root").alias("canopy"))
        links = settled(links.union(touching))


def next_pairs(steps: DataFrame, trace: str, order: str, node: str) -> DataFrame:
    """(trace, u, v) of steps that follow each other; a step that stays on its node is none."""
    after = F.lead(node).over(Window.partitionBy(trace).orderBy(order))
    return steps.withColumn("u", F.col(node)).withColumn("v", after).where("v IS NOT NULL AND u <> v")


def edges(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("support"))


def top_attributes(pairs: DataFrame, attribute: str, most: int = MAX_ATTRIBUTES) -> DataFrame:
    """The most frequent values of an attribute of each edge; ties by value. Values are counted before an edge's are ranked."""
    counts = pairs.where(F.coalesce(F.trim(attribute), F.lit("")) != "").groupBy("u", "v", attribute).agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.partitionBy("u", "v").orderBy(F.desc("n"), attribute))
    best = counts.withColumn("k", k).where(F.col("k") <= most)
    return best.groupBy("u", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", attribute))), lambda x: x[attribute]).alias(attribute))


def counted_map(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys`` with a map of how often each ``value`` occurs; nulls are no value. The pairs are counted before they are gathered, so a map holds one entry a value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "__n")))).alias(name))


def merged_counts(a: Column, b: Column) -> Column:
    """The sum of two maps of counts."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def graph_nodes(steps: DataFrame, trace: str, order: str, node: str, family: str) -> DataFrame:
    """Each node with n_occurrences, n_starts and n_ends (of traces that begin and end there) and a map of its families' counts."""
    ends = steps.groupBy(trace).agg(F.min_by(node, order).alias("first"), F.max_by(node, order).alias("last"))
    at = ends.select(F.explode(F.array(F.struct(F.col("first").alias(node), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("last").alias(node), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x")).select("x.*")
    counts = steps.groupBy(node).agg(F.count(F.lit(1)).alias("n_occurrences"))
    edge = at.groupBy(node).agg(F.sum("s").alias("n_starts"), F.sum("e").alias("n_ends"))
    zero = F.lit(0).cast("bigint")
    found = counts.join(edge, node, "left").join(counted_map(steps, [node], family, "families"), node, "left")
    return found.select(node, "n_occurrences", F.coalesce("n_starts", zero).alias("n_starts"), F.coalesce("n_ends", zero).alias("n_ends"), F.coalesce("families", F.create_map().cast("map<string,bigint>")).alias("families"))


def start_of(nodes: DataFrame, node: str, families: str = "families") -> DataFrame:
    """(family, u): the node where a family's walk starts, that with the most starts times occurrences in the family; ties by node."""
    rows = nodes.where("n_starts > 0").select(node, "n_starts", F.explode(families).alias("family", "n"))
    return rows.groupBy("family").agg(F.max_by(node, F.struct((F.col("n_starts") * F.col("n")).alias("w"), (-F.col(node)).alias("o"))).alias("u"))


def strongest_next(edge_rows: DataFrame, most: int = 3) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("support"), "v"))
    return edge_rows.withColumn("rank", k).where(F.col("rank") <= most)


def greedy_walks(edge_rows: DataFrame, starts: DataFrame | None = None, length: int = 8) -> DataFrame:
    """(start, path) of every start node: along the strongest edge to a node not yet seen, ties by node, up to ``length`` nodes.

    All walks go on together, a join for each step, in one plan. A node's ``length`` strongest neighbours are enough: fewer
    nodes have been seen, so one of these is free if any is. ``starts`` has u; without it every node with an edge starts.
    """
    k = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("support"), "v"))
    best = edge_rows.where("u <> v").withColumn("k", k).where(F.col("k") <= length)
    after = best.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("__after"))
    walks = (starts if starts is not None else edge_rows).select(F.col("u").alias("start")).distinct().withColumn("path", F.array("start"))
    for _ in range(length - 1):
        stepped = walks.withColumn("u", F.element_at("path", -1)).join(after, "u", "left")
        free = F.get(F.filter(F.coalesce("__after", F.array().cast(dict(after.dtypes)["__after"])), lambda v: ~F.array_contains("path", v)), F.lit(0))
        # a walk that has ended stays where it is, as its last node offers nothing new
        walks = stepped.withColumn("__free", free).select("start", F.when(F.col("__free").isNotNull(), F.concat("path", F.array("__free"))).otherwise(F.col("path")).alias("path"))
    return walks


def nearest_node(nodes: DataFrame, queries: DataFrame, least: float = 0.6) -> DataFrame:
    """The node of each query with the highest cosine, from ``least`` on. nodes: node, vector; queries: query, query_vector."""
    from .retrieval import pair_scores, top_k

    return top_k(pair_scores(queries, nodes, "query_vector", "vector"), "query", "node", 1).where(F.col("score") >= least).select("query", "node", "score")
