"""Vector and hybrid retrieval with a concept graph, and semantic boundaries.

A search takes a table of queries against all rows. Scores are dot products of unit
vectors in double precision. For the best hits both sides are dealt into blocks that meet pairwise, a
task holds two blocks, and only the best of each block are rows; for all pairs
queries are broadcast after their number is checked, else dealt into blocks as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST_QUERIES = 10_000
ROWS_OF_BLOCK, QUERIES_OF_BLOCK, QUERIES_AT_ONCE = 8192, 4096, 256
#: Scores this close to the last of the best may be equal after rounding.
MARGIN = 1e-8
CONCEPT_BOOST, NEIGHBOUR_BOOST, TITLE_FACTOR = 0.10, 0.03, 1.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pair_scores(queries: DataFrame, rows: DataFrame, query_vector: str, vector: str) -> DataFrame:
    """All (query, row) pairs with their cosine. Columns of the two tables must differ."""
    # norms once a row, not once a pair
    queries, rows = queries.withColumn("__nq", norm(F.col(query_vector))), rows.withColumn("__nr", norm(F.col(vector)))
    n = queries.count()
    if n <= MOST_BROADCAST_QUERIES:
        pairs = rows.crossJoin(F.broadcast(queries))
    else:
        k = -(-n // MOST_BROADCAST_QUERIES)
        dealt = queries.withColumn("__b", F.pmod(F.xxhash64(query_vector), F.lit(k)))
        pairs = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))).join(dealt, "__b").drop("__b")
    return pairs.withColumn("score", dot(F.col(query_vector), F.col(vector)) / (F.col("__nq") * F.col("__nr"))).drop("__nq", "__nr")


def _unit_parts(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix of the vectors (null ones as zeros), which are there, and their norms, summed in order as :func:`norm` does."""
    there = vectors.notna().to_numpy()
    size = len(vectors[there].iloc[0]) if there.any() else 1
    m = np.zeros((len(vectors), size))
    if there.any():
        m[there] = np.stack(vectors[there].to_list())
    total = np.zeros(len(vectors))
    for d in range(size):
        total += m[:, d] * m[:, d]
    if not (np.isfinite(total[there]) & (total[there] > 0)).all():
        raise ValueError("a vector of zeros, or of values that aren't numbers, has no cosine")
    return m, there, np.sqrt(total)


def _weights(lists: pd.Series, index: dict[str, int], value: str | None = None) -> np.ndarray:
    """By row and concept the sum of ``value`` of a row's entries; without value the number of entries."""
    m = np.zeros((len(lists), len(index)))
    for i, entries in enumerate(lists):
        for x in entries if entries is not None else ():
            if x["concept"] in index:
                m[i, index[x["concept"]]] += 1.0 if value is None else x[value]
    return m


def _best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, query: str, key: str, query_vector: str, vector: str, carried: list[str], boosted: bool) -> pd.DataFrame:
    """For each query the rows of a block that can be among its best k, with their dense score and score. Of rows alike in vector and tags the k + 1 smallest keys stand for all."""
    rows = rows.sort_values(key, ignore_index=True)
    (q, asked, q_norm), (r, there, r_norm) = _unit_parts(queries[query_vector]), _unit_parts(rows[vector])
    index = {c: i for i, c in enumerate(sorted({x["concept"] for w in queries["weights"] if w is not None for x in w}))} if boosted else {}
    own, near = (_weights(queries["weights"], index, name) for name in ("own", "near")) if index else (None, None)
    title, count = (_weights(rows["tags"], index, name) for name in ("factor", None)) if index else (None, None)
    boost_of = lambda i, j: (own[i] * title[j] + near[i] * count[j]).sum(axis=1) if index else 0.0
    found_q, found_r, dense = [], [], []
    places = np.flatnonzero(there)
    if len(places):
        alike = r[places] if not index else np.hstack([r[places], title[places], count[places]])
        _, first, group = np.unique(np.ascontiguousarray(alike).view(np.dtype((np.void, alike.dtype.itemsize * alike.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - starts[group[order]]
        few = rank <= k
        places = places[few]
        unit = r[places] / r_norm[places][:, None]
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            chosen = at + np.flatnonzero(asked[at : at + QUERIES_AT_ONCE])
            if not len(chosen):
                continue
            near_scores = (q[chosen] / q_norm[chosen][:, None]) @ unit.T
            if index:
                near_scores += own[chosen] @ title[places].T + near[chosen] @ count[places].T
            # the query itself may be one of them
            last = np.partition(near_scores, -(k + 1), axis=1)[:, -(k + 1)] if len(places) > k + 1 else np.full(len(chosen), -np.inf)
            i, j = np.nonzero(near_scores >= last[:, None] - MARGIN)
            i, j = chosen[i], places[j]
            total = np.zeros(len(i))
            for d in range(q.shape[1]):
                total += q[i, d] * r[j, d]
            found_q.append(i), found_r.append(j), dense.append(total / (q_norm[i] * r_norm[j]))
    # without a vector there is no score; such rows come last
    lost_q, lost_r = np.flatnonzero(~asked), np.flatnonzero(~there)[: k + 1]
    for some_q, some_r in ((lost_q, np.arange(min(k + 1, len(rows)))), (np.flatnonzero(asked), lost_r)):
        found_q.append(np.repeat(some_q, len(some_r))), found_r.append(np.tile(some_r, len(some_q))), dense.append(np.full(len(some_q) * len(some_r), np.nan))
    i, j, dense = np.concatenate(found_q).astype(int), np.concatenate(found_r).astype(int), np.concatenate(dense)
    found = {c: queries[c].to_numpy()[i] if c in queries.columns else rows[c].to_numpy()[j] for c in [query, key, *carried]}
    score = dense + boost_of(i, j)
    plain = lambda x: pd.array(np.where(np.isnan(x), 0.0, x), dtype="Float64")
    result = pd.DataFrame(found | {"dense_score": plain(dense), "score": plain(score)})
    result.loc[np.isnan(dense), ["dense_score", "score"]] = pd.NA
    return result[result[query] != result[key]]


def nearest(queries: DataFrame, rows: DataFrame, query: str, key: str, query_vector: str, vector: str, k: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of the highest score of each query, itself left out: query, key, the columns ``carried`` from either side, dense_score, score and rank; ties by key, as :func:`top_k` over all pairs.

    Where ``queries`` have ``weights`` (array of concept, own, near) and ``rows`` have ``tags`` (array of concept and factor), these are added to the
    score. Vectors of zeros and values that aren't numbers are an error.
    """
    boosted = "weights" in queries.columns
    n_rows, n_queries = max(1, -(-rows.count() // ROWS_OF_BLOCK)), max(1, -(-queries.count() // QUERIES_OF_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("__q", block(query, n_queries)).withColumn("__r", every(n_rows))
    right = rows.withColumn("__r", block(key, n_rows)).withColumn("__q", every(n_queries))
    kinds = dict(queries.dtypes) | dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (query, key, *carried)) + ", dense_score double, score double"
    names = list(carried)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(a, b, k, query, key, query_vector, vector, names, boosted)

    found = left.groupBy("__r", "__q").cogroup(right.groupBy("__r", "__q")).applyInPandas(best, schema)
    return top_k(found, query, key, k)


def concept_weights(query_concepts: DataFrame, frequencies: DataFrame, near: DataFrame) -> DataFrame:
    """(query, weights) of ``query_concepts`` (query, concept): what a row's concepts add to its score (:func:`hybrid_scores`), by concept: as the query's own and as a neighbour of one."""
    own = query_concepts.join(frequencies, "concept").select("query", "concept", (CONCEPT_BOOST * F.col("idf")).alias("own"), F.lit(0.0).alias("near"))
    other = query_concepts.join(near, "concept").select("query", F.col("other").alias("concept")).distinct().join(query_concepts, ["query", "concept"], "left_anti")
    more = other.join(frequencies, "concept").select("query", "concept", F.lit(0.0), (NEIGHBOUR_BOOST * F.col("idf")).alias("near"))
    return own.union(more).groupBy("query").agg(F.collect_list(F.struct("concept", "own", "near")).alias("weights"))


def top_k(scores: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k rows of the highest score of each query, with their rank; ties by key. The limit is pushed below the shuffle by a rank within each partition."""
    order = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cap_per_group(ranked: DataFrame, query: str, group: str, rank: str, most: int, exempt: Column | None = None) -> DataFrame:
    """At most ``most`` hits of a group for each query; exempt rows are kept and don't count. Ranks are made anew."""
    counts = F.lit(1) if exempt is None else F.when(exempt, 0).otherwise(1)
    used = F.sum(counts).over(Window.partitionBy(query, group).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    keep = F.col("__used") <= most
    rows = ranked.withColumn("__used", used).where(keep if exempt is None else keep | exempt).drop("__used")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(query).orderBy(rank)))


def concept_frequencies(tags: DataFrame, n_chunks: int) -> DataFrame:
    """concept, df and idf = ln(n / df) / ln(n), 0 at least, of tags (chunk, concept)."""
    n = float(max(2, n_chunks))
    df = tags.groupBy("concept").agg(F.count_distinct("chunk").alias("df"))
    return df.withColumn("idf", F.greatest(F.lit(0.0), F.log(n / F.col("df")) / F.log(F.lit(n))))


def cooccurrence(tags: DataFrame, key: str, concept: str, least: int = 2) -> DataFrame:
    """(a, b, w) with a < b of concepts that share ``least`` keys or more. The vocabulary of concepts bounds the pairs of a key."""
    distinct = tags.select(key, concept).distinct()
    pairs = distinct.select(key, F.col(concept).alias("a")).join(distinct.select(key, F.col(concept).alias("b")), key).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= least)


def neighbours(pairs: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` strongest neighbours of each concept; ties by name."""
    both = pairs.union(pairs.select("b", "a", "w")).toDF("concept", "other", "w")
    k = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("w"), "other"))
    return both.withColumn("k", k).where(F.col("k") <= most).drop("k")


def adjacency(chunks: DataFrame, document: str, index: str, key: str) -> DataFrame:
    order = Window.partitionBy(document).orderBy(index)
    return chunks.select(key, F.lag(key).over(order).alias("previous"), F.lead(key).over(order).alias("next"))


def hybrid_scores(scores: DataFrame, query_concepts: DataFrame, tags: DataFrame, frequencies: DataFrame, near: DataFrame) -> DataFrame:
    """``scores`` (query, chunk, score) with the boost of concepts a chunk shares with its query, more in a title, and of neighbours of the query's concepts.

    ``query_concepts`` has query and concept, ``tags`` chunk, concept and in_title.
    """
    wanted = query_concepts.join(frequencies, "concept").select("query", "concept", "idf")
    own = wanted.join(tags, "concept").select("query", "chunk", (CONCEPT_BOOST * F.col("idf") * F.when(F.col("in_title"), TITLE_FACTOR).otherwise(1.0)).alias("boost"))
    other = query_concepts.join(near, "concept").select("query", F.col("other").alias("concept")).distinct().join(query_concepts, ["query", "concept"], "left_anti")
    more = other.join(frequencies, "concept").join(tags, "concept").select("query", "chunk", (NEIGHBOUR_BOOST * F.col("idf")).alias("boost"))
    boosts = own.union(more).groupBy("query", "chunk").agg(F.sum("boost").alias("boost"))
    return scores.join(boosts, ["query", "chunk"], "left").withColumn("dense_score", F.col("score")).withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables have the same set of keys; else an index built from one is stale for the other."""
    x, y = a.select(key), b.select(key)
    return not x.exceptAll(y).head(1) and not y.exceptAll(x).head(1)


def semantic_boundaries(rows: DataFrame, group: str, position: str, vector: str, cutoff: float = 85.0, least_depth: float = 0.05, least_units: int = 0) -> DataFrame:
    """Similarity to the row before, its depth score and whether a segment begins here.

    The depth of a dip is how far the highest similarities on both sides rise above it; a segment begins where it reaches the group's percentile and the least depth.
    A group of fewer than ``least_units`` rows (fixed: 6 sentences, 4 paragraphs) is one segment.
    """
    order = Window.partitionBy(group).orderBy(position)
    v, last = F.col(vector), F.lag(vector).over(order)
    rows = rows.withColumn("__last", last).withColumn("similarity", F.when(F.col("__last").isNotNull(), dot(v, F.col("__last")) / (norm(v) * norm(F.col("__last"))))).drop("__last")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("depth", F.max("similarity").over(before) + F.max("similarity").over(after) - 2 * F.col("similarity"))
    limits = rows.groupBy(group).agg(F.percentile("depth", F.lit(cutoff / 100.0)).alias("__limit"), F.count(F.lit(1)).alias("__units"))
    rows = rows.join(limits, group)
    deep = (F.col("depth") >= F.greatest("__limit", F.lit(least_depth))) & (F.col("__units") >= least_units)
    return rows.withColumn("boundary", F.coalesce(deep, F.lit(False))).drop("__limit", "__units")


#: Fixed: a chunk of more words is cut by topic, at the percentile and least number of units for paragraphs; smaller pieces are folded.
LONG_CHUNK, TOPIC_CUTOFF, TOPIC_UNITS, SMALL_PIECE = 600, 75.0, 4, 30


def topic_pieces(units: DataFrame, chunk: str, position: str, words: str, vector: str) -> DataFrame:
    """``units`` of chunks (their paragraphs in order, with their words and unit vectors) with ``piece`` from 1 on and ``pieces``.

    A chunk of more than 600 words is cut where its topic shifts (:func:`semantic_boundaries`); a piece under 30 words joins the one before, and
    what is before the first piece of that size joins it if it is smaller itself. Other chunks are one piece.
    """
    total = F.sum(words).over(Window.partitionBy(chunk))
    rows = semantic_boundaries(units.withColumn("__long", total > LONG_CHUNK), chunk, position, vector, TOPIC_CUTOFF, least_units=TOPIC_UNITS)
    upto = Window.partitionBy(chunk).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__part", F.sum((F.col("boundary") & F.col("__long")).cast("int")).over(upto))
    parts = rows.groupBy(chunk, "__part").agg(F.sum(words).alias("__words"))
    order = Window.partitionBy(chunk).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    begins = (F.col("__part") == 0) | (F.col("__words") >= SMALL_PIECE)
    parts = parts.withColumn("__group", F.sum(begins.cast("int")).over(order))
    head = F.sum(F.when(F.col("__group") == 1, F.col("__words"))).over(Window.partitionBy(chunk))
    # a small head is one with the group after it
    parts = parts.withColumn("piece", F.when(head < SMALL_PIECE, F.greatest(F.lit(1), F.col("__group") - 1)).otherwise(F.col("__group")))
    parts = parts.withColumn("pieces", F.max("piece").over(Window.partitionBy(chunk)))
    return rows.join(parts.select(chunk, "__part", F.col("piece").cast("int").alias("piece"), F.col("pieces").cast("int").alias("pieces")), [chunk, "__part"]).drop("__part", "__long", "boundary")
