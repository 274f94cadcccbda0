"""Near copies by the Jaccard similarity of word shingles: op05_simhash at a wider reach, for the corpus pipeline.

Two texts link if the sets of their ``SHINGLE_WORDS``-word shingles have a Jaccard
similarity of ``LEAST`` or more. Equal sets are one node, so copies never make pairs.

Candidates come from two searches, and every one is verified on the sets:

* SimHash of the sets: ``op05_simhash.links`` finds, by pivot distance tables, the fingerprints
  that differ in at most three bits, which is where most near copies are;
* a shared band: ``ROWS`` of ``BANDS * ROWS`` MinHash values. At a similarity of 0.8 about ten
  of 64 bits differ, and pivot tables discard nothing at that distance, as random fingerprints
  are all about as far from any pivot. A pair of similarity s misses all bands with
  probability (1 - s**ROWS)**BANDS, 3 in a million at 0.8 and less above it.

First each node of a bucket is compared with one of the bucket, as often as ``STARS``; what
these links connect needs no more comparisons, so a large group of near copies costs
as much as its rows. In buckets that are still apart, all pairs of different components
meet: by pivot tables of Jaccard distances first (it is a metric, so a pair whose
distances to any pivot differ by more than 1 - ``LEAST`` can't link), then by the sets
of the survivors. A bucket with many nodes is dealt into chunks, and each pair of
chunks is a group of its own. Sets are made again from the texts of candidates only.

Defined results are those of ``op05_simhash``; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, released, text_or_empty
from .graph import connected_components
from .op05_simhash import BITS, BLOCK_BYTES, HASH_SEED, HOT_SHARE, MOST_BROADCAST, PIVOTS, labelled, representatives
from .op05_simhash import links as near_prints

SHINGLE_WORDS = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
STARS = 2
#: Nodes of a bucket that a group holds; two of these chunks meet at a time.
CHUNK = 128
#: Bytes of sets that are broadcast.
MOST_SET_BYTES = 32 << 20
_AT_ONCE = 1 << 12
_FACTORS = np.random.Generator(np.random.PCG64(HASH_SEED)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; words as in op05_simhash."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), HASH_SEED) for i in range(n)], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(own: np.ndarray) -> list[int]:
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), _AT_ONCE):
        least = np.minimum(least, (own[i : i + _AT_ONCE, None] * _FACTORS).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(own), _AT_ONCE):
        counts += np.unpackbits(own[i : i + _AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(own)).tobytes(), "big", signed=True)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of its text (tie), its node (fp), SimHash and the keys of its bands, for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                nodes, prints, keys = [], [], []
                for text in block.column(2).to_pylist():
                    own = shingles(text)
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                    prints.append(fingerprint(own))
                    keys.append(band_keys(own))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tie", "fp", "print", "keys"]
                )

    plain = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    return plain.mapInArrow(released(run), f"doc_id {dict(plain.dtypes)['doc_id']}, tie long, fp long, print long, keys array<long>")


def _few(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table of numbers, as one partition if it has few rows, so that what follows needs no exchange."""
    return df.coalesce(1) if df.count() <= MOST_BROADCAST else df


def _small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles, from the text of one row of each wanted node (node, first: doc_id and tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                sets = [shingles(t).tobytes() for t in block.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    one = _small(checkpoint(wanted.select("node", F.col("first.doc_id").alias("id"), F.col("first.tie").alias("own"))))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    texts = rows.join(one, (F.col("tie") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(released(run), "node long, set binary")


def _print_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that connect all whose SimHash is equal or differs in three bits or fewer, if every one of them links."""
    of = checkpoint(distinct.groupBy(F.col("print").alias("fp")).agg(F.min(F.col("fp")).alias("node")))
    same = distinct.select("fp", "print").join(of.select(F.col("fp").alias("print"), "node"), "print").where("fp <> node").select(F.col("fp").alias("u"), F.col("node").alias("v"))
    near = near_prints(of.select("fp"), of.count())
    near = near.join(of.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(of.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    return same.union(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that link. A v of more than one in HOT_SHARE pairs is broadcast with its set, as there are fewer than HOT_SHARE of these, but only if their sets are small together; else adaptive execution splits its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one pair's sets at a time: a batch holds two of each row
            near = pa.array([jaccard(*(np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pair)) >= least for pair in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["u", "v"])

    counts = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.count()
    hot = checkpoint(counts.where(F.col("n") > total / HOT_SHARE).select("v").join(sets.withColumnRenamed("node", "v"), "v"))
    if (hot.agg(F.sum(F.octet_length("set"))).first()[0] or 0) <= MOST_SET_BYTES:
        hot = F.broadcast(hot)
    # few pairs go to the sets, which then stay where they are
    rows = _small(pairs).join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u")
    cold = rows.join(hot.select("v"), "v", "left_anti").join(sets.select(F.col("node").alias("v"), "set"), "v")
    both = rows.join(hot, "v").select("u", "v", "a", "set").unionByName(cold.select("u", "v", "a", "set"))
    return both.mapInArrow(released(run), "u long, v long")


def cross_links(sets: list[np.ndarray], parts: np.ndarray, right: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Links that connect all that lie within reach, between different ``parts``, and between ``right`` and the others where there are any of both."""
    sizes = np.array([len(s) for s in sets])
    table = np.array([[1 - jaccard(s, sets[p]) for p in range(min(PIVOTS, len(sets)))] for s in sets]) if len(sets) > 8 else np.zeros((len(sets), 1))
    root = {int(p): int(p) for p in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    split = right.any()
    for i in range(len(sets)):
        alive = (parts != parts[i]) & (np.abs(table - table[i]) <= 1 - least + 1e-9).all(axis=1) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i]) - 1e-9)
        alive &= (right & (not right[i])) if split else (np.arange(len(sets)) > i)
        for j in np.flatnonzero(alive).tolist():
            x, y = find(int(parts[i])), find(int(parts[j]))
            if x != y and jaccard(sets[i], sets[j]) >= least:
                root[x] = y
                out.append((i, j))
    return out


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node and part of the buckets whose nodes are in several components, once for each set of nodes. labels is a checkpointed table."""
    rows = members.join(_small(labels), "node", "left").withColumn("part", F.coalesce("part", "node"))
    number = F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))
    open_keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.sum(number).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other")).where("low < high")
    single = checkpoint(open_keys.groupBy("n", "mark", "other").agg(F.min("key").alias("key")).select("key", "n"))
    return rows.join(_small(single), "key").select("key", "n", "node", "part")


def _remaining_links(apart: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """Links between the parts of each bucket. Nodes of its largest part meet the others only, chunk by chunk; the others also meet each other."""
    by_part = apart.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    largest = by_part.groupBy("key").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("n"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(c / chunk)).cast("int")
    largest = _small(checkpoint(largest.select("key", F.col("m.part").alias("most"), chunks(F.col("m.c")).alias("in_most"), chunks(F.col("n") - F.col("m.c")).alias("in_rest"))))
    placed = apart.select("key", "node", "part").join(largest, "key").withColumn("inner", F.col("part") == F.col("most"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("inner"), F.col("in_most")).otherwise(F.col("in_rest"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    # a chunk of the largest part has a negative number
    meets = lambda low, high, right: F.struct(low.alias("low"), high.alias("high"), right.alias("right"))
    of_most = F.transform(upto("in_rest"), lambda i: meets(-1 - F.col("own"), i, F.lit(True)))
    of_rest = F.transform(upto("in_rest"), lambda i: meets(F.least("own", i), F.greatest("own", i), F.col("own") > i))
    with_most = F.transform(upto("in_most"), lambda i: meets(-1 - i, F.col("own"), F.lit(False)))
    rows = placed.select("key", F.explode(F.when(F.col("inner"), of_most).otherwise(F.concat(of_rest, with_most))).alias("g"), "node", "part").select("key", "g.*", "node", "part")
    rows = rows.join(sets, "node").select("key", "low", "high", "right", "node", "part", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def solve() -> pa.RecordBatch:
            found = cross_links([np.frombuffer(r[6], dtype=np.uint64) for r in held], np.array([r[5] for r in held]), np.array([r[3] for r in held]), least) if len(held) > 1 else []
            u, v = ([held[x[i]][4] for x in found] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != at:
                    yield solve()
                    held, at = [], row[:3]
                held.append(row)
        yield solve()

    grouped = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(released(run), "u long, v long")


def _found(docs: DataFrame, least: float, chunk: int) -> DataFrame:
    prints = checkpoint(_sketches(docs))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("print").alias("print"), F.first("keys").alias("keys")))
    rows = distinct.select(F.col("fp").alias("node"), F.explode("keys").alias("key"))
    # a frequent key is one row a task before it is shuffled
    shared = checkpoint(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"))
    members = _few(checkpoint(rows.join(_small(shared), "key")))
    candidates = _few(checkpoint(_print_pairs(distinct)))
    wanted = members.select("node").union(candidates.select("u")).union(candidates.select("v")).distinct()
    sets = checkpoint(_sets(docs, wanted.join(distinct.select(F.col("fp").alias("node"), "first"), "node")))
    links = _few(checkpoint(_verified(candidates, sets, least)))
    for k in range(STARS + 1):
        labels = connected_components(links).select("node", F.col("root").alias("part"))
        apart = _few(checkpoint(_apart(members, labels)))
        if not apart.head(1):
            break
        if k < STARS:
            number = F.xxhash64("node", F.lit(k))
            least_of = apart.groupBy("key").agg(F.min(F.struct(number.alias("h"), "node", "part")).alias("m"))
            pairs = apart.join(_small(checkpoint(least_of)), "key").where("part <> m.part").select(F.col("node").alias("u"), F.col("m.node").alias("v")).distinct()
            found = _verified(_few(checkpoint(pairs)), sets, least)
        else:
            found = _remaining_links(apart, sets, least, chunk)
        links = _few(checkpoint(links.unionByName(found)))
    return labelled(prints.select("doc_id", "tie", "fp"), distinct.select("fp", "first", "n"), connected_components(links))


def near_copies(docs: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fp (the node) and component_id, the smallest doc_id that links reach, of each row of ``docs``."""
    return _found(docs, least, chunk).select("doc_id", "fp", F.col("chosen.doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id and, of these, hash of the text; one of equal rows."""
    return representatives(docs, _found(docs, least, chunk))
