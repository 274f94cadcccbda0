"""SimHash near-duplicates with pivot distance tables.

Fingerprints have 64 bits; two of them link if at most ``MAX_BITS`` bits differ.
Equal fingerprints are one node, so copies never make pairs.

Candidates share a block key: the 64 bits are cut into n blocks, and as
``MAX_BITS`` differing bits touch at most that many blocks, the other blocks are
equal. Every choice of n - MAX_BITS blocks is a key, and n grows with the number
of fingerprints, so that a key has few of them. Within a key, a pivot table holds
each fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints. By
the triangle inequality a pair whose distances to any pivot differ by more than
``MAX_BITS`` can't link: it is discarded by its largest coordinate
difference, and only survivors are compared bit by bit. A key emits a spanning
forest of its links, not the pairs.

A key with many fingerprints is dealt into chunks, and each pair of chunks is a
group of its own, so that no task holds more than two chunks of one key.

Components are found by alternating stars on the links; nothing but counts comes
to the driver.

Defined results: a null text counts as empty; a text without words has fingerprint
zero, linked like any other; with fewer words than a shingle has, all words are the
one shingle. Repeated rows appear as often as they occur. A component of null
doc_ids alone has a null component_id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, blocks, checkpoint, table, text_or_empty
from .graph import connected_components

BITS = 64
MAX_BITS = 3
#: The contract's shingles; the operators take another length as a parameter.
SHINGLE_WORDS = 3
HASH_SEED = 42
PIVOTS = 24
PIVOT_SEED = 7
#: Fingerprints of a key that a group holds; two of these chunks meet at a time.
CHUNK = 1024
#: Rows of a table that is broadcast.
MOST_BROADCAST = 200_000
#: Rows of a fingerprint with more than this part of all rows don't go through a shuffle.
HOT_SHARE = 1000
BLOCK_BYTES = 4 << 20
_HASHED_AT_ONCE = 1 << 14


def simhash(text: str, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number. bytes.lower and bytes.split know A-Z and the six ASCII spaces only."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest, seed = xxhash.xxh64_intdigest, HASH_SEED
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _HASHED_AT_ONCE):
        some = range(i, min(i + _HASHED_AT_ONCE, n))
        hashes = np.array([digest(joined[starts[k] : ends[k + last]], seed) for k in some], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text) and fp (long) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                fps = np.array([simhash(t, shingle) for t in block.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tie", "fp"])

    plain = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("tie"), "text")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, tie long, fp long")


def block_masks(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """The signed masks of all choices of n - max_bits out of n blocks."""
    edges = [BITS * i // n for i in range(n + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, n - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def number_of_blocks(rows: int, max_bits: int = MAX_BITS) -> int:
    """So many that a key has bits enough to leave a fingerprint alone, unless it has near ones."""
    n = max_bits + 2
    while n < 10 and BITS * (n - max_bits) / n < math.log2(max(rows, 2)) + 4:
        n += 1
    return n


def _pivots() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(PIVOT_SEED)).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The distances of fingerprints (rows) to the pivots (columns)."""
    return np.bitwise_count(fps[:, None] ^ _pivots()).astype(np.int8)


def linked(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which of the fingerprints a (rows) and b (columns) link: pivot tables first, then the bits of the survivors."""
    ta, tb = tables or (pivot_table(a), pivot_table(b))
    alive = np.ones((len(a), len(b)), dtype=bool)
    for p in range(PIVOTS):
        alive &= np.abs(ta[:, p, None] - tb[None, :, p]) <= max_bits
    i, j = np.nonzero(alive)
    alive[i, j] = np.bitwise_count(a[i] ^ b[j]) <= max_bits
    return alive


def spanning_links(fps: np.ndarray, right: np.ndarray, table: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints that are not ``right`` and those that are; of all links if none is."""
    if right.any():
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        near = np.zeros((len(fps), len(fps)), dtype=bool)
        near[np.ix_(a, b)] = linked(fps[a], fps[b], max_bits, (table[a], table[b]))
        near |= near.T
    else:
        near = linked(fps, fps, max_bits, (table, table))
    waiting = np.ones(len(fps), dtype=bool)
    out = []
    for start in range(len(fps)):
        if not waiting[start]:
            continue
        waiting[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i] & waiting).tolist():
                waiting[j] = False
                stack.append(j)
                out.append((i, j))
    return out


def links(distinct: DataFrame, n_rows: int, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all that lie within ``max_bits`` of each other."""
    masks = block_masks(number_of_blocks(n_rows, max_bits), max_bits)
    # keys that a hash lets coincide only add candidates
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(shared, "key")
    # pair of chunks: (low, high); a row is in all pairs that have its own chunk
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks).cast("int")
    rows = rows.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    rows = rows.select("fp", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(fps: np.ndarray, group: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1 if len(group) > 1 else np.zeros(0, dtype=int)
            u: list[int] = []
            v: list[int] = []
            edges = [0, *cuts.tolist(), len(fps)]
            sizes = np.diff(edges)
            # one row of the pivot table for each fingerprint of the batch, in however many groups it is
            distinct, row = np.unique(fps, return_inverse=True)
            table = pivot_table(distinct)
            pairs = np.array(edges[:-1], dtype=int)[sizes == 2]
            if len(pairs):  # most groups: all at once
                near = np.abs(table[row[pairs]] - table[row[pairs + 1]]).max(axis=1) <= max_bits
                a, b = fps[pairs][near], fps[pairs + 1][near]
                near = np.bitwise_count(a ^ b) <= max_bits
                u += a[near].view(np.int64).tolist()
                v += b[near].view(np.int64).tolist()
            for k in np.flatnonzero(sizes > 2).tolist():
                own = slice(edges[k], edges[k + 1])
                for i, j in spanning_links(fps[own], right[own], table[row[own]], max_bits):
                    u.append(int(fps[own][i].view(np.int64)))
                    v.append(int(fps[own][j].view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            fps = batch.column(0).to_numpy().view(np.uint64)
            group = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)])
            right = batch.column(4).to_numpy(zero_copy_only=False)
            if held is not None:
                fps, group, right = np.concatenate((held[0], fps)), np.concatenate((held[1], group)), np.concatenate((held[2], right))
            last = int(np.argmax((group == group[-1]).all(axis=1)))  # the group that may go on
            if last:
                yield solve(fps[:last], group[:last], right[:last])
            held = fps[last:], group[last:], right[last:]
        if held is not None:
            yield solve(*held)

    grouped = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return grouped.mapInArrow(run, "u long, v long")


def distinct_nodes(prints: DataFrame) -> DataFrame:
    """fp, its smallest row (first: doc_id and tie, null ids last) and number of rows."""
    return prints.groupBy("fp").agg(F.min(_rank()).alias("first"), F.count(F.lit(1)).alias("n"))


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")


def labelled(prints: DataFrame, distinct: DataFrame, tree: DataFrame) -> DataFrame:
    """``prints`` with ``chosen``, the smallest row of the component. distinct is :func:`distinct_nodes`, tree has node and root of the components.

    A fingerprint with more than one in HOT_SHARE rows is hot. There are fewer than HOT_SHARE of these,
    so they are broadcast and their rows stay where they are.
    """
    members = tree.select(F.col("node").alias("fp"), "root").union(tree.select(F.col("root").alias("fp"), "root").distinct())
    members = members.join(distinct.select("fp", "first"), "fp")
    smallest = members.groupBy("root").agg(F.min("first").alias("smallest"))
    joined = members.join(smallest, "root").select("fp", "smallest")
    labels = checkpoint(distinct.join(joined, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("chosen"), "n"))
    n_rows = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > n_rows / HOT_SHARE
    hot = F.broadcast(labels.where(is_hot).select("fp", "chosen"))
    cold = prints.join(hot.select("fp"), "fp", "left_anti").join(labels.where(~is_hot).select("fp", "chosen"), "fp")
    return prints.join(hot, "fp").unionByName(cold)


def _found(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    prints = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(distinct_nodes(prints))
    return labelled(prints, distinct, connected_components(links(distinct.select("fp"), distinct.count(), max_bits)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of each row of ``docs``."""
    return _found(docs, shingle, max_bits).select("doc_id", "fp", F.col("chosen.doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id and, of these, hash of the text; one of equal rows."""
    return representatives(docs, _found(docs, shingle, max_bits))


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the chosen ones of ``found``, once each. Rows are told by doc_id and text, so that rows with the same or no id stay if they are chosen.

    Most rows stay, so the others are marked. Up to ``MOST_BROADCAST`` marks, which is checked, they are broadcast;
    beyond, texts are shuffled to them.
    """
    marks = found.select("doc_id", "tie", _rank().eqNullSafe(F.col("chosen")).alias(f"{OWN}chosen")).groupBy(F.col("doc_id").alias(f"{OWN}id"), F.col("tie").alias(f"{OWN}key"))
    marks = checkpoint(marks.agg(F.min(f"{OWN}chosen").alias(f"{OWN}chosen"), F.count(F.lit(1)).alias(f"{OWN}n")).where(f"NOT {OWN}chosen OR {OWN}n > 1"))
    few = marks.count() <= MOST_BROADCAST
    rows = docs.withColumn(f"{OWN}tie", F.xxhash64(text_or_empty()))
    rows = rows.join(F.broadcast(marks) if few else marks, (F.col(f"{OWN}tie") == F.col(f"{OWN}key")) & F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")), "left")
    columns = [f"`{c}`" for c in docs.columns]
    single = rows.where(F.col(f"{OWN}n").isNull()).select(*columns)
    if not marks.where(f"{OWN}chosen").head(1):
        return single
    return single.unionByName(rows.where(f"{OWN}chosen").dropDuplicates(["doc_id", f"{OWN}tie"]).select(*columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
