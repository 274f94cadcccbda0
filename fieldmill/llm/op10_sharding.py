"""Sharding along a Hilbert curve.

Documents are points in a space of metadata dimensions. Each dimension is
quantised to ``BITS`` bits, the cell's index on the Hilbert curve orders the
points, and the order is cut into runs of equal length: a shard then covers a
compact region in all dimensions at once, so that a reader who filters on any of
them skips most shards by their smallest and largest values.

The dimensions are source, language, size in bytes and doc_id. Numbers are
quantised by their quantiles and names by a hash. Equal texts are one group: they
share the coordinates of the group's smallest document and lie side by side, so
only a cut between two shards can part them.

The law is ``rows``: ranks are exact, and rank * shards / rows is the shard, so
counts differ by one at most however the rows are spread. Only ids, sizes and
digests are sorted, never texts. The order is fixed by a checkpoint; the rows of
each partition are counted, and the partitions' offsets (one number each) give
the ranks.

Defined results: a null text has no bytes and counts as a group of its own kind
with the empty text; null coordinates come first; equal rows get neighbouring
slots; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, checkpoint, table, text_or_empty, working_partitions

SHARDS = 40
#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Bits of each dimension.
BITS = 6
DIMENSIONS = 4


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of unsigned coordinates (n, dimensions).

    Skilling's transform: undo the excess rotations from the highest bit down,
    Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            high = (x[i] & bit) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & np.uint64(1 << b)) > 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << np.uint64(1) | (x[i] >> np.uint64(b) & np.uint64(1))
    return index.astype(np.int64)


def _cuts(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Quantiles of all rows that cut each column into 2**BITS parts; a fixed number of them."""
    shares = F.array(*[F.lit(i / (1 << BITS)) for i in range(1, 1 << BITS)])
    row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def hilbert_ordered(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 in the order of the curve, with ``rank`` from 0 and the curve's index."""
    text = text_or_empty()
    digest = F.struct(F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias(f"{OWN}text"), F.col("source").alias(f"{OWN}source"), F.col("lang").alias(f"{OWN}lang")
    )
    group = rows.groupBy(f"{OWN}text").agg(F.min(F.struct("doc_id", f"{OWN}source", f"{OWN}lang")).alias(f"{OWN}first"), F.min("size").alias(f"{OWN}bytes"))
    group = group.select(f"{OWN}text", f"{OWN}bytes", F.col(f"{OWN}first.doc_id").alias(f"{OWN}id"), f"{OWN}first.{OWN}source", f"{OWN}first.{OWN}lang")
    cuts = _cuts(docs.select("doc_id", F.octet_length(text).alias("size")), ["size", "doc_id"])
    size_cuts = np.array(cuts["size"], dtype=float) + ROW_BYTES
    id_cuts = np.array(cuts["doc_id"], dtype=float)

    @F.pandas_udf("long")
    def curve(source: pd.Series, lang: pd.Series, size: pd.Series, doc: pd.Series) -> pd.Series:
        cells = np.empty((len(size), DIMENSIONS), dtype=np.uint64)
        cells[:, 0] = source.to_numpy() % (1 << BITS)
        cells[:, 1] = lang.to_numpy() % (1 << BITS)
        cells[:, 2] = np.searchsorted(size_cuts, size.to_numpy())
        cells[:, 3] = np.searchsorted(id_cuts, np.nan_to_num(doc.to_numpy(dtype=float), nan=-np.inf))
        return pd.Series(hilbert_index(cells))

    name = lambda c: F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    group = group.select(f"{OWN}text", curve(name(f"{OWN}source"), name(f"{OWN}lang"), f"{OWN}bytes", f"{OWN}id").alias("curve"))
    placed = rows.join(group, f"{OWN}text").select("curve", f"{OWN}text", "doc_id", "size", "text_crc32")
    order = ["curve", f"{OWN}text", "doc_id"]
    ordered = placed.repartitionByRange(working_partitions(docs), *order).sortWithinPartitions(*order)
    ordered = checkpoint(ordered.select("doc_id", "size", "text_crc32", "curve", F.monotonically_increasing_id().alias(f"{OWN}at")))
    part, inside = F.shiftright(f"{OWN}at", 33), F.col(f"{OWN}at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    by_part = F.map_from_arrays(F.array(*[F.lit(p) for p in offsets]), F.array(*[F.lit(x).cast("long") for x in offsets.values()])) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return ordered.select("doc_id", "size", "text_crc32", "curve", (F.element_at(by_part, part) + inside).alias("rank"), F.lit(total).cast("long").alias("n_rows"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each of ``docs`` with its shard from 0 to ``shards`` - 1 and its slot in it; ``curve`` is the Hilbert index."""
    ordered = hilbert_ordered(docs)
    shard = F.expr(f"(rank * {shards}) div n_rows")
    first = F.expr(f"(shard * n_rows + {shards - 1}) div {shards}")  # the smallest rank of the shard
    return ordered.withColumn("shard", shard.cast("long")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes ``docs`` as one folder a shard. Rows are matched by doc_id, which has to be unique here."""
    placed = assign_shards(docs, shards).select(F.col("doc_id").alias(f"{OWN}id"), "shard", "slot")
    joined = docs.join(placed, docs["doc_id"].eqNullSafe(placed[f"{OWN}id"])).drop(f"{OWN}id")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
