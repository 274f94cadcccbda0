"""Filter interaction audit over a packed bitmap index.

Each document has one bit for each filter (set where it fails) and for each label. A
task packs the bits of a batch of rows into bytes, part after part, each part from
a byte of its own, so that one vector operation works on all parts and one
segmented sum of bit counts gives each part's figure. For each subset of filters
that can come before a filter it counts, by AND, AND-NOT and popcount:

* removed: fails the filter and nothing before it,
* redundant: fails the filter, but something before it as well,
* kept: fails neither the filter nor anything before it,
* one count for each label: removed with the label set.

The counts of a task's batches, then of all tasks, are added up. An order of filters is a
chain of subsets, so all orders follow from the counts of 2**n * n / 2 pairs of a
subset and a filter, and so does the Shapley sum: a subset of s filters comes before
a filter in s! * (n - 1 - s)! orders.

That a text was seen before takes all of a table: the smallest doc_id of each
text's digest is found with map-side aggregation, and rows meet it by doc_id and
digest, so that copies, however many, are spread over all tasks.

Defined results: a null text is empty, a null lang is the part of the empty string; a
row without doc_id is never a copy and has no labels; rows with the same doc_id and
text are no copies of each other; labels of a doc_id with several rows are their
largest; null labels count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, released, table, text_or_empty

#: Orders are listed: 8 filters have 40,320.
MOST_FILTERS = 8
WORD_SPACE = r"[\x20\x09-\x0D]+"
#: Letters of the five filters of the query.
FILTERS = ["A", "B", "C", "D", "E"]
LABELS = {"good": "quality", "toxic": "toxic"}


def subsets(n: int) -> list[tuple[int, int]]:
    """All pairs of a set of filters, as a mask, and a filter outside it, by number."""
    return [(mask, f) for mask in range(1 << n) for f in range(n) if not mask >> f & 1]


def packed(bits: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``bits`` (columns, rows) as bytes, part after part, and each part's first byte. A last row marks the bits that are rows."""
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part)
    room = -(-sizes // 8)  # whole bytes
    first_byte = np.concatenate([[0], np.cumsum(room)[:-1]])
    at = np.arange(len(part)) + np.repeat(first_byte * 8 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    wide = np.zeros((len(bits) + 1, int(room.sum()) * 8), dtype=bool)
    wide[:-1, at] = bits[:, order]
    wide[-1, at] = True
    return np.packbits(wide, axis=1), first_byte


def subset_counts(index: np.ndarray, first_byte: np.ndarray, n: int) -> np.ndarray:
    """For each part and each of ``subsets(n)``: kept, removed, redundant, alone, and one count a label."""
    fails, labels, rows = index[:n], index[n:-1], index[-1]
    any_of = np.zeros((1 << n, index.shape[1]), dtype=np.uint8)
    for mask in range(1, 1 << n):
        low = mask & -mask
        any_of[mask] = any_of[mask ^ low] | fails[low.bit_length() - 1]
    total = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first_byte)
    everything = (1 << n) - 1
    alone = [total(fails[f] & ~any_of[everything ^ 1 << f]) for f in range(n)]
    found = np.empty((len(first_byte), len(subsets(n)), 4 + len(labels)), dtype=np.int64)
    for k, (mask, f) in enumerate(subsets(n)):
        removed = fails[f] & ~any_of[mask]
        found[:, k, 0] = total(rows & ~(any_of[mask] | fails[f]))
        found[:, k, 1] = total(removed)
        found[:, k, 2] = total(fails[f] & any_of[mask])
        found[:, k, 3] = alone[f]
        for i, label in enumerate(labels):
            found[:, k, 4 + i] = total(removed & label)
    return found


def count_subsets(rows: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """part, mask (the filters before), filter (its number), kept, removed, redundant, unique_fails and ``<label>_lost``.

    ``filters`` and ``labels`` are boolean columns without nulls, ``part`` is a string.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} filters have too many orders to list")
    names = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in labels]]
    pairs = subsets(len(filters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            bits = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], dtype=bool)
            counts = subset_counts(*packed(bits, parts.indices.to_numpy()), len(filters))
            for name, figures in zip(parts.dictionary.to_pylist(), counts, strict=True):
                total[name] = total[name] + figures if name in total else figures
        for name, figures in total.items():
            columns = [pa.array([name] * len(pairs), pa.string()), pa.array([m for m, _ in pairs], pa.int32()), pa.array([f for _, f in pairs], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v) for v in figures.T]], ["part", "mask", "filter", *names])

    schema = "part string, mask int, filter int, " + ", ".join(f"`{n}` long" for n in names)
    counted = rows.select(F.col(part), *filters, *labels).mapInArrow(released(run), schema)
    return counted.groupBy("part", "mask", "filter").agg(*[F.sum(n).alias(n) for n in names])


def audit(rows: DataFrame, filters: list[str], labels: list[str], part: str) -> DataFrame:
    """A row for each part, order of ``filters`` and step: the counts of that step's filter after those before it, and its Shapley sum."""
    n = len(filters)
    orders = [("".join(filters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step]) for order in itertools.permutations(range(n)) for step in range(n)]
    before = F.bit_count("mask").cast("int")
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(n - 1 - s)) for s in range(n)])
    shapley = F.sum(F.col("removed") * F.get(weights, before)).over(Window.partitionBy("part", "filter")).cast("long")
    counts = count_subsets(rows, filters, labels, part).withColumn("shapley", shapley)
    listed = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, mask int, filter int")
    # as many rows as there are orders and steps, whatever the input
    return counts.join(F.broadcast(listed), ["mask", "filter"]).drop("mask", "filter")


def seen_before(docs: DataFrame, digest: str, flag: str) -> DataFrame:
    """``docs`` with a boolean column: a smaller doc_id has the same ``digest``."""
    first = docs.groupBy(F.col(digest).alias(f"{OWN}first_digest")).agg(F.min("doc_id").alias(f"{OWN}first_id"))
    joined = docs.join(first, (F.col("doc_id") == F.col(f"{OWN}first_id")) & (F.col(digest) == F.col(f"{OWN}first_digest")), "left")
    return joined.withColumn(flag, F.col("doc_id").isNotNull() & F.col(f"{OWN}first_id").isNull()).drop(f"{OWN}first_id", f"{OWN}first_digest")


def quality_flags(text: Column) -> dict[str, Column]:
    """The four filters that look at one text; A and B are from its words, in ``__fm_words``."""
    words, length = F.col(f"{OWN}words"), F.length(text)
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(50),
        "C": capitals.cast("long") * 100 > length.cast("long") * 3,
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, the flags A to E and the labels ``good`` and ``toxic``."""
    text = text_or_empty()
    words = F.array_remove(F.split(text, WORD_SPACE), "")
    flags = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text"), words.alias(f"{OWN}words"))
    flags = flags.select("doc_id", "part", *[c.alias(k) for k, c in quality_flags(text).items()], F.unhex(F.sha2(text, 256)).alias(f"{OWN}digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(f"{OWN}id")).agg(*[F.coalesce(F.max(c) == 1, F.lit(False)).alias(k) for k, c in LABELS.items()])
    joined = seen_before(flags, f"{OWN}digest", "E").join(marks, F.col("doc_id") == F.col(f"{OWN}id"), "left")
    return joined.select("doc_id", "part", *FILTERS, *[F.coalesce(k, F.lit(False)).alias(k) for k in LABELS])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), FILTERS, list(LABELS), "part")


ORACLE_OP13 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), flags AS (
    SELECT x.part,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false)::INT AS fails,
        coalesce(m.good, false)::INT AS good, coalesce(m.toxic, false)::INT AS toxic
    FROM texts x LEFT JOIN marks m ON x.doc_id = m.doc_id
), patterns AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails
), letters AS (
    SELECT chr(65 + i::INT) AS letter, (1 << i)::INT AS bit FROM range(5) r(i)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier FROM orders, range(1, 6) r(s)
), counted AS (
    SELECT p.part, s.filter_order, s.step, s.bit,
        coalesce(sum(n) FILTER (fails & (earlier | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & earlier = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails & bit <> 0 AND fails & earlier <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (fails & bit <> 0 AND fails & earlier = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (fails & bit <> 0 AND fails & earlier = 0), 0)::BIGINT AS toxic_lost
    FROM patterns p, steps s GROUP BY p.part, s.filter_order, s.step, s.bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
