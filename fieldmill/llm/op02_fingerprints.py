"""Document fingerprints: I-Match over randomised lexicons.

The lexicon holds the terms whose inverse document frequency, ln(N / df), lies in
a band. Document frequencies are counted over all documents. A document's
fingerprint is made of one hash for each of ``len(RATES)`` random subsets of the
lexicon: the hash of the document's distinct terms in that subset, sorted. Small
subsets survive larger edits, large ones tell more documents apart.

Terms of a group of copies with a large share of all rows are too frequent for the band,
and those of a small language can be too rare. So that such documents have a likeness
too, a fingerprint ends with sums over random subsets of all terms of the document.

The lexicon is broadcast. Its size has a bound that doesn't grow with the corpus:
a term in the band is in at least exp(-IDF_HIGH) of all documents, so there are at
most (mean distinct terms of a document) * exp(IDF_HIGH) of them; more than
``MOST_TERMS`` are an error. The counts themselves stay distributed: each task counts its
documents and sends one row a term.

Each document is compared with an edited form that takes in the start of its
successor by doc_id, and with the successor itself. For that, documents are dealt
into ranges of doc_id; the first document of each range is also sent to the range
before it, and that of the first range to the last. Texts travel compressed and
only once. Within a range one document at a time is held with its successor.

Defined results: a null text counts as empty. A document without any term has the hash
of its text and is like itself alone, as is one none of whose terms is in any subset. Null doc_ids come first; equal
doc_ids are ordered by a hash of their text; the successor of a single document is
itself. Repeated rows are fingerprinted one by one; an empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, table, working_partitions

#: Terms in a fifth of all documents or fewer, but in a thousandth or more.
IDF_LOW, IDF_HIGH = math.log(5), math.log(1000)
#: The share of the lexicon in each random subset.
RATES = (1 / 8,) * 4 + (1 / 32,) * 6 + (1 / 128,) * 8 + (1 / 512,) * 8
EMPTY = "0" * 8
#: Of all terms of a document: so many bits of a term's hash have to be zero for each subset of its own terms.
OWN_BITS = (1,) * 1 + (3,) * 3 + (5,) * 4 + (7,) * 4
#: Terms of the lexicon, which comes to the driver and goes to every task.
MOST_TERMS = 2_000_000
#: Distinct terms that a task counts before it sends the counts on.
COUNTED_TERMS = 600_000
BLOCK_BYTES = 4 << 20
_TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    return set(_TERM.findall(text.lower()))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term and df over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["term", "df"])

        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                for text in block.column(0).to_pylist():
                    found.update(terms(text))
                if len(found) > COUNTED_TERMS:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return docs.select("text").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> list[str]:
    """The terms whose inverse document frequency lies in the band, sorted."""
    n = docs.count()
    least, most = n * math.exp(-idf_high), n * math.exp(-idf_low)
    found = document_frequencies(docs).where(F.col("df").between(least - 1e-6, most + 1e-6)).select("term").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms in the band: choose a narrower one")
    return sorted(r[0] for r in found)


def subsets(words: list[str]) -> dict[str, tuple[int, ...]]:
    """By term of the lexicon: the subsets that it is in."""
    return {w: tuple(k for k, rate in enumerate(RATES) if xxhash.xxh32_intdigest(w, k) < rate * 2**32) for w in words}


class IMatch:
    def __init__(self, words: list[str]):
        self.subsets = subsets(words)
        self.words = frozenset(words)

    def fingerprint(self, text: str) -> str:
        own = terms(text)
        held: list[list[str]] = [[] for _ in RATES]
        for term in sorted(own & self.words):
            for k in self.subsets[term]:
                held[k].append(term)
        sums = own_sums(own)
        if not any(held) and all(x == EMPTY for x in sums):
            return "-" + xxhash.xxh64_hexdigest(" ".join(sorted(own)) or "\0" + text)
        return "".join([*(xxhash.xxh32_hexdigest(" ".join(x)) if x else EMPTY for x in held), *sums])


def own_sums(own: set[str]) -> list[str]:
    """The sum of the hashes of the terms in each subset of a document's own terms."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t) for t in own), dtype=np.uint64, count=len(own))
    out, at = [], 0
    for bits in OWN_BITS:
        inside = hashes[(hashes >> np.uint64(at)) & np.uint64((1 << bits) - 1) == 0]
        out.append(f"{(int(inside.sum(dtype=np.uint64)) >> 32) or 1:08x}" if len(inside) else EMPTY)
        at += bits
    return out


def likeness(a: str, b: str) -> float:
    """The share of subsets, of the lexicon and of their own terms, with equal hashes among those that either document has terms of."""
    if a == b:
        return 1.0
    if "-" in (a[0], b[0]):
        return 0.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    used = [(x, y) for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in used) / len(used)


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many, or all, from the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that occur, cutting the documents into even ranges; each is the first of its range."""
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 100_000)).first()[0] if n > 1 else []
    return sorted(set(cuts or []))


def fingerprint_documents(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likeness, for each row of ``docs``. doc_id is a whole number."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(lexicon(docs) if words is None else sorted(set(words)))
    n = working_partitions(docs)
    cuts = np.array(_ranges(docs, n), dtype=np.int64)
    low, nulls = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    first = None if nulls else low
    cuts = cuts[cuts > low] if first is not None else cuts  # the first range begins with the first document
    last, starts = len(cuts), set(cuts.tolist())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                ids = block.column(0).to_pylist()
                packed, ties = [], []
                for text in block.column(1).to_pylist():
                    data = text.encode()
                    packed.append(pack(data))
                    ties.append(xxhash.xxh3_64_intdigest(data) >> 1)
                at = [0 if i is None else int(np.searchsorted(cuts, i, side="right")) for i in ids]
                rows = [(b, False, k) for k, b in enumerate(at)]
                rows += [(b - 1, True, k) for k, b in enumerate(at) if ids[k] in starts]
                rows += [(last, True, k) for k in range(len(ids)) if ids[k] == first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in rows], pa.int32()),
                        pa.array([x for _, x, _ in rows], pa.bool_()),
                        pa.array([ids[k] for _, _, k in rows], pa.int64()),
                        pa.array([ties[k] for _, _, k in rows], pa.int64()),
                        pa.array([packed[k] for _, _, k in rows], pa.binary()),
                    ],
                    ["part", "extra", "doc_id", "tie", "packed"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = IMatch(shared.value)
        unpack = zstandard.ZstdDecompressor().decompress
        held: tuple[int, int | None, str, str] | None = None
        for batch in batches:
            out: list[tuple] = []
            for part, extra, doc_id, packed in zip(*[batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "packed")], strict=True):
                if extra and (held is None or held[0] != part):
                    continue  # of several first documents of the next range one is enough
                text = unpack(packed).decode()
                own = model.fingerprint(text)
                if held is not None:
                    _, before_id, before, print_ = held
                    form = edited(before, text)
                    form_print = model.fingerprint(form)
                    out.append((before_id, len(before), hashlib.sha256(form.encode()).hexdigest(), print_, form_print, likeness(print_, form_print), likeness(print_, own)))
                held = None if extra else (part, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = docs.mapInArrow(deal, "part int, extra boolean, doc_id long, tie long, packed binary")
    ordered = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "extra", F.asc_nulls_first("doc_id"), "tie")
    return ordered.mapInArrow(compare, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
