"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product (bind) of
its letters' vectors, the first rotated twice and the second once (permute). A
text is the sum (bundle) of the vectors of all its trigrams, and a language is
the sum over the trigrams of all its training documents. A document gets the
language whose vector has the largest cosine with its own.

Texts are lower-cased; each run of characters that aren't letters counts as one
space, and a text begins and ends with one. There are ``SYMBOLS`` symbols: the
space, a to z, and a hash for every other letter, so that the table of trigram
vectors is bounded whatever the scripts. Training sums over all documents that
are not held out: each task adds up its own documents, and one vector a language
and task is shuffled. Only the languages' vectors come to the driver, and more than
``MOST_LANGUAGES`` of them are an error. Workers keep trigram vectors as bytes and drop
them with the end of a task.

Defined results: a text that is null or has no letter gets ``und`` with score 0,
as does every text if nothing can be learned. Documents with a null lang or
without letters teach nothing. Equal cosines go to the smaller language name.
Repeated rows count as often as they occur; an empty table gives an empty
result; texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, blocks, released, table

UNKNOWN = "und"
DIMENSIONS = 512
SYMBOLS = 128
SEED = 20240607
#: Trigram vectors that a worker keeps at once.
KEPT_TRIGRAMS = 12_000
#: Trigrams that are added up at once; at most KEPT_TRIGRAMS.
BUNDLED_AT_ONCE = 2_000
#: Learned lang values; their vectors come to the driver and go to every task.
MOST_LANGUAGES = 5_000
BLOCK_BYTES = 4 << 20


@cache
def _symbols() -> np.ndarray:
    """By code point: 0 for no letter, 1-26 for a to z, else a hash up to ``SYMBOLS`` - 1."""
    found = np.zeros(0x110000, dtype=np.uint8)
    letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), dtype=np.int64)
    found[letters] = 27 + (letters * 2654435761 >> 7) % (SYMBOLS - 27)
    found[97:123] = np.arange(1, 27)
    return found


@cache
def _letters() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))


def trigrams(text: str) -> np.ndarray:
    """Ids of all trigrams in order; none if the text has no letter."""
    symbols = _symbols()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)].astype(np.int32)
    letter = symbols > 0
    if not letter.any():
        return np.zeros(0, dtype=np.int32)
    letter[1:] |= letter[:-1]
    letter[0] = True
    s = symbols[letter]  # of a run of spaces the first stays
    if s[-1]:
        s = np.append(s, 0)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


class TrigramVectors:
    """Rows of the table of trigram vectors, made as they are needed."""

    def __init__(self) -> None:
        self.row = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.vectors = np.empty((KEPT_TRIGRAMS, DIMENSIONS), dtype=np.int8)
        self.used = 0

    def bundle(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        at_once = min(BUNDLED_AT_ONCE, KEPT_TRIGRAMS)
        for i in range(0, len(ids), at_once):
            part = ids[i : i + at_once]
            total += counts[i : i + at_once].astype(np.float32) @ self._rows(part).astype(np.float32)
        return total

    def _rows(self, ids: np.ndarray) -> np.ndarray:
        rows = self.row[ids]
        new = ids[rows < 0]
        if len(new):
            if self.used + len(new) > KEPT_TRIGRAMS:
                self.row.fill(-1)
                self.used, new = 0, ids
            at = np.arange(self.used, self.used + len(new))
            letters = _letters()
            self.vectors[at] = np.roll(letters[new // SYMBOLS**2], 2, axis=1) * np.roll(letters[new // SYMBOLS % SYMBOLS], 1, axis=1) * letters[new % SYMBOLS]
            self.row[new] = at
            self.used += len(new)
            rows = self.row[ids]
        return self.vectors[rows]


@cache
def _vectors() -> TrigramVectors:
    return TrigramVectors()


def document_vector(text: str) -> np.ndarray | None:
    ids = trigrams(text)
    return _vectors().bundle(*np.unique(ids, return_counts=True)) if len(ids) else None


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """The languages' vectors, of unit length, from all rows of text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                by_lang: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(trigrams(text))
                for lang, parts in by_lang.items():
                    counts = np.bincount(np.concatenate(parts))
                    ids = np.flatnonzero(counts)
                    total[lang] = total.get(lang, 0) + _vectors().bundle(ids, counts[ids])
        _vectors.cache_clear()
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(vector)], ["lang", "at", "value"])

    # the parts are whole numbers, so that their sum doesn't depend on the order
    sums = labelled.select("text", "lang").mapInArrow(released(run), "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors: dict[str, np.ndarray] = {}
    found = sums.limit(MOST_LANGUAGES * DIMENSIONS + 1).collect()
    if len(found) > MOST_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: their vectors would not fit on the driver")
    for lang, at, value in found:
        vectors.setdefault(lang, np.zeros(DIMENSIONS))[at] = value
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(vectors.items()) if v.any()}


def predict(docs: DataFrame, languages: dict[str, np.ndarray], lang_column: str, score_column: str) -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its cosine, in 0 to 1."""
    names = list(languages)
    profiles = np.array([languages[n] for n in names]).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                found, scores = [], []
                for text in block.column(block.schema.get_field_index("text")).to_pylist():
                    vector = document_vector(text) if names else None
                    if vector is None or not vector.any():
                        found.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = profiles @ (vector / np.linalg.norm(vector))
                    best = int(np.argmax(cosines))
                    found.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*block.schema.names, lang_column, score_column])
        _vectors.cache_clear()

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(released(run), f"{schema}, `{lang_column}` string, `{score_column}` double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: the remainder of crc32(doc_id as text) by 4 is 2. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    languages = learn(training_rows(docs))
    plain = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(plain, languages, "lang_pred", "score").drop("text")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those in which no language is found: null texts and texts without a letter. A null lang becomes the predicted one."""
    found = predict(docs, learn(training_rows(docs)), f"{OWN}lang", f"{OWN}score").where(F.col(f"{OWN}lang") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", f"{OWN}lang")).select(*[f"`{c}`" for c in docs.columns])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
