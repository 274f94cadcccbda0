"""Runs of words that repeat with a period, found by counting matches at each lag.

A run with period p is an island at lag p: consecutive words that equal the word
p places on. First the matches of every lag are counted, exactly, without looking
at places:

* heavy words (more occurrences than a threshold that grows with the root of the text's
  length) by autocorrelation: the squared spectra of their indicators are added
  and transformed back once, and rounded to whole numbers,
* light words by the differences of their positions.

Only lags with at least the matches that a run of that period needs, max(6 - p, 3 p),
are scanned for islands, from the smallest lag on. Matches that a known run
explains are taken off at the multiples of its period: there its island can hold
no other run, since a stretch of four periods whose smallest period is q has a period
that q divides. So a text of one word repeated costs one scan, not one a lag. A scan looks
at every (p / 8)th place first and at all places only where enough of these match
in a row: an island that is long enough covers that many.

All work on a text is in one task and takes memory in proportion to its length; texts
are dealt in blocks. Nothing is shuffled.

Defined results: a null text has no words, no runs and an empty collapsed text; repeated
rows each get their result; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, blocks, released, table, text_or_empty

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places of a period that a scan looks at first.
PROBES = 8
BLOCK_BYTES = 1 << 20
WORD_SPACE = r"[\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def needed(lag: np.ndarray | int) -> np.ndarray | int:
    """Matches at a lag that a run of that period has."""
    return np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places match the place ``lag`` further on, for lags 0 (left 0) to ``most``."""
    n = len(ids)
    found = np.zeros(most + 1, dtype=np.int64)
    size = 1 << (n + most - 1).bit_length()
    counts = np.bincount(ids)
    heavy_from = max(24, int((size * size.bit_length()) ** 0.5 / 2))
    heavy = np.flatnonzero(counts > heavy_from)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft((ids == word).astype(np.float64), size)
            power += spectrum.real**2 + spectrum.imag**2
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    light = (counts > 1) & (counts <= heavy_from)
    places = np.flatnonzero(light[ids])
    words = ids[places]
    order = np.argsort(words, kind="stable")
    places, words = places[order], words[order]
    at, k = np.arange(len(places)), 0
    while len(at):  # the kth next occurrence of each place's word
        k += 1
        at = at[at < len(places) - k]
        at = at[words[at + k] == words[at]]
        gaps = places[at + k] - places[at]
        near = gaps <= most
        at, gaps = at[near], gaps[near]
        if len(gaps):
            seen = np.bincount(gaps)
            found[: len(seen)] += seen
    found[0] = 0
    return found


def streaks(hits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and end of every stretch of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(hits.astype(np.int8), prepend=0, append=0))
    first, end = edges[::2], edges[1::2]
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist(), strict=True))


def islands(ids: np.ndarray, lag: int, least: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and end of the islands of at least ``least`` matches at ``lag``, without the ``known`` ones."""
    last = len(ids) - lag
    step = max(1, lag // PROBES)
    found = []
    for a, b in streaks(ids[:last:step] == ids[lag::step], least // step):
        if any(first <= a * step and (b - 1) * step < end for first, end in known):
            continue
        low, high = max(0, (a - 1) * step + 1), min(b * step, last)
        whole = [(low + x, low + y) for x, y in streaks(ids[low:high] == ids[low + lag : high + lag], least)]
        found += [x for x in whole if x not in known]
    return found


def period_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word numbers, by start, then period."""
    n = len(ids)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS or most == 0:
        return []
    matches = lag_matches(ids, most)
    lags = np.arange(most + 1)
    least = needed(lags)
    runs: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = {}
    for lag in np.flatnonzero((matches >= least) & (lags > 0)).tolist():
        explained = known.pop(lag, [])
        if matches[lag] - sum(end - first for first, end in explained) < least[lag]:
            continue
        for first, end in islands(ids, lag, int(least[lag]), explained):
            runs.append((first, end - first + lag, lag))
            for multiple in range(2 * lag, min(end - first + lag - 1, most) + 1, lag):
                known.setdefault(multiple, []).append((first, end + lag - multiple))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, ``runs`` by start and period, the ``strongest`` one, and ``collapsed``: the words without the repeats of any run."""
    runs_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_dict = lambda r: dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                found, best, kept = [], [], []
                for text in block.column(1):
                    words = text.as_buffer().to_pybytes().split()  # bytes are split at the six white-space characters of ASCII
                    number: dict[bytes, int] = {}
                    runs = period_runs(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
                    keep = np.ones(len(words), dtype=bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    top = strongest(runs)
                    found.append([as_dict(r) for r in runs])
                    best.append(as_dict(top) if top else None)
                    kept.append(b" ".join(words if not runs else [words[i] for i in np.flatnonzero(keep)]).decode())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.list_(runs_type)), pa.array(best, runs_type), pa.array(kept, pa.string())], ["doc_id", "runs", "strongest", "collapsed"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, runs array<{RUN}>, strongest {RUN}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and ``text``, in a tenth of the documents with a repeating tail: of h, the crc32 of doc_id as text, h % 10 is 0."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.array_remove(F.split(text_or_empty(), WORD_SPACE), "")
    chosen = docs.select("doc_id", "text", g.alias(f"{OWN}g"), F.when(h % 10 == 0, words).alias(f"{OWN}words"))
    n = F.size(f"{OWN}words")
    chosen = chosen.withColumn(f"{OWN}n", F.when(n > 0, n))
    chosen = chosen.withColumn(f"{OWN}a", (F.col(f"{OWN}g") % F.col(f"{OWN}n")).cast("int"))
    a, rest = F.col(f"{OWN}a"), F.col(f"{OWN}n") - F.col(f"{OWN}a")
    chosen = chosen.withColumn(f"{OWN}rest", rest).withColumn(f"{OWN}p", (1 + F.floor(rest / (3 + F.col(f"{OWN}g") % 8))).cast("int"))
    rest, p = F.col(f"{OWN}rest"), F.col(f"{OWN}p")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(f"{OWN}words", a + 1, p), F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice(f"{OWN}words", F.lit(1), a), tail), " ")
    return chosen.select("doc_id", F.when(p.isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    listing = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
