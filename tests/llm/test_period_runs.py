import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fieldmill.llm import op11_period_runs as op


def runs_by_loops(words):
    """All runs, straight from the definition: every period, every stretch that no neighbour extends."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def wanted_row(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = runs_by_loops(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_equal_loops(letters):
    rng = np.random.default_rng(letters)
    for trial in range(250):
        parts = []
        for _ in range(rng.integers(1, 6)):
            unit = rng.integers(0, letters, rng.integers(1, 30))
            parts += [np.tile(unit, rng.integers(1, 9)), rng.integers(0, letters, rng.integers(0, 20))]
        ids = np.concatenate(parts).astype(np.int64)[: rng.integers(1, 900)]
        assert op.period_runs(ids) == runs_by_loops(ids.tolist()), (trial, ids.tolist())


@pytest.mark.parametrize("n, letters", [(7, 1), (300, 2), (2000, 3), (5000, 400)])
def test_matches_of_every_lag(n, letters):
    ids = np.minimum(np.random.default_rng(n).geometric(1 / letters, n) - 1, 3 * letters)
    most = n // 4
    assert op.lag_matches(ids, most).tolist() == [0] + [int((ids[:-k] == ids[k:]).sum()) for k in range(1, most + 1)]


def test_long_texts_take_few_scans(monkeypatch):
    scans = []
    real = op.islands
    monkeypatch.setattr(op, "islands", lambda *a: scans.append(a[1]) or real(*a))
    assert op.period_runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)] and scans == [1]
    unit = np.random.default_rng(1).permutation(20_000)
    assert op.period_runs(np.tile(unit, 6)) == [(0, 120_000, 20_000)]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r) for r in op.op11_period_runs(spark, sf_dir).collect()}
    assert found == {r["doc_id"]: wanted_row(r["doc_id"], r["text"]) for r in rows}
    assert sum(r[1] > 0 for r in found.values()) > len(found) // 20


def test_planted_periods(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c d e f g h i j k l\x0bm n\x0co p q", "x " * 500]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(300)] + [(None, "no id at all")], "doc_id long, text string")
    found = op.with_planted_periods(docs).collect()
    assert len(found) == 301
    for r in found:
        text = texts[r["doc_id"] % len(texts)] if r["doc_id"] is not None else "no id at all"
        assert words_of(r["text"]) == planted(r["doc_id"], words_of(text))


def test_defined_cases(spark, odd_docs, no_docs):
    rows = op.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        words = words_of(texts[r["doc_id"]])
        runs = [(0, 9000, 1)] if len(words) == 9000 else runs_by_loops(words)
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == ("word" if len(words) == 9000 else " ".join(words))
        assert r["strongest"] == (None if not runs else runs[0])
    assert op.find_runs(no_docs).count() == 0
    assert op.find_runs(no_docs).columns == ["doc_id", "runs", "strongest", "collapsed"]


def test_rows_of_any_batch_give_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = (sorted(map(repr, op.find_runs(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many
