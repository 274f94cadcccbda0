import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from fieldmill.llm import op02_fingerprints as fp


def test_edited_text_and_successor(spark, sf_dir):
    rows = sorted(fp.op2_fingerprints(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    assert len(rows) == len(texts)
    model = fp.IMatch(fp.lexicon(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    for i, r in enumerate(rows):
        after = texts[(i + 1) % len(texts)]
        form = fp.edited(texts[i], after)
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(form.encode()).hexdigest()
        assert r["fingerprint"] == model.fingerprint(texts[i]) and r["edited_fingerprint"] == model.fingerprint(form)
        assert r["near_next"] == fp.likeness(r["fingerprint"], model.fingerprint(after))
    assert sum(r["near_edited"] for r in rows) > 3 * sum(r["near_next"] for r in rows)


def by_definition(text, lexicon):
    """A fingerprint written as plain loops."""
    own = set(re.findall(r"[^\W_]+", text.lower()))
    parts = []
    for k, rate in enumerate([1 / 8] * 4 + [1 / 32] * 6 + [1 / 128] * 8 + [1 / 512] * 8):
        inside = sorted(t for t in own if t in lexicon and xxhash.xxh32_intdigest(t, k) < rate * 2**32)
        parts.append(xxhash.xxh32_hexdigest(" ".join(inside)) if inside else "00000000")
    at = 0
    for bits in [1] * 1 + [3] * 3 + [5] * 4 + [7] * 4:
        inside = [h for h in map(xxhash.xxh64_intdigest, own) if (h >> at) % 2**bits == 0]
        parts.append(f"{(sum(inside) % 2**64 >> 32) or 1:08x}" if inside else "00000000")
        at += bits
    if set(parts) == {"00000000"}:
        return "-" + xxhash.xxh64_hexdigest(" ".join(sorted(own)) or "\0" + text)
    return "".join(parts)


def test_whole_table_by_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    df = Counter(t for x in texts.values() for t in set(re.findall(r"[^\W_]+", x.lower())))
    lexicon = {t for t, n in df.items() if len(texts) / 1000 <= n + 1e-6 and n - 1e-6 <= len(texts) / 5}
    ids = sorted(texts)
    for r in fp.op2_fingerprints(spark, sf_dir).collect():
        at = ids.index(r["doc_id"])
        own, after = texts[r["doc_id"]], texts[ids[(at + 1) % len(ids)]]
        k = len(own) // 4
        assert r["fingerprint"] == by_definition(own, lexicon)
        assert r["edited_fingerprint"] == by_definition(own[: len(own) - k] + after[:k], lexicon)


def test_hot_group_of_near_copies_is_alike(spark):
    """A third of all rows are copies with one changed word: their terms are too frequent for the lexicon."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(300):
        own = list(base) if i % 3 == 0 else [word() for _ in range(120)]
        own[rng.randrange(120)] = word()
        texts.append(" ".join(own))
    order = sorted(range(300), key=lambda i: i % 3)  # the copies follow each other
    docs = spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")
    rows = sorted(fp.fingerprint_documents(docs).collect(), key=lambda r: r["doc_id"])
    hot = [r["near_next"] for r in rows[:99]]
    assert sum(hot) / len(hot) > 0.5 and min(hot) > 0
    # a text whose last quarter is replaced is about as like as in the other documents
    assert sum(r["near_edited"] for r in rows[:99]) / 99 > 0.5 * sum(r["near_edited"] for r in rows[101:]) / len(rows[101:]) > 0.05
    assert all(r["near_next"] < 0.2 for r in rows[101:299])


def test_too_many_terms_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(fp, "MOST_TERMS", 3)
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 6}") for i in range(40)], "doc_id long, text string")
    with pytest.raises(ValueError, match="band"):
        fp.lexicon(docs)


def test_lexicon_is_the_band(spark):
    texts = [" ".join(["common", f"rare{i}", f"band{i % 10}"]) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert fp.lexicon(docs, idf_low=1.0, idf_high=4.0) == sorted(f"band{i}" for i in range(10))


def test_small_edits_keep_most_hashes():
    random.seed(1)
    words = [f"w{i}" for i in range(5000)]
    model = fp.IMatch(words)
    text = random.sample(words, 200)
    near = text[:-4] + random.sample(words, 4)
    far = random.sample(words, 200)
    a, b, c = (model.fingerprint(" ".join(x)) for x in (text, near, far))
    assert model.fingerprint(" ".join(reversed(text))) == a
    assert fp.likeness(a, b) > 0.4 > 0.1 > fp.likeness(a, c)


def test_defined_cases(odd_docs, no_docs, spark):
    rows = fp.fingerprint_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fp.fingerprint_documents(no_docs).count() == 0
    one = fp.fingerprint_documents(spark.createDataFrame([(7, "alone in the world")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
