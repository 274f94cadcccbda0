import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import op12_passage_quality as op


def tables(spark, folder):
    return (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_labels(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    rows = {r["doc_id"]: r for r in op.op12_passage_quality(spark, "/root/testdata/sf0.1").collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = (sorted(r["score"] for r, q in held if q == k) for k in (1, 0))
    auc = np.mean([np.searchsorted(good, b, "right") for b in bad]) / len(good)  # the share of pairs in the wrong order
    assert len(bad) > 80 and auc < 0.03
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.97
    assert np.mean([r["predicted"] for r, q in held if q == 1]) > 0.99


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    docs, labels = tables(spark, sf_dir)
    changed = labels.withColumn("quality", F.when(op.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = ({r["doc_id"]: r["score"] for r in op.score_documents(d, op.learn(d, k)).collect()} for d, k in ((docs, labels), (other, changed)))
    assert a == b


def figures_by_loops(text):
    """All passages of one text, from the definitions; without the bins of words."""
    data = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", data)]
    n = max(1, (len(words) + op.PASSAGE_WORDS // 2) // op.PASSAGE_WORDS)
    groups = [[] for _ in range(n)]
    for i in range(len(words)):
        groups[min(i // op.PASSAGE_WORDS, n - 1)].append(i)
    said, found = set(), []
    for k, group in enumerate(groups):
        first = 0 if k == 0 else words[group[0]][0]
        end = len(data) if k == n - 1 else words[groups[k + 1][0]][0]
        row = [float(x) / max(1, end - first) for x in np.bincount(op.KIND[list(data[first:end])].astype(int), minlength=op.KINDS)]
        terms = [data[a:b] for a, b in (words[i] for i in group)]
        size = max(1, len(terms))
        row += [math.log1p(sum(map(len, terms)) / size), 1 - (len(terms) - len(set(terms))) / size, sum(a == b for a, b in zip(terms, terms[1:])) / size]
        again = 0
        for i in group:
            three = tuple(data[a:b] for a, b in words[i : i + 3])
            if len(three) == 3:
                again += three in said
                said.add(three)
        found.append([*row, again / size, math.log1p(len(terms))])
    return np.array(found)


TEXTS = ["", " \n", "one", "Tab\tand\x0bform\x0cfeed", "a b a b a b a b " * 40, "Ünï ## cödé!! 漢字 😀 " * 70, "no end of words " * 700, "x" * 5000, " lead and trail  "]


def test_figures_equal_loops(monkeypatch):
    for piece in (1 << 20, 64):
        monkeypatch.setattr(op, "PIECE_BYTES", piece)
        texts = TEXTS if piece > 64 else [t for t in TEXTS if len(t.encode()) <= 64]
        column = pa.array(["cut off", *texts])[1:]
        figures, passages = op.encode_texts(column)
        wanted = [figures_by_loops(t) for t in texts]
        assert passages.tolist() == [len(w) for w in wanted]
        assert np.allclose(figures[:, : op.KINDS + 5], np.concatenate(wanted), atol=1e-6)
        assert np.allclose((figures[:, op.KINDS + 5 :] ** 2).sum(axis=1), figures[:, op.KINDS + 4] > 0, atol=1e-5)


def test_long_texts_are_read_whole_in_pieces(monkeypatch):
    monkeypatch.setattr(op, "PIECE_BYTES", 1000)
    text = " ".join(f"word{i % 977}" for i in range(3000)) + " " + "y" * 3500
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    parts = list(op.pieces(data, np.array([0, len(data)])))
    assert parts[0][1] == 0 and parts[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(parts, parts[1:])) and all(0 < b - a <= 1000 for _, a, b in parts)
    figures, passages = op.encode_texts(pa.array(["first", text, "last"]))
    assert passages.tolist()[::2] == [1, 1] and passages[1] == len(figures) - 2
    assert np.isclose(np.expm1(figures[1:-1, op.KINDS + 4]).sum(), sum(len(text[a:b].split()) for _, a, b in parts), rtol=1e-5)
    assert op.encode_texts(pa.array([], pa.string()))[1].tolist() == []


def small_model():
    rng = np.random.default_rng(3)
    model = op.AttentionModel(rng.random(op.WIDTH), 0.5 + rng.random(op.WIDTH))
    return model, model.standard(rng.random((9, op.WIDTH))), np.array([2, 1, 4, 2])


def test_attention_equals_loops():
    model, x, passages = small_model()
    m, at = model.weights, 0
    got = model.forward(x, passages)
    for doc, n in enumerate(passages):
        h = [np.tanh(row @ m["W"] + m["b"]) for row in x[at : at + n]]
        s = [float(np.sum(m["w"] * np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"]))))) for v in h]
        a = np.exp(s) / np.sum(np.exp(s))
        z = sum(k * v for k, v in zip(a, h))
        assert np.allclose(got["attention"][at : at + n], a) and np.isclose(got["score"][doc], 1 / (1 + np.exp(-(z @ m["c"] + m["c0"][0]))))
        at += n


def test_gradients_are_those_of_the_loss():
    model, x, passages = small_model()
    label = np.array([1.0, 0, 1, 0])

    def loss():
        p = model.forward(x, passages)["score"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, d in model.gradients(model.forward(x, passages), label).items():
        w = model.weights[name]
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 7)]:
            old, step = w[at], 1e-6
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert np.isclose(d[at], (up - down) / (2 * step), atol=1e-6)


def test_one_bad_passage_gets_the_attention():
    """Bags of plain passages, half of them with one of shouting: the model finds it."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, labels = [], []
    for i in range(300):
        parts = [" ".join(word() for _ in range(64)) for _ in range(6)]
        if i % 2:
            parts[i % 6] = " ".join(word().upper() + "!!" for _ in range(64))
        texts.append(" ".join(parts))
        labels.append(1.0 - i % 2)
    figures, passages = op.encode_texts(pa.array(texts))
    model = op.AttentionModel(figures.mean(axis=0), np.maximum(figures.std(axis=0), 1e-6))
    model.fit(figures[: 6 * 200], passages[:200], np.array(labels[:200]))
    f = model.forward(model.standard(figures[6 * 200 :]), passages[200:])
    assert ((f["score"] > 0.5) == (np.array(labels[200:]) == 1)).all()
    assert np.mean([f["attention"][6 * k + (200 + k) % 6] > 1 / 6 for k in range(1, 100, 2)]) > 0.9


def test_the_sample_is_bounded(spark, sf_dir, monkeypatch):
    docs, labels = tables(spark, sf_dir)
    monkeypatch.setattr(op, "FIT_DOCUMENTS", 20)
    assert len(op.fit_sample(docs, labels, "quality")[1]) == 20
    monkeypatch.setattr(op, "FIT_PASSAGES", 30)
    figures, passages, marks = op.fit_sample(docs, labels, "quality")
    assert len(figures) == passages.sum() <= 30 and len(marks) == len(passages) > 1


def test_defined_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 0, 0), (None, 1, 1), (4, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    taught = op.fit_sample(odd_docs, labels, "quality")
    used = [i for i in (0, 1, 2, 4, 7, 8, 9) if zlib.crc32(str(i).encode()) % 5]  # 3 contradicts itself, 5 has three rows, 6 also has a 7
    assert len(taught[2]) == len(used) and sorted(taught[2]) == sorted(i % 2 for i in used)
    rows = op.score_documents(odd_docs, op.learn(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_id.values()) and by_id[0] == by_id[1]
    none = op.score_documents(odd_docs, op.learn(odd_docs, labels.where("false")))
    assert {r["score"] for r in none.collect()} == {0.5}
    ones = op.learn(odd_docs, labels.where("quality = 1"))
    assert 0.5 < ones < 1
    assert op.score_documents(no_docs, op.learn(no_docs, labels)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_scores_do_not_depend_on_partitions(spark, sf_dir, parts):
    docs, labels = tables(spark, sf_dir)
    model = op.learn(docs, labels)
    a, b = ({r["doc_id"]: r["score"] for r in op.score_documents(d, model).collect()} for d in (docs, docs.repartition(parts)))
    assert a == b
