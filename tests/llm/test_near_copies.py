import random

import corpus_pipeline
from fieldmill.llm import near_copies as near


def components(texts, least=0.8):
    """By brute force: the smallest id that links reach."""
    sets = {i: near.shingles(t or "") for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near.jaccard(sets[a], sets[b]) >= least]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def corpus(seed=3):
    """Groups of texts with scattered edits, whose similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(25):
        base = rng.choices(words, k=rng.choice((12, 40, 150, 600)))
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    return texts


def test_components_equal_brute_force(spark):
    texts = corpus()
    wanted = components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for chunk in (near.CHUNK, 2):
        assert {r["doc_id"]: r["component_id"] for r in near.near_copies(docs, chunk=chunk).collect()} == wanted
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(wanted.values()) and len(kept) < len(texts)


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in near.keep_representatives(docs).collect()} == set(wanted.values())


def test_remaining_pairs_link_like_brute_force():
    import numpy as np

    texts = corpus(5)
    sets = [near.shingles(t) for t in texts.values()]
    found = near.cross_links(sets, np.arange(len(sets)), np.zeros(len(sets), dtype=bool))
    assert all(near.jaccard(sets[i], sets[j]) >= 0.8 for i, j in found)
    assert len(sets) - len(found) == len(set(components(texts).values()))


def test_large_sets_are_not_broadcast(spark, monkeypatch):
    texts = corpus(7)
    hub = " ".join(f"hub{i}" for i in range(200))
    for k in range(40):  # near copies of one text, which is in most pairs
        texts[len(texts)] = f"{hub} end{k}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = components(texts)
    for most in (near.MOST_SET_BYTES, 0):
        monkeypatch.setattr(near, "MOST_SET_BYTES", most)
        assert {r["doc_id"]: r["component_id"] for r in near.near_copies(docs).collect()} == wanted


def test_remaining_links_of_a_large_part(spark):
    """A bucket of one large part and some others: what meets connects as much as all pairs do."""
    from pyspark.sql import functions as F

    texts = corpus(11)
    label = components(texts)
    nodes = {i: near.shingles(t) for i, t in texts.items()}
    rng = random.Random(1)
    part = {i: label[i] if rng.random() < 0.8 else i for i in texts}
    big = max(set(label.values()), key=lambda x: sum(v == x for v in label.values()))
    apart = spark.createDataFrame([(k, i, big if k and label[i] == big else p) for k in (0, 1) for i, p in part.items()], "key long, node long, part long")
    apart = near.checkpoint(apart)
    sets = near.checkpoint(spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in nodes.items()], "node long, set binary"))
    for chunk in (near.CHUNK, 4):
        found = {(r["u"], r["v"]) for r in near._remaining_links(apart, sets, near.LEAST, chunk).collect()}
        assert all(near.jaccard(nodes[u], nodes[v]) >= 0.8 for u, v in found)
        links = found | {(i, p) for i, p in part.items()}
        joined = spark.createDataFrame([(int(a), int(b)) for a, b in links if a != b], "u long, v long").select("u", "v")
        roots = {r["node"]: r["root"] for r in near.connected_components(joined).collect()}
        assert {i: min(roots.get(i, i), i) for i in texts} == label
        assert apart.where(F.col("part").isNull()).count() == 0
