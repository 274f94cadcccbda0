import random
import re

import numpy as np
import pytest
import xxhash

from fieldmill.llm import near_copies
from fieldmill.llm import op05_simhash as sim
from fieldmill.llm.graph import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The smallest index that links reach, of each fingerprint."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(values)):
        for j in (np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_whole_table(spark, sf_dir):
    rows = sorted(sim.op5_simhash(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in docs]
    assert [r["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    assert [r["component_id"] for r in rows] == [docs[i]["doc_id"] for i in components(prints)]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_links_connect_all_near_fingerprints(spark, chunk):
    """A dense ball, chains, random ones and a flipped bit in every block, also where keys are dealt into small chunks."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {flip(centre, rng.randint(0, 4)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(200)} | {0, 7, 7 << 61, (1 << 64) - 1}
    at = rng.getrandbits(64)
    for _ in range(20):
        at = flip(at, 3)
        prints.add(at)
    prints = sorted(prints)
    table = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    tree = {r["node"]: r["root"] for r in connected_components(sim.links(table, len(prints), chunk=chunk)).collect()}
    got = {}
    for p in prints:
        key = int(np.uint64(p).view(np.int64))
        got.setdefault(tree.get(key, key), []).append(p)
    wanted = {}
    for p, c in zip(prints, components(prints), strict=True):
        wanted.setdefault(c, []).append(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_pivots_discard_no_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, int(k), replace=False)) for k in rng.integers(0, 6, 400)], dtype=np.uint64)
    assert (sim.linked(a, b) == (np.bitwise_count(a[:, None] ^ b[None, :]) <= 3)).all()


def test_block_masks_cover_three_bits():
    rng = random.Random(2)
    for n in range(5, 9):
        masks = [m % (1 << 64) for m in sim.block_masks(n)]
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(flipped & m == 0 for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


def test_defined_cases(odd_docs, no_docs):
    rows = sim.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fp"] == 0 == by_id[1]["fp"] and by_id[1]["component_id"] == 0 and by_id[6]["component_id"] == 5
    assert sim.near_duplicates(no_docs).count() == 0
    kept = sim.keep_representatives(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and None in ids
    assert sim.keep_representatives(no_docs).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word399", "other")
    docs = spark.createDataFrame([(3, text), (1, near), (2, text), (9, "something else entirely, on its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in sim.keep_representatives(docs).collect()) == [1, 9]


def test_unlinked_rows_with_the_same_or_no_id_stay(spark):
    """Two null ids, one id over two texts, an exact repeat of a row, and a near copy."""
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(None, "first of two without an id", 1), (None, "a second one, of other words", 2), (5, "one text", 3), (5, "and quite another text here", 4), (7, long, 5), (7, long, 5), (8, long, 6), (None, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    for module in (sim, near_copies):
        kept = sorted(r["extra"] for r in module.keep_representatives(docs).collect())
        assert kept == [1, 2, 3, 4, 5]
