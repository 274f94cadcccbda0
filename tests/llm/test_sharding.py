import itertools
import zlib

import numpy as np
import pytest

from fieldmill.llm import op10_sharding as shards


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)), dtype=np.uint64)
    index = shards.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)].astype(int), axis=0)).sum(axis=1)
    assert (steps == 1).all()


def check(rows, texts, n=shards.SHARDS):
    sizes = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(i, [])) for i in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = shards.op10_sharding(spark, sf_dir).collect()
    check(rows, texts)
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in rows)
    runs = [k for k, _ in itertools.groupby(texts[r["doc_id"]] for r in ordered)]
    assert len(runs) == len(set(runs))  # equal texts lie side by side


def test_defined_cases(odd_docs, no_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    check(shards.assign_shards(odd_docs).collect(), texts)
    check(shards.assign_shards(odd_docs, 3).collect(), texts, 3)
    assert shards.assign_shards(no_docs).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 3}", "en") for i in range(50)], "doc_id long, text string, source string, lang string")
    shards.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13]
