"""The best hits by blocks against all pairs, with copies of a vector and rows without one."""

import random

from pyspark.sql import functions as F

from fieldmill.operators import retrieval


def test_blocks_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = spark.createDataFrame([(i, some[i % 40] if i % 7 or i == 0 else some[0], i % 3) for i in range(300)], "id long, v array<double>, label int")
    rows = rows.union(spark.createDataFrame([(1000, None, 1)], rows.schema))
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("qv"))
    monkeypatch.setattr(retrieval, "ROWS_OF_BLOCK", 100)
    monkeypatch.setattr(retrieval, "QUERIES_OF_BLOCK", 3)
    pairs = retrieval.pair_scores(queries, rows, "qv", "v").where("query <> id")
    wanted = {(r["query"], r["rank"], r["id"], r["label"], r["score"]) for r in retrieval.top_k(pairs, "query", "id", 12).collect()}
    found = retrieval.nearest(queries, rows, "query", "id", "qv", "v", 12, ("label",)).collect()
    assert {(r["query"], r["rank"], r["id"], r["label"], r["score"]) for r in found} == wanted and len(found) == len(wanted)


def test_a_vector_of_zeros_is_an_error():
    import pandas as pd
    import pytest

    with pytest.raises(ValueError):
        retrieval._unit_parts(pd.Series([[1.0, 0.0], [0.0, 0.0]]))
