"""Every query with SQL is held against it on the small tables, and no query depends on the partitioning of its input."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldmill.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    wanted = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


@pytest.fixture(scope="module")
def dealt_dir(spark, sf_dir, tmp_path_factory):
    """The same tables in another order, dealt over five files."""
    folder = tmp_path_factory.mktemp("dealt")
    for t in ("documents", "pages", "conversations", "embeddings", "orders", "lineitem", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").orderBy(F.rand(7)).repartition(5).write.parquet(f"{folder}/{t}.parquet")
    for t in set(TABLES) - {p.name.split(".")[0] for p in folder.iterdir()}:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_does_not_depend_on_partitions(spark, sf_dir, dealt_dir, name):
    first, second = (sorted(map(repr, QUERIES[name](spark, d).collect())) for d in (sf_dir, dealt_dir))
    assert first == second


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark, sf_dir):
    """Columns and filters reach the scan."""
    plan = QUERIES["usage_rollup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    plan = QUERIES["lookback_range_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
