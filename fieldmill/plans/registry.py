"""Where plan modules enter their queries and the SQL these are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name."""

    def enter(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return enter


#: Tables whose rows take long each; inputs of so many parts are not dealt anew, however many a shuffle has.
TEXTS = ("documents", "pages", "conversations")
MOST_DEALT = 16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of texts in fewer parts than a shuffle has (or MOST_DEALT) is dealt over as many, as a small file is one part, and the work on its rows would be one task; a larger one stays as its files lie."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_DEALT)
    return rows.repartition(parts) if name in TEXTS and rows.rdd.getNumPartitions() < parts else rows
