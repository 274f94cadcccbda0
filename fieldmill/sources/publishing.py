"""An index of several tables that is published as a whole.

A version is a folder with all tables. It counts from the moment a pointer names it, and the pointer is one small file
that appears at once; a writer that dies before leaves the version before in use. The pointer keeps for each table its rows and a
digest of its ids that doesn't depend on their order, so that a load can refuse tables that don't belong together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version string, published timestamp, tables map<string, struct<rows: bigint, ids: bigint, digest: bigint>>, facts map<string, string>"


class StaleIndex(ValueError):
    """Tables of an index whose ids are not the same."""


def id_digest(rows: DataFrame, key: str, **by: str) -> DataFrame:
    """rows, ids and digest of a table (by groups of columns, if any): how many rows and distinct ids it has, and the sum of 32 bits of the md5 of each distinct id.

    Equal sets of ids have equal digests in whatever order and however often they occur.
    """
    groups = [F.col(c).alias(name) for name, c in by.items()]
    once = rows.groupBy(*groups, F.col(key).cast("string").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    bits = F.conv(F.substring(F.md5("__id"), 1, 8), 16, 10).cast("bigint")
    return once.groupBy(*by).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("__id").alias("ids"), F.coalesce(F.sum(bits), F.lit(0)).alias("digest"))


def publish(tables: dict[str, DataFrame], keys: dict[str, str], path: str, facts: dict[str, str] | None = None) -> str:
    """Writes all tables as a new version under ``path`` and points to it last; returns the version.

    ``keys`` names each table's id column. ``facts`` are kept beside, as the name of the model that made the vectors.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    entries = []
    for name, table in tables.items():
        table.write.parquet(f"{path}/versions/{version}/{name}")
        written = spark.read.parquet(f"{path}/versions/{version}/{name}")
        entries.append((name, id_digest(written, keys[name]).first()))
    pointer = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published"),
        F.map_from_arrays(F.array(*[F.lit(n) for n, _ in entries]), F.array(*[F.struct(F.lit(r["rows"]).cast("bigint").alias("rows"), F.lit(r["ids"]).cast("bigint").alias("ids"), F.lit(r["digest"]).cast("bigint").alias("digest")) for _, r in entries])).alias("tables"),
        F.create_map(*[F.lit(x) for kv in (facts or {"": ""}).items() for x in kv]).alias("facts"),
    )
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return version


def current(spark: SparkSession, path: str) -> dict:
    """The pointer of the newest published version."""
    row = spark.read.schema(POINTER).parquet(f"{path}/pointers").orderBy(F.desc("published"), F.desc("version")).first()
    if row is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return row.asDict(recursive=True)


def load(spark: SparkSession, path: str, together: list[str] | None = None, expected: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version.

    Tables of ``together`` must have the same set of ids, and ``expected`` facts (the model of the vectors) must be those of the version, else StaleIndex.
    """
    pointer = current(spark, path)
    for name, value in (expected or {}).items():
        if pointer["facts"].get(name) != value:
            raise StaleIndex(f"{name} is {pointer['facts'].get(name)!r}, not {value!r}")
    sets = {(pointer["tables"][t]["ids"], pointer["tables"][t]["digest"]) for t in together or []}
    if len(sets) > 1:
        raise StaleIndex(f"{', '.join(together or [])} don't have the same ids")
    return {name: spark.read.parquet(f"{path}/versions/{pointer['version']}/{name}") for name in pointer["tables"]}
