"""Readers and writers with explicit schemas.

Network fetches, scanned pages and neural models are outside: what they give is read
as files or columns (landed JSON, layout rows, an embedding or loss column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSCRIPT = (
    "jaar STRING, bestand STRING, pagina INT, image_path STRING, opmerkingen_pagina STRING, "
    "entries ARRAY<STRUCT<datum_ruw: STRING, datum_iso: STRING, tijd: STRING, opmerkingen: STRING, onzeker: BOOLEAN, raw_transcript: STRING, toepassingen: ARRAY<STRUCT<middel: STRING, hoeveelheid: STRING>>>>"
)


def source_manifest(spark: SparkSession, folder: str, sources: DataFrame) -> DataFrame:
    """``sources`` (id, file, blocked) with status, path, size and sha256 of the file in ``folder``; the content is hashed where it lies."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", F.sha2("content", 256).alias("sha256"))
    status = F.when(F.col("blocked"), "blocked").when(F.col("sha256").isNotNull(), "acquired").otherwise("missing")
    return sources.join(files, "file", "left").withColumn("status", status)


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """One row: sources that are there (new or from before), blocked and failed."""
    status = F.col("status")
    return manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(status.isin("acquired", "already_acquired")).alias("n_acquired"), F.count_if(status == "blocked").alias("n_blocked"), F.count_if(status == "failed").alias("n_failed"))


def rerooted(path: str, marker: str):
    """The part of a path after a marker folder, either separator; null without it."""
    return F.nullif(F.regexp_extract(path, rf"{marker}[/\\](.*)$", 1), F.lit(""))


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, entries, applications and unreadable files of transcribed pages; of pages with the same file and number the first path wins."""
    raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").schema(f"{TRANSCRIPT}, corrupt STRING").json(path)
    raw = raw.withColumn("file", F.input_file_name())
    bad = raw.where("corrupt IS NOT NULL OR bestand IS NULL").select("file")
    first = F.row_number().over(Window.partitionBy("bestand", "pagina").orderBy("file"))
    good = raw.where("corrupt IS NULL AND bestand IS NOT NULL").withColumn("k", first).where("k = 1")
    good = good.withColumn("page_id", F.xxhash64("bestand", "pagina"))
    pages = good.select("page_id", "jaar", "bestand", "pagina", "image_path", "opmerkingen_pagina")
    entries = good.select("page_id", F.posexplode("entries").alias("position", "e")).withColumn("entry_id", F.xxhash64("page_id", "position"))
    applications = entries.select("entry_id", F.posexplode("e.toepassingen").alias("position", "a")).select("entry_id", "position", F.col("a.middel").alias("product"), F.col("a.hoeveelheid").alias("amount"))
    flat = entries.select("entry_id", "page_id", "position", F.try_to_date("e.datum_iso").alias("day"), F.col("e.tijd").alias("time"), F.col("e.opmerkingen").alias("remarks"), F.coalesce("e.onzeker", F.lit(False)).alias("uncertain"))
    return pages, flat, applications, bad


def nested_entries(entries: DataFrame, applications: DataFrame) -> DataFrame:
    """Entries with their applications as an ordered array, empty where there are none."""
    apps = applications.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("position", "product", "amount"))).alias("a"))
    apps = apps.select("entry_id", F.transform("a", lambda x: F.struct(x["product"].alias("product"), x["amount"].alias("amount"))).alias("applications"))
    return entries.join(apps, "entry_id", "left").withColumn("applications", F.coalesce("applications", F.array().cast("array<struct<product:string,amount:string>>")))


def training_entries(nested: DataFrame) -> DataFrame:
    return nested.where("day IS NOT NULL AND NOT uncertain AND size(applications) > 0")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sampled_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same rows at any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(n)


def write_new_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """Nested documents as JSON, a folder for each document; what was there before goes."""
    rows.write.mode("overwrite").partitionBy("doc_id").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_unverified(rows: DataFrame, spark: SparkSession, path: str, force: bool = False) -> None:
    """Overwrites a table, but not one with verified rows unless forced."""
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = None
    if existing is not None and not force and existing.where("verified").head(1):
        raise ValueError(f"{path} has verified rows")
    rows.write.mode("overwrite").parquet(path)


def latest_corrections(rows: DataFrame, corrections: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` with the latest correction of each key in the place of the original."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    last = corrections.withColumn("__k", newest).where("__k = 1").select(*rows.columns)
    return rows.join(last.select(key), key, "left_anti").unionByName(last)


def column_payload(spark: SparkSession, path: str, arrays: dict[str, str]) -> DataFrame:
    """A landed column-wise payload ({"daily": {"time": [...], ...}}) as rows."""
    fields = ", ".join(f"{n}: ARRAY<{t}>" for n, t in arrays.items())
    raw = spark.read.option("multiLine", "true").schema(f"daily STRUCT<{fields}>").json(path)
    return raw.select(F.explode(F.arrays_zip(*[F.col(f"daily.{n}").alias(n) for n in arrays])).alias("r")).select("r.*")


def rain_nowcast(lines: DataFrame, text: str = "value") -> DataFrame:
    """time and mm/h of lines "v|HH:MM"; mm/h is 10 to the power of (v - 109) / 32, to three places."""
    v = F.split_part(text, F.lit("|"), F.lit(1)).try_cast("int")
    rate = F.when(v > 0, F.bround(F.pow(F.lit(10.0), (v - 109) / 32.0), 3)).otherwise(0.0)
    return lines.where(F.contains(text, F.lit("|"))).select(F.trim(F.split_part(text, F.lit("|"), F.lit(2))).alias("time"), rate.alias("mm_per_hour"))


