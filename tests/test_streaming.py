import datetime as dt

from pyspark.sql import functions as F

from fieldmill.operators import water
from fieldmill.streaming import series


def test_windowed_counts_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = series.windowed_counts(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    day = F.date_trunc("day", "ts")
    wanted = {(r["d"], r["event_type"]): r["count"] for r in events.groupBy(day.alias("d"), "event_type").count().collect()}
    assert got == wanted


def test_stateful_bucket_equals_the_fold(spark, tmp_path):
    rows = [(s, dt.date(2024, 6, 1) + dt.timedelta(days=i), float((i * 7 + s) % 11 == 0) * 30, 6.0) for s in (1, 2) for i in range(60)]
    days = spark.createDataFrame(rows, "site int, day date, precipitation_mm double, et0_mm double").withColumn("irrigation_mm", F.lit(0.0))
    batch = water.water_balance(days, "site").select("site", "day", "inflow", "etc", "depletion")
    for k, part in enumerate((batch.where("day < '2024-07-01'"), batch.where("day >= '2024-07-01'"))):
        part.select("site", "day", "inflow", "etc").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    schema = batch.select("site", "day", "inflow", "etc").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = series.soil_state(stream).writeStream.format("memory").queryName("soil").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["site"], r["day"]): r["depletion"] for r in spark.table("soil").collect()}
    assert len(got) == 120 and all(abs(got[r["site"], r["day"]] - r["depletion"]) < 1e-9 for r in batch.collect())
