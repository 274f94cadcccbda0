import datetime as dt

from pyspark.sql import functions as F

from fieldmill.functions import dates, stats
from fieldmill.operators import calendar, season, thresholds, trends, water


def days(start, n):
    return [dt.date.fromisoformat(start) + dt.timedelta(days=i) for i in range(n)]


def test_bucket_by_hand_and_mass_balance(spark):
    one = spark.createDataFrame([(1, dt.date(2024, 7, 10), 1.0, 5.0, 0.0)], "site int, day date, precipitation_mm double, et0_mm double, irrigation_mm double")
    r = water.water_balance(one, "site", cover="bare").first()
    assert (round(r["etc"], 9), round(r["delta"], 9), round(r["depletion"], 9)) == (4.5, -3.5, 3.5)
    rain = [0, 0, 40, 0, 3, 0, 0, 80, 0, 0] * 30
    rows = [(1, d, float(p), None if i % 17 == 0 else 6.0, 0.0) for i, (d, p) in enumerate(zip(days("2024-03-01", 300), rain, strict=True))]
    table = spark.createDataFrame(rows, one.schema)
    out = water.water_balance(table, "site").collect()
    assert abs(sum(r["inflow"] for r in out) - sum(r["etc_actual"] for r in out) - sum(r["drainage"] for r in out) + max(out, key=lambda r: r["day"])["depletion"]) < 1e-9
    again = water.water_balance(table.repartition(7), "site").collect()
    assert sorted(out) == sorted(again)


def test_clamped_deficit_equals_the_loop(spark):
    rain = [0.0, 9.0, 1.0, 30.0, 0.0, 2.0] * 70
    rows = [(1, d, p, 4.0 if i % 9 else None) for i, (d, p) in enumerate(zip(days("2023-02-01", 420), rain, strict=True))]
    found = {r["day"]: r["deficit"] for r in water.clamped_deficit(spark.createDataFrame(rows, "site int, day date, precipitation_mm double, et0_mm double"), "site").collect()}
    total, year = 0.0, None
    for _, d, p, e in rows:
        if not 4 <= d.month <= 9:
            assert found[d] is None
            continue
        if d.year != year:
            total, year = 0.0, d.year
        total = max(0.0, total + (e or 0.0) - p)
        assert abs(found[d] - total) < 1e-9


def test_zero_filled_and_absent_years(spark):
    rows = [("a", y, 10) for y in (2000, 2000, 2003)] + [("b", y, 10) for y in (2000, 2001, 2002, 2003)]
    e = spark.createDataFrame(rows, "category string, year int, doy int")
    filled = {(r["category"], r["year"]): r["n"] for r in trends.zero_filled_counts(e, "category", "year").collect()}
    assert filled["a", 2001] == 0 and filled["a", 2000] == 2 and len(filled) == 8
    assert season.cumulative_counts(e, "category", "year", "doy", 20).count() == 6


def test_zscore_floor(spark):
    rows = [(6.0, 1.0, 0.0, 4), (1.0, 1.0, 0.0, 4), (3.0, 0.0, 0.0, 4), (3.0, 1.0, 1.0, 1), (3.0, 1.0, 2.0, 4)]
    t = spark.createDataFrame(rows, "v double, m double, d double, n int")
    assert [r[0] for r in t.select(stats.zscore(F.col("v"), F.col("m"), F.col("d"), F.col("n"))).collect()] == [10.0, 0.0, 6.0, 0.0, 1.0]


def test_calendar_functions(spark):
    t = spark.createDataFrame([(dt.date(2024, 12, 30), 2023), (dt.date(2024, 2, 29), 2023), (dt.date(2024, 2, 29), 2020)], "d date, y int")
    rows = t.select(dates.period_key(F.col("d"), "week").alias("w"), dates.anniversary(F.col("y"), F.col("d")).alias("a")).collect()
    assert rows[0]["w"] == "2025-W01" and [str(r["a"]) for r in rows] == ["2023-12-30", "2023-02-28", "2020-02-29"]
    k = spark.range(1).select(dates.month_window(F.lit(11), F.lit(2)).alias("m"), dates.utc_evening_date(F.lit("2024-05-01T22:00:00Z")).alias("e"), dates.utc_evening_date(F.lit("2024-05-01T21:59:00Z")).alias("f")).first()
    assert k["m"] == [11, 12, 1, 2] and str(k["e"]) == "2024-05-02" and str(k["f"]) == "2024-05-01"
    kc = spark.createDataFrame([(d,) for d in days("2024-01-01", 366)], "d date").select(dates.crop_coefficient(F.col("d")).alias("k")).collect()
    assert all(abs(a["k"] - b["k"]) < 0.06 for a, b in zip(kc, kc[1:], strict=False))


def test_dedupe_keeps_rows_of_the_first_page(spark):
    rows = [(1, "k", "p1"), (2, "k", "p1"), (3, "k", "p2"), (4, None, "p2"), (5, None, "p3")]
    t = spark.createDataFrame(rows, "id int, key string, page string")
    assert sorted(r["id"] for r in calendar.dedupe_pages(t, ["key"], "page", ["id"], F.col("key").isNull()).collect()) == [1, 2, 4, 5]


def test_prefix_matches_both_ways(spark):
    names = spark.createDataFrame([("Captan 480",), ("Cap",), ("Delan",)], "name string")
    queries = spark.createDataFrame([("captan",), ("de",)], "text string")
    assert sorted(r["name"] for r in calendar.prefix_matches(names, "name", queries, "text").collect()) == ["Cap", "Captan 480"]


def test_thresholds(spark):
    t = spark.createDataFrame([(-7.0,), (-3.0,), (-1.0,), (3.0,)], "t double")
    assert [r[0] for r in t.select(thresholds.frost_risk(F.col("t"), F.lit(-2.2), F.lit(-6.7))).collect()] == ["critical", "high", "moderate", "low"]
    assert thresholds.alerts(t.select(thresholds.frost_risk(F.col("t"), F.lit(-2.2), F.lit(-6.7)).alias("risk"))).count() == 2


def test_bee_flight_never_null(spark):
    t = spark.createDataFrame([(None, 0.0, 1.0), (15.0, 0.0, None), (15.0, 0.6, 1.0), (15.0, 0.5, 26.0)], "t double, r double, w double")
    assert [r[0] for r in t.select(season.bee_flight_day(F.col("t"), F.col("r"), F.col("w"))).collect()] == [False, True, False, False]
