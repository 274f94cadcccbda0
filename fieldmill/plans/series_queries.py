"""Daily series, seasons, look-backs and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calendar, season, thresholds, water
from .registry import query, read
from .trend_queries import _ENTRIES, _order_entries, _r


@query(
    "season_to_date_zscore",
    _ENTRIES
    + """, counts AS (SELECT category, year, count(*) AS n FROM entries WHERE doy <= 180 GROUP BY ALL),
s AS (
  SELECT category, coalesce(max(n) FILTER (year = 2000), 0)::DOUBLE AS current, avg(n) FILTER (year <> 2000) AS mean,
         stddev_pop(n) FILTER (year <> 2000) AS deviation, count(*) FILTER (year <> 2000) AS n_baseline
  FROM counts GROUP BY category
), z AS (
  SELECT *, CASE WHEN n_baseline < 2 THEN 0 WHEN deviation = 0 THEN CASE WHEN current = mean THEN 0 ELSE (current - mean) / greatest(abs(mean) * 0.1, 0.5) END
            ELSE (current - mean) / deviation END AS z FROM s WHERE n_baseline >= 3
)
SELECT category, current, round(mean, 6) AS mean, round(deviation, 6) AS deviation, n_baseline, round(z, 6) AS z,
       CASE WHEN abs(z) >= 2.5 THEN 'high' WHEN abs(z) >= 1.5 THEN 'moderate' ELSE 'info' END AS severity
FROM z""",
)
def season_to_date_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = season.cumulative_counts(_order_entries(spark, sf_dir), "category", "year", "doy", 180)
    return season.baseline_scores(counts, "category", "year", "n", 2000).withColumns(_r(["mean", "deviation", "z"]))


@query(
    "season_spikes",
    _ENTRIES
    + """, counts AS (SELECT category, year, count(*) AS n FROM entries WHERE doy <= 200 GROUP BY ALL),
s AS (
  SELECT category, coalesce(max(n) FILTER (year = 1998), 0)::DOUBLE AS current, avg(n) FILTER (year <> 1998) AS mean,
         stddev_pop(n) FILTER (year <> 1998) AS deviation, count(*) FILTER (year <> 1998) AS n_baseline
  FROM counts GROUP BY category
), z AS (
  SELECT *, CASE WHEN n_baseline < 2 THEN 0 WHEN deviation = 0 THEN CASE WHEN current = mean THEN 0 ELSE (current - mean) / greatest(abs(mean) * 0.1, 0.5) END
            ELSE (current - mean) / deviation END AS z FROM s WHERE n_baseline >= 3
)
SELECT category, current, round(mean, 6) AS mean, round(deviation, 6) AS deviation, n_baseline, round(z, 6) AS z, CASE WHEN z >= 2.5 THEN 'high' ELSE 'moderate' END AS severity
FROM z WHERE z >= 1.5""",
)
def season_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.season_spikes(_order_entries(spark, sf_dir), "category", "year", "doy", 1998, 200).withColumns(_r(["mean", "deviation", "z"]))


_DAILY = """
daily AS (
  SELECT o_orderdate::DATE AS day, avg(o_totalprice) / 10000.0 AS temp_max_c, count(*)::DOUBLE AS precipitation_mm,
         CASE WHEN sum(o_orderkey) % 7 = 0 THEN NULL ELSE sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.5 END) END AS et0_mm
  FROM orders GROUP BY ALL
)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a daily weather series: mean price is the temperature, the number of orders the rain."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    et0 = F.when(F.sum("o_orderkey") % 7 == 0, None).otherwise(F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5)))
    return orders.groupBy("day").agg((F.avg("o_totalprice") / 10000.0).alias("temp_max_c"), F.count(F.lit(1)).cast("double").alias("precipitation_mm"), et0.alias("et0_mm"))


@query(
    "season_weather_summary",
    "WITH"
    + _DAILY
    + """
SELECT year(day) AS season, count(*) AS n_days, round(avg(temp_max_c), 6) AS avg_tmax, sum(precipitation_mm) AS total_precip, sum(et0_mm) AS total_et0,
       sum(precipitation_mm) - sum(et0_mm) AS water_balance
FROM daily WHERE date_diff('day', make_date(year(day), 3, 1), day) BETWEEN 0 AND 150 AND year(day) BETWEEN 1994 AND 2000 GROUP BY ALL""",
)
def season_weather_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = season.same_window(_daily(spark, sf_dir), "day", 2000, 3, 1, F.lit("2000-07-29").cast("date"), 6)
    return season.season_summary(rows, ["season"]).withColumns(_r(["avg_tmax"]))


@query(
    "weather_anomalies",
    "WITH "
    + _DAILY
    + """, w AS (
  SELECT year(day) AS season, avg(temp_max_c) AS temperature, sum(precipitation_mm) - sum(et0_mm) AS water_balance FROM daily
  WHERE temp_max_c IS NOT NULL AND day - make_date(year(day), 3, 1) BETWEEN 0 AND DATE '2000-07-29' - DATE '2000-03-01' AND year(day) BETWEEN 1994 AND 2000 GROUP BY 1
), x AS (SELECT season, 'temperature' AS signal, temperature AS v FROM w UNION ALL SELECT season, 'water_balance', water_balance FROM w),
s AS (
  SELECT signal, coalesce(max(v) FILTER (season = 2000), 0) AS current, avg(v) FILTER (season <> 2000) AS mean, stddev_pop(v) FILTER (season <> 2000) AS deviation, count(v) FILTER (season <> 2000) AS n_baseline
  FROM x WHERE v IS NOT NULL GROUP BY signal
), z AS (
  SELECT *, CASE WHEN deviation = 0 THEN CASE WHEN current = mean THEN 0 ELSE (current - mean) / greatest(abs(mean) * 0.1, 0.5) END ELSE (current - mean) / deviation END AS z FROM s WHERE n_baseline >= 3
)
SELECT signal, round(current, 6) AS current, round(mean, 6) AS mean, round(z, 6) AS z, CASE WHEN abs(z) >= 2.5 THEN 'high' ELSE 'moderate' END AS severity, n_baseline FROM z WHERE abs(z) >= 1.5""",
)
def weather_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = season.same_window(_daily(spark, sf_dir), "day", 2000, 3, 1, F.lit("2000-07-29").cast("date"), 6)
    return season.weather_anomalies(season.season_summary(rows, ["season"]), 2000).withColumns(_r(["current", "mean", "z"]))


def _site_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation and day as rain and demand of a site."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("site"))
    rows = orders.join(customers, "o_custkey").groupBy("site", "day")
    missing = F.sum("o_orderkey") % 11 == 0
    return rows.agg((F.count(F.lit(1)) * 2.5).alias("precipitation_mm"), F.when(~missing, F.max("o_orderkey") % 90 / 10.0).alias("et0_mm"), F.lit(0.0).alias("irrigation_mm"))


_SITES = """sites AS (
  SELECT c_nationkey::INT AS site, o_orderdate::DATE AS day, count(*) * 2.5::DOUBLE AS precipitation_mm,
         CASE WHEN sum(o_orderkey) % 11 = 0 THEN NULL ELSE max(o_orderkey) % 90 / 10.0 END::DOUBLE AS et0_mm
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
)"""


@query(
    "clamped_deficit",
    "WITH "
    + _SITES
    + """, inside AS (
  SELECT site, day, month(day) BETWEEN 4 AND 9 AS inside,
         sum(CASE WHEN month(day) BETWEEN 4 AND 9 THEN coalesce(et0_mm, 0) - precipitation_mm ELSE 0 END) OVER (PARTITION BY site, year(day) ORDER BY day) AS s FROM sites
)
SELECT site, day, CASE WHEN inside THEN round(s - least(0, min(s) OVER (PARTITION BY site, year(day) ORDER BY day)), 6) END AS deficit FROM inside""",
)
def clamped_deficit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.clamped_deficit(_site_days(spark, sf_dir), "site").select("site", "day", F.round("deficit", 6).alias("deficit"))


@query(
    "trailing3_running_sum",
    "WITH "
    + _SITES
    + """ SELECT site, day, sum(precipitation_mm) OVER w AS running, sum(precipitation_mm) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3
FROM sites WINDOW w AS (PARTITION BY site ORDER BY day ROWS UNBOUNDED PRECEDING)""",
)
def trailing3_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.running_sums(_site_days(spark, sf_dir), "site", "precipitation_mm").select("site", "day", "running", "last3")


_KC = """CASE WHEN day < make_date(year(day), 4, 1) OR day >= make_date(year(day), 11, 15) THEN 0.5
  WHEN day < make_date(year(day), 6, 1) THEN 0.5 + (1.15 - 0.5) * date_diff('day', make_date(year(day), 4, 1), day) / date_diff('day', make_date(year(day), 4, 1), make_date(year(day), 6, 1))
  WHEN day < make_date(year(day), 9, 15) THEN 1.15
  WHEN day < make_date(year(day), 11, 1) THEN 1.15 + (0.9 - 1.15) * date_diff('day', make_date(year(day), 9, 15), day) / date_diff('day', make_date(year(day), 9, 15), make_date(year(day), 11, 1))
  ELSE 0.9 + (0.5 - 0.9) * date_diff('day', make_date(year(day), 11, 1), day) / date_diff('day', make_date(year(day), 11, 1), make_date(year(day), 11, 15)) END::DOUBLE"""

_BUCKET = (
    "WITH RECURSIVE "
    + _SITES
    + f""", d AS (
  SELECT site, day, row_number() OVER (PARTITION BY site ORDER BY day) AS k, ({_KC}) * greatest(coalesce(et0_mm, 0), 0) AS etc, greatest(precipitation_mm, 0) AS inflow, et0_mm IS NULL AS et0_missing FROM sites
), f AS (
  SELECT site, 0::BIGINT AS k, 0.0::DOUBLE AS dr, NULL::DATE AS day, 0.0::DOUBLE AS etc, 0.0::DOUBLE AS inflow, false AS et0_missing, 1.0::DOUBLE AS ks, 0.0::DOUBLE AS raw_after FROM (SELECT DISTINCT site FROM sites)
  UNION ALL
  SELECT f.site, d.k, least(greatest(f.dr - d.inflow + (CASE WHEN f.dr <= 77.5 THEN 1.0 ELSE greatest(0, (155.0 - f.dr) / 77.5) END) * d.etc, 0), 155.0), d.day, d.etc, d.inflow, d.et0_missing,
         CASE WHEN f.dr <= 77.5 THEN 1.0 ELSE greatest(0, (155.0 - f.dr) / 77.5) END,
         f.dr - d.inflow + (CASE WHEN f.dr <= 77.5 THEN 1.0 ELSE greatest(0, (155.0 - f.dr) / 77.5) END) * d.etc
  FROM f JOIN d ON d.site = f.site AND d.k = f.k + 1
), w AS (
  SELECT *, greatest(0, -raw_after) AS drainage, sum(greatest(0, -raw_after)) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS drained FROM f WHERE k > 0
), r AS (
  SELECT site, day, etc, ks, inflow - etc AS delta, drainage, dr AS depletion, et0_missing, inflow,
         CASE WHEN ks < 1 THEN 'dry' WHEN dr > 0.75 * 77.5 THEN 'dry soon' WHEN drained >= 5 THEN 'wet' ELSE 'ok' END AS status FROM w
)
"""
)


@query("soil_bucket", _BUCKET + "SELECT site, day, round(etc, 4) AS etc, round(ks, 4) AS ks, round(delta, 4) AS delta, round(drainage, 4) AS drainage, round(depletion, 4) AS depletion, et0_missing, status FROM r")
def soil_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = water.water_balance(_site_days(spark, sf_dir), "site")
    return rows.withColumns(_r(["etc", "ks", "delta", "drainage", "depletion"], 4)).select("site", "day", "etc", "ks", "delta", "drainage", "depletion", "et0_missing", "status")


@query(
    "soil_period_summary",
    _BUCKET
    + """SELECT site, year(day) AS year, count(*) AS days, round(sum(inflow), 3) AS inflow, round(sum(etc), 3) AS etc, round(sum(drainage), 3) AS drainage,
       count(*) FILTER (status = 'dry') AS stress_days, count(*) FILTER (status = 'wet') AS wet_days, count(*) FILTER (et0_missing) AS et0_missing_days FROM r GROUP BY ALL""",
)
def soil_period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = water.water_balance(_site_days(spark, sf_dir), "site").withColumn("year", F.year("day"))
    return water.period_summary(rows, ["site", "year"]).drop("delta").withColumns(_r(["inflow", "etc", "drainage"], 3))


@query(
    "water_outlook",
    _BUCKET
    + """SELECT site, round(sum(inflow), 4) AS inflow, round(sum(etc), 4) AS etc, round(max_by(depletion, day), 4) AS last_depletion, min(day) FILTER (status IN ('dry', 'dry soon')) AS first_dry_day
FROM r WHERE day > DATE '2000-12-31' GROUP BY site""",
)
def water_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed days to the end of 2000 and the days after as a forecast."""
    days = _site_days(spark, sf_dir)
    joined = water.observed_and_forecast(days.where("day <= DATE'2000-12-31'"), days.where("day > DATE'2000-12-20'"), "site")
    balance = water.water_balance(joined, "site").where("day > DATE'2000-12-31'")
    return water.outlook(balance, "site").withColumns(_r(["inflow", "etc", "last_depletion"], 4))


@query(
    "threshold_bands",
    """
SELECT c_custkey, c_mktsegment,
  CASE WHEN t10 IS NULL THEN 'low' WHEN c_acctbal / 500.0 - 5 <= t90 THEN 'critical' WHEN c_acctbal / 500.0 - 5 <= t10 THEN 'high' WHEN c_acctbal / 500.0 - 5 <= t10 + 2 THEN 'moderate' ELSE 'low' END AS frost,
  CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_acctbal / 500.0 >= 15 THEN 'critical' WHEN c_acctbal / 500.0 >= 8 THEN 'high' WHEN c_acctbal / 500.0 >= 3 THEN 'moderate' ELSE 'low' END ELSE 'low' END AS crack
FROM customer LEFT JOIN (VALUES ('BUILDING', -2.2, -6.7), ('MACHINERY', -9.4, -17.8), ('HOUSEHOLD', -1.1, -4.4)) s(c_mktsegment, t10, t90) USING (c_mktsegment)""",
)
def threshold_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"BUILDING": "bloom", "MACHINERY": "bud swell", "HOUSEHOLD": "fruit set"}
    table = spark.createDataFrame([(k, *thresholds.FROST_STAGES[v]) for k, v in stages.items()], "c_mktsegment string, t10 double, t90 double")
    rows = read(spark, sf_dir, "customer").join(F.broadcast(table), "c_mktsegment", "left")
    temp, rain = F.col("c_acctbal") / 500.0 - 5, F.col("c_acctbal") / 500.0
    frost = F.when(F.col("t10").isNull(), "low").otherwise(thresholds.frost_risk(temp, F.col("t10"), F.col("t90")))
    return rows.select("c_custkey", "c_mktsegment", frost.alias("frost"), thresholds.rain_crack_risk(F.col("c_mktsegment") == "BUILDING", rain).alias("crack"))


@query(
    "chill_and_degrees",
    """
SELECT user_id, count(*) FILTER (value / 10.0 BETWEEN 0 AND 7.2) AS chill_hours, round(count(*) FILTER (value / 10.0 BETWEEN 0 AND 7.2) / 1400.0, 6) AS chill_fraction,
       round(sum(greatest(0, value / 10.0 - 4.4)), 4) AS degrees,
       CASE WHEN count(*) FILTER (value BETWEEN 18 AND 30) / count(*) >= 0.5 THEN 'high' WHEN count(*) FILTER (value BETWEEN 18 AND 30) / count(*) >= 0.25 THEN 'moderate' ELSE 'low' END AS fly
FROM events GROUP BY user_id""",
)
def chill_and_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    temp = F.col("value") / 10.0
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(
        thresholds.chill_hours(temp).alias("chill_hours"), thresholds.growing_degrees(temp, temp).alias("degrees"), thresholds.favourable_share(F.col("value")).alias("share")
    )
    fraction = thresholds.chill_fraction(F.col("chill_hours"), F.lit(thresholds.CHILL_REQUIREMENTS["Kordia"]))
    return rows.select("user_id", "chill_hours", F.round(fraction, 6).alias("chill_fraction"), F.round("degrees", 4).alias("degrees"), thresholds.fly_risk(F.col("share")).alias("fly"))


@query(
    "pollination_windows",
    """
WITH g AS (
  SELECT user_id, count(*) AS n_days, count(*) FILTER (value >= 13 AND event_id % 3 <= 0.5 AND coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END <= 25, true)) AS n_good FROM events GROUP BY user_id HAVING count(*) >= 5
)
SELECT user_id, n_days, n_good, round(1 - n_good / n_days, 6) AS poor_share,
       CASE WHEN 1 - n_good / n_days >= 0.6 THEN 'high' WHEN 1 - n_good / n_days >= 0.4 THEN 'moderate' ELSE 'none' END AS severity FROM g""",
)
def pollination_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") % 3).cast("double").alias("rain"), F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("wind"))
    return season.pollination_risk(rows, ["user_id"], "value", "rain", "wind").withColumns(_r(["poor_share"]))


@query(
    "dedupe_cross_page",
    """
SELECT doc_id, source FROM (
  SELECT doc_id, source, text, first(source) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS page FROM documents
) WHERE text IS NULL OR source IS NOT DISTINCT FROM page""",
)
def dedupe_cross_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on the source where their text occurs first; the texts themselves are not shuffled."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("key"))
    return calendar.dedupe_pages(docs, ["key"], "source", ["doc_id"], F.col("key").isNull()).drop("key")


@query(
    "anniversary_band_join",
    """
WITH u AS (
  SELECT o_custkey % 40 AS product, o_orderdate::DATE AS day, date_diff('day', CASE WHEN year(o_orderdate) % 4 = 0 THEN make_date(year(o_orderdate), 2, 29) ELSE make_date(year(o_orderdate), 2, 28) END, o_orderdate::DATE) AS off FROM orders
)
SELECT product, count(DISTINCT year(day)) FILTER (year(day) <> 2000) AS n_years, count(*) FILTER (year(day) <> 2000) AS n, median(off) FILTER (year(day) <> 2000) AS median_offset,
       count(*) FILTER (year(day) = 2000) AS this_year, max(year(day)) FILTER (year(day) <> 2000) AS last_year
FROM u WHERE abs(off) <= 14 GROUP BY product HAVING count(*) FILTER (year(day) <> 2000) > 0""",
)
def anniversary_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around 29 February, which most years lack."""
    uses = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("product"), F.to_date("o_orderdate").alias("day"))
    return calendar.product_calendar(uses, "product", "day", F.lit("2000-02-29").cast("date"), 14)


@query(
    "lookback_range_join",
    """
WITH e AS (SELECT user_id, ts::DATE AS event_day, event_id FROM events WHERE event_type = 'error'),
d AS (SELECT user_id, ts::DATE AS day, avg(value) AS value, sum(value) / 50.0 AS amount FROM events GROUP BY ALL)
SELECT event_id, count(*) AS n_days, round(avg(value), 9) AS avg_value, round(sum(amount), 9) AS total_amount, count(*) FILTER (amount >= 1) AS n_wet_days
FROM e JOIN d ON e.user_id = d.user_id AND d.day BETWEEN event_day - 10 AND event_day - 1 GROUP BY event_id""",
)
def lookback_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    errors = events.where("event_type = 'error'").select("user_id", F.col("day").alias("event_day"), "event_id")
    daily = events.groupBy("user_id", "day").agg(F.avg("value").alias("value"), (F.sum("value") / 50.0).alias("amount"))
    rows = season.window_before(errors, daily, "user_id", "event_day", "day", 10)
    return season.window_summary(rows, ["event_id"], "value", "amount").withColumns(_r(["avg_value", "total_amount"], 9))


@query("early_warnings")
def early_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose first order of a year came after windows such as the current one."""
    daily = _daily(spark, sf_dir).select(F.lit(1).alias("site"), "day", "temp_max_c", "precipitation_mm")
    entries = _order_entries(spark, sf_dir).where("doy > 60")
    onsets = entries.groupBy("category", "year").agg(F.min("day").alias("onset")).select("category", "onset", F.lit(1).alias("site"), F.dayofyear("onset").alias("doy"))
    rows = season.window_before(onsets, daily, "site", "onset", "day", 10)
    profile = season.onset_profile(season.window_summary(rows, ["category", "onset", "doy"], "temp_max_c", "precipitation_mm"), "category", "doy")
    now = season.window_summary(daily.where("day BETWEEN DATE'2000-03-01' AND DATE'2000-03-10'"), ["site"], "temp_max_c", "precipitation_mm")
    recent = entries.where("day BETWEEN DATE'2000-03-01' AND DATE'2000-03-10'").select("category")
    return season.early_warnings(now, profile, recent, "category", 70)


@query(
    "gap_intervals",
    """
WITH g AS (
  SELECT o_custkey AS product, o_orderdate::DATE AS day, date_diff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate::DATE), o_orderdate::DATE) AS gap FROM orders
), m AS (SELECT product, median(gap) AS median_gap, min(gap)::INT AS least_gap FROM g WHERE gap > 0 GROUP BY product)
SELECT o_custkey AS product, count(*) AS n, count(DISTINCT year(o_orderdate)) AS n_years, min(o_orderdate::DATE) AS first_day, max(o_orderdate::DATE) AS last_day, any_value(median_gap) AS median_gap, any_value(least_gap) AS least_gap
FROM orders LEFT JOIN m ON product = o_custkey GROUP BY o_custkey""",
)
def gap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), F.to_date("o_orderdate").alias("day"))
    return calendar.product_history(uses, "product", "day")


@query(
    "limit_breaches",
    """
WITH u AS (SELECT o_custkey AS product, o_orderdate::DATE AS day, year(o_orderdate) AS year FROM orders),
g AS (SELECT product, year, min(gap) AS gap FROM (SELECT product, year, date_diff('day', lag(day) OVER (PARTITION BY product, year ORDER BY day), day) AS gap FROM u) WHERE gap > 0 GROUP BY ALL),
y AS (SELECT product, year, count(*) AS n, count(DISTINCT month(day)) FILTER (month(day) NOT BETWEEN 2 AND 11) AS outside FROM u GROUP BY ALL)
SELECT product, year, 'season' AS flag, n::INT AS found, 3 AS allowed FROM y WHERE n > 3
UNION ALL SELECT product, year, 'interval', gap::INT, 14 FROM y JOIN g USING (product, year) WHERE gap < 14
UNION ALL SELECT product, year, 'month', outside::INT, 0 FROM y WHERE outside > 0""",
)
def limit_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("product"), F.to_date("o_orderdate").alias("day"))
    months = F.sequence(F.lit(2), F.lit(9))
    limits = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product"))
    limits = limits.select("product", F.lit(2).alias("season_cap"), F.lit(21).alias("least_gap"), months.alias("months")).union(limits.select("product", F.lit(3), F.lit(14), F.sequence(F.lit(8), F.lit(11))))
    return calendar.limit_breaches(uses, "product", "day", limits)


@query(
    "latency_percentiles",
    """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, median(value) AS p50, max(value) FILTER (k = greatest(1, least(n, round_even(n * 0.95, 0)::BIGINT))) AS p95, max(value) AS max FROM s GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluation import latency_stats

    return latency_stats(read(spark, sf_dir, "events"), ["event_type"], "value").withColumns(_r(["mean"]))


@query(
    "severity_signals",
    """
SELECT event_type, CASE WHEN abs((value - 50) / 20) >= 2.5 THEN 'high' WHEN abs((value - 50) / 20) >= 1.5 THEN 'moderate' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY ALL""",
)
def severity_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = stats.severity((F.col("value") - 50) / 20)
    return read(spark, sf_dir, "events").groupBy("event_type", level.alias("severity")).agg(F.count(F.lit(1)).alias("n"))
