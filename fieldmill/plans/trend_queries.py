"""Trends over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import period_key
from ..operators import trends
from .registry import query, read


def _r(columns: list[str], digits: int = 6) -> dict:
    return {c: F.round(c, digits) for c in columns}


def _order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as log entries: the category is the customer's nation."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("category"))
    return orders.join(customers, "o_custkey").join(nations, "n_nationkey").select("o_orderkey", "category", "day", F.year("day").alias("year"), F.dayofyear("day").alias("doy"))


_ENTRIES = """
WITH entries AS (
  SELECT o_orderkey, n_name AS category, o_orderdate::DATE AS day, year(o_orderdate) AS year, dayofyear(o_orderdate) AS doy
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

_TIMING = """, first AS (
  SELECT category, year, min(doy) AS first_day FROM entries GROUP BY ALL
), timing AS (
  SELECT category, 'timing' AS kind, regr_slope(first_day, year) AS slope, regr_intercept(first_day, year) AS intercept, count(*) AS n_periods
  FROM first GROUP BY category HAVING count(*) >= 4
)"""


@query(
    "seasonal_first_occurrence",
    _ENTRIES
    + _TIMING
    + """
SELECT category, kind, round(slope, 6) AS slope, round(intercept, 4) AS intercept, n_periods,
       round(least(1.0, abs(slope) / 5.0) * least(1.0, n_periods / 8.0), 6) AS importance
FROM timing""",
)
def seasonal_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = trends.first_occurrence(_order_entries(spark, sf_dir), "category", "year", "doy", "o_orderkey")
    return trends.timing_patterns(first, "category", "year").withColumns(_r(["slope", "importance"]) | _r(["intercept"], 4))


@query(
    "first_occurrence_entries",
    _ENTRIES
    + """
SELECT category, year, first_day, first_key FROM (
  SELECT category, year, doy AS first_day, o_orderkey AS first_key, row_number() OVER (PARTITION BY category, year ORDER BY doy, o_orderkey) AS k FROM entries
) WHERE k = 1""",
)
def first_occurrence_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.first_occurrence(_order_entries(spark, sf_dir), "category", "year", "doy", "o_orderkey")


_FREQUENCY = """
WITH e AS (SELECT event_type AS category, date_trunc('week', ts)::DATE AS week FROM events),
counts AS (SELECT category, week, count(*) AS n FROM e GROUP BY ALL),
filled AS (
  SELECT category, week, coalesce(n, 0)::DOUBLE AS n, date_diff('day', (SELECT min(week) FROM counts), week) / 7.0 AS x
  FROM (SELECT DISTINCT category FROM counts) CROSS JOIN (SELECT DISTINCT week FROM counts) LEFT JOIN counts USING (category, week)
), t AS (
  SELECT category, regr_slope(n, x) AS slope, regr_intercept(n, x) AS intercept, count(*) AS n_periods, sum(n) AS total, avg(n) AS mean
  FROM filled GROUP BY category HAVING sum(n) >= 4 AND count(*) >= 4
)
"""


@query(
    "frequency_trend_zero_filled",
    _FREQUENCY
    + """SELECT category, 'frequency' AS kind, round(slope, 6) AS slope, round(intercept, 6) AS intercept, n_periods,
       round(least(1.0, abs(slope) * n_periods / mean) * least(1.0, total / 15.0), 6) AS importance FROM t""",
)
def frequency_trend_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a week by type. The last week may be partial; it is kept."""
    weeks = read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.to_date(F.date_trunc("week", "ts")).alias("week"))
    filled = trends.zero_filled_counts(weeks, "category", "week")
    start = filled.agg(F.min("week").alias("start"))
    filled = filled.crossJoin(F.broadcast(start)).withColumn("x", F.date_diff("week", "start") / 7.0)
    return trends.frequency_patterns(filled, "category", "x").withColumns(_r(["slope", "intercept", "importance"]))


_DOSE = """
WITH e AS (SELECT user_id AS product, event_type AS unit, value, event_id, date_trunc('week', ts)::DATE AS week FROM events),
modal AS (
  SELECT product, unit FROM (
    SELECT product, unit, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, min(event_id), unit) AS k FROM e GROUP BY product, unit
  ) WHERE k = 1
), means AS (
  SELECT product, date_diff('day', (SELECT min(week) FROM e), week) / 7.0 AS x, avg(value) AS dose FROM e JOIN modal USING (product, unit) GROUP BY ALL
), t AS (
  SELECT product, regr_slope(dose, x) AS slope, regr_intercept(dose, x) AS intercept, count(*) AS n_periods, avg(dose) AS mean FROM means GROUP BY product HAVING count(*) >= 4 AND avg(dose) > 0
)
"""


@query(
    "dose_trend_modal_group",
    _DOSE
    + """SELECT product, 'dose' AS kind, round(slope, 8) AS slope, round(intercept, 8) AS intercept, n_periods,
       round(0.5 * least(1.0, abs(slope) * n_periods / mean) * least(1.0, n_periods / 6.0), 8) AS importance
FROM t WHERE abs(slope) * n_periods / mean >= 0.15""",
)
def dose_trend_modal_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_type").alias("unit"), "value", "event_id", F.to_date(F.date_trunc("week", "ts")).alias("week"))
    start = events.agg(F.min("week").alias("start"))
    events = events.crossJoin(F.broadcast(start)).withColumn("x", F.date_diff("week", "start") / 7.0)
    means = trends.dose_means(events, "product", "x", "value", "unit", "event_id")
    return trends.dose_patterns(means, "product", "x").withColumns(_r(["slope", "intercept", "importance"], 8))


@query(
    "monthly_heatmap",
    _ENTRIES + " SELECT category, count(*) AS total, " + ", ".join(f"count(*) FILTER (month(day) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM entries GROUP BY category",
)
def monthly_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.month_calendar(_order_entries(spark, sf_dir), "category", "day")


@query(
    "ranked_patterns",
    _ENTRIES
    + _TIMING
    + """, counts AS (SELECT category, year, count(*) AS n FROM entries GROUP BY ALL),
filled AS (
  SELECT category, year, coalesce(n, 0)::DOUBLE AS n
  FROM (SELECT DISTINCT category FROM counts) CROSS JOIN (SELECT DISTINCT year FROM counts) LEFT JOIN counts USING (category, year)
), frequency AS (
  SELECT category, 'frequency' AS kind, regr_slope(n, year) AS slope, count(*) AS n_periods, sum(n) AS total, avg(n) AS mean
  FROM filled GROUP BY category HAVING sum(n) >= 4 AND count(*) >= 4
), every AS (
  SELECT category, kind, slope, n_periods, least(1.0, abs(slope) / 5.0) * least(1.0, n_periods / 8.0) AS importance FROM timing
  UNION ALL
  SELECT category, kind, slope, n_periods, least(1.0, abs(slope) * n_periods / mean) * least(1.0, total / 15.0) FROM frequency
)
SELECT category, kind, round(slope, 6) AS slope, n_periods, round(importance, 6) AS importance
FROM every ORDER BY round(importance, 9) DESC, kind, category LIMIT 6""",
)
def ranked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most important patterns of two detectors."""
    entries = _order_entries(spark, sf_dir)
    timing = trends.timing_patterns(trends.first_occurrence(entries, "category", "year", "doy", "o_orderkey"), "category", "year")
    filled = trends.zero_filled_counts(entries, "category", "year").withColumn("x", F.col("year").cast("double"))
    best = trends.top_patterns([timing, trends.frequency_patterns(filled, "category", "x")], 6)
    return best.select("category", "kind", "slope", "n_periods", "importance").withColumns(_r(["slope", "importance"]))


_PERIOD = {
    "week": "format('{}-W{:02d}', isoyear(l_shipdate), week(l_shipdate))",
    "month": "strftime(l_shipdate, '%Y-%m')",
    "quarter": "format('{}-Q{}', year(l_shipdate), quarter(l_shipdate))",
    "year": "year(l_shipdate)::VARCHAR",
}


def _usage(granularity: str):
    """Uses by period, product and class; quantities of one unit never add to those of another."""

    @query(
        f"period_usage_{granularity}",
        f"""SELECT {_PERIOD[granularity]} AS period, p_brand AS product, l_returnflag AS class, count(*) AS n,
       round(sum(CASE WHEN p_size % 2 = 0 THEN l_quantity ELSE 0 END), 2) AS sum_ml, round(sum(CASE WHEN p_size % 2 = 1 THEN l_quantity ELSE 0 END), 2) AS sum_g
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.usage import usage_by_period

        lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("day"))
        parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"), F.when(F.col("p_size") % 2 == 0, "ml").otherwise("g").alias("unit"))
        uses = lines.join(parts, "l_partkey").select(period_key(F.col("day"), granularity).alias("period"), "product", F.col("l_returnflag").alias("class"), "unit", F.col("l_quantity").alias("value"))
        return usage_by_period(uses).withColumns(_r(["sum_ml", "sum_g"], 2))

    return run


for _g in _PERIOD:
    _usage(_g)


@query(
    "usage_rollup",
    """SELECT year(l_shipdate) AS period, l_returnflag AS class, grouping(period, class) AS level, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM lineitem GROUP BY ROLLUP (period, class)""",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("class"), "l_quantity")
    return lines.rollup("period", "class").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))
