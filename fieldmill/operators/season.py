"""Season-to-date comparisons, spikes, and the weather before an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import severity, severity_rank, zscore

MIN_BASELINE = 3
MIN_ONSETS = 3


def cumulative_counts(entries: DataFrame, category: str, year: str, doy: str, cutoff: int) -> DataFrame:
    """n up to a day of the year, by category and year; years without any are absent."""
    return entries.where(F.col(doy) <= cutoff).groupBy(category, year).agg(F.count(F.lit(1)).alias("n"))


def baseline_scores(values: DataFrame, category: str, year: str, value: str, target: int) -> DataFrame:
    """The target year's value of each category against its other years: mean, population deviation, z and severity. A category without the target year has value 0."""
    other = F.col(year) != target
    stats = values.groupBy(category).agg(
        F.coalesce(F.max(F.when(~other, F.col(value))), F.lit(0.0)).cast("double").alias("current"),
        F.avg(F.when(other, F.col(value))).alias("mean"),
        F.stddev_pop(F.when(other, F.col(value))).alias("deviation"),
        F.count(F.when(other, F.col(value))).alias("n_baseline"),
    )
    z = zscore(F.col("current"), F.col("mean"), F.col("deviation"), F.col("n_baseline"))
    return stats.where(F.col("n_baseline") >= MIN_BASELINE).withColumn("z", z).withColumn("severity", severity(F.col("z")))


def season_spikes(entries: DataFrame, category: str, year: str, doy: str, target: int, cutoff: int) -> DataFrame:
    """Categories with more entries in the season so far than in other years; the most severe first."""
    scores = baseline_scores(cumulative_counts(entries, category, year, doy, cutoff), category, year, "n", target)
    return scores.where((F.col("severity") != "info") & (F.col("z") > 0)).orderBy(severity_rank(F.col("severity")).desc(), category)


def season_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """n_days, avg_tmax, total_precip, total_et0 (null if no day has one) and water_balance over days with a maximum temperature."""
    usable = daily.where("temp_max_c IS NOT NULL").groupBy(*keys)
    summary = usable.agg(F.count(F.lit(1)).alias("n_days"), F.avg("temp_max_c").alias("avg_tmax"), F.sum("precipitation_mm").alias("total_precip"), F.sum("et0_mm").alias("total_et0"))
    return summary.withColumn("water_balance", F.col("total_precip") - F.col("total_et0"))


def same_window(daily: DataFrame, day: str, target: int, month: int, dom: int, as_of: Column, lookback: int) -> DataFrame:
    """``daily`` with the year of the season window each day falls in: from the season's start over as many days as the target's window has, in the target and the ``lookback`` years before."""
    start = F.make_date(F.year(day), F.lit(month), F.lit(dom))
    n_days = F.date_diff(as_of, F.make_date(F.lit(target), F.lit(month), F.lit(dom)))
    since = F.date_diff(F.col(day), start)
    return daily.where((since >= 0) & (since <= n_days) & F.year(day).between(target - lookback, target)).withColumn("season", F.year(day))


def weather_anomalies(summaries: DataFrame, target: int) -> DataFrame:
    """signal (temperature, water_balance), current, mean, z and severity, where either differs from three other seasons or more."""
    both = summaries.select("season", F.explode(F.create_map(F.lit("temperature"), F.col("avg_tmax"), F.lit("water_balance"), F.col("water_balance"))).alias("signal", "value"))
    scores = baseline_scores(both.where("value IS NOT NULL"), "signal", "season", "value", target)
    return scores.where("severity <> 'info'").select("signal", "current", "mean", "z", "severity", "n_baseline")


def window_before(events: DataFrame, daily: DataFrame, key: str, event_day: str, day: str, n_days: int) -> DataFrame:
    """Each event with the days of ``daily`` in the n days before it, by key.

    A range join made an equi-join: an event is joined on each of its n days, so the
    plan is a hash join on (key, day) and never compares all days of a key.
    """
    wanted = events.withColumn("__day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n_days)), lambda i: F.date_sub(F.col(event_day), i))))
    return wanted.join(daily.withColumnRenamed(day, "__day"), [key, "__day"]).withColumnRenamed("__day", day)


def window_summary(rows: DataFrame, keys: list[str], value: str, amount: str) -> DataFrame:
    """n_days, the mean value, the total amount and the days with an amount of 1 or more."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(value).alias("avg_value"), F.sum(amount).alias("total_amount"), F.count_if(F.col(amount) >= 1.0).alias("n_wet_days")
    )


def onset_profile(summaries: DataFrame, category: str, doy: str) -> DataFrame:
    """Mean, smallest and largest of each measure before a category's onsets, where it has three or more."""
    measures = ["avg_value", "total_amount", "n_wet_days", doy]
    stats = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return summaries.groupBy(category).agg(F.count(F.lit(1)).alias("n_events"), *stats).where(F.col("n_events") >= MIN_ONSETS)


def early_warnings(current: DataFrame, profile: DataFrame, recent: DataFrame, category: str, doy: int, margin: int = 21) -> DataFrame:
    """Categories whose current window reaches the smallest values before past onsets, in their season give or take ``margin`` days, without a treatment of late (``recent``), for each row of ``current``, a window a site, with its columns but the measures.

    The profile has a row a category, so each window meets a bounded table, in a join on the measure it has to reach.
    """
    near = profile.where((F.lit(doy) >= F.col("doy_min") - margin) & (F.lit(doy) <= F.col("doy_max") + margin)).join(recent.select(category).distinct(), category, "left_anti")
    met = current.join(near, F.expr("avg_value >= avg_value_min AND total_amount >= total_amount_min AND n_wet_days >= n_wet_days_min"))
    strong = F.expr("avg_value >= avg_value_mean AND total_amount >= total_amount_mean AND n_wet_days >= n_wet_days_mean")
    own = [c for c in current.columns if c not in ("n_days", "avg_value", "total_amount", "n_wet_days", category)]
    return met.select(*own, category, F.when(strong, "high").otherwise("moderate").alias("severity"), "n_events")


#: Fixed: bees fly from this temperature on, up to this much rain and wind.
BEE_MIN_TEMP_C, BEE_MAX_RAIN_MM, BEE_MAX_WIND_KMH = 13.0, 0.5, 25.0


def bee_flight_day(tmax: Column, rain: Column, wind: Column) -> Column:
    """Never null: no temperature is no flight, no wind reading is no hindrance."""
    return F.coalesce((tmax >= BEE_MIN_TEMP_C) & (rain <= BEE_MAX_RAIN_MM), F.lit(False)) & F.coalesce(wind <= BEE_MAX_WIND_KMH, F.lit(True))


def pollination_risk(daily: DataFrame, keys: list[str], tmax: str, rain: str, wind: str) -> DataFrame:
    """The share of poor days and its severity, over windows of five days or more."""
    good = F.count_if(bee_flight_day(F.col(tmax), F.col(rain), F.col(wind)))
    found = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), good.alias("n_good")).where("n_days >= 5")
    poor = 1 - F.col("n_good") / F.col("n_days")
    return found.withColumn("poor_share", poor).withColumn("severity", F.when(poor >= 0.6, "high").when(poor >= 0.4, "moderate").otherwise("none"))
