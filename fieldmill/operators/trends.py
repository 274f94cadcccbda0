"""Multi-year trends: first occurrence, frequency and dose, each with its importance.

All tables are aggregated per (category, period) before anything is joined, and the
regressions are aggregates, so that every step is one partial aggregation and
one shuffle on the category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import capped

MIN_PERIODS = 4


def first_occurrence(entries: DataFrame, category: str, year: str, day: str, key: str) -> DataFrame:
    """The first day of each year for each category, with the entry it comes from: of several on that day the one with the smallest key."""
    first = F.min(F.struct(F.col(day).alias("day"), F.col(key).alias("key")))
    return entries.groupBy(category, year).agg(first.alias("first")).select(category, year, F.col("first.day").alias("first_day"), F.col("first.key").alias("first_key"))


def trend(by_period: DataFrame, category: str, x: str, y: str) -> DataFrame:
    """Slope, intercept and extent of the least-squares line of y over x, by category."""
    return by_period.groupBy(category).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n_periods"), F.sum(y).alias("total"), F.avg(y).alias("mean"), F.min(x).alias("first_period"), F.max(x).alias("last_period")
    )


def timing_patterns(first: DataFrame, category: str, year: str, weight: Column | None = None) -> DataFrame:
    """Categories whose first day drifts: five days a year is the largest effect, eight years the full confidence."""
    found = trend(first.withColumn("first_day", F.col("first_day").cast("double")).withColumn("x", F.col(year).cast("double")), category, "x", "first_day")
    found = found.where(F.col("n_periods") >= MIN_PERIODS)
    effect, confidence = capped(F.abs("slope") / 5.0), capped(F.col("n_periods") / 8.0)
    return found.select(category, F.lit("timing").alias("kind"), "slope", "intercept", "n_periods", ((F.lit(1.0) if weight is None else weight) * effect * confidence).alias("importance"))


def zero_filled_counts(entries: DataFrame, category: str, period: str) -> DataFrame:
    """n for each category in each period that the table has at all. The grid is of distinct values, which are few."""
    counts = entries.groupBy(category, period).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(category).distinct().crossJoin(counts.select(period).distinct())
    return grid.join(counts, [category, period], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frequency_patterns(filled: DataFrame, category: str, x: str, weight: Column | None = None) -> DataFrame:
    """Categories that come more or less often. A change by the mean over the whole extent is the largest effect, fifteen entries the full confidence."""
    found = trend(filled.withColumn("y", F.col("n").cast("double")), category, x, "y").where((F.col("total") >= MIN_PERIODS) & (F.col("n_periods") >= MIN_PERIODS))
    effect = capped(F.abs("slope") * F.col("n_periods") / F.col("mean"))
    confidence = capped(F.col("total") / 15.0)
    return found.select(category, F.lit("frequency").alias("kind"), "slope", "intercept", "n_periods", ((F.lit(1.0) if weight is None else weight) * effect * confidence).alias("importance"))


def modal_unit(entries: DataFrame, product: str, unit: str, order: str) -> DataFrame:
    """The unit that each product is given in most often; of several, the one that comes first."""
    counts = entries.groupBy(product, unit).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(unit).alias("unit")))
    return counts.groupBy(product).agg(best.alias("best")).select(product, F.col("best.unit").alias(unit))


def dose_means(entries: DataFrame, product: str, period: str, value: str, unit: str, order: str) -> DataFrame:
    """Mean dose for each product and period, in the product's modal unit only."""
    same = entries.join(modal_unit(entries, product, unit, order), [product, unit])
    return same.groupBy(product, period).agg(F.avg(value).alias("dose"))


def dose_patterns(means: DataFrame, product: str, x: str) -> DataFrame:
    """Products whose dose changes by 15 % or more over the extent."""
    found = trend(means, product, x, "dose").where((F.col("n_periods") >= MIN_PERIODS) & (F.col("mean") > 0))
    change = F.abs("slope") * F.col("n_periods") / F.col("mean")
    found = found.where(change >= 0.15)
    return found.select(product, F.lit("dose").alias("kind"), "slope", "intercept", "n_periods", (0.5 * capped(change) * capped(F.col("n_periods") / 6.0)).alias("importance"))


def month_calendar(entries: DataFrame, category: str, day: str) -> DataFrame:
    """Entries by category and calendar month over all years, the largest categories first."""
    months = {f"m{m:02d}": F.count_if(F.month(day) == m) for m in range(1, 13)}
    table = entries.groupBy(category).agg(F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in months.items()])
    return table.orderBy(F.desc("total"), category)


def top_patterns(patterns: list[DataFrame], n: int, category: str = "category") -> DataFrame:
    """The n most important of several detectors' patterns; ties by kind and category."""
    every = patterns[0]
    for p in patterns[1:]:
        every = every.unionByName(p)
    return every.orderBy(F.desc(F.round("importance", 9)), "kind", category).limit(n)


def running_rank(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
