"""Phenology thresholds: chill, growing degrees, frost, pests and cracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import chill_window

#: Fixed: hours in this range count as chill.
CHILL_RANGE_C = (0.0, 7.2)
GDD_BASE_C = 4.4
#: Fixed: chill hours that a variety needs, where known.
CHILL_REQUIREMENTS = {"Kordia": 1400.0}
#: Fixed: temperatures that kill a tenth and nine tenths of the buds, by stage; other stages have no table and low risk.
FROST_STAGES = {"bud swell": (-9.4, -17.8), "bloom": (-2.2, -6.7), "fruit set": (-1.1, -4.4)}
#: Fixed: the fruit fly reproduces in this range.
FLY_RANGE_C = (18.0, 30.0)
RISKS = ("low", "moderate", "high", "critical")


def chill_hours(temp: Column) -> Column:
    """An aggregate: hours within the chill range."""
    return F.count_if(temp.between(*CHILL_RANGE_C))


def chill_fraction(hours: Column, required: Column) -> Column:
    """Of the requirement; null where none is known."""
    return F.when(required > 0, hours / F.nullif(required, F.lit(0.0)))


def growing_degrees(tmin: Column, tmax: Column, base: float = GDD_BASE_C) -> Column:
    """An aggregate: the sum of daily means above the base."""
    return F.sum(F.greatest(F.lit(0.0), (tmin + tmax) / 2.0 - base))


def frost_risk(temp: Column, t10: Column, t90: Column) -> Column:
    """Critical at t90 or below, high at t10, moderate within two degrees of it."""
    return F.when(temp <= t90, "critical").when(temp <= t10, "high").when(temp <= t10 + 2.0, "moderate").otherwise("low")


def favourable_share(temp: Column, low: float = FLY_RANGE_C[0], high: float = FLY_RANGE_C[1]) -> Column:
    """An aggregate: the share of hours in a pest's range."""
    return F.count_if(temp.between(low, high)) / F.greatest(F.count(F.lit(1)), F.lit(1))


def fly_risk(share: Column) -> Column:
    return F.when(share >= 0.5, "high").when(share >= 0.25, "moderate").otherwise("low")


def rain_crack_risk(stage_is_ripe: Column, rain_mm: Column) -> Column:
    level = F.when(rain_mm >= 15.0, "critical").when(rain_mm >= 8.0, "high").when(rain_mm >= 3.0, "moderate").otherwise("low")
    return F.when(stage_is_ripe, level).otherwise("low")


def risk_rank(column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), column).cast("int") - 1


def alerts(risks: DataFrame, risk: str = "risk") -> DataFrame:
    """Rows of high risk or above, with ``rank`` (2 or 3) to show the worst first."""
    return risks.withColumn("rank", risk_rank(F.col(risk))).where("rank >= 2")


#: Fixed: the stage that a month stands for, as a starting value.
STAGE_OF_MONTH = {1: "rest", 2: "bud swell", 3: "bloom", 4: "fruit set", 5: "growth", 6: "growth", 7: "ripening", 8: "harvest", 9: "aftercare", 10: "aftercare", 11: "rest", 12: "rest"}
RIPE_STAGES = ("ripening", "harvest")


def default_stage(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(STAGE_OF_MONTH[m]) for m in range(1, 13)]), month)


def season_snapshot(sites: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """One row a site: chill hours and their share of the need, growing degrees, the worst frost risk with its first day, fly and cracking risk.

    ``sites`` has site, as_of, variety and stage (null: that of the month); ``hourly`` site, time and temp, ``daily`` site, day, temp_min_c,
    temp_max_c and precipitation_mm. Chill counts from the last 1 November on; the outlook is the seven days from as_of on, cracking that of its first two. Risks
    without weather are low.
    """
    window = chill_window(F.col("as_of"))
    rows = sites.withColumn("stage", F.coalesce("stage", default_stage(F.month("as_of")))).withColumn("__w", window)
    key = rows.select("site", "as_of", "stage", "__w")
    t = F.to_date("time")
    chill = hourly.join(key, "site").where((t >= F.col("__w.start")) & (t <= F.col("__w.end"))).groupBy("site").agg(chill_hours(F.col("temp")).alias("chill_hours"))
    ahead = (F.col("day") >= F.col("as_of")) & (F.col("day") < F.date_add("as_of", 7))
    t10 = F.lit(None).cast("double")
    t90 = F.lit(None).cast("double")
    for stage, (a, b) in FROST_STAGES.items():
        t10, t90 = F.when(F.col("stage") == stage, a).otherwise(t10), F.when(F.col("stage") == stage, b).otherwise(t90)
    outlook = daily.join(key, "site").where(ahead).withColumn("__frost", risk_rank(F.coalesce(F.when(t10.isNotNull(), frost_risk(F.col("temp_min_c"), t10, t90)), F.lit("low"))))
    outlook = outlook.groupBy("site").agg(
        growing_degrees(F.col("temp_min_c"), F.col("temp_max_c")).alias("growing_degrees"), F.max("__frost").alias("__frost"), F.min_by("day", F.struct((-F.col("__frost")).alias("r"), "day")).alias("__worst"),
        F.sum(F.when(F.col("day") < F.date_add("as_of", 2), F.col("precipitation_mm")).otherwise(0.0)).alias("rain_mm"),
    )
    hours = hourly.join(key, "site").where((t >= F.col("as_of")) & (t < F.date_add("as_of", 7))).groupBy("site").agg(favourable_share(F.col("temp")).alias("fly_share"))
    need = F.lit(None).cast("double")
    for variety, n in CHILL_REQUIREMENTS.items():
        need = F.when(F.col("variety") == variety, n).otherwise(need)
    found = rows.join(chill, "site", "left").join(outlook, "site", "left").join(hours, "site", "left")
    name = lambda r: F.element_at(F.array(*[F.lit(x) for x in RISKS]), r + 1)
    hours_so_far = F.coalesce("chill_hours", F.lit(0).cast("bigint"))
    frost = F.coalesce("__frost", F.lit(0))
    return found.select(
        "site", "as_of", "stage", hours_so_far.alias("chill_hours"), chill_fraction(hours_so_far, need).alias("chill_share"), F.coalesce("growing_degrees", F.lit(0.0)).alias("growing_degrees"),
        name(frost).alias("frost"), F.when(frost > 0, F.col("__worst")).alias("frost_day"), fly_risk(F.coalesce("fly_share", F.lit(0.0))).alias("fly"), rain_crack_risk(F.col("stage").isin(*RIPE_STAGES), F.coalesce("rain_mm", F.lit(0.0))).alias("cracking"),
    )
