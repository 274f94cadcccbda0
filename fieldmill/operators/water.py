"""Soil water: the bucket, the clamped deficit and running sums, by site.

The bucket clamps at both ends and its uptake depends on its state, so it has no
closed form. It runs over each site's days in order, one loop a site after one
shuffle on the site; a site's days are as many as its calendar has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import crop_coefficient

#: Fixed: available water by soil, m3/m3.
SOILS = {"sand": 0.08, "loamy sand": 0.09, "sandy loam": 0.13, "loam": 0.155, "silt loam": 0.16, "clay": 0.16}
DEPLETION_FRACTION = 0.50
DRY_WARNING = 0.75
WET_DRAINAGE_MM = 5.0

def total_available_water(soil: str, root_depth_m: float) -> float:
    return 1000.0 * SOILS[soil] * root_depth_m


def water_balance(days: DataFrame, site: str, soil: str = "loam", root_depth_m: float = 1.0, cover: str = "grass", start_mm: float = 0.0, fraction: float = DEPLETION_FRACTION) -> DataFrame:
    """A row for each day of each site: demand, uptake, delta, drainage, depletion, moisture and status.

    ``days`` has site, day, precipitation_mm, et0_mm (null: missing, counted as 0) and irrigation_mm.
    """
    taw = total_available_water(soil, root_depth_m)
    raw = fraction * taw
    kc = crop_coefficient(F.col("day"), cover)
    et0 = F.greatest(F.coalesce("et0_mm", F.lit(0.0)), F.lit(0.0))
    inflow = F.greatest("precipitation_mm", F.lit(0.0)) + F.greatest(F.coalesce("irrigation_mm", F.lit(0.0)), F.lit(0.0))
    rows = days.select(site, "day", kc.alias("kc"), (kc * et0).alias("etc"), F.col("et0_mm").isNull().alias("et0_missing"), inflow.alias("inflow"))
    first = min(max(start_mm, 0.0), taw)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["day", "kc", "etc", "et0_missing", "inflow"], ignore_index=True)
        depletion, out = first, []
        for etc, water in zip(group["etc"].tolist(), group["inflow"].tolist(), strict=True):
            ks = 1.0 if depletion <= raw else max(0.0, (taw - depletion) / ((1.0 - fraction) * taw))
            after = depletion - water + ks * etc
            depletion = min(max(after, 0.0), taw)
            out.append((ks * etc - max(0.0, after - taw), ks, water - etc, max(0.0, -after), depletion))
        return pd.concat([group, pd.DataFrame(out, columns=["etc_actual", "ks", "delta", "drainage", "depletion"], dtype=float)], axis=1)

    kind = dict(rows.dtypes)[site]
    rows = rows.groupBy(site).applyInPandas(run, f"`{site}` {kind}, day date, kc double, etc double, et0_missing boolean, inflow double, etc_actual double, ks double, delta double, drainage double, depletion double")
    drained = F.sum("drainage").over(Window.partitionBy(site).orderBy("day").rowsBetween(-2, 0))
    status = F.when(F.col("ks") < 1.0, "dry").when(F.col("depletion") > DRY_WARNING * raw, "dry soon").when(drained >= WET_DRAINAGE_MM, "wet").otherwise("ok")
    return rows.withColumn("moisture_pct", 100.0 * (1.0 - F.col("depletion") / taw)).withColumn("status", status)


def clamped_deficit(days: DataFrame, site: str) -> DataFrame:
    """The sum of (et0 - precipitation) since 1 April, never below 0; null outside April to September.

    With S the running sum, the clamped sum is S - min(0, the smallest S so far).
    """
    inside = F.month("day").between(4, 9)
    change = F.when(inside, F.coalesce("et0_mm", F.lit(0.0)) - F.col("precipitation_mm")).otherwise(F.lit(0.0))
    order = Window.partitionBy(site, F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("__s", F.sum(change).over(order))
    deficit = F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(order))
    return rows.withColumn("deficit", F.when(inside, deficit)).drop("__s")


def running_sums(days: DataFrame, site: str, value: str) -> DataFrame:
    """The running sum of a value and its sum over the last three rows, by site."""
    order = Window.partitionBy(site).orderBy("day")
    return days.withColumn("running", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last3", F.sum(value).over(order.rowsBetween(-2, 0)))


def observed_and_forecast(observed: DataFrame, forecast: DataFrame, site: str) -> DataFrame:
    """Observed days, then the forecast days after the last of them, labelled; irrigation is joined by the caller."""
    last = observed.groupBy(site).agg(F.max("day").alias("__last"))
    later = forecast.join(last, site, "left").where(F.col("__last").isNull() | (F.col("day") > F.col("__last"))).drop("__last")
    return observed.withColumn("origin", F.lit("observed")).unionByName(later.withColumn("origin", F.lit("forecast")))


def period_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.sum("inflow").alias("inflow"), F.sum("etc").alias("etc"), F.sum("delta").alias("delta"), F.sum("drainage").alias("drainage"),
        F.count_if(F.col("status") == "dry").alias("stress_days"), F.count_if(F.col("status") == "wet").alias("wet_days"), F.count_if("et0_missing").alias("et0_missing_days"),
    )


def outlook(forecast: DataFrame, site: str) -> DataFrame:
    """Totals of a forecast, its last depletion and the first day that is dry or nearly so."""
    return forecast.groupBy(site).agg(F.sum("inflow").alias("inflow"), F.sum("etc").alias("etc"), F.max_by("depletion", "day").alias("last_depletion"), F.min(F.when(F.col("status").isin("dry", "dry soon"), F.col("day"))).alias("first_dry_day"))
