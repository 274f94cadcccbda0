"""Streaming forms of the series operators: the same aggregates over event time with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.water import DEPLETION_FRACTION, DRY_WARNING, total_available_water


def windowed_counts(events: DataFrame, ts: str, category: str, value: str, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """n and the sum of a value by category and window; a window is final once the watermark has passed it."""
    bucket = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(bucket.alias("w"), category).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), category, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def soil_state(days: DataFrame, soil: str = "loam", root_depth_m: float = 1.0) -> DataFrame:
    """The soil bucket as a stateful operator: site, day, depletion and status for each day (site, day, inflow, etc) as it comes. Days of a site must come in order."""
    taw = total_available_water(soil, root_depth_m)
    raw = DEPLETION_FRACTION * taw

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        depletion = state.get[0] if state.exists else 0.0
        for batch in batches:
            out = []
            for day, inflow, etc in batch.sort_values("day")[["day", "inflow", "etc"]].itertuples(index=False):
                ks = 1.0 if depletion <= raw else max(0.0, (taw - depletion) / ((1 - DEPLETION_FRACTION) * taw))
                depletion = min(max(depletion - inflow + ks * etc, 0.0), taw)
                out.append((key[0], day, depletion, "dry" if ks < 1 else "dry soon" if depletion > DRY_WARNING * raw else "ok"))
            yield pd.DataFrame(out, columns=["site", "day", "depletion", "status"])
        state.update((depletion,))

    return days.groupBy("site").applyInPandasWithState(step, "site int, day date, depletion double, status string", "depletion double", "append", "NoTimeout")
