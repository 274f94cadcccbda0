"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zscore(value: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """Against a baseline's mean and population deviation. Under two baseline values it is 0; a baseline without spread gets a floor of a tenth of its mean, 0.5 at least."""
    floor = F.greatest(F.abs(mean) * 0.1, F.lit(0.5))
    flat = F.when(value == mean, F.lit(0.0)).otherwise((value - mean) / floor)
    return F.when(n < 2, F.lit(0.0)).when(deviation == 0, flat).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))


def severity(z: Column) -> Column:
    return F.when(F.abs(z) >= 2.5, "high").when(F.abs(z) >= 1.5, "moderate").otherwise("info")


SEVERITY_ORDER = {"info": 0, "moderate": 1, "high": 2}


def severity_rank(column: Column) -> Column:
    return F.when(column == "high", 2).when(column == "moderate", 1).otherwise(0)


def capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def nearest_rank(values: Column, share: float) -> Column:
    """Of a sorted array, the element at the rank nearest to that share of its size, half to even; null for an empty one."""
    rank = F.bround(F.size(values) * share).cast("int")
    return F.try_element_at(values, F.greatest(F.lit(1), F.least(rank, F.size(values))))


def round_up(x: Column, step: int) -> Column:
    return (F.ceil(x / step) * step).cast("int")


def compass(degrees: Column) -> Column:
    """One of sixteen points; null for null."""
    points = F.array(*[F.lit(p) for p in "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()])
    return F.element_at(points, (F.floor(degrees / 22.5 + 0.5) % 16 + 1).cast("int"))


def decimal_comma(text: Column) -> Column:
    """A number that may be written with a decimal comma; null if it isn't one."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def inside(box: Column, region: Column, margin: float = 2.0) -> Column:
    """Whether a box (x0, y0, x1, y1) lies in a region, give or take a margin."""
    return (box["x0"] >= region["x0"] - margin) & (box["y0"] >= region["y0"] - margin) & (box["x1"] <= region["x1"] + margin) & (box["y1"] <= region["y1"] + margin)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The part of box a that lies in box b."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when((w <= 0) | (h <= 0) | (area <= 0), F.lit(0.0)).otherwise(w * h / F.nullif(area, F.lit(0.0)))
