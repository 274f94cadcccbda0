"""Calendar arithmetic as column expressions. ``as_of`` is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_key(day: Column, granularity: str) -> Column:
    """2024-W01 (ISO week and its year), 2024-01, 2024-Q1 or 2024."""
    if granularity == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if granularity == "month":
        return F.concat(F.year(day).cast("string"), F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))
    if granularity == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    if granularity == "year":
        return F.year(day).cast("string")
    raise ValueError(f"no such granularity: {granularity}")


def anniversary(year: Column, day: Column) -> Column:
    """The same day in another year; 28 February where there is no 29th."""
    month_day = F.date_format(day, "-MM-dd")
    return F.coalesce(F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), month_day)), F.make_date(year, F.lit(2), F.lit(28)))


def month_window(first: Column, last: Column) -> Column:
    """The months from first to last, over the turn of the year if need be."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.concat(F.sequence(first, F.lit(12)), F.sequence(F.lit(1), last)))


def spinup_start(end: Column, period_days: int) -> Column:
    """1 March, or that of the year before if less than thirty days lie between it and the period."""
    march = F.make_date(F.year(end), F.lit(3), F.lit(1))
    return F.when(march > F.date_sub(end, period_days + 30), F.make_date(F.year(end) - 1, F.lit(3), F.lit(1))).otherwise(march)


def latest_archive_day(as_of: Column) -> Column:
    return F.date_sub(as_of, 1)


def utc_evening_date(stamp: Column) -> Column:
    """The date of an ISO stamp in UTC; from 22:00 on it is the next day, which is local midnight."""
    day = F.try_to_date(F.substring(stamp, 1, 10))
    hour = F.try_element_at(F.split(F.substring(stamp, 12, 5), ":"), F.lit(1)).try_cast("int")
    return F.date_add(day, F.when(hour >= 22, 1).otherwise(0))


#: Fixed: crop coefficients at the start, middle and end of the season, by ground cover.
CROP_COEFFICIENTS = {"bare": (0.45, 0.90, 0.65), "grass": (0.50, 1.15, 0.90)}


def crop_coefficient(day: Column, cover: str = "grass") -> Column:
    """Piecewise linear over the year: flat to 1 April, up to 1 June, flat to 15 September, down to 1 November, back by 15 November."""
    start, middle, end = CROP_COEFFICIENTS[cover]
    at = lambda m, d: F.make_date(F.year(day), F.lit(m), F.lit(d))

    def line(a: Column, b: Column, u: float, v: float) -> Column:
        return F.lit(u) + F.lit(v - u) * F.date_diff(day, a) / F.date_diff(b, a)

    a1, a2, a3, a4, a5 = at(4, 1), at(6, 1), at(9, 15), at(11, 1), at(11, 15)
    return (
        F.when((day < a1) | (day >= a5), F.lit(start))
        .when(day < a2, line(a1, a2, start, middle))
        .when(day < a3, F.lit(middle))
        .when(day < a4, line(a3, a4, middle, end))
        .otherwise(line(a4, a5, end, start))
    )


#: Fixed: names of the months.
MONTHS_NL = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]
#: Fixed: days around a day and around the middle of a month.
DAY_WINDOW, MONTH_WINDOW = 14, 15


def dutch_date(day: Column) -> Column:
    """3 mei 2021; a hyphen for null."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS_NL]), F.month(day))
    return F.when(day.isNull(), "-").otherwise(F.concat_ws(" ", F.dayofmonth(day).cast("string"), name, F.year(day).cast("string")))


def calendar_argument(text: Column, as_of: Column) -> Column:
    """struct(day, window) that an argument names: an ISO date, the middle of a month by name (its first three letters as a word, where the name is longer), else ``as_of``."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    iso = F.try_to_date(F.nullif(F.regexp_extract(t, r"\d{4}-\d{2}-\d{2}", 0), F.lit("")))
    month = F.lit(None).cast("int")
    for n, name in reversed(list(enumerate(MONTHS_NL, 1))):
        short = F.array_contains(F.split(t, r"\s+"), name[:3]) if len(name) > 3 else F.lit(False)
        month = F.when(F.contains(t, F.lit(name)) | short, n).otherwise(month)
    middle = F.make_date(F.year(as_of), month, F.lit(15))
    named = F.when(iso.isNotNull(), iso).when(month.isNotNull(), middle).otherwise(as_of)
    return F.struct(named.alias("day"), F.when(iso.isNull() & month.isNotNull(), MONTH_WINDOW).otherwise(DAY_WINDOW).alias("window"))


def chill_window(as_of: Column) -> Column:
    """struct(start, end) of the dormant season: from 1 November, of this year from July on if it has come, else of the year before, to 28 February or ``as_of``."""
    november = F.make_date(F.year(as_of), F.lit(11), F.lit(1))
    before = F.make_date(F.year(as_of) - 1, F.lit(11), F.lit(1))
    start = F.when(as_of >= november, november).otherwise(before)
    return F.struct(start.alias("start"), F.least(as_of, F.make_date(F.year(start) + 1, F.lit(2), F.lit(28))).alias("end"))
