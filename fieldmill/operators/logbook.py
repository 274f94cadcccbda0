"""A log of entries and their applications: filters, work queue, drill-down, key figures, recent days.

Entries are (entry_id, page_id, day, certain, verified, remarks), applications are (entry_id, pos, product, amount).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_entries(entries: DataFrame, applications: DataFrame, year: int | None = None, certain: bool = False, product: str | None = None) -> DataFrame:
    """Entries of a year, only certain ones, and with a product whose name contains ``product``, each where asked for. In no order: a list shows them by day, undated ones last, then entry_id."""
    rows = entries
    if year is not None:
        rows = rows.where(F.col("day").between(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    if certain:
        rows = rows.where("certain")
    if product is not None:
        rows = rows.join(applications.where(F.contains(F.lower("product"), F.lit(product.lower()))).select("entry_id"), "entry_id", "left_semi")
    return rows


def work_queue(entries: DataFrame, most: int | None = None) -> DataFrame:
    """Entries that nobody verified and that aren't certain; with ``most`` the first so many of them by page and entry, else all in no order."""
    rows = entries.where(~F.coalesce("certain", F.lit(False)) & ~F.coalesce("verified", F.lit(False)))
    return rows if most is None else rows.orderBy("page_id", "entry_id").limit(most)


#: Entries and applications that a task has at once, about.
TASK_ROWS = 250_000


def _lines(applications: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", "product", F.when(F.col("amount").isNotNull(), F.concat(F.lit("("), "amount", F.lit(")"))))
    return applications.select("entry_id", "pos", line.alias("line"))


def _joined(lines: DataFrame) -> DataFrame:
    return lines.groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "; ").alias("applications"))


def applications_text(applications: DataFrame) -> DataFrame:
    """entry_id and its applications as one text, in their order."""
    return _joined(_lines(applications))


def drill_down(entries: DataFrame, applications: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted entries (entry_id) with their applications as a text, empty without any.

    Rows are dealt once by entry, over as many tasks as there are rows for, so that what a task holds doesn't grow with the log; what is
    joined is then so small in each task that it is hashed and nothing is sorted for it.
    """
    parts = 1 + (entries.count() + applications.count()) // TASK_ROWS
    # distinct after the deal: else the optimizer puts the semi-joins, and a deal of their own, before it
    ids = wanted.select("entry_id").repartition(parts, "entry_id").distinct().hint("shuffle_hash")
    rows = entries.repartition(parts, "entry_id").join(ids, "entry_id", "left_semi")
    texts = _joined(_lines(applications).repartition(parts, "entry_id").join(ids, "entry_id", "left_semi"))
    return rows.join(texts.hint("shuffle_hash"), "entry_id", "left").withColumn("applications", F.coalesce("applications", F.lit("")))


def entry_text(day: Column, applications: Column, remarks: Column) -> Column:
    """An entry as one line: its day, applications and remarks, those that it has."""
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws(" | ", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("no date")), known(applications), known(remarks))


def key_figures(entries: DataFrame, applications: DataFrame) -> DataFrame:
    """One row: entries, pages, certain entries, first and last day, applications and products."""
    of_entries = entries.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_distinct("page_id").alias("n_pages"), F.count_if("certain").alias("n_certain"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    of_applications = applications.agg(F.count(F.lit(1)).alias("n_applications"), F.count_distinct("product").alias("n_products"))
    return of_entries.withColumn("__one", F.lit(1)).join(of_applications.withColumn("__one", F.lit(1)), "__one").drop("__one")


def verification_progress(entries: DataFrame) -> DataFrame:
    """One row: entries, certain, verified and waiting ones."""
    sure, seen = F.coalesce("certain", F.lit(False)), F.coalesce("verified", F.lit(False))
    return entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("n_certain"), F.count_if(seen).alias("n_verified"), F.count_if(~sure & ~seen).alias("n_waiting"))


def years(entries: DataFrame) -> DataFrame:
    """The years that have entries, the latest first."""
    return entries.where("day IS NOT NULL").select(F.year("day").alias("year")).distinct().orderBy(F.desc("year"))


def own_products(applications: DataFrame) -> DataFrame:
    """Products and how often they were applied; a list shows them by n falling, then by name."""
    named = applications.where(F.trim("product") != "").groupBy(F.trim("product").alias("product"))
    return named.agg(F.count(F.lit(1)).alias("n"))


def period(rows: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    return rows.where(F.col(day).between(start, end))


def window_around(rows: DataFrame, day: str, center: Column, before: int, after: int) -> DataFrame:
    """The days from ``before`` days before a date to ``after`` days after it, both included."""
    return period(rows, day, F.date_sub(center, before), F.date_add(center, after))


def last_observed(rows: DataFrame, key: str, day: str, value: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key that have a value."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))
    return rows.where(F.col(value).isNotNull()).withColumn("__k", rank).where(F.col("__k") <= n).drop("__k")


def recent_weather(daily: DataFrame, keys: list[str]) -> DataFrame:
    """days, avg_tmax over all days (one without a reading counts as 0), total rain and the wettest day's."""
    n = F.count(F.lit(1))
    tmax, rain = F.coalesce(F.sum("temp_max_c"), F.lit(0.0)), F.coalesce(F.sum("precipitation_mm"), F.lit(0.0))
    return daily.groupBy(*keys).agg(n.alias("days"), (tmax / F.greatest(F.lit(1), n)).alias("avg_tmax"), rain.alias("total_precip"), F.max("precipitation_mm").alias("max_precip"))


def named_products(question: Column, names: list[str], most: int = 2) -> Column:
    """The names that a question holds as whole words, in the order of the list, ``most`` at most."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    plain = lambda name: " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(f" {plain(n)} ")), F.lit(n)) for n in names])), 1, most)
