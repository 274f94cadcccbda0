"""Histories and calendars of products: gaps, anniversaries, limits and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import anniversary

MIN_ROWS_OF_A_YEAR = 8


def dedupe_pages(entries: DataFrame, key: list[str], page: str, order: list[str], keep: Column | None = None) -> DataFrame:
    """Rows whose page is that of the first row with the same key; rows that ``keep`` holds for are never removed."""
    first = F.first(page).over(Window.partitionBy(*key).orderBy(*order))
    stays = F.col(page).eqNullSafe(first)
    return entries.withColumn("__stays", stays if keep is None else keep | stays).where("__stays").drop("__stays")


def gaps(uses: DataFrame, product: str, day: str) -> DataFrame:
    """Days since the last use of the same product in the same year, where more than 0."""
    last = F.lag(day).over(Window.partitionBy(product, F.year(day)).orderBy(day))
    return uses.withColumn("gap", F.date_diff(F.col(day), last)).where("gap > 0")


def history_years(entries: DataFrame, day: str, before: int) -> DataFrame:
    """Years before a given one with rows enough to count as history."""
    return entries.where(F.year(day) < before).groupBy(F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS_OF_A_YEAR)


def around_anniversary(uses: DataFrame, day: str, reference: Column, window: int) -> DataFrame:
    """Rows within ``window`` days of the reference's anniversary in their own year; a band join that needs no join, as the anchor follows from the row's year."""
    anchor = anniversary(F.year(day), reference)
    return uses.withColumn("offset", F.date_diff(F.col(day), anchor)).where(F.abs("offset") <= window)


def product_calendar(uses: DataFrame, product: str, day: str, reference: Column, window: int) -> DataFrame:
    """By product, around the anniversary: years, uses, the median offset, this year's uses and the latest year. A list shows them by n_years and n falling, then product."""
    near = around_anniversary(uses, day, reference, window)
    this = F.year(day) == F.year(reference)
    table = near.groupBy(product).agg(
        F.count_distinct(F.when(~this, F.year(day))).alias("n_years"), F.count_if(~this).alias("n"), F.median(F.when(~this, F.col("offset"))).alias("median_offset"), F.count_if(this).alias("this_year"), F.max(F.when(~this, F.year(day))).alias("last_year")
    )
    return table.where("n_years > 0")


def product_history(uses: DataFrame, product: str, day: str) -> DataFrame:
    """By product: uses, years, first and last day, and the median gap within a year."""
    between = gaps(uses, product, day).groupBy(product).agg(F.median("gap").alias("median_gap"), F.min("gap").alias("least_gap"))
    total = uses.groupBy(product).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year(day)).alias("n_years"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return total.join(between, product, "left")


#: Fixed: days around the anniversary that count as near it, and the share of the years in which a product was used by then to be usual.
NEAR_DAYS, USUAL_SHARE = 15, 0.5


def _by_distinct_years(uses: DataFrame, product: str, day: str, remarks: str, most: int) -> DataFrame:
    """(product, purposes): the ``most`` purposes that remarks name in the most distinct years, as structs of purpose and years; ties by name."""
    named = uses.select(product, F.year(day).alias("__y"), F.explode(purposes(F.coalesce(F.col(remarks), F.lit("")))).alias("purpose")).distinct()
    years = named.groupBy(product, "purpose").agg(F.count(F.lit(1)).alias("years"))
    k = F.row_number().over(Window.partitionBy(product).orderBy(F.desc("years"), "purpose"))
    best = years.withColumn("__k", k).where(F.col("__k") <= most)
    return best.groupBy(product).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "purpose", "years"))), lambda x: F.struct(x["purpose"].alias("purpose"), x["years"].alias("years"))).alias("purposes"))


def own_use(uses: DataFrame, entries: DataFrame, product: str, day: str, remarks: str, reference: Column) -> DataFrame:
    """By product the whole history: n, first and last day, uses by year and by month (maps), median gap, purposes (three), history years, and in how many of these it was used near the reference's anniversary.

    ``uses`` has a row for each use, ``entries`` one for each dated entry of the log, from which the history years follow.
    """
    years = history_years(entries, day, 9999).select("year", F.lit(True).alias("__history"))
    dated = uses.where(F.col(day).isNotNull())
    counted = lambda of, name: dated.groupBy(product, of(day).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).groupBy(product).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(name))
    covered = years.where(F.col("year") < F.year(reference))
    close = around_anniversary(dated, day, reference, NEAR_DAYS).select(product, F.year(day).alias("year")).distinct().join(covered, "year", "left_semi").groupBy(product).agg(F.count(F.lit(1)).alias("near_years"))
    found = product_history(dated, product, day).join(counted(F.year, "by_year"), product).join(counted(F.month, "by_month"), product)
    found = found.join(_by_distinct_years(dated, product, day, remarks, 3), product, "left").join(close, product, "left")
    total = covered.agg(F.count(F.lit(1)).alias("history_years"))
    # one row
    return found.crossJoin(F.broadcast(total)).withColumn("near_years", F.coalesce("near_years", F.lit(0).cast("bigint"))).withColumn("purposes", F.coalesce("purposes", F.array().cast("array<struct<purpose:string,years:bigint>>")))


def usual_now(uses: DataFrame, entries: DataFrame, product: str, day: str, remarks: str, reference: Column, window: int = 14) -> DataFrame:
    """By product, in the history years around the reference's anniversary: n_years, years_back (those with a use up to the anniversary), n, median_gap, purposes (two), this_year, and ``missing``.

    This year counts up to the reference. A product is missing this year if the year has entries enough to compare, it was used by now in half of the
    history years or more (one at least), and not yet this year. Rows come in no order; that of the calendar is n_years and n falling, then product.
    """
    dated = uses.where(F.col(day).isNotNull())
    this = F.year(day) == F.year(reference)
    years = entries.groupBy(F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= MIN_ROWS_OF_A_YEAR)
    history = years.where(F.col("year") < F.year(reference)).select("year")
    near = around_anniversary(dated, day, reference, window).withColumn("year", F.year(day))
    past = near.join(history, "year", "left_semi")
    table = past.groupBy(product).agg(F.count_distinct("year").alias("n_years"), F.count_distinct(F.when(F.col("offset") <= 0, F.col("year"))).alias("years_back"), F.count(F.lit(1)).alias("n"))
    between = gaps(past, product, day).groupBy(product).agg(F.bround(F.median("gap")).cast("int").alias("median_gap"))
    now = near.where(this & (F.col("offset") <= 0)).groupBy(product).agg(F.count(F.lit(1)).alias("this_year"))
    whole = years.agg(F.count_if(F.col("year") < F.year(reference)).alias("__history"), F.coalesce(F.max(F.col("year") == F.year(reference)), F.lit(False)).alias("__comparable"))
    found = table.join(between, product, "left").join(now, product, "left").join(_by_distinct_years(past, product, day, remarks, 2), product, "left").crossJoin(F.broadcast(whole))
    this_year = F.coalesce("this_year", F.lit(0).cast("bigint"))
    usual = F.col("years_back") >= F.greatest(F.lit(1.0), USUAL_SHARE * F.col("__history"))
    return found.withColumn("this_year", this_year).withColumn("missing", F.col("__comparable") & usual & (F.col("this_year") == 0)).withColumn("purposes", F.coalesce("purposes", F.array().cast("array<struct<purpose:string,years:bigint>>"))).drop("__history", "__comparable")


def advice(queries: DataFrame, products: DataFrame, own: DataFrame, breaches: DataFrame) -> DataFrame:
    """(query, product, registered, valid, n, flags, note) of each query's products, registered or in the own log.

    ``queries`` has query and text, ``products`` product and valid (for the crop), ``own`` product and n (see :func:`own_use`), ``breaches`` product and flag. Names meet
    a query by equality or a common beginning of three characters or more. The note says why own use was not compared.
    """
    registered = prefix_matches(products, "product", queries, "text").groupBy("query", "product").agg(F.max("valid").alias("valid"))
    used = prefix_matches(own.select("product", "n"), "product", queries, "text").groupBy("query", "product").agg(F.max("n").alias("n"))
    flags = breaches.groupBy("product").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    rows = registered.join(used, ["query", "product"], "full").join(flags, "product", "left")
    is_registered, valid = F.col("valid").isNotNull(), F.coalesce("valid", F.lit(False))
    shown = F.when(F.col("n").isNotNull() & valid, F.coalesce("flags", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("n").isNull(), "no own use").when(~is_registered, "not registered").when(~valid, "no valid use for the crop").when(F.size("flags") > 0, "differs").otherwise("no difference found")
    return rows.select("query", "product", is_registered.alias("registered"), valid.alias("valid"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), shown.alias("flags"), note.alias("note"))


def prefix_matches(names: DataFrame, name: str, queries: DataFrame, text: str) -> DataFrame:
    """Names that equal a query, begin with it or are its beginning, from three characters on.

    Joined on the first three characters, so that it is an equi-join and not a comparison of all pairs.
    """
    a = names.withColumn("__head", F.substring(F.lower(name), 1, 3)).where(F.length(name) >= 3)
    b = queries.withColumn("__head", F.substring(F.lower(text), 1, 3)).where(F.length(text) >= 3)
    x, y = F.lower(name), F.lower(text)
    return a.join(b, "__head").where(F.startswith(x, y) | F.startswith(y, x)).drop("__head")


def limit_breaches(uses: DataFrame, product: str, day: str, limits: DataFrame) -> DataFrame:
    """(product, year, flag, found, allowed): more uses in a year than allowed, a shorter gap, or a month outside the window.

    ``limits`` has product, season_cap, least_gap and months; of several rows the most generous applies.
    """
    allowed = limits.groupBy(product).agg(F.max("season_cap").alias("cap"), F.min("least_gap").alias("gap_floor"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("months")))).alias("months"))
    by_year = uses.groupBy(product, F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.month(day)).alias("used"))
    shortest = gaps(uses, product, day).groupBy(product, F.year(day).alias("year")).agg(F.min("gap").alias("gap"))
    rows = by_year.join(shortest, [product, "year"], "left").join(allowed, product)
    outside = F.size(F.array_except("used", "months"))
    flags = F.array(
        F.when(F.col("n") > F.col("cap"), F.struct(F.lit("season").alias("flag"), F.col("n").cast("int").alias("found"), F.col("cap").cast("int").alias("allowed"))),
        F.when(F.col("gap") < F.col("gap_floor"), F.struct(F.lit("interval").alias("flag"), F.col("gap").cast("int").alias("found"), F.col("gap_floor").cast("int").alias("allowed"))),
        F.when((F.size("months") > 0) & (outside > 0), F.struct(F.lit("month").alias("flag"), outside.cast("int").alias("found"), F.lit(0).alias("allowed"))),
    )
    return rows.select(product, "year", F.explode(F.array_compact(flags)).alias("f")).select(product, "year", "f.*")


def purposes(remarks: Column) -> Column:
    """What a remark says the use was against: the parts of each "against x and y"."""
    found = F.regexp_extract_all(F.lower(remarks), F.lit(r"(?:tegen|against)\s+([^.;,]+)"), F.lit(1))
    parts = F.flatten(F.transform(found, lambda f: F.split(f, r"\s+(?:en|and|\+|&)\s+|\s*[+&/]\s*")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= 3))


def lookup_products(products: DataFrame, name: str, query: str, valid: str, expires: str, most: int = 6) -> DataFrame:
    """Products whose name holds the query: valid ones by exact, prefix and other match, then expired ones by the latest expiry; ``most`` of each."""
    text = F.lower(name)
    rank = F.when(text == query.lower(), 0).when(F.startswith(text, F.lit(query.lower())), 1).otherwise(2)
    found = products.where(F.contains(text, F.lit(query.lower()))).withColumn("match", rank)
    order = Window.partitionBy(valid).orderBy(F.when(F.col(valid), F.col("match")), F.when(~F.col(valid), F.col(expires)).desc(), name)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).orderBy(F.desc(valid), "place")
