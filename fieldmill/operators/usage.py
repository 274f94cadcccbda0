"""Product use: canonical names, quantities, and sums by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: units of volume and weight, and what one is in millilitres or grams.
VOLUME = {"liter": 1000.0, "ltr": 1000.0, "l": 1000.0, "milliliter": 1.0, "ml": 1.0, "cc": 1.0}
WEIGHT = {"kilogram": 1000.0, "kg": 1000.0, "gram": 1.0, "gr": 1.0, "g": 1.0}
#: Fixed: an amount with its unit.
_QUANTITY = r"(?i)(\d+(?:[.,]\d+)?)\s*(kilogram|milliliter|liter|ltr|kg|gram|gr|ml|cc|g|l)\b"


def parse_quantity(text: Column) -> Column:
    """struct(value, unit) of the first number with a unit, in ml or g; null without one."""
    number = F.replace(F.regexp_extract(text, _QUANTITY, 1), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, _QUANTITY, 2))
    factors = F.create_map(*[F.lit(x) for pair in (VOLUME | WEIGHT).items() for x in pair])
    base = F.when(unit.isin(*VOLUME), "ml").otherwise("g")
    return F.when(number.isNotNull(), F.struct((number * F.element_at(factors, unit)).alias("value"), base.alias("unit")))


def normal_name(raw: Column) -> Column:
    """A product name for lookup: lower case, single spaces, no punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " "), r"^[\s.,;:]+|[\s.,;:]+$", "")


def canonical_products(uses: DataFrame, aliases: DataFrame, raw: str = "raw") -> DataFrame:
    """``uses`` with product and class from ``aliases`` (alias, product, class); unknown names keep their own and are of class other.

    The table of aliases is a dimension; the optimiser broadcasts it by its size.
    """
    keyed = uses.withColumn("alias", normal_name(F.col(raw)))
    joined = keyed.join(aliases, "alias", "left")
    return joined.withColumn("product", F.coalesce("product", F.trim(raw))).withColumn("class", F.coalesce("class", F.lit("other"))).drop("alias")


def usage_records(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row for each application (product, amount) of dated entries, with its canonical product and parsed amount."""
    flat = entries.where("day IS NOT NULL").select("entry_id", "day", F.posexplode("applications").alias("position", "a"))
    flat = flat.select("entry_id", "day", "position", F.col("a.product").alias("raw"), F.col("a.amount").alias("raw_amount")).where(F.trim("raw") != "")
    found = canonical_products(flat, aliases).withColumn("q", parse_quantity(F.col("raw_amount")))
    return found.select("entry_id", "day", "position", "product", "class", "raw", "raw_amount", F.col("q.value").alias("value"), F.col("q.unit").alias("unit"))


def usage_by_period(uses: DataFrame) -> DataFrame:
    """n and the sums in ml and in g by period, product and class; the two are never mixed."""
    total = lambda u: F.sum(F.when(F.col("unit") == u, F.col("value")).otherwise(0.0))
    return uses.groupBy("period", "product", "class").agg(F.count(F.lit(1)).alias("n"), total("ml").alias("sum_ml"), total("g").alias("sum_g"))
