"""Landed answers of an interface, kept by key and time, and which of them answers a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: days for which an answer is fresh.
FRESH_DAYS = 7


def request_key(url: Column) -> Column:
    """The key under which an address is kept: the sha1 of its text."""
    return F.sha1(url)


def last_before(requests: DataFrame, answers: DataFrame, key: str, at: str, found: str = "answer", bucket: str = "month") -> DataFrame:
    """``requests`` with ``found``: the struct of all columns of the last of ``answers`` with the same key and a time not after its own; null without one.

    Both tables have ``key`` and ``at``; of answers of one key and time the greatest counts. Instead of comparing ranges, rows meet
    in the order of time within a key's bucket of time, so that a hot key is spread over its buckets; what an earlier bucket left
    last is carried over from a table of one row a bucket. A request without key or time has no answer.
    """
    part = lambda df: df.withColumn("__bucket", F.date_trunc(bucket, F.col(at)))
    kept = part(answers.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.struct(F.col(at).alias("__at"), F.struct(*answers.columns).alias("row")).alias("__a")))
    asked = part(requests.select(F.col(key), F.col(at), F.struct(*requests.columns).alias("__r")))
    both = kept.select(key, "__bucket", at, F.lit(0).alias("__turn"), "__a", F.lit(None).cast(asked.schema["__r"].dataType).alias("__r"))
    both = both.unionByName(asked.select(key, "__bucket", at, F.lit(1).alias("__turn"), F.lit(None).cast(kept.schema["__a"].dataType).alias("__a"), "__r"))
    # at one time answers come before requests, and of several answers the greatest comes last
    order = Window.partitionBy(key, "__bucket").orderBy(at, "__turn", "__a").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__near", F.last("__a", ignorenulls=True).over(order)).where("__turn = 1")
    # the last answer of each bucket, carried into the buckets that follow
    buckets = kept.groupBy(key, "__bucket").agg(F.max("__a").alias("__last")).unionByName(asked.where(F.col(at).isNotNull()).select(key, "__bucket").distinct(), allowMissingColumns=True)
    buckets = buckets.groupBy(key, "__bucket").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(key, "__bucket", F.last("__last", ignorenulls=True).over(earlier).alias("__carried")).where("__carried IS NOT NULL")
    rows = near.join(carried, [key, "__bucket"], "left")
    answer = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.coalesce("__near", "__carried")["row"])
    return rows.select("__r.*", answer.alias(found))


def as_of(requests: DataFrame, answers: DataFrame, key: str, at: str, fresh_days: int = FRESH_DAYS) -> DataFrame:
    """``requests`` with the last ``answer`` before each, its age in whole days, and its state.

    The state is fresh (younger than ``fresh_days``), stale (older: shown with a note of its age, as nothing newer was to be had) or
    missing (no answer at all, which is an error of that row and of no other).
    """
    rows = last_before(requests, answers, key, at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"answer.{at}").cast("timestamp"))
    age = F.floor(seconds / 86_400_000_000)
    state = F.when(F.col("answer").isNull(), "missing").when(seconds < fresh_days * 86_400_000_000, "fresh").otherwise("stale")
    note = F.when(F.col("state") == "stale", F.concat(F.lit("from "), F.col("age_days").cast("string"), F.lit(" days ago"))).when(F.col("state") == "missing", F.lit("no answer"))
    return rows.withColumn("age_days", age).withColumn("state", state).withColumn("note", note)
