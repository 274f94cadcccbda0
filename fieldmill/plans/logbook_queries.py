"""The log's filters and figures, with orders as entries and line items as applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, evaluation, logbook
from .registry import query, read

_LOG = """WITH e AS (SELECT o_orderkey AS entry_id, o_custkey AS page_id, o_orderdate::DATE AS day, o_orderstatus <> 'P' AS certain, o_orderpriority LIKE '1%' AS verified, o_orderpriority AS remarks FROM orders),
a AS (SELECT l_orderkey AS entry_id, l_linenumber AS pos, 'part ' || (l_partkey % 40) AS product, l_quantity::BIGINT || ' kg' AS amount, l_partkey FROM lineitem)
"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entries = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("page_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") != "P").alias("certain"), F.startswith("o_orderpriority", F.lit("1")).alias("verified"), F.col("o_orderpriority").alias("remarks")
    )
    product = F.concat(F.lit("part "), (F.col("l_partkey") % 40).cast("string"))
    applications = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("pos"), product.alias("product"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" kg")).alias("amount"), "l_partkey"
    )
    return entries, applications


@query("log_filter", _LOG + "SELECT entry_id, day, remarks FROM e WHERE year(day) = 1996 AND certain AND entry_id IN (SELECT entry_id FROM a WHERE product LIKE '%part 3%')")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, applications = _log(spark, sf_dir)
    return logbook.filter_entries(entries, applications, 1996, True, "Part 3").select("entry_id", "day", "remarks")


@query("log_work_queue", _LOG + "SELECT page_id, entry_id FROM e WHERE NOT certain AND NOT verified")
def log_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.work_queue(_log(spark, sf_dir)[0]).select("page_id", "entry_id")


@query(
    "log_drill_down",
    _LOG + "SELECT entry_id, strftime(day, '%Y-%m-%d') || coalesce(' | ' || applications, '') || ' | ' || remarks AS line FROM e LEFT JOIN (SELECT entry_id, string_agg(product || ' (' || amount || ')', '; ' ORDER BY pos, product || ' (' || amount || ')') AS applications FROM a GROUP BY 1) USING (entry_id) WHERE NOT certain",
)
def log_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, applications = _log(spark, sf_dir)
    found = logbook.drill_down(entries, applications, entries.where("NOT certain"))
    return found.select("entry_id", logbook.entry_text(F.col("day"), F.col("applications"), F.col("remarks")).alias("line"))


@query("log_key_figures", _LOG + "SELECT count(*) AS n_entries, count(DISTINCT page_id) AS n_pages, count(*) FILTER (certain) AS n_certain, min(day) AS first_day, max(day) AS last_day, (SELECT count(*) FROM a) AS n_applications, (SELECT count(DISTINCT product) FROM a) AS n_products FROM e")
def log_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.key_figures(*_log(spark, sf_dir))


@query("log_progress", _LOG + "SELECT count(*) AS n, count(*) FILTER (certain) AS n_certain, count(*) FILTER (verified) AS n_verified, count(*) FILTER (NOT certain AND NOT verified) AS n_waiting FROM e")
def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.verification_progress(_log(spark, sf_dir)[0])


@query("log_years", _LOG + "SELECT DISTINCT year(day)::INT AS year FROM e")
def log_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.years(_log(spark, sf_dir)[0])


@query("own_products", _LOG + "SELECT product, count(*) AS n FROM a GROUP BY 1")
def own_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.own_products(_log(spark, sf_dir)[1])


_DAYS = "WITH d AS (SELECT ts::DATE AS day, event_type AS site, CASE WHEN max(value) < 300 THEN max(value) / 10 END AS temp_max_c, sum(value) / 100 AS precipitation_mm FROM events GROUP BY ALL)\n"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("site"))
    rows = rows.agg(F.max("value").alias("v"), (F.sum("value") / 100).alias("precipitation_mm"))
    return rows.select("day", "site", F.when(F.col("v") < 300, F.col("v") / 10).alias("temp_max_c"), "precipitation_mm")


@query(
    "recent_weather",
    _DAYS + "SELECT site, count(*) AS days, round(coalesce(sum(temp_max_c), 0) / count(*), 6) AS avg_tmax, round(sum(precipitation_mm), 6) AS total_precip, round(max(precipitation_mm), 6) AS max_precip FROM d WHERE day BETWEEN DATE '2024-01-06' AND DATE '2024-01-13' GROUP BY site",
)
def recent_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days around 10 January: four before and three after."""
    rows = logbook.window_around(_days(spark, sf_dir), "day", F.lit("2024-01-10").cast("date"), 4, 3)
    return logbook.recent_weather(rows, ["site"]).withColumns({c: F.round(c, 6) for c in ("avg_tmax", "total_precip", "max_precip")})


@query("last_observed_days", _DAYS + "SELECT site, day FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day DESC) AS k FROM d WHERE temp_max_c IS NOT NULL) WHERE k <= 5")
def last_observed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbook.last_observed(_days(spark, sf_dir), "site", "day", "temp_max_c", 5).select("site", "day")


_ANSWERS = "WITH r AS (SELECT event_type AS kind, user_id % 7 = 0 AS failed, CASE WHEN event_id % 3 > 0 THEN value / 500 END AS coverage, event_id % 5 > 0 AS grounded, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS n_forbidden, value AS seconds FROM events)\n"


@query(
    "answer_summary",
    _ANSWERS + "SELECT kind, count(*) AS n, count(*) FILTER (failed) AS n_failed, round(avg(coverage) FILTER (NOT failed), 6) AS coverage, round(avg(grounded::INT) FILTER (NOT failed), 6) AS grounded_share, count(*) FILTER (NOT failed AND n_forbidden > 0) AS n_forbidden, round(avg(seconds) FILTER (NOT failed), 6) AS seconds FROM r GROUP BY kind",
)
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = read(spark, sf_dir, "events").select(
        c("event_type").alias("kind"), F.when(c("user_id") % 7 == 0, "timeout").alias("error"), F.when(c("event_id") % 3 > 0, c("value") / 500).alias("coverage"), (c("event_id") % 5 > 0).alias("grounded"), F.when(c("user_id") % 11 == 0, 1).otherwise(0).alias("n_forbidden"), c("value").alias("seconds")
    )
    return evaluation.answer_summary(rows, ["kind"]).withColumns({x: F.round(x, 6) for x in ("coverage", "grounded_share", "seconds")})


@query(
    "recall_by_kind",
    """WITH x AS (SELECT conv_id AS item, role AS kind, turn, conv_id * 10 + turn AS expected FROM conversations), f AS (SELECT item, kind, count(*) AS n, count(*) FILTER (expected % 4 <> 1) AS found FROM x GROUP BY ALL)
SELECT kind, count(*) AS n, round(avg(found / n), 6) AS recall, count(*) FILTER (found = 0) AS n_missed FROM f GROUP BY kind""",
)
def recall_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item"), F.col("role").alias("kind"), (F.col("conv_id") * 10 + F.col("turn")).alias("entry_id"))
    found = evaluation.recall_by_kind(rows, rows.where("entry_id % 4 <> 1").select("item", "entry_id"))
    return found.withColumn("recall", F.round("recall", 6))


@query("sampling_summary", "SELECT count(DISTINCT source) AS n_prompts, count(*) AS n_candidates, count(*) FILTER (quality = 0) AS n_gated, round(avg(toxic), 6) AS mean_reward, round((SELECT avg(b) FROM (SELECT max(toxic) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)), 6) AS mean_best FROM documents JOIN labels USING (doc_id)")
def sampling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    found = evaluation.sampling_summary(rows.select(F.col("source").alias("prompt"), F.col("toxic").cast("double").alias("reward"), F.col("quality").cast("double").alias("gate")))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_reward", "mean_best")})


@query(
    "log_question_set",
    """WITH r AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m') AS ym, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority[3:]) END AS target FROM orders),
ring AS (SELECT id, y, d, row_number() OVER (PARTITION BY y ORDER BY md5('13|' || id), id) - 1 AS place, count(*) OVER (PARTITION BY y) AS n FROM r),
own AS (SELECT 'recall_day' AS kind, 'Wat is er gedaan op ' || d || '?' AS question, d AS period, y, id FROM r
  UNION ALL SELECT 'recall_target', 'Wat is er in ' || y || ' gebruikt tegen ' || target || '?', id::VARCHAR, y, id FROM r WHERE target IS NOT NULL),
asked AS (SELECT o.*, n, ('0x' || left(md5('14|' || kind || '|' || period), 8))::BIGINT % n AS start FROM (SELECT kind, question, period, y, count(*) AS m FROM own GROUP BY ALL) o JOIN (SELECT y, any_value(n) AS n FROM ring GROUP BY y) g ON g.y = o.y),
spots AS (SELECT kind, question, period, y, n, start, unnest(range(0, least(n, m + 3))) AS turn FROM asked),
met AS (SELECT s.*, ring.id, row_number() OVER (PARTITION BY kind, period ORDER BY turn) AS k FROM spots s JOIN ring ON ring.y = s.y AND ring.place = (s.start + s.turn) % s.n WHERE CASE WHEN kind = 'recall_day' THEN ring.d <> period ELSE ring.id::VARCHAR <> period END),
empty AS (SELECT asked, y FROM (SELECT DISTINCT y, make_date(y, mm, dd) AS asked FROM r, range(4, 10) a(mm), range(1, 29) b(dd)) WHERE asked NOT IN (SELECT day FROM r) ORDER BY md5('15|' || strftime(asked, '%Y-%m-%d')), asked LIMIT 40),
near AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY abs(day - asked), day, id) AS k FROM empty e JOIN r ON r.y = e.y)
SELECT kind, question, period, id AS entry_id, 'own' AS role FROM own
UNION ALL SELECT kind, question, period, id, 'distractor' FROM met WHERE k <= 3
UNION ALL SELECT 'recall_month', 'Welke middelen zijn in ' || ym || ' gebruikt?', ym, id, 'own' FROM r WHERE ym IN (SELECT ym FROM r GROUP BY ym HAVING count(*) BETWEEN 2 AND 200)
UNION ALL SELECT 'abstain_day', 'Wat is er gedaan op ' || strftime(asked, '%Y-%m-%d') || '?', strftime(asked, '%Y-%m-%d'), id, 'near' FROM near WHERE k <= 3""",
)
def log_question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries; fulfilled ones have a remark that names a target."""
    aimed = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("tegen "), F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(".")))
    entries = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.to_date("o_orderdate").alias("day"), aimed.alias("remarks"))
    return datasets.log_question_set(entries, month_most=200)
