"""Own use of products, what is usual now, advice on products and the state of the season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant, calendar, evaluation, thresholds
from .registry import query, read

REFERENCE = "2001-06-15"
_USES = """u AS (SELECT o_custkey % 40 AS product, o_orderdate::DATE AS day, year(o_orderdate) AS y, make_date(year(o_orderdate), 6, 15) AS anchor,
  [lower(o_orderpriority[3:])] || CASE WHEN o_orderstatus = 'F' THEN ['luis'] ELSE [] END AS aims FROM orders),
h AS (SELECT y FROM u WHERE y < 2001 GROUP BY y HAVING count(*) >= 8)"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uses; what they were against follows from their priority and status."""
    remark = F.concat(F.lit("Tegen "), F.lower(F.substring("o_orderpriority", 3, 100)), F.when(F.col("o_orderstatus") == "F", " en luis").otherwise(""), F.lit("."))
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("product"), F.to_date("o_orderdate").alias("day"), remark.alias("remarks"))


def _listed(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def _aims(purposes: str) -> Column:
    return F.array_join(F.transform(purposes, lambda p: F.concat_ws(":", p["purpose"], p["years"].cast("string"))), ",")


@query(
    "own_use",
    f"""WITH {_USES},
g AS (SELECT product, median(gap) AS median_gap, min(gap)::INT AS least_gap FROM (SELECT product, date_diff('day', lag(day) OVER (PARTITION BY product, y ORDER BY day), day) AS gap FROM u) WHERE gap > 0 GROUP BY product),
yy AS (SELECT product, string_agg(y || ':' || n, ',' ORDER BY y) AS by_year FROM (SELECT product, y, count(*) AS n FROM u GROUP BY ALL) GROUP BY product),
mm AS (SELECT product, string_agg(m || ':' || n, ',' ORDER BY m) AS by_month FROM (SELECT product, month(day) AS m, count(*) AS n FROM u GROUP BY ALL) GROUP BY product),
a AS (SELECT product, aim, count(DISTINCT y) AS years FROM (SELECT product, y, unnest(aims) AS aim FROM u) GROUP BY ALL),
p AS (SELECT product, string_agg(aim || ':' || years, ',' ORDER BY years DESC, aim) AS purposes FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY years DESC, aim) AS k FROM a) WHERE k <= 3 GROUP BY product),
c AS (SELECT product, count(DISTINCT y) AS near_years FROM u WHERE y IN (SELECT y FROM h) AND abs(day - anchor) <= 15 GROUP BY product)
SELECT u.product, count(*) AS n, count(DISTINCT y) AS n_years, min(day) AS first_day, max(day) AS last_day, any_value(median_gap) AS median_gap, any_value(least_gap) AS least_gap, any_value(by_year) AS by_year, any_value(by_month) AS by_month,
  any_value(purposes) AS purposes, coalesce(any_value(near_years), 0) AS near_years, (SELECT count(*) FROM h) AS history_years
FROM u LEFT JOIN g USING (product) JOIN yy USING (product) JOIN mm USING (product) LEFT JOIN p USING (product) LEFT JOIN c USING (product) GROUP BY u.product""",
)
def own_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _uses(spark, sf_dir)
    found = calendar.own_use(uses, uses, "product", "day", "remarks", F.lit(REFERENCE).cast("date"))
    maps = {c: _listed(F.array_sort(F.map_entries(c))) for c in ("by_year", "by_month")}
    return found.withColumns(maps | {"purposes": _aims("purposes")})


@query(
    "usual_now",
    f"""WITH {_USES},
w AS (SELECT *, day - anchor AS off FROM u WHERE abs(day - anchor) <= 14), past AS (SELECT * FROM w WHERE y IN (SELECT y FROM h)),
g AS (SELECT product, round_even(median(gap), 0)::INT AS median_gap FROM (SELECT product, date_diff('day', lag(day) OVER (PARTITION BY product, y ORDER BY day), day) AS gap FROM past) WHERE gap > 0 GROUP BY product),
a AS (SELECT product, aim, count(DISTINCT y) AS years FROM (SELECT product, y, unnest(aims) AS aim FROM past) GROUP BY ALL),
p AS (SELECT product, string_agg(aim || ':' || years, ',' ORDER BY years DESC, aim) AS purposes FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY years DESC, aim) AS k FROM a) WHERE k <= 2 GROUP BY product),
n AS (SELECT product, count(*) AS this_year FROM w WHERE y = 2001 AND off <= 0 GROUP BY product),
t AS (SELECT product, count(DISTINCT y) AS n_years, count(DISTINCT y) FILTER (off <= 0) AS years_back, count(*) AS n FROM past GROUP BY product)
SELECT product, n_years, years_back, n, median_gap, purposes, coalesce(this_year, 0) AS this_year,
  (SELECT count(*) FROM u WHERE y = 2001) >= 8 AND years_back >= greatest(1, 0.5 * (SELECT count(*) FROM h)) AND coalesce(this_year, 0) = 0 AS missing
FROM t LEFT JOIN g USING (product) LEFT JOIN p USING (product) LEFT JOIN n USING (product)""",
)
def usual_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _uses(spark, sf_dir)
    return calendar.usual_now(uses, uses, "product", "day", "remarks", F.lit(REFERENCE).cast("date")).withColumn("purposes", _aims("purposes"))


@query(
    "product_advice",
    """WITH q AS (SELECT p_partkey AS query, CASE WHEN p_partkey % 100 = 0 THEN string_split(p_name, ' ')[1] ELSE upper(p_name) END AS text FROM part WHERE p_partkey % 50 = 0),
r AS (SELECT p_name AS product, bool_or(p_size > 48) AS valid FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_name),
o AS (SELECT p_name AS product, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#1' AND l_quantity > 45 GROUP BY p_name),
f AS (SELECT product, string_agg(flag, ',' ORDER BY flag) AS flags FROM (SELECT DISTINCT p_name AS product, CASE WHEN p_size < 3 THEN 'interval' ELSE 'season' END AS flag FROM part WHERE p_size < 3 OR p_size = 10) GROUP BY product),
a AS (SELECT query, product, bool_or(valid) AS valid FROM q JOIN r ON starts_with(lower(product), lower(text)) OR starts_with(lower(text), lower(product)) GROUP BY ALL),
b AS (SELECT query, product, max(n) AS n FROM q JOIN o ON starts_with(lower(product), lower(text)) OR starts_with(lower(text), lower(product)) GROUP BY ALL),
j AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.product, b.product) AS product, valid, n FROM a FULL JOIN b ON a.query = b.query AND a.product = b.product)
SELECT query, j.product, valid IS NOT NULL AS registered, coalesce(valid, false) AS valid, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL AND coalesce(valid, false) THEN coalesce(flags, '') ELSE '' END AS flags,
  CASE WHEN n IS NULL THEN 'no own use' WHEN valid IS NULL THEN 'not registered' WHEN NOT valid THEN 'no valid use for the crop' WHEN flags IS NOT NULL THEN 'differs' ELSE 'no difference found' END AS note FROM j LEFT JOIN f USING (product)""",
)
def product_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as products; every fiftieth part asks for its name or its first word."""
    part = read(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 100 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.upper("p_name"))
    queries = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), text.alias("text"))
    registered = part.where("p_type <> 'ECONOMY'").groupBy(F.col("p_name").alias("product")).agg(F.max(F.col("p_size") > 48).alias("valid"))
    lines = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    own = lines.join(part.where("p_brand <> 'Brand#1'").select("p_partkey", "p_name"), "p_partkey").groupBy(F.col("p_name").alias("product")).agg(F.count(F.lit(1)).alias("n"))
    breaches = part.where("p_size < 3 OR p_size = 10").select(F.col("p_name").alias("product"), F.when(F.col("p_size") < 3, "interval").otherwise("season").alias("flag"))
    return calendar.advice(queries, registered, own, breaches).withColumn("flags", F.array_join("flags", ","))


@query(
    "season_snapshot",
    """WITH s AS (SELECT n_nationkey AS site, make_date(1998, 1, 1) + n_nationkey * 37 AS as_of, CASE WHEN n_regionkey % 2 = 0 THEN 1400.0 END AS need, CASE WHEN n_nationkey % 3 = 0 THEN 'bloom' END AS stage FROM nation),
k AS (SELECT site, as_of, need, coalesce(stage, ['rest', 'bud swell', 'bloom', 'fruit set', 'growth', 'growth', 'ripening', 'harvest', 'aftercare', 'aftercare', 'rest', 'rest'][month(as_of)]) AS stage, CASE WHEN month(as_of) >= 11 THEN make_date(year(as_of), 11, 1) ELSE make_date(year(as_of) - 1, 11, 1) END AS begins FROM s),
w AS (SELECT l_suppkey % 25 AS site, l_shipdate::DATE AS day, l_quantity / 2 - 8 AS temp, l_discount FROM lineitem),
c AS (SELECT k.site, count(*) FILTER (temp BETWEEN 0 AND 7.2) AS chill FROM k JOIN w ON w.site = k.site AND day BETWEEN begins AND least(as_of, make_date(year(begins) + 1, 2, 28)) GROUP BY k.site),
d AS (SELECT site, day, min(temp) AS lo, max(temp) AS hi, count(*) AS rain FROM w GROUP BY ALL),
t AS (SELECT k.site, day, lo, hi, CASE WHEN day < as_of + 2 THEN rain ELSE 0 END AS rain, CASE stage WHEN 'bud swell' THEN CASE WHEN lo <= -17.8 THEN 3 WHEN lo <= -9.4 THEN 2 WHEN lo <= -7.4 THEN 1 ELSE 0 END
  WHEN 'bloom' THEN CASE WHEN lo <= -6.7 THEN 3 WHEN lo <= -2.2 THEN 2 WHEN lo <= -2.2 + 2.0 THEN 1 ELSE 0 END WHEN 'fruit set' THEN CASE WHEN lo <= -4.4 THEN 3 WHEN lo <= -1.1 THEN 2 WHEN lo <= -1.1 + 2.0 THEN 1 ELSE 0 END ELSE 0 END AS frost
  FROM k JOIN d ON d.site = k.site AND day >= as_of AND day < as_of + 7),
o AS (SELECT site, round(sum(greatest(0, (lo + hi) / 2 - 4.4)), 6) AS degrees, max(frost) AS frost, arg_min(day, (-frost, day)) AS frost_day, sum(rain) AS rain FROM t GROUP BY site),
f AS (SELECT k.site, count(*) FILTER (temp BETWEEN 18 AND 30) / count(*) AS share FROM k JOIN w ON w.site = k.site AND day >= as_of AND day < as_of + 7 GROUP BY k.site)
SELECT k.site, as_of, stage, coalesce(chill, 0) AS chill_hours, round(coalesce(chill, 0) / need, 6) AS chill_share, coalesce(degrees, 0) AS growing_degrees, ['low', 'moderate', 'high', 'critical'][coalesce(frost, 0) + 1] AS frost, CASE WHEN frost > 0 THEN frost_day END AS frost_day,
  CASE WHEN share >= 0.5 THEN 'high' WHEN share >= 0.25 THEN 'moderate' ELSE 'low' END AS fly, CASE WHEN stage NOT IN ('ripening', 'harvest') THEN 'low' WHEN rain >= 15 THEN 'critical' WHEN rain >= 8 THEN 'high' WHEN rain >= 3 THEN 'moderate' ELSE 'low' END AS cracking
FROM k LEFT JOIN c USING (site) LEFT JOIN o USING (site) LEFT JOIN f USING (site)""",
)
def season_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sites, each at a day of its own; line items as measurements, with their quantity as temperature and their number a day as rain."""
    key = F.col("n_nationkey")
    sites = read(spark, sf_dir, "nation").select(
        key.alias("site"), F.date_add(F.lit("1998-01-01").cast("date"), key * 37).alias("as_of"), F.when(F.col("n_regionkey") % 2 == 0, "Kordia").alias("variety"), F.when(key % 3 == 0, "bloom").alias("stage")
    )
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("site"), F.col("l_shipdate").alias("time"), (F.col("l_quantity") / 2 - 8).alias("temp"))
    daily = rows.groupBy("site", F.to_date("time").alias("day")).agg(F.min("temp").alias("temp_min_c"), F.max("temp").alias("temp_max_c"), F.count(F.lit(1)).cast("double").alias("precipitation_mm"))
    found = thresholds.season_snapshot(sites, rows, daily)
    return found.withColumns({c: F.round(c, 6) for c in ("chill_share", "growing_degrees")})


_KEYWORDS = ["wat kost een middel", "komt er nachtvorst", "een bui op komst", "hoeveel koude-uren", "is de kersenvlieg er", "barsten ze", "Regen en VORST", "niets"]
_ROUTES = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in words)} THEN '{name}'" for name, words in assistant.ROUTES.items())


@query(
    "question_routes",
    f"SELECT conv_id, turn, CASE {_ROUTES} END AS route FROM (SELECT conv_id, turn, lower(text || ' ' || [{', '.join(chr(39) + k + chr(39) for k in _KEYWORDS)}][(conv_id + turn) % 8 + 1]) AS t FROM conversations WHERE role = 'user')",
)
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of conversations, each with a few words more."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    more = F.element_at(F.array(*[F.lit(k) for k in _KEYWORDS]), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    return turns.select("conv_id", "turn", assistant.route(F.concat_ws(" ", "text", more), assistant.ROUTES).alias("route"))


_NOTICES = ["Dit project is gefinancierd door X.", "Alle rechten voorbehouden", "Lees meer", "03/05/2021", "{menu}", "Een gewone zin die blijft.", "Een kort"]


@query(
    "web_chrome",
    rf"""WITH b AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 3 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind, CASE WHEN (doc_id + pos) % 2 = 0 THEN [{", ".join(f"'{n}'" for n in _NOTICES)}][(doc_id + pos) // 2 % 7 + 1] ELSE line END AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))
SELECT kind, text IN ('Dit project is gefinancierd door X.', 'Alle rechten voorbehouden', '03/05/2021', '{{menu}}') AS boilerplate, len(regexp_extract_all(text, '\S+')) < CASE kind WHEN 'paragraph' THEN 4 ELSE 3 END AND NOT regexp_matches(text, '[.!?:;…]["''”’)\]]*\s*$') AS fragment, count(*) AS n FROM b GROUP BY ALL""",
)
def web_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks of a web page, every other one a notice, a label or a sentence."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    nth = F.col("doc_id") + F.col("pos")
    text = F.when(nth % 2 == 0, F.element_at(F.array(*[F.lit(n) for n in _NOTICES]), (F.floor(nth / 2) % 7 + 1).cast("int"))).otherwise(F.col("line"))
    blocks = rows.select(F.when(nth % 3 == 0, "list_item").otherwise("paragraph").alias("kind"), text.alias("text"))
    return blocks.groupBy("kind", T.boilerplate(F.col("text")).alias("boilerplate"), T.web_fragment(F.col("kind"), F.col("text")).alias("fragment")).agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = r"""t AS (SELECT a.conv_id * 1000 + a.turn AS item, CASE WHEN a.conv_id % 3 = 0 THEN 'guardrail' ELSE 'kennisbank' END AS category, a.text AS answer, CASE WHEN (a.conv_id + a.turn) % 7 = 0 THEN 'timeout' END AS error, length(a.text) / 100 AS seconds,
  CASE WHEN contains(a.text, 'the ') THEN 'green' ELSE 'red' END AS grounding, regexp_extract_all(q.text, '[a-z]{5,}')[1:2] AS facts, trim(regexp_replace(lower(strip_accents(a.text)), '\s+', ' ', 'g')) AS f
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE a.role = 'assistant' AND q.role = 'user'),
e AS (SELECT *, CASE WHEN error IS NULL THEN trim(answer) <> '' END AS answered, CASE WHEN error IS NULL THEN CASE WHEN len(facts) > 0 THEN len(list_filter(facts, lambda x: contains(f, x))) / len(facts) ELSE 1.0 END END AS coverage,
  CASE WHEN error IS NULL AND category = 'guardrail' THEN contains(f, 'the') OR contains(f, 'und') END AS mentions FROM t)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of conversations against the question before, whose first two long words are the facts; some failed, and a third are guardrails."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    facts = F.transform(F.slice(F.regexp_extract_all("question", F.lit("[a-z]{5,}"), F.lit(0)), 1, 2), lambda w: F.array(w))
    answers = rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.when(F.col("conv_id") % 3 == 0, "guardrail").otherwise("kennisbank").alias("category"), F.col("text").alias("answer"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "timeout").alias("error"),
        (F.length("text") / 100).alias("seconds"), F.when(F.contains("text", F.lit("the ")), "green").otherwise("red").alias("grounding"), facts.alias("key_facts"), F.array(F.array(F.lit("the"), F.lit("und"))).alias("must_mention"),
    )
    return evaluation.evaluate_answers(answers)


@query("evaluated_answers", f"WITH {_ANSWERS} SELECT item, error, answered, round(coverage, 6) AS coverage, mentions, mentions AS guardrail_pass FROM e")
def evaluated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("item", "error", "answered", F.round("coverage", 6).alias("coverage"), "mentions", "guardrail_pass")


@query(
    "answer_report",
    f"""WITH {_ANSWERS}, k AS (SELECT seconds, row_number() OVER (ORDER BY seconds) AS k, count(*) OVER () AS m FROM e WHERE error IS NULL)
SELECT count(*) AS n, count(*) FILTER (error IS NOT NULL) AS n_failed, round(avg(answered::INT), 6) AS answered_share, round(avg((grounding = 'green')::INT) FILTER (error IS NULL), 6) AS green_share,
  count(*) FILTER (error IS NULL AND category <> 'guardrail') AS n_content, round(avg(coverage) FILTER (category <> 'guardrail'), 6) AS coverage, round(avg((coverage = 1)::INT) FILTER (category <> 'guardrail'), 6) AS full_share,
  count(*) FILTER (error IS NULL AND category = 'guardrail') AS n_guardrail, round(avg(mentions::INT), 6) AS pass_share, 0::BIGINT AS n_violating, round(avg(seconds) FILTER (error IS NULL), 6) AS seconds_mean, median(seconds) FILTER (error IS NULL) AS seconds_p50,
  (SELECT max(seconds) FROM k WHERE k = greatest(1, least(m, round_even(m * 0.95, 0)::BIGINT))) AS seconds_p95, max(seconds) FILTER (error IS NULL) AS seconds_max FROM e""",
)
def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.answer_report(_evaluated(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("answered_share", "green_share", "coverage", "full_share", "pass_share", "seconds_mean")})
