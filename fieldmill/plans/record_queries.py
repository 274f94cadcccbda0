"""Nested records, landed answers and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registrations
from ..sources import publishing, snapshots
from .registry import query, read


def _order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: a use whose crops are the order's parts below their flag and status, and whose organisms are its parts below their flag."""
    # dealt by order once, for all groupings
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity").repartition("l_orderkey")
    key, flag = F.col("l_orderkey"), F.col("l_returnflag")
    leaf = F.struct(F.concat(F.lit("part "), "l_partkey").alias("crop"), (F.col("l_quantity") >= 30).alias("selected"))
    organism = F.struct(F.concat(F.lit("org "), "l_partkey").alias("organismScientific"), (F.col("l_quantity") < 20).alias("selected"), F.when(F.col("l_partkey") % 2 == 0, F.array("l_linestatus")).alias("diseases"))
    status = lines.groupBy(key, flag, "l_linestatus").agg(F.array_sort(F.collect_list(leaf)).alias("items"), F.collect_list(organism).alias("organisms"))
    status = status.select(key, flag, F.struct(F.concat(flag, F.lit("/"), "l_linestatus").alias("group"), (key % 4 == 0).alias("complete"), "items").alias("node"), "organisms")
    flags = status.groupBy(key, flag).agg(F.array_sort(F.collect_list("node")).alias("crops"), F.array_sort(F.flatten(F.collect_list("organisms"))).alias("organisms"))
    crops = F.struct(flag.alias("group"), ((key + F.ascii(flag)) % 5 == 0).alias("complete"), F.col("crops").alias("items"))
    organisms = F.struct(F.concat(F.lit("group "), flag).alias("group"), (key % 2 == 0).alias("selected"), F.col("organisms").alias("items"))
    orders = flags.groupBy(key).agg(F.array_sort(F.collect_list(crops)).alias("targetCrops"), F.array_sort(F.collect_list(organisms)).alias("targetOrganisms"))
    uses = F.array(F.struct(F.struct(F.lit("# use").alias("name")).alias("nameOfUse"), "targetCrops", "targetOrganisms"))
    return orders.select(F.to_json(F.struct(F.struct(key.alias("id"), F.lit("P").alias("name"), uses.alias("uses")).alias("data"))).alias("payload"))


@query(
    "record_trees",
    """WITH RECURSIVE nodes AS (
  SELECT DISTINCT l_orderkey AS k, l_returnflag AS id, NULL AS parent, l_returnflag AS name, false AS leaf, (l_orderkey + ascii(l_returnflag)) % 5 = 0 AS chosen FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, l_returnflag || '/' || l_linestatus, l_returnflag, l_returnflag || '/' || l_linestatus, false, l_orderkey % 4 = 0 FROM lineitem
  UNION ALL SELECT l_orderkey, NULL, l_returnflag || '/' || l_linestatus, 'part ' || l_partkey, true, l_quantity >= 30 FROM lineitem),
walk AS (
  SELECT k, id, name, leaf, chosen, false AS whole FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.k, n.id, n.name, n.leaf, n.chosen, w.whole OR w.chosen FROM walk w JOIN nodes n ON n.k = w.k AND n.parent = w.id),
crops AS (SELECT k, string_agg(DISTINCT name, ',' ORDER BY name) AS crops FROM walk WHERE chosen OR leaf AND whole GROUP BY k),
labels AS (
  SELECT l_orderkey AS k, l_returnflag AS flag, 0 AS pos, 'group ' || l_returnflag AS label FROM lineitem WHERE l_orderkey % 2 = 0
  UNION ALL SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY 'org ' || l_partkey, l_quantity < 20, CASE WHEN l_partkey % 2 = 0 THEN l_linestatus END NULLS FIRST), CASE WHEN l_quantity < 20 THEN CASE WHEN l_partkey % 2 = 0 THEN l_linestatus || ' (org ' || l_partkey || ')' ELSE 'org ' || l_partkey END END FROM lineitem),
firsts AS (SELECT k, label, min((flag, pos)) AS place FROM labels WHERE label IS NOT NULL GROUP BY k, label),
organisms AS (SELECT k, string_agg(label, ';' ORDER BY place) AS organisms FROM firsts GROUP BY k)
SELECT k::VARCHAR AS product_id, 'use' AS use_name, coalesce(crops, '') AS crops, coalesce(organisms, '') AS organisms FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN crops USING (k) LEFT JOIN organisms USING (k)""",
)
def record_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registrations.product_uses(_order_records(spark, sf_dir))
    return found.select("product_id", "use_name", F.array_join("crops", ",").alias("crops"), F.array_join("organisms", ";").alias("organisms"))


@query(
    "answers_as_of",
    """WITH a AS (SELECT user_id, ts, max(event_id) AS answer_id FROM events WHERE event_type = 'purchase' GROUP BY ALL),
j AS (SELECT q.event_id, q.ts, a.answer_id, a.ts AS answered FROM (SELECT * FROM events WHERE event_type = 'error') q ASOF LEFT JOIN a ON q.user_id = a.user_id AND q.ts >= a.ts)
SELECT event_id, answer_id, floor(epoch_us(ts - answered) / 86400000000)::BIGINT AS age_days, CASE WHEN answer_id IS NULL THEN 'missing' WHEN epoch_us(ts - answered) < 86400000000 THEN 'fresh' ELSE 'stale' END AS state FROM j""",
)
def answers_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as requests and a user's purchases as answers, fresh for a day."""
    rows = read(spark, sf_dir, "events")
    requests = rows.where("event_type = 'error'").select("user_id", "ts", "event_id")
    answers = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("answer_id"))
    found = snapshots.as_of(requests, answers, "user_id", "ts", fresh_days=1)
    return found.select("event_id", F.col("answer.answer_id").alias("answer_id"), "age_days", "state")


@query(
    "id_digests",
    """WITH t AS (SELECT 'documents' AS name, doc_id::VARCHAR AS id FROM documents UNION ALL SELECT 'labels', doc_id::VARCHAR FROM labels UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR FROM lineitem),
o AS (SELECT name, id, count(*) AS n FROM t GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS rows, count(*) AS ids, sum(('0x' || left(md5(id), 8))::BIGINT)::BIGINT AS digest FROM o GROUP BY name""",
)
def id_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table belongs to another: equal ids and digest mean the same set of ids."""
    keys = {"documents": "doc_id", "labels": "doc_id", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [read(spark, sf_dir, t).select(F.lit(t).alias("name"), F.col(k).cast("string").alias("id")) for t, k in keys.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return publishing.id_digest(both, "id", name="name")
