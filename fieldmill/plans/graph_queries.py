"""Retrieval, graphs, structure and data-set building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets, evaluation, procedures, retrieval, structure
from ..sources import markup
from .registry import query, read

_COS = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
_SCORES = f"scores AS (SELECT q.vec_id AS query, q.label AS query_label, e.vec_id AS vec_id, e.label AS label, {_COS} AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector as a query, and all vectors."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("query_label"), F.col("embedding").alias("query_vector")), rows


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.nearest(*_sides(spark, sf_dir), "query", "vec_id", "query_vector", "embedding", k, ("query_label", "label"))


@query("dense_topk", f"WITH {_SCORES} SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scores) WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "capped_topk",
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scores),
c AS (SELECT *, sum(CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY query, label ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE rank <= 60)
SELECT query, vec_id, label, rank FROM (SELECT query, vec_id, label, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM c WHERE used <= 1 OR vec_id % 10 = 0) WHERE rank <= 6""",
)
def capped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit of a label at most; every tenth vector is a card, which is exempt."""
    pool = _nearest(spark, sf_dir, 60)
    return retrieval.cap_per_group(pool, "query", "label", "rank", 1, exempt=F.col("vec_id") % 10 == 0).where("rank <= 6").select("query", "vec_id", "label", "rank")


@query(
    "hybrid_topk",
    f"""WITH {_SCORES},
t AS (SELECT vec_id AS chunk, label::VARCHAR AS concept, vec_id % 4 = 0 AS in_title FROM embeddings UNION ALL SELECT vec_id, 'm' || vec_id % 7, false FROM embeddings),
f AS (SELECT concept, greatest(0, ln((SELECT count(*) FROM embeddings) / count(DISTINCT chunk)) / ln((SELECT count(*) FROM embeddings))) AS idf FROM t GROUP BY concept),
p AS (SELECT x.concept AS concept, y.concept AS other, count(*) AS w FROM t x JOIN t y ON x.chunk = y.chunk AND x.concept <> y.concept GROUP BY ALL HAVING count(*) >= 2),
n AS (SELECT concept, other FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY w DESC, other) AS k FROM p) WHERE k <= 5),
qc AS (SELECT chunk AS query, concept FROM t WHERE chunk % 50 = 0),
o AS (SELECT DISTINCT query, other AS concept FROM qc JOIN n USING (concept) WHERE NOT EXISTS (SELECT 1 FROM qc z WHERE z.query = qc.query AND z.concept = n.other)),
b AS (SELECT query, chunk, sum(boost) AS boost FROM (
  SELECT query, chunk, 0.1 * idf * CASE WHEN in_title THEN 1.5 ELSE 1.0 END AS boost FROM qc JOIN t USING (concept) JOIN f USING (concept)
  UNION ALL SELECT query, chunk, 0.03 * idf FROM o JOIN t USING (concept) JOIN f USING (concept)) GROUP BY ALL),
h AS (SELECT s.query, s.vec_id, s.score + coalesce(boost, 0) AS score FROM scores s LEFT JOIN b ON b.query = s.query AND b.chunk = s.vec_id)
SELECT query, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM h) WHERE rank <= 6""",
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's concepts are its label, in the title of every fourth, and its place in seven; neighbours are concepts that occur together."""
    rows = read(spark, sf_dir, "embeddings")
    by_label = rows.select(F.col("vec_id").alias("chunk"), F.col("label").cast("string").alias("concept"), (F.col("vec_id") % 4 == 0).alias("in_title"))
    tags = by_label.union(rows.select("vec_id", F.concat(F.lit("m"), F.col("vec_id") % 7), F.lit(False)))
    near = retrieval.neighbours(retrieval.cooccurrence(tags, "chunk", "concept"))
    asked = tags.where("chunk % 50 = 0").select(F.col("chunk").alias("query"), "concept")
    weights = retrieval.concept_weights(asked, retrieval.concept_frequencies(tags, rows.count()), near)
    tagged = tags.groupBy("chunk").agg(F.collect_list(F.struct("concept", F.when(F.col("in_title"), retrieval.TITLE_FACTOR).otherwise(1.0).alias("factor"))).alias("tags"))
    queries, vectors = _sides(spark, sf_dir)
    found = retrieval.nearest(queries.join(weights, "query", "left"), vectors.join(tagged.withColumnRenamed("chunk", "vec_id"), "vec_id", "left"), "query", "vec_id", "query_vector", "embedding", 6)
    return found.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "retrieval_metrics",
    f"""WITH {_SCORES}, r AS (SELECT query, query_label, min(rank) FILTER (label = query_label) AS first_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scores) WHERE rank <= 10 GROUP BY ALL)
SELECT query_label, grouping(query_label)::INT AS level, count(*) AS n, """
    + ", ".join(f"round(avg(coalesce(first_rank <= {k}, false)::INT), 6) AS hit_{k}" for k in evaluation.KS)
    + ", round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg((first_rank IS NULL)::INT), 6) AS miss_rate FROM r GROUP BY GROUPING SETS ((), (query_label))",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit is relevant if it has the query's label."""
    top = _nearest(spark, sf_dir, 10)
    ranks = top.groupBy("query", "query_label").agg(F.min(F.when(F.col("label") == F.col("query_label"), F.col("rank"))).alias("first_rank"))
    found = evaluation.retrieval_summary(ranks, "first_rank", "query_label")
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith("hit_") or c in ("mrr", "miss_rate")})


@query(
    "semantic_valleys",
    """WITH s AS (SELECT label, vec_id, list_dot_product(embedding::DOUBLE[], p) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(p, p))) AS similarity
  FROM (SELECT *, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)),
d AS (SELECT *, max(similarity) OVER (PARTITION BY label ORDER BY vec_id) + max(similarity) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * similarity AS depth FROM s)
SELECT label, vec_id, round(similarity, 6) AS similarity, round(depth, 6) AS depth, coalesce(depth >= greatest(l, 0.05), false) AS boundary FROM d JOIN (SELECT label, quantile_cont(depth, 0.85) AS l FROM d GROUP BY label) USING (label)""",
)
def semantic_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.semantic_boundaries(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return found.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), F.round("depth", 6).alias("depth"), "boundary")


@query(
    "chunk_topics",
    """WITH u AS (SELECT vec_id // 40 AS chunk, vec_id, CASE WHEN vec_id // 40 % 5 = 0 THEN vec_id % 10 ELSE 3 + vec_id * 7 % 60 END AS words, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT *, list_dot_product(e, p) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(p, p))) AS similarity FROM (SELECT *, lag(e) OVER (PARTITION BY chunk ORDER BY vec_id) AS p FROM u)),
d AS (SELECT *, max(similarity) OVER (PARTITION BY chunk ORDER BY vec_id) + max(similarity) OVER (PARTITION BY chunk ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * similarity AS depth, sum(words) OVER (PARTITION BY chunk) > 600 AS long FROM s),
l AS (SELECT chunk, quantile_cont(depth, 0.75) AS l, count(*) AS n FROM d GROUP BY chunk),
b AS (SELECT d.*, sum(coalesce(long AND n >= 4 AND depth >= greatest(l, 0.05), false)::INT) OVER (PARTITION BY d.chunk ORDER BY vec_id) AS part FROM d JOIN l ON l.chunk = d.chunk),
w AS (SELECT chunk, part, sum(words) AS words FROM b GROUP BY ALL),
g AS (SELECT *, sum((part = 0 OR words >= 30)::INT) OVER (PARTITION BY chunk ORDER BY part) AS grp FROM w),
h AS (SELECT *, sum(words) FILTER (grp = 1) OVER (PARTITION BY chunk) AS head FROM g),
q AS (SELECT chunk, part, CASE WHEN head < 30 THEN greatest(1, grp - 1) ELSE grp END AS piece FROM h)
SELECT b.chunk, vec_id, piece::INT AS piece, (max(piece) OVER (PARTITION BY b.chunk))::INT AS pieces FROM b JOIN q ON q.chunk = b.chunk AND q.part = b.part""",
)
def chunk_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty vectors as the paragraphs of a chunk; every fifth chunk is short."""
    chunk = F.floor(F.col("vec_id") / 40)
    words = F.when(chunk % 5 == 0, F.col("vec_id") % 10).otherwise(3 + F.col("vec_id") * 7 % 60)
    units = read(spark, sf_dir, "embeddings").select(chunk.alias("chunk"), "vec_id", words.alias("words"), "embedding")
    return retrieval.topic_pieces(units, "chunk", "vec_id", "words", "embedding").select("chunk", "vec_id", "piece", "pieces")


@query("cooccurrence", "WITH t AS (SELECT DISTINCT l_orderkey AS k, p_brand AS c FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT x.c AS a, y.c AS b, count(*) AS w FROM t x JOIN t y ON x.k = y.k AND x.c < y.c GROUP BY ALL HAVING count(*) >= 2")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that are ordered together."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("c"))
    return retrieval.cooccurrence(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey"), "l_orderkey", "c")


@query("concept_neighbours", "WITH t AS (SELECT DISTINCT l_orderkey AS k, p_brand AS c FROM lineitem JOIN part ON p_partkey = l_partkey), p AS (SELECT x.c AS concept, y.c AS other, count(*) AS w FROM t x JOIN t y ON x.k = y.k AND x.c <> y.c GROUP BY ALL HAVING count(*) >= 2) SELECT concept, other, w FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY w DESC, other) AS k FROM p) WHERE k <= 5")
def concept_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.neighbours(cooccurrence(spark, sf_dir))


@query("concept_idf", "SELECT p_brand AS concept, count(DISTINCT l_orderkey) AS df, round(greatest(0, ln((SELECT count(DISTINCT l_orderkey) FROM lineitem) / count(DISTINCT l_orderkey)) / ln((SELECT count(DISTINCT l_orderkey) FROM lineitem))), 6) AS idf FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def concept_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), "l_partkey")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("concept"))
    n = lines.agg(F.count_distinct("chunk")).first()[0]
    return retrieval.concept_frequencies(lines.join(parts, "l_partkey"), n).withColumn("idf", F.round("idf", 6))


@query("chunk_adjacency", "SELECT l_orderkey * 10 + l_linenumber AS chunk, lag(l_orderkey * 10 + l_linenumber) OVER w AS previous, lead(l_orderkey * 10 + l_linenumber) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def chunk_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"))
    return retrieval.adjacency(rows, "l_orderkey", "l_linenumber", "chunk")


@query(
    "next_edges",
    """WITH p AS (SELECT event_type AS u, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events),
e AS (SELECT u, v, count(*) AS support FROM p WHERE v IS NOT NULL AND u <> v GROUP BY ALL)
SELECT u, v, support, rank FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY support DESC, v) AS rank FROM e) WHERE rank <= 3""",
)
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return procedures.strongest_next(procedures.edges(procedures.next_pairs(steps, "user_id", "at", "event_type")))


@query(
    "graph_nodes",
    """WITH s AS (SELECT l_orderkey AS t, l_partkey AS node, l_returnflag AS family, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
f AS (SELECT node, string_agg(family || ':' || c, ',' ORDER BY family) AS families FROM (SELECT node, family, count(*) AS c FROM s GROUP BY ALL) GROUP BY node)
SELECT node, count(*) AS n_occurrences, count(*) FILTER (k = 1) AS n_starts, count(*) FILTER (k = n) AS n_ends, any_value(families) AS families FROM s JOIN f USING (node) GROUP BY node""",
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, orders as traces, return flags as families."""
    steps = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("family"))
    found = procedures.graph_nodes(steps, "l_orderkey", "at", "node", "family")
    entries = F.transform(F.array_sort(F.map_entries("families")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.withColumn("families", F.array_join(entries, ","))


@query(
    "family_walks",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS t, l_partkey AS node, l_returnflag AS family, row_number() OVER w AS k, lead(l_partkey) OVER w AS after, lead(l_returnflag) OVER w AS after_family FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)),
starts AS (SELECT node, count(*) FILTER (k = 1) AS n_starts FROM s GROUP BY node HAVING count(*) FILTER (k = 1) > 0),
c AS (SELECT family, node, n_starts * count(*) AS w FROM s JOIN starts USING (node) GROUP BY family, node, n_starts),
u AS (SELECT family, node FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY w DESC, node) AS r FROM c) WHERE r = 1),
e AS (SELECT node AS a, after AS b, count(*) AS support FROM s WHERE after IS NOT NULL AND after <> node GROUP BY ALL),
a AS (SELECT a, list(b ORDER BY support DESC, b) AS onward FROM e GROUP BY a),
walk(family, path) AS (SELECT family, [node] FROM u UNION ALL SELECT family, list_append(path, list_filter(onward, lambda v: NOT list_contains(path, v))[1]) FROM walk JOIN a ON a.a = path[-1] WHERE len(path) < 8 AND len(list_filter(onward, lambda v: NOT list_contains(path, v))) > 0)
SELECT family, arg_max(array_to_string(path, '>'), len(path)) AS path FROM walk GROUP BY family""",
)
def family_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks from each family's start."""
    steps = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("family"))
    starts = procedures.start_of(procedures.graph_nodes(steps, "l_orderkey", "at", "node", "family"), "node")
    found = procedures.greedy_walks(procedures.edges(procedures.next_pairs(steps, "l_orderkey", "at", "node")), starts)
    return starts.join(found, starts["u"] == found["start"]).select("family", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "edge_attributes",
    """WITH p AS (SELECT event_type AS u, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, (event_id % 7)::VARCHAR AS source FROM events),
c AS (SELECT u, v, source, count(*) AS n FROM p WHERE v IS NOT NULL AND u <> v GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY n DESC, source) AS k FROM c)
SELECT u, v, string_agg(source, ',' ORDER BY k) AS sources FROM k WHERE k <= 5 GROUP BY u, v""",
)
def edge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", (F.col("event_id") % 7).cast("string").alias("source"))
    found = procedures.top_attributes(procedures.next_pairs(steps, "user_id", "at", "event_type"), "source", procedures.MAX_SOURCES)
    return found.select("u", "v", F.array_join("source", ",").alias("sources"))


@query("canonical_steps")
def canonical_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector leans three to one on the first of its ten, so that some of these are one step."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("first"), F.col("embedding").alias("onto"))
    rows = vectors.withColumn("first", F.col("vec_id") - F.col("vec_id") % 10).join(first, "first")
    rows = rows.withColumn("embedding", F.zip_with("embedding", "onto", lambda x, y: x.cast("double") + 3 * y))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    steps = rows.select(F.col("vec_id").alias("pos"), (F.col("vec_id") % 2).cast("string").alias("guard"), F.concat(F.lit("step "), F.col("vec_id") % 5).alias("action"), F.transform("embedding", lambda x: x / length).alias("embedding"))
    return procedures.canonical_steps(steps)


@query(
    "greedy_walks",
    """WITH RECURSIVE p AS (SELECT l_partkey AS u, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem),
e AS (SELECT u, v, count(*) AS support FROM p WHERE v IS NOT NULL AND u <> v GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY support DESC, v) AS k FROM e),
a AS (SELECT u, list(v ORDER BY k) AS onward FROM k GROUP BY u),
w(start, path) AS (SELECT u, [u] FROM a UNION ALL SELECT start, list_append(path, list_filter(onward, lambda v: NOT list_contains(path, v))[1]) FROM w JOIN a ON a.u = path[-1] WHERE len(path) < 8 AND len(list_filter(onward, lambda v: NOT list_contains(path, v))) > 0)
SELECT start, arg_max(array_to_string(path, '>'), len(path)) AS path, max(len(path))::INT AS n FROM w GROUP BY start""",
)
def greedy_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, each followed by the next one of its order; walks from all of them."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("at"), "l_partkey")
    found = procedures.greedy_walks(procedures.edges(procedures.next_pairs(lines, "l_orderkey", "at", "l_partkey")))
    return found.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("n"))


@query("hash_split_stable", "SELECT doc_id, CASE WHEN (('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 1000) < 100 THEN 'validation' ELSE 'train' END AS split FROM documents")
def hash_split_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.split_by_key(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("holdout_exclusion", "SELECT doc_id FROM documents WHERE md5(lower(trim(text))) NOT IN (SELECT md5(lower(trim(text))) FROM benchmark)")
def holdout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.lower(F.trim("text"))).alias("key")
    return datasets.without_held_out(read(spark, sf_dir, "documents").select("doc_id", key), read(spark, sf_dir, "benchmark").select(key), "key").select("doc_id")


@query(
    "preference_pairs",
    """WITH r AS (SELECT source, doc_id, quality = 1 AS good, row_number() OVER (PARTITION BY source, quality = 1 ORDER BY doc_id) - 1 AS k,
 count(*) FILTER (WHERE quality = 1) OVER (PARTITION BY source) AS ng, count(*) FILTER (WHERE quality <> 1) OVER (PARTITION BY source) AS nb FROM documents JOIN labels USING (doc_id))
SELECT g.source, g.doc_id AS chosen, b.doc_id AS rejected FROM r g JOIN r b ON g.source = b.source AND CASE WHEN g.ng >= g.nb THEN g.k % g.nb = b.k ELSE b.k % g.ng = g.k END WHERE g.good AND NOT b.good""",
)
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return datasets.preference_pairs(rows, "source", "doc_id", F.col("quality") == 1)


_FOLDED = r"trim(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g'))"
_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(" + _FOLDED + ", '[a-z]{{6,}}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in datasets.FORMAT_WORDS) + ")), lambda w: left(w, 6)))"
_NUMBERS = r"list_transform(regexp_extract_all(regexp_replace({}, '(?im)(fragment|kaart|p\.|pagina|blz\.?|stap)\s*\d+(?:\s*[-–,]\s*\d+)*|^\s*\d+[.)]\s', ' ', 'g'), '(^|[^\w.])(\d+(?:[.,]\d+)?)', 2), lambda n: replace(n, ',', '.'))"
_SHARE = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE len(list_filter({0}, lambda v: list_contains({1}, v))) / len({0}) END"


@query(
    "reward_score",
    rf"""WITH t AS (SELECT a.conv_id, a.turn, a.text AS answer, q.text AS question, regexp_extract_all(q.text, '[a-z]{{5,}}')[1:2] AS facts, trim(a.text) AS trimmed, len(regexp_extract_all(a.text, '\S+')) AS words, {_FOLDED.format("a.text")} AS f
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn WHERE a.role = 'assistant' AND q.role = 'user'),
p AS (SELECT *, {_STEMS.format("answer")} AS own, {_STEMS.format("question")} AS allowed, {_NUMBERS.format("answer")} AS said, {_NUMBERS.format("question || ' ' || question")} AS given FROM t),
m AS (SELECT *, CASE WHEN len(facts) > 0 THEN len(list_filter(facts, lambda x: contains(f, x))) / len(facts) ELSE 1.0 END AS coverage, CASE WHEN conv_id % 2 = 0 THEN {_SHARE.format("own", "allowed")} END AS focus,
  regexp_matches(answer, '(?im)^\W*bronnen?\s*:')::INT::DOUBLE AS grounding, {_SHARE.format("said", "given")} AS numeric,
  (trimmed <> '' AND NOT (contains(trimmed, '<think>') AND NOT contains(trimmed, '</think>')) AND CASE WHEN regexp_matches(trimmed, '(?im)^\W*bronnen?\s*:') THEN NOT regexp_matches(trimmed, '(?:,|-|\(| en| of)\s*$') ELSE regexp_matches(trimmed, '(?:[.!?)\]]|\*\*)$') END)::INT::DOUBLE AS complete,
  CASE WHEN words <= 250 THEN 1.0 ELSE greatest(0.0, 1.0 - (words - 250) / 350) END AS concise,
  (NOT (regexp_matches(f, '{T.DOSE_PER_AREA}') OR regexp_matches(f, '{T.DOSE_PER_VOLUME}') OR len(list_filter(regexp_split_to_array(f, '[.;:?!\n]'), lambda c: regexp_matches(c, '{T.AUTHORISATION_CLAIM}') AND NOT regexp_matches(c, '{T.HEDGE}'))) > 0))::INT::DOUBLE AS gate FROM p)
SELECT conv_id, turn, round(coverage, 6) AS coverage, round(focus, 6) AS focus, grounding, round(numeric, 6) AS numeric, complete, round(concise, 6) AS concise, gate,
  round(gate * (0.35 * coverage + 0.2 * coalesce(focus, 0) + 0.1 * grounding + 0.15 * numeric + 0.1 * complete + 0.1 * concise) / CASE WHEN focus IS NULL THEN 0.8 ELSE 1.0 END, 6) AS reward FROM m""",
)
def reward_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns scored against the turn before, whose first two long words are the facts."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"])
    facts = F.transform(F.slice(F.regexp_extract_all("question", F.lit("[a-z]{5,}"), F.lit(0)), 1, 2), lambda w: F.array(w))
    rows = rows.withColumn("context", F.col("question")).withColumn("gold_text", F.when(F.col("conv_id") % 2 == 0, F.col("question"))).withColumn("key_facts", facts)
    return datasets.score_answers(rows).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("coverage", "focus", "grounding", "numeric", "complete", "concise", "gate", "reward")])


@query("html_blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_blocks(read(spark, sf_dir, "pages"), "page_id", "html")


@query("markdown_blocks")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.markdown_blocks(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "pos", "kind", F.md5("text").alias("text_md5"), "level", F.size("urls").alias("n_urls"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = markup.html_blocks(read(spark, sf_dir, "pages"), "page_id", "html")
    kept = structure.without_chrome(structure.drop_adjacent_duplicates(blocks))
    merged = structure.close_sentences(structure.merge_continuations(kept))
    return structure.sections(merged)


@query("page_sections")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sections(spark, sf_dir)
    return found.groupBy("doc_id", "section").agg(F.first("title").alias("title"), F.count(F.lit(1)).alias("n_blocks"), F.array_join(F.first("heading_path"), " > ").alias("path"))


@query("page_chapters")
def page_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chapters(_sections(spark, sf_dir))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.finish_chunks(structure.define_chunks(_sections(spark, sf_dir)))
    return found.select("doc_id", "chunk_index", "chunk_id", "title", "word_count", "merged", "starts_midsentence", "ends_open", "tabular_score")


@query("furniture_lines")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that repeat over the documents of a source, as if these were its pages."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("l"))
    edges = F.array_distinct(F.array(F.struct(F.lit(0).alias("pos"), F.col("l")[0].alias("text")), F.struct(F.lit(1).alias("pos"), F.element_at("l", -1).alias("text"))))
    edge = rows.select("doc_id", "page", F.explode(edges).alias("e")).select("doc_id", "page", "e.*").where(F.length("text").between(6, 90))
    return structure.repeating_furniture(edge, least=3, share=0.05)


@query(
    "robust_outliers",
    """WITH m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events), d AS (SELECT *, greatest(median(abs(value - m)) OVER (PARTITION BY event_type) * 1.4826, 1e-6) AS s FROM m),
z AS (SELECT user_id, event_id::VARCHAR AS t, (value - m) / s AS z FROM d)
SELECT user_id, count(*) AS n, count(*) FILTER (z > 1) AS outliers, round(count(*) FILTER (z > 1) / count(*), 6) AS outlier_share, round(max(z), 6) AS max_z, first(t ORDER BY z DESC, t DESC) AS worst FROM z GROUP BY user_id""",
)
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", "user_id", "value", F.col("event_id").cast("string").alias("text"))
    return evaluation.robust_outliers(rows, "event_type", "user_id", "value", "text", 1.0).withColumns({c: F.round(c, 6) for c in ("outlier_share", "max_z")})


@query("document_ids", "SELECT doc_id, 'chunk_' || left(md5(doc_id || '|' || 0 || '|' || left(text, 200)), 8) AS chunk_id FROM documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.stable_id("chunk", F.col("doc_id"), F.lit(0), F.substring("text", 1, 200)).alias("chunk_id"))
