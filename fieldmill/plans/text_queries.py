"""Text measures, the quality gate and corpus statistics over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import quality
from .registry import query, read

#: Accented letters of the languages of the documents.
ACCENTS = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü"}

_STOP_EN = ", ".join(f"'{w}'" for w in T.STOPWORDS["en"])
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_TOKENS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_WORDS = r"regexp_extract_all(text, '[\p{L}]{3,}')"

_SIGNALS = rf"""
WITH s AS (SELECT doc_id, text, {_LINES} AS ls, {_TOKENS} AS ts, list_transform({_WORDS}, lambda w: lower(w)) AS ws FROM documents)
SELECT doc_id, len(ts)::INT AS words,
  round_even(CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda l: len(regexp_extract_all(l, '\S+')) < 4 AND NOT regexp_matches(l, '[.!?:;]$') AND NOT regexp_matches(l, '^\s*(?:[-•*]|\d{{1,2}}[.)])\s+'))) / len(ls) END, 3) AS fragment_ratio,
  round_even(CASE WHEN len(ts) = 0 THEN 0 ELSE len(list_filter(ts, lambda t: regexp_matches(t, '^[\d.,%±()/\-–+<>=°]+[a-zA-Z%°]{{0,3}}$'))) / len(ts) END, 3) AS tabular_score,
  round_even(CASE WHEN length(text) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[0-9]')) / length(text) END, 3) AS digit_ratio,
  round_even(CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: w IN ({_STOP_EN}))) / len(ws) END, 3) AS stopword_ratio,
  (len(ls) - len(list_distinct(ls)))::INT AS duplicate_lines,
  round_even(CASE WHEN len(regexp_extract_all(text, '\p{{L}}')) = 0 THEN 0 ELSE len(regexp_extract_all(text, '\p{{Lu}}')) / len(regexp_extract_all(text, '\p{{L}}')) END, 3) AS caps_ratio
FROM s"""


@query("text_quality_signals", _SIGNALS)
def text_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.signals(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "words", "fragment_ratio", "tabular_score", "digit_ratio", "stopword_ratio", "duplicate_lines", "caps_ratio")


@query(
    "protected_terms",
    rf"""
WITH w AS (SELECT unnest(list_transform({_WORDS}, lambda w: lower(w))) AS term FROM documents),
s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
c AS (SELECT unnest(regexp_extract_all(sentence, '[\p{{L}}]{{3,}}')[2:]) AS w FROM s)
SELECT term FROM w GROUP BY term HAVING count(*) >= 3
UNION SELECT lower(w) FROM c WHERE regexp_matches(w, '^\p{{Lu}}')""",
)
def protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.protected_terms(read(spark, sf_dir, "documents"))


@query(
    "page_residue_ngrams",
    rf"""
WITH u AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
t AS (SELECT source, doc_id, {_TOKENS} AS w FROM u),
g AS (SELECT source, doc_id, unnest(list_transform(range(0, len(w) - 5), lambda i: {{'gram': lower(array_to_string(w[i + 1:i + 6], ' ')), 'start': i = 0}})) AS g FROM t WHERE len(w) >= 6)
SELECT source, g.gram AS gram, count(DISTINCT doc_id) AS n_chunks, count(*) AS n, count(*) FILTER (g.start) AS n_start
FROM g GROUP BY ALL HAVING count(DISTINCT doc_id) >= 4 AND count(*) FILTER (g.start) >= 0.5 * count(*)""",
)
def page_residue_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return quality.page_residue(lines, "source", "doc_id", "text")


@query(
    "sentence_split_counts",
    r"""
SELECT doc_id, len(s)::INT AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest
FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""",
)
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = T.split_sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(sentences).alias("n_sentences"), F.coalesce(F.array_max(F.transform(sentences, lambda s: F.length(s))), F.lit(0)).alias("longest"))


@query(
    "repetition_loop",
    r"""
WITH s AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM conversations),
c AS (SELECT conv_id, turn, sentence, count(*) AS n FROM s WHERE len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) >= 4 GROUP BY ALL)
SELECT conv_id, turn, coalesce(max(n), 0) >= 3 AS loops FROM conversations LEFT JOIN c USING (conv_id, turn) GROUP BY conv_id, turn""",
)
def repetition_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.repetition_loop(F.col("text")).alias("loops"))


@query(
    "collapsed_repetition",
    r"""WITH s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM conversations),
l AS (SELECT *, list_filter(ss, lambda x: len(regexp_extract_all(x, '\S+')) >= 4) AS long FROM s),
k AS (SELECT *, list_filter(ss, lambda x, i: len(regexp_extract_all(x, '\S+')) < 4 OR list_position(ss, x) = i) AS kept FROM l),
e AS (SELECT *, coalesce(list_max(list_transform(kept, lambda x, i: CASE WHEN regexp_matches(x, '[.!?)*:]\s*$') THEN i ELSE 0 END)), 0) AS last FROM k)
SELECT conv_id, turn, length(CASE WHEN coalesce(list_max(list_transform(list_distinct(long), lambda x: len(list_filter(long, lambda y: y = x)))), 0) >= 3 THEN array_to_string(kept[1:last], ' ') ELSE text END)::INT AS n_chars FROM e""",
)
def collapsed_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(T.collapse_repetition(F.col("text"))).alias("n_chars"))


@query(
    "redact_patterns",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]{3}-[0-9]{4}', '[NUMBER]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[ADDRESS]', 'g')) AS redacted FROM documents""",
)
def redact_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = T.redact(F.col("text"), {"NUMBER": r"[0-9]{3}-[0-9]{4}", "ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"})
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(redacted).alias("redacted"))


_KEYWORDS = {"function": ["the ", "und ", "les "], "licence": ["licensed", "copyright"], "credential": ["password", "token"], "contact": ["@", "+1 ("]}


@query(
    "keyword_multilabel",
    "WITH k(category, word) AS (VALUES ('function', 'the '), ('function', 'und '), ('function', 'les '), ('licence', 'licensed'), ('licence', 'copyright'), ('credential', 'password'), ('credential', 'token'), ('contact', '@'), ('contact', '+1 (')) "
    "SELECT DISTINCT doc_id, category FROM documents JOIN k ON contains(lower(text), word)",
)
def keyword_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {c: [w.replace("+", r"\+").replace("(", r"\(") for w in ws] for c, ws in _KEYWORDS.items()}
    return quality.keyword_categories(read(spark, sf_dir, "documents"), words, "text", "doc_id")


@query(
    "semi_anti_filters",
    """
SELECT 'semi' AS kind, source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source
UNION ALL SELECT 'anti', source, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source""",
)
def semi_anti_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    semi = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.lit("semi").alias("kind"), "source")
    anti = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select(F.lit("anti").alias("kind"), "source")
    return semi.union(anti).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "last_n_turns",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 4",
)
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two exchanges of each conversation."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", k.alias("k")).where("k <= 4").drop("k")


@query("deep_questions", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) > 18 OR regexp_matches(' ' || lower(trim(text)) || ' ', ' en | maar | zowel | rekening houdend| gelijktijdig| allebei| beide| tegelijk| waarom | hoe kan het dat| welke van de| of moet ik') AS deep FROM conversations WHERE role = 'user'")
def deep_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.needs_deep_thinking(F.col("text")).alias("deep"))


@query("document_quality_report", "SELECT source, count(*) AS n, min(w)::INT AS min_words, trunc(median(w))::INT AS median_words, max(w)::INT AS max_words FROM (SELECT source, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY source")
def document_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", T.word_count(F.col("text")).alias("w"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("min_words"), F.median("w").cast("int").alias("median_words"), F.max("w").alias("max_words"))
