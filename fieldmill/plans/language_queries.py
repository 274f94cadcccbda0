"""Lexicons, concepts and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant, gate, hyphens, lexicon, quality
from .registry import query, read
from .text_queries import ACCENTS

_CONCEPTS = {"licence": ["licensed", "copyright"], "secret": ["password", "token"], "the": ["the"]}


@query(
    "concept_tags",
    r"""SELECT * FROM (
  SELECT doc_id, 'licence' AS concept, len(regexp_extract_all(lower(text), '\blicensed|\bcopyright'))::INT AS n FROM documents
  UNION ALL SELECT doc_id, 'secret', len(regexp_extract_all(lower(text), '\bpassword|\btoken'))::INT FROM documents
  UNION ALL SELECT doc_id, 'the', len(regexp_extract_all(lower(strip_accents(text)), '\bthe(?:s|en)?\b'))::INT FROM documents) WHERE n > 0""",
)
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.concept_tags(read(spark, sf_dir, "documents"), "doc_id", _CONCEPTS)


@query(
    "lexical_noise",
    r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\p{L}]{3,}')) AS w FROM documents),
lex AS (SELECT lower(w) AS word FROM w GROUP BY 1 HAVING count(*) >= 5),
s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
c AS (SELECT unnest(regexp_extract_all(sentence, '[\p{L}]{3,}')[2:]) AS w FROM s),
p AS (SELECT lower(w) AS word FROM w GROUP BY 1 HAVING count(*) >= 3 UNION SELECT lower(w) FROM c WHERE regexp_matches(w, '^\p{Lu}')),
bad AS (SELECT doc_id, count(*) AS n FROM w WHERE NOT regexp_matches(w, '^\p{Lu}') AND (lower(w) NOT IN (SELECT word FROM lex) AND lower(w) NOT IN (SELECT word FROM p)
 OR regexp_matches(CASE lang WHEN 'de' THEN translate(lower(w), 'äöüß', '') WHEN 'fr' THEN translate(lower(w), 'àâæçéèêëîïôœùûüÿ', '') WHEN 'es' THEN translate(lower(w), 'áéíñóúü', '') ELSE lower(w) END, '[^\x00-\x7F]')) GROUP BY doc_id),
t AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}]{3,}'))::INT AS n_words FROM documents)
SELECT doc_id, n_words, coalesce(n, 0) AS n_unknown, round_even(CASE WHEN n_words = 0 THEN 0 ELSE coalesce(n, 0) / n_words END, 3) AS oov_ratio FROM t LEFT JOIN bad USING (doc_id)""",
)
def lexical_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    terms = gate.settled(gate.vocabulary(gate.chunk_words(docs, "doc_id"), "doc_id"))
    found = gate.noise(docs, "doc_id", terms, known_from=5, accents=ACCENTS)
    return found.select("doc_id", F.col("n_words").cast("int").alias("n_words"), "n_unknown", "oov_ratio")


_PROTECTED = r"""w AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\p{L}]{3,}')) AS w FROM documents),
s AS (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM documents),
c AS (SELECT unnest(regexp_extract_all(sentence, '[\p{L}]{3,}')[2:]) AS w FROM s),
p AS (SELECT lower(w) AS word FROM w GROUP BY 1 HAVING count(*) >= 3 UNION SELECT lower(w) FROM c WHERE regexp_matches(w, '^\p{Lu}'))"""


@query(
    "garbled_tokens",
    rf"""WITH {_PROTECTED},
j AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+[\^{{}}\[\]|\\_~<>#]+[A-Za-z]+|[a-z]\([a-z]')) AS token FROM documents)
SELECT DISTINCT lang, token FROM j
UNION SELECT lang, w FROM w WHERE NOT regexp_matches(w, '^\p{{Lu}}') AND lower(w) NOT IN (SELECT word FROM p) AND regexp_matches(CASE lang WHEN 'de' THEN translate(lower(w), 'äöüß', '') WHEN 'fr' THEN translate(lower(w), 'àâæçéèêëîïôœùûüÿ', '') WHEN 'es' THEN translate(lower(w), 'áéíñóúü', '') ELSE lower(w) END, '[^\x00-\x7F]')""",
)
def garbled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lexicon.garbled_tokens(docs, "lang", quality.protected_terms(docs), accents=ACCENTS)


@query(
    "compound_words",
    r"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}]{3,}'))) AS word FROM documents),
lex AS (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 5), un AS (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT word FROM lex)),
h AS (SELECT word, left(word, i::INT) AS l, substr(word, i::INT + 1) AS r FROM (SELECT word, unnest(generate_series(3, length(word) - 3)) AS i FROM un WHERE length(word) >= 6)),
a AS (SELECT DISTINCT word, r FROM h WHERE l IN (SELECT word FROM lex) OR (suffix(l, 's') OR suffix(l, 'e')) AND left(l, length(l) - 1) IN (SELECT word FROM lex) OR suffix(l, 'en') AND left(l, length(l) - 2) IN (SELECT word FROM lex)),
g AS (SELECT r AS word, left(r, i::INT) AS l, substr(r, i::INT + 1) AS r FROM (SELECT r, unnest(generate_series(3, length(r) - 3)) AS i FROM (SELECT DISTINCT r FROM a WHERE length(r) >= 6))),
b AS (SELECT DISTINCT word FROM g WHERE r IN (SELECT word FROM lex) AND (l IN (SELECT word FROM lex) OR (suffix(l, 's') OR suffix(l, 'e')) AND left(l, length(l) - 1) IN (SELECT word FROM lex) OR suffix(l, 'en') AND left(l, length(l) - 2) IN (SELECT word FROM lex)))
SELECT DISTINCT word FROM a WHERE r IN (SELECT word FROM lex) OR r IN (SELECT word FROM b)""",
)
def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside the lexicon that are compounds of its words."""
    words = read(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = gate.settled(words)
    return lexicon.compounds(terms.where("n < 5").select("word"), terms.where("n >= 5").select("word"))


@query(
    "conversation_list",
    r"""WITH c AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS q, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id), f AS (SELECT *, trim(regexp_replace(coalesce(q, ''), '\s+', ' ', 'g')) AS t FROM c)
SELECT conv_id, CASE WHEN t = '' THEN 'New conversation' WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 60), '\s+\S*$', '') || '…' END AS title, n_turns, last_turn FROM f""",
)
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assistant.conversations_by_recency(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("log_questions", "SELECT 'day' AS kind, 'What was done on ' || strftime(ts, '%Y-%m-%d') || '?' AS question, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'month', 'What was done in ' || strftime(ts, '%Y-%m') || '?', count(*) FROM events GROUP BY ALL")
def log_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_id").alias("entry_id"))
    return assistant.log_questions(entries).select("kind", "question", F.size("entry_ids").cast("long").alias("n"))


_MONTH_NAMES = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]


@query(
    "log_search",
    f"""WITH e AS (SELECT event_id AS entry_id, ts::DATE AS day, string_split(lower(event_type || ' k' || lpad((event_id % 100)::VARCHAR, 2, '0') || 'aa'), ' ') AS words FROM events),
m AS (SELECT [{", ".join(f"'{m}'" for m in _MONTH_NAMES)}] AS names),
q AS (SELECT event_id AS query, [event_type] || CASE WHEN event_id % 3 = 0 THEN ['k' || lpad((event_id % 100)::VARCHAR, 2, '0') || 'aa'] ELSE ['entries'] END AS terms, CASE event_id // 50 % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'month' WHEN 2 THEN 'year' END AS kind, ts::DATE AS day,
  CASE event_id // 50 % 4 WHEN 0 THEN names[month(ts)] WHEN 1 THEN names[month(ts)] END AS month_term, CASE WHEN event_id // 50 % 4 = 1 THEN 2019 ELSE year(ts) END AS y FROM events, m WHERE event_id % 50 = 0),
t AS (SELECT query, kind, day, y, list_filter(list_distinct(terms || CASE WHEN kind IN ('date', 'month') THEN ['wanneer', 'waren', month_term] ELSE ['wanneer', 'waren'] END), lambda x: length(x) >= 4) AS terms FROM q),
c AS (SELECT query, entry_id, kind, CASE kind WHEN 'date' THEN e.day = t.day WHEN 'month' THEN year(e.day) = y AND month(e.day) = month(t.day) WHEN 'year' THEN year(e.day) = y END AS fits, len(list_filter(terms, lambda x: len(list_filter(words, lambda w: contains(w, x) OR length(x) >= 5 AND starts_with(w, left(x, 5)))) > 0)) / len(terms) AS score FROM t, e),
a AS (SELECT query, coalesce(bool_or(fits), false) AS any_fits FROM c GROUP BY query),
r AS (SELECT c.query, entry_id, score, kind, any_fits, row_number() OVER (PARTITION BY c.query ORDER BY score DESC, entry_id DESC) AS rank FROM c JOIN a ON a.query = c.query WHERE NOT any_fits OR fits)
SELECT query, entry_id, round(score, 6) AS score, rank, any_fits AS time_filtered FROM r WHERE rank <= CASE WHEN kind IN ('date', 'month') THEN 8 ELSE 6 END""",
)
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth event as a question about its kind, on its date, in its month of a year that the log lacks, in its year, or at any time."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.to_date("ts").alias("day"), "event_type")
    number = F.concat(F.lit("k"), F.lpad((F.col("entry_id") % 100).cast("string"), 2, "0"), F.lit("aa"))
    entries = rows.select("entry_id", "day", F.concat_ws(" ", "event_type", number).alias("text"))
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTH_NAMES]), F.month("day"))
    year = F.year("day").cast("string")
    turn = F.floor(F.col("entry_id") / 50) % 4
    when = F.when(turn == 0, F.concat_ws(" ", F.lit("op"), F.dayofmonth("day").cast("string"), month, year)).when(turn == 1, F.concat_ws(" ", F.lit("in"), month, F.lit("2019"))).when(turn == 2, F.concat(F.lit("in "), year)).otherwise("")
    question = F.concat(F.lit("Wanneer waren "), "event_type", F.lit(" "), F.when(F.col("entry_id") % 3 == 0, number).otherwise(F.lit("entries")), F.lit(" "), when, F.lit("?"))
    queries = rows.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query"), question.alias("question"))
    return assistant.search_log(entries, queries).withColumn("score", F.round("score", 6))


@query(
    "joined_hyphens",
    r"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[\p{L}]{3,}'))) AS word FROM documents), lex AS (SELECT word FROM w GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '([a-z]{4})([a-z]{4}) ', '\1-' || chr(10) || '\2 ', 'g'), '([a-z]{3}) ([aeiou][a-z]{2,})', '\1-' || chr(10) || '\2', 'g') AS text FROM documents),
l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
x AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following FROM l),
b AS (SELECT *, coalesce(regexp_matches(line, '\p{L}\p{L}-$') AND regexp_matches(following, '^[a-z]{2}'), false) AS broken, lower(regexp_extract(line, '(\p{L}+)-$', 1)) AS a, regexp_extract(following, '^([a-z]+)', 1) AS z FROM x),
k AS (SELECT *, coalesce(broken AND lang = 'en' AND a || z NOT IN (SELECT word FROM lex) AND a IN (SELECT word FROM lex) AND z IN (SELECT word FROM lex), false) AS keep FROM b)
SELECT doc_id, md5(string_agg(CASE WHEN following IS NULL THEN line WHEN broken AND keep THEN line WHEN broken THEN left(line, length(line) - 1) ELSE line || chr(10) END, '' ORDER BY n)) AS text_md5, count(*) FILTER (keep) AS kept_hyphens FROM k GROUP BY doc_id""",
)
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose long words and some pairs of words were broken at line ends, put together again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    broken = F.regexp_replace(F.regexp_replace("text", "([a-z]{4})([a-z]{4}) ", "$1-\n$2 "), "([a-z]{3}) ([aeiou][a-z]{2,})", "$1-\n$2")
    found = hyphens.join_line_breaks(docs.withColumn("text", broken), "doc_id", lexicon.corpus_lexicon(docs))
    return found.select("doc_id", F.md5("text").alias("text_md5"), F.col("kept_hyphens").cast("long").alias("kept_hyphens"))
