"""Page layout over the lines of documents, as if these were the blocks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout
from .registry import query, read

#: Every ninth line is the caption of a table, every thirteenth a figure; lines of cells are tables.
_BLOCKS = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 9 = 0 THEN 'caption' WHEN (doc_id + pos) % 13 = 0 THEN 'figure' WHEN contains(line, ' | ') THEN 'table' WHEN length(line) = 12 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE WHEN (doc_id + pos) % 9 = 0 THEN 'Table ' || pos || '. ' || regexp_replace(line, '\.$', '') ELSE line END AS text, length(line)::INT AS n FROM l)"""
_WORDS = "len(regexp_extract_all(text, '\\S+'))"
_ENDS = "regexp_matches({}, '[.!?:;…][\"''”’)\\]]*\\s*$')"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    nth = F.col("doc_id") + F.col("pos")
    kind = F.when(nth % 9 == 0, "caption").when(nth % 13 == 0, "figure").when(F.contains("line", F.lit(" | ")), "table").when(F.length("line") == 12, "heading").otherwise("paragraph")
    text = F.when(nth % 9 == 0, F.concat(F.lit("Table "), "pos", F.lit(". "), F.regexp_replace("line", r"\.$", ""))).otherwise(F.col("line"))
    return rows.select("doc_id", "pos", kind.alias("kind"), text.alias("text"), F.length("line").alias("n"))


@query(
    "table_zones",
    rf"""WITH {_BLOCKS},
o AS (SELECT *, {_WORDS} AS w, kind = 'caption' AND regexp_matches(text, '(?i)^(?:[A-Z]{{1,3}}-?\d{{2,6}}\s+)?(?:table|tabel)\s*[\dIVX]+\s*[.:—–-]') AS opens FROM b),
p AS (SELECT *, lag(CASE WHEN opens THEN text END) OVER (PARTITION BY doc_id ORDER BY pos) AS above, last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS zone FROM o),
s AS (SELECT *, coalesce(kind = 'paragraph' AND NOT regexp_matches(above, '[.?]\s*$') AND (regexp_matches(text, '^\p{{Ll}}') OR w < 40), false) AS second FROM p),
r AS (SELECT *, NOT second AND (kind = 'table' OR kind = 'paragraph' AND (regexp_matches(text, '^[\^*†‡]\s?[A-Z][a-z]') AND w <= 70 OR w < 12 AND NOT {_ENDS.format("text")})) AS is_row FROM s),
e AS (SELECT *, min(CASE WHEN NOT opens AND NOT second AND NOT is_row AND kind <> 'figure' THEN pos END) OVER (PARTITION BY doc_id, zone) AS stop FROM r),
i AS (SELECT *, NOT opens AND zone IS NOT NULL AND (stop IS NULL OR pos < stop) AS inner_block, lead(CASE WHEN second THEN text END) OVER (PARTITION BY doc_id ORDER BY pos) AS more FROM e)
SELECT doc_id, pos, kind, md5(CASE WHEN opens AND more IS NOT NULL THEN text || ' ' || more ELSE text END) AS text_md5, 1 AS n_lines FROM i WHERE NOT inner_block
UNION ALL SELECT doc_id, min(pos), 'table', md5(string_agg(text, chr(10) ORDER BY pos)), count(*)::INT FROM i WHERE inner_block AND is_row GROUP BY doc_id, zone""",
)
def table_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.table_zones(_blocks(spark, sf_dir), ("doc_id",))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.md5("text").alias("text_md5"), F.col("pieces").alias("n_lines"))


#: Positions that follow from a line's place and length, so that some pieces are at the caption's edge and near it.
_PLACED = r"""g AS (SELECT doc_id, pos, CASE WHEN kind = 'figure' THEN 'paragraph' ELSE kind END AS kind, text, 50 + 9 * (n % 3) AS x, 20 * pos + n % 4 AS y, 20 * pos + n % 4 + 12 AS y1 FROM b)"""


@query(
    "caption_pieces",
    rf"""WITH {_BLOCKS}, {_PLACED},
a AS (SELECT *, {_WORDS} AS w, last_value(CASE WHEN kind = 'caption' THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge, y - lag(y1) OVER (PARTITION BY doc_id ORDER BY pos) AS gap,
  lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before, last_value(CASE WHEN kind = 'caption' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chain FROM g),
f AS (SELECT *, coalesce(kind = 'paragraph' AND abs(x - edge) <= 14 AND gap BETWEEN -14 AND 12 AND w <= 45 AND (NOT {_ENDS.format("before")} OR NOT regexp_matches(text, '^\p{{Lu}}')), false) AS fits FROM a),
e AS (SELECT *, min(CASE WHEN kind <> 'caption' AND NOT fits THEN pos END) OVER (PARTITION BY doc_id, chain) AS stop FROM f),
k AS (SELECT *, CASE WHEN stop IS NULL OR pos < stop THEN coalesce(chain, pos) ELSE pos END AS block FROM e)
SELECT doc_id, min(pos) AS pos, arg_min(kind, pos) AS kind, count(*) AS pieces, md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5, arg_max(y1, pos)::BIGINT AS y1 FROM k GROUP BY doc_id, block""",
)
def caption_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pos = F.col("n"), F.col("pos")
    placed = _blocks(spark, sf_dir).select("doc_id", "pos", F.when(F.col("kind") == "figure", "paragraph").otherwise(F.col("kind")).alias("kind"), "text", (50 + 9 * (n % 3)).alias("x"), (20 * pos + n % 4).alias("y"), (20 * pos + n % 4 + 12).alias("y1"))
    found = layout.fold_captions(placed, ("doc_id",))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.col("pieces").cast("long").alias("pieces"), F.md5("text").alias("text_md5"), F.col("y1").cast("long").alias("y1"))


@query(
    "run_in_headings",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS x0 FROM l),
s AS (SELECT doc_id, line_no, x0, x0 < (doc_id + line_no) % 11 OR x0 % 17 = 16 AS bold, CASE WHEN x0 = (doc_id + line_no) % 11 AND line_no % 2 = 0 THEN 'Z' || word ELSE word END || ' ' AS text FROM w),
f AS (SELECT *, min(CASE WHEN NOT bold AND trim(text) <> '' THEN x0 END) OVER (PARTITION BY doc_id, line_no) AS plain FROM s),
t AS (SELECT doc_id, line_no, trim(regexp_replace(coalesce(string_agg(text, '' ORDER BY x0) FILTER (plain IS NULL OR x0 < plain), ''), '[ \t]+', ' ', 'g')) AS label,
  trim(regexp_replace(coalesce(string_agg(text, '' ORDER BY x0) FILTER (x0 >= plain), ''), '[ \t]+', ' ', 'g')) AS body, trim(regexp_replace(string_agg(text, '' ORDER BY x0), '[ \t]+', ' ', 'g')) AS whole FROM f GROUP BY ALL),
a AS (SELECT *, label <> '' AND len(string_split(label, ' ')) <= 8 AND regexp_matches(body, '^\p{Lu}') AS apart FROM t)
SELECT doc_id, line_no, 0 AS part, 'heading' AS kind, label AS text FROM a WHERE apart
UNION ALL SELECT doc_id, line_no, 1, NULL, body FROM a WHERE apart
UNION ALL SELECT doc_id, line_no, 0, NULL, whole FROM a WHERE NOT apart AND whole <> ''""",
)
def run_in_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as spans, of which the first (up to ten, by the line's number) are bold, and every seventeenth; on even lines the next word begins with a capital."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = rows.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("x0", "word"))
    nth = (F.col("doc_id") + F.col("line_no")) % 11
    word = F.when((F.col("x0") == nth) & (F.col("line_no") % 2 == 0), F.concat(F.lit("Z"), "word")).otherwise(F.col("word"))
    spans = words.select("doc_id", "line_no", "x0", ((F.col("x0") < nth) | (F.col("x0") % 17 == 16)).alias("bold"), F.concat(word, F.lit(" ")).alias("text"))
    found = layout.run_in_headings(spans, ("doc_id", "line_no"))
    return found.withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "ocr_junk_lines",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ts FROM l)
SELECT doc_id, count(*) AS n FROM t WHERE len(ts) BETWEEN 1 AND 8 AND len(list_filter(ts, lambda x: length(regexp_replace(x, '^[\^*''".,;:]+|[\^*''".,;:]+$', '', 'g')) <= 2)) >= 0.6 * len(ts) AND NOT {_ENDS.format("text")} GROUP BY doc_id""",
)
def ocr_junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    return rows.where(T.ocr_junk(F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
