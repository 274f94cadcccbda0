"""Words that a line end broke, joined by the language of their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import settled

#: A hyphen at a line end between two letters and two small ones; the literal part leads, so that a text is scanned for it alone.
LINE_BREAK = r"-\n(?<=\p{L}\p{L}-\n)(?=[a-z]{2})"
#: A lexicon of so many words is sent to all tasks, as hashes.
MOST_BROADCAST_WORDS = 4_000_000


def join_line_breaks(docs: DataFrame, key: str, lexicon: DataFrame, text: str = "text", language: str = "lang", hyphenating: tuple[str, ...] = ("en",)) -> DataFrame:
    """``docs`` with broken words joined in ``text``, and ``kept_hyphens``, how many of them stay compounds.

    Usually the hyphen goes. In the languages that write compounds with a hyphen it stays where the lexicon (word) knows both
    halves and not the joined word. Breaks are looked up by hash where they are, or, with a lexicon too large to be sent to all tasks, each distinct
    pair of halves once; the decisions come back by the place of the break. Texts in other languages aren't moved, and no filter reads a text, as a text
    that is an expression would be made once more for it. A null language joins always. Keys are unique and not null; a null text stays null.
    """
    many = F.coalesce(F.col(language).isin(*hyphenating), F.lit(False))
    p = F.col("__pieces")
    sides = F.transform(F.when(F.size(p) > 1, F.sequence(F.lit(0), F.size(p) - 2)), lambda i: F.struct(i.alias("at"), F.get(p, i).alias("before"), F.get(p, i + 1).alias("after")))
    # an outer explode, as a plain one has its array made once more for a filter
    cut = docs.where(many).select(key, F.split(text, LINE_BREAK).alias("__pieces")).select(key, F.explode_outer(sides).alias("b")).select(key, "b.*").where("at IS NOT NULL")
    breaks = cut.select(key, "at", F.lower(F.regexp_extract("before", r"(\p{L}+)$", 1)).alias("left"), F.regexp_extract("after", "^([a-z]+)", 1).alias("right"))
    words = settled(lexicon.where("word IS NOT NULL").select(F.xxhash64("word").alias("h")).distinct())
    small = words.count() <= MOST_BROADCAST_WORDS
    near = F.broadcast if small else lambda t: t
    halves = {"l": F.xxhash64("left"), "r": F.xxhash64("right"), "j": F.xxhash64(F.concat("left", "right"))}

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(halves)
        for h in halves:
            rows = rows.join(near(words.select(F.col("h").alias(h), F.lit(True).alias(f"has_{h}"))), h, "left")
        return rows.withColumn("keep", F.col("has_l").isNotNull() & F.col("has_r").isNotNull() & F.col("has_j").isNull())

    judged = marked(breaks) if small else breaks.join(marked(breaks.select("left", "right").distinct()).select("left", "right", "keep"), ["left", "right"])
    # the places of a text's breaks, in order, are 0 and so on: an odd number keeps its hyphen
    glue = judged.groupBy(key).agg(F.sort_array(F.collect_list(2 * F.col("at") + F.col("keep").cast("int"))).alias("__glue"), F.count_if("keep").cast("int").alias("__kept"))
    joined = F.array_join(F.transform(F.split(text, LINE_BREAK), lambda piece, i: F.when(F.get(F.col("__glue"), i) % 2 == 1, F.concat(piece, F.lit("-"))).otherwise(piece)), "")
    plain = docs.where(~many).withColumn(text, F.regexp_replace(text, LINE_BREAK, "")).withColumn("kept_hyphens", F.lit(0))
    decided = docs.where(many).join(glue, key, "left").withColumn(text, joined).withColumn("kept_hyphens", F.coalesce("__kept", F.lit(0)))
    return plain.unionByName(decided.drop("__glue", "__kept"))
