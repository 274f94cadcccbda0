"""Words against a lexicon: unknown words, compounds, garbled tokens and concept tags.

A lexicon is an input table (word). Where none is at hand, words that are frequent in
the corpus make one; see :func:`corpus_lexicon`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def corpus_lexicon(docs: DataFrame, text: str = "text", least: int = 5) -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORDS), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


#: Fixed: accented letters of each language.
ACCENTS = {"nl": "éèëïóöüêôâçàíá", "en": ""}
_WORDS = r"(?U)" + T.WORD


def _impossible(word: Column, language: Column, accents: dict[str, str]) -> Column:
    """Whether a small word has a letter beyond ASCII that its language doesn't have; a language that isn't listed has none."""
    left = word
    for name, letters in accents.items():
        left = F.when(language == name, F.translate(word, letters, "")).otherwise(left) if letters else left
    return F.regexp(left, F.lit(r"[^\x00-\x7F]"))


def unknown_words(docs: DataFrame, key: str, lexicon: DataFrame, protected: DataFrame, text: str = "text", language: str = "lang", accents: dict[str, str] | None = None, compound_languages: tuple[str, ...] = ("nl",)) -> DataFrame:
    """(key, word, n) of the words of each text that begin small and are noise.

    Words with a letter that their language doesn't have always are; others are if they are in neither table and, in the
    languages with productive compounds, don't split into known words. Words are counted per text first, and
    each distinct word is looked up once.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORDS), F.lit(0))
    rows = docs.select(key, F.col(language).alias("__lang"), F.explode(F.filter(found, lambda w: ~F.regexp(w, F.lit(r"^\p{Lu}")))).alias("w")).select(key, "__lang", F.lower("w").alias("word"))
    counts = rows.groupBy(key, "__lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("__bad", F.coalesce(_impossible(F.col("word"), F.col("__lang"), ACCENTS if accents is None else accents), F.lit(False)))
    distinct = counts.where("NOT __bad").groupBy("word").agg(F.max(F.coalesce(F.col("__lang").isin(*compound_languages), F.lit(False))).alias("__splits"))
    unknown = distinct.join(lexicon.select("word"), "word", "left_anti").join(protected.select(F.col("term").alias("word")), "word", "left_anti")
    made = compounds(unknown.where("__splits").select("word"), lexicon).withColumn("__made", F.lit(True))
    unknown = unknown.select("word").join(made, "word", "left").withColumn("__unknown", F.lit(True))
    noise = F.col("__bad") | (F.coalesce("__unknown", F.lit(False)) & ~(F.coalesce("__made", F.lit(False)) & F.coalesce(F.col("__lang").isin(*compound_languages), F.lit(False))))
    return counts.join(unknown, "word", "left").where(noise).select(key, "word", "n")


def lexical_noise(docs: DataFrame, key: str, unknown: DataFrame, text: str = "text") -> DataFrame:
    """The share of a text's words that are noise (:func:`unknown_words`), to three places; 0 without words."""
    total = docs.select(key, F.size(T.words(F.col(text))).alias("n_words"))
    bad = unknown.groupBy(key).agg(F.sum("n").alias("n_unknown"))
    rows = total.join(bad, key, "left")
    return rows.select(key, "n_words", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.bround(T.ratio(F.coalesce("n_unknown", F.lit(0)), F.col("n_words")), 3).alias("oov_ratio"))


def compounds(words: DataFrame, lexicon: DataFrame, least: int = 3, depth: int = 2) -> DataFrame:
    """Words that split into ``depth`` + 1 known parts or fewer, each of ``least`` letters or more, where a part before the last may end in a linking s, e or en.

    Each cut is joined on its parts; what a cut leaves on the right and isn't known is split in turn, each distinct rest once.
    """
    if not depth:
        return words.select("word").where("false")
    known = lexicon.select(F.col("word").alias("__known")).distinct()
    left = F.expr("left(word, cut)")
    stems = F.array_distinct(F.array_compact(F.array(left, *[F.when(F.endswith(left, F.lit(x)), F.expr(f"left(word, cut - {len(x)})")) for x in ("s", "e", "en")])))
    cuts = words.select("word").distinct().where(F.length("word") >= 2 * least).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("cut"))
    halves = cuts.select("word", F.explode(stems).alias("__known"), F.expr("substring(word, cut + 1)").alias("rest")).join(known, "__known", "left_semi").select("word", "rest").distinct()
    ends = halves.select("rest").distinct().join(known.withColumnRenamed("__known", "rest"), "rest", "left_semi")
    if depth > 1:
        longer = halves.select("rest").distinct().join(ends, "rest", "left_anti").select(F.col("rest").alias("word"))
        ends = ends.union(compounds(longer, lexicon, least, depth - 1))
    return halves.join(ends, "rest", "left_semi").select("word").distinct()


#: Fixed: a stray symbol between letters.
JUNK_INSIDE = r"[A-Za-z]+[\^{}\[\]|\\_~<>#]+[A-Za-z]+|[a-z]\([a-z]"


def garbled_tokens(docs: DataFrame, language: str, protected: DataFrame, text: str = "text", accents: dict[str, str] | None = None) -> DataFrame:
    """(language, token) of tokens with a stray symbol inside, and of words that begin small, aren't protected and have a letter that their language doesn't have."""
    t = F.coalesce(F.col(text), F.lit(""))
    junk = docs.select(language, F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(JUNK_INSIDE), F.lit(0)))).alias("token")).distinct()
    odd = F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(_WORDS), F.lit(0))), lambda w: ~F.regexp(w, F.lit(r"^\p{Lu}")) & F.coalesce(_impossible(F.lower(w), F.col(language), ACCENTS if accents is None else accents), F.lit(False)))
    rows = docs.select(language, F.explode(odd).alias("token")).distinct().withColumn("term", F.lower("token"))
    return junk.union(rows.join(protected.select("term"), "term", "left_anti").select(language, "token")).distinct()


def concept_tags(docs: DataFrame, key: str, aliases: dict[str, list[str]], text: str = "text") -> DataFrame:
    """(key, concept, n): mentions of each concept. An alias of five letters or more also counts as the beginning of a word, a shorter one as a whole word or with an ending s or en."""
    folded = T.fold(F.col(text))

    def pattern(alias: str) -> str:
        plain = "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in alias)
        begin, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
        return begin + plain if len(alias) >= 5 else rf"{begin}{plain}(?:s|en)?{end}"

    counts = [F.struct(F.lit(c).alias("concept"), F.regexp_count(folded, F.lit("|".join(pattern(a) for a in names))).alias("n")) for c, names in aliases.items()]
    return docs.select(key, F.explode(F.filter(F.array(*counts), lambda x: x["n"] > 0)).alias("t")).select(key, "t.concept", "t.n")


def alias_table(concepts: DataFrame) -> DataFrame:
    """(alias, concepts): each alias of ``concepts`` (concept, aliases: array), folded, with the concepts that it stands for, in order."""
    rows = concepts.select("concept", F.explode("aliases").alias("a")).select("concept", T.fold(F.col("a")).alias("alias")).distinct()
    return rows.groupBy("alias").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
