"""The quality gate: signals of a chunk, its verdict, and corpus statistics behind them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prose
from ..functions import text as T
from .linking import settled

SIGNALS = (
    "words", "sentence_ratio", "fragment_ratio", "tabular_score", "digit_ratio", "reference_score", "stopword_ratio", "duplicate_lines", "caps_ratio",
    "n_sentences", "incomplete_sentences", "first_incomplete", "last_incomplete", "hyphens", "incomplete_examples",
)
#: Fixed: titles of lists of references and of what belongs to a site and not to its text.
REFERENCE_TITLE = r"(?i)literature cited|literatuur|references|referenties|bibliograph|bronnen en|verder lezen|further readings?|about the authors"
CHROME_TITLE = r"(?i)^(nieuws|reacties?|disqus|gerelateerd\w*|volg ons|nieuwsbrief|contact|uitgever|colofon|over deze praktijksamenvatting|permalink|projectnaam)\b"
#: Hashes of runs that are sent to all tasks, at most.
MOST_BROADCAST_RUNS = 4_000_000
#: Fixed: kinds of chunks that may be short.
STANDALONE = ("probleem",)


def sentence_flags(sentences: Column) -> Column:
    """For each sentence whether it is complete: it begins like one, ends like one and has three words."""
    return F.transform(sentences, lambda s: F.regexp(s, F.lit("^[\\p{Lu}\\p{Nd}\"'“‘(]")) & F.regexp(s, F.lit("[.!?:;…][\"')”’]*$")) & (T.word_count(s) >= 3))


def _measures(text: pa.Array, language: pa.Array) -> pa.Array:
    columns = zip(*map(prose.measures, text.to_pylist(), language.to_pylist()), strict=True) if len(text) else [[]] * len(prose.MEASURES)
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.StructArray.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, prose.MEASURES, strict=True)], [n for n, _ in prose.MEASURES])


def signals(docs: DataFrame, text: str = "text", language: str = "lang", terms: str | None = None) -> DataFrame:
    """``docs`` with the structural signals of their text; ratios to three places, half to even. A text is read once, in Python; the number of its words goes to the column ``terms``."""
    m = lambda n: F.col(f"__m.{n}")
    ratio = lambda a, b: F.bround(T.ratio(m(a), m(b)), 3)
    measured = F.arrow_udf(_measures, "struct<" + ", ".join(f"{n}: {t}" for n, t in prose.MEASURES) + ">")
    found = docs.withColumn("__m", measured(text, F.col(language).cast("string")))
    return found.withColumns(
        {
            "words": m("words"), "sentence_ratio": ratio("good", "plain"), "fragment_ratio": ratio("fragments", "lines"), "tabular_score": ratio("numeric", "words"), "digit_ratio": ratio("digits", "length"),
            "reference_score": F.bround(m("references") / F.greatest(F.lit(1), m("words")), 3), "stopword_ratio": ratio("stop", "terms"), "duplicate_lines": m("duplicate_lines"), "caps_ratio": ratio("capitals", "letters"),
            **{n: m(n) for n in ("n_sentences", "incomplete_sentences", "first_incomplete", "last_incomplete", "hyphens", "incomplete_examples")}, **({terms: m("terms").cast("long")} if terms else {}),
        }
    ).drop("__m")


def _or_default(rows: DataFrame, column: str, default: Column) -> Column:
    """A column that a row may lack, as chunks without a title or unscored sentences do."""
    return F.coalesce(F.col(column), default) if column in rows.columns else default


def verdict(rows: DataFrame) -> DataFrame:
    """``rows`` with verdict (references, fail, warn or ok, the first that applies), its reasons in order and their categories.

    Beside the signals a row may have title, heading_path, type, oov_ratio, page_residue, and outliers with
    outlier_share of its sentences' losses; a rule on a column that is not there doesn't apply.
    """
    c = F.col
    title = _or_default(rows, "title", F.lit(""))
    headings = F.concat_ws(" ", title, _or_default(rows, "heading_path", F.array().cast("array<string>")))
    oov, residue = _or_default(rows, "oov_ratio", F.lit(0.0)), _or_default(rows, "page_residue", F.lit(False))
    outliers, share = _or_default(rows, "outliers", F.lit(0)), _or_default(rows, "outlier_share", F.lit(0.0))
    running = ~_or_default(rows, "type", F.lit("")).isin(*STANDALONE)
    # fixed: the thresholds below and the order of the rules
    references = F.regexp(headings, F.lit(REFERENCE_TITLE)) | ((c("words") >= 25) & (c("reference_score") >= 0.12)) | ((c("words") >= 8) & (c("caps_ratio") >= 0.45) & (c("reference_score") >= 0.05))
    chrome = F.regexp(title, F.lit(CHROME_TITLE))
    inner = c("incomplete_sentences") - c("first_incomplete").cast("int") - c("last_incomplete").cast("int")
    fail = (
        ("table", "no running sentences", (c("words") >= 25) & running & (c("sentence_ratio") < 0.35)),
        ("table", "table", (c("words") >= 12) & (c("tabular_score") >= 0.45)),
        ("ocr", "many unknown words", oov >= 0.12),
        ("language", "language", (c("stopword_ratio") < 0.03) & (c("words") >= 50) & running),
        ("columns", "mixed columns", (outliers >= 2) & (share >= 0.25)),
        ("page_break", "begins inside a sentence", c("first_incomplete")),
        ("page_break", "ends inside a sentence", c("last_incomplete")),
        ("incomplete", "incomplete sentences", inner > 0),
        ("incomplete", "too little text", (c("words") < 8) & running),
        ("page_break", "page residue", residue),
    )
    warn = (
        ("ocr", "unknown words", oov >= 0.06),
        ("page_break", "hyphens of line ends", F.size("hyphens") > 0),
        ("table", "fragments", (c("fragment_ratio") >= 0.3) & (c("words") >= 20)),
        (None, "duplicate lines", c("duplicate_lines") > 0),
        ("columns", "unlikely sentences", outliers >= 1),
    )
    met = lambda rules: F.filter(F.array(*[F.struct(F.lit(k).cast("string").alias("category"), F.lit(r).alias("reason"), F.coalesce(x, F.lit(False)).alias("met")) for k, r, x in rules]), lambda x: x["met"])
    only = lambda k, r: F.array(F.struct(F.lit(k).alias("category"), F.lit(r).alias("reason"), F.lit(True).alias("met")))
    rows = rows.withColumn("__fail", met(fail)).withColumn("__warn", met(warn))
    failed, warned = F.size("__fail") > 0, F.size("__warn") > 0
    rows = rows.withColumn("verdict", F.when(references, "references").when(chrome | failed, "fail").when(warned, "warn").otherwise("ok"))
    why = F.when(references, only("references", "bibliography")).when(chrome, only("chrome", "part of the site")).when(failed, c("__fail")).otherwise(c("__warn"))
    rows = rows.withColumn("__why", why)
    return rows.withColumn("reasons", F.transform("__why", lambda x: x["reason"])).withColumn("categories", F.array_distinct(F.array_compact(F.transform("__why", lambda x: x["category"])))).drop("__fail", "__warn", "__why")


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """A verdict that a person gave (key, override) wins."""
    return rows.join(overrides, key, "left").withColumn("verdict", F.coalesce("override", "verdict")).drop("override")


def indexable(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("verdict"), F.lit("ok")).isin("ok", "warn"))


def failing(rows: DataFrame) -> DataFrame:
    """Rows that need a look, with ``severity``: 1 for fail, 2 for references, 3 for warn. A list shows them by severity, document and index."""
    rank = F.array_position(F.array(*[F.lit(v) for v in ("fail", "references", "warn")]), F.col("verdict"))
    return rows.where(F.col("verdict").isin("fail", "references", "warn")).withColumn("severity", rank.cast("int"))


def issue_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How often each category of issue occurs."""
    return rows.select(*keys, F.explode("categories").alias("category")).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def verdict_counts(rows: DataFrame, group: str) -> DataFrame:
    """Verdicts by group, one column each."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("ok", "warn", "fail", "references")])


def protected_terms(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Words that occur ``least`` times in all texts, or with a capital inside a sentence. Texts are read once, and words are counted per task before they are shuffled."""
    in_sentence = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(?U)" + T.WORD), F.lit(0)), lambda w, i: F.struct(F.lower(w).alias("term"), ((i > 0) & F.regexp(w, F.lit(r"^\p{Lu}"))).alias("inner")))
    rows = docs.select(F.explode(F.flatten(F.transform(T.split_sentences(F.col(text)), in_sentence))).alias("w")).select("w.*")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).where((F.col("n") >= least) | F.col("inner")).select("term")


def page_residue(units: DataFrame, document: str, chunk: str, text: str, size: int = 6, least: int = 4) -> DataFrame:
    """Runs of six words that occur in four chunks of a document or more, at least half of them at the start of a unit.

    A run that half the time begins a unit does so twice at least, so that only runs that begin two units of a document are counted, by
    a 64-bit hash of document and words; the words come back for the survivors only. A null document is one of its own. No filter reads a text.
    """
    w, low = F.col("__w"), F.lower(F.coalesce(F.col(text), F.lit("")))
    run = lambda i: F.xxhash64(F.coalesce(F.col(document).cast("string"), F.lit("\0")), *[F.xxhash64(F.get(w, i + k)) for k in range(size)])
    # a unit's first words, of which white space may be one more piece before and the rest one after
    heads = units.select(document, F.slice(F.filter(F.split(low, r"\s+", size + 2), lambda t: t != ""), 1, size).alias("__w"))
    heads = heads.select(document, F.coalesce(F.when(F.size(w) == size, run(F.lit(0))), F.lit(0).cast("long")).alias("h"), F.array_join(w, " ").alias("gram"))
    firsts = settled(heads.groupBy("h").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= 0.5 * least).select("h"))
    near = lambda t: F.broadcast(t) if t.count() <= MOST_BROADCAST_RUNS else t
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size))
    # an outer explode, as a plain one has its array made once more for a filter
    runs = units.select(document, chunk, T.tokens(low).alias("__w")).select(document, chunk, F.explode_outer(F.transform(starts, lambda i: F.struct(run(i).alias("h"), (i == 0).alias("start")))).alias("g")).select(document, chunk, "g.*")
    by_chunk = runs.join(near(firsts), "h", "left_semi").groupBy(document, "h", chunk).agg(F.count(F.lit(1)).alias("n"), F.count_if("start").alias("s"))
    found = by_chunk.groupBy(document, "h").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n"), F.sum("s").alias("n_start"))
    found = settled(found.where((F.col("n_chunks") >= least) & (F.col("n_start") >= 0.5 * F.col("n"))))
    # half of a survivor's occurrences begin a unit, so its words are those of such a unit
    words = heads.select("h", "gram").join(near(found.select("h")), "h", "left_semi").distinct()
    return found.join(words, "h").select(document, "n_chunks", "n", "n_start", "gram")


def repair(rows: DataFrame, text: str = "text", most: float = 0.3, garbled: str | None = None) -> DataFrame:
    """Texts without their incomplete sentences and those that hold a token of the array column ``garbled``, if these are three tenths or fewer; the raw text and what was dropped are kept. Always made from text_raw, so that repairing twice changes nothing."""
    raw = F.col("text_raw") if "text_raw" in rows.columns else F.col(text)
    # sentences and their flags are columns, so that they are made once a row
    rows = rows.withColumn("__sentences", T.whole_sentences(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\n+", " \n ")))
    sentences = F.col("__sentences")
    damaged = F.col(garbled) if garbled else F.array().cast("array<string>")
    hurt = lambda s: F.exists(damaged, lambda g: F.when(F.regexp(g, F.lit(r"^\p{L}+$")), F.array_contains(T.words(s), F.lower(g))).otherwise(F.contains(s, g)))
    flags = F.zip_with(sentence_flags(sentences), sentences, lambda f, s: f & ~F.coalesce(hurt(s), F.lit(False)))
    rows = rows.withColumn("__pairs", F.zip_with(sentences, flags, lambda s, f: F.struct(s.alias("s"), F.coalesce(f, F.lit(False)).alias("f"))))
    pairs = F.col("__pairs")
    good = F.transform(F.filter(pairs, lambda p: p["f"]), lambda p: p["s"])
    bad = F.transform(F.filter(pairs, lambda p: ~p["f"]), lambda p: p["s"])
    can = (F.size(bad) > 0) & (F.size(good) > 0) & (F.size(bad) <= most * F.size(sentences))
    return rows.withColumn("text_raw", raw).withColumn("repairs", F.when(can, bad).otherwise(F.array().cast("array<string>"))).withColumn(text, F.when(can, F.array_join(good, " ")).otherwise(raw)).drop("__sentences", "__pairs")


def keyword_categories(rows: DataFrame, keywords: dict[str, list[str]], text: str, key: str) -> DataFrame:
    """A row for each category of which a keyword is in the text."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.regexp(low, F.lit("|".join(k.replace(".", r"\.") for k in words))), F.lit(c)) for c, words in keywords.items()]))
    return rows.select(key, F.explode(found).alias("category"))


#: Fixed: keywords of the categories of remarks.
TARGET_KEYWORDS = {
    "fruitvliegen": ["kersenvlieg", "suzukii", "suzuki vlieg", "suzuki fruitvlieg", "suzuki-fruitvlieg", "fruitvlieg"],
    "vruchtrot": ["vruchtrot", "monilia", "monillia"],
    "bacterie_kanker": ["pseudomonas", "bacterie", "bacterien", "bacteriën", "kanker"],
    "bladvlekkenziekte": ["bladvlekkenziekte", "bladvlekziekte"],
    "bladvalziekte": ["bladvalziekte", "bladval"],
    "hagelschot": ["hagelschot"],
    "spint": ["spint"],
    "luis": ["luis", "luizen", "kersenluis"],
    "rupsen": ["rupsen", "bladroller"],
    "bestuiving": ["bestuiving", "bijen", "bijenkast", "bloesem"],
    "voeding": ["voedingssupplement", "bladvoeding", "boomversterker", "bemesting", "stikstof", "kunstmest"],
}
#: Fixed: how much each category weighs for the harvest.
TARGET_WEIGHTS = {"fruitvliegen": 1.0, "vruchtrot": 0.95, "bacterie_kanker": 0.6, "bladvlekkenziekte": 0.5, "bladvalziekte": 0.5, "hagelschot": 0.55, "spint": 0.4, "luis": 0.4, "rupsen": 0.4, "bestuiving": 0.9, "voeding": 0.3}
