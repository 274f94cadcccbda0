"""Around a question: routes, context, sources, history and saved conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Fixed: keywords of the routes of a question, in the order in which they are tried; a question without one goes to the model.
ROUTES = {
    "registration": ["middel", "dosering", "toegelaten", "ctgb", "spuiten met"], "frost": ["vorst", "nachtvorst", "koud vannacht"], "rain": ["regen", "neerslag", "bui"],
    "chill": ["koude-uren", "chill", "rust-uren"], "fly": ["suzuki", "kersenvlieg", "fruitvlieg", "drosophila"], "cracking": ["barst", "oogst", "vruchtrot"],
}


def route(question: Column, routes: dict[str, list[str]]) -> Column:
    """The first route of which a keyword is in the question; null without one."""
    low, found = F.lower(question), F.lit(None).cast("string")
    for name, keywords in reversed(routes.items()):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        found = F.when(hit, name).otherwise(found)
    return found


def personal_history(question: Column) -> Column:
    """Whether a question is about what the asker did."""
    return F.regexp(T.fold(question), F.lit(r"\b(heb ik|hebben we|deed ik|deden we|mijn logboek|ons logboek|vorig jaar|did i|did we|my log)\b"))


def title_of(question: Column, most: int = 60) -> Column:
    """The first line of a question on one line, cut at a word where it is too long."""
    flat = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(flat == "", "New conversation").when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def context_of(hits: DataFrame, query: str) -> DataFrame:
    """The hits of each query as numbered fragments in the order of their rank, without doses."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.regexp_replace(F.regexp_replace("text", T.DOSE_PER_AREA, "[dose: see the label]"), T.DOSE_PER_VOLUME, "[dose: see the label]"))
    rows = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return rows.select(query, F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))


def sources_of(hits: DataFrame, query: str) -> DataFrame:
    """The documents of each query's hits, once each, by their best rank."""
    first = hits.groupBy(query, "doc_id").agg(F.min("rank").alias("rank"))
    return first.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l")).select(query, F.transform("l", lambda x: x["doc_id"]).alias("sources"))


def without_notice(answer: Column, mark: str = "*Let op:") -> Column:
    """An answer without the notice that follows it."""
    return F.trim(F.substring_index(answer, "\n\n" + mark, 1))


def conversations_by_recency(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, title, turns and last turn of each conversation; a list shows them by last turn falling, then key."""
    first = F.min_by(text, F.when(F.col(role) == "user", F.col(turn)))
    found = turns.groupBy(key).agg(first.alias("q"), F.count(F.lit(1)).alias("n_turns"), F.max(turn).alias("last_turn"))
    return found.select(key, title_of(F.col("q")).alias("title"), "n_turns", "last_turn")


def _prefixed(prefix: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(prefix), x.cast("string"))


#: Fixed: hits of a question, and of one that names a date or a month.
MOST_HITS, MOST_TIMED_HITS = 6, 8
#: Letters by which terms and words meet; a term has as many at least.
GRAM = 4


def _time_keys(hints: Column) -> Column:
    """A named time as keys: dates, else years with months, years, or months."""
    text = lambda c: c.cast("string")
    dates = F.transform(hints["dates"], lambda d: F.concat(F.lit("d"), text(d)))
    both = F.flatten(F.transform(hints["years"], lambda y: F.transform(hints["months"], lambda m: F.concat(F.lit("b"), text(y), F.lit("-"), text(m)))))
    years, months = (F.transform(hints[h], _prefixed(p)) for h, p in (("years", "y"), ("months", "m")))
    return F.array_distinct(F.when(F.size(dates) > 0, dates).when(F.size(both) > 0, both).when(F.size(years) > 0, years).otherwise(months))


def _day_keys(day: Column) -> Column:
    year, month = F.year(day).cast("string"), F.month(day).cast("string")
    return F.array(F.lit(""), F.concat(F.lit("d"), day.cast("string")), F.concat(F.lit("b"), year, F.lit("-"), month), F.concat(F.lit("y"), year), F.concat(F.lit("m"), month))


def term_hits(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(term, word) where the word holds the term, or begins with its first five letters. Both are tables of distinct values that meet by four letters in a row."""
    first = terms.select("term", F.explode(F.array_distinct(F.array(F.substring("term", 1, GRAM)))).alias("g"))
    at = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    grams = words.where(F.length("word") >= GRAM).select("word", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))).alias("g"))
    holds = F.contains("word", F.col("term")) | ((F.length("term") >= 5) & F.startswith("word", F.substring("term", 1, 5)))
    return first.join(grams, "g").where(holds).select("term", "word").distinct()


def search_log(entries: DataFrame, queries: DataFrame, most: int = MOST_HITS, dense: DataFrame | None = None) -> DataFrame:
    """(query, entry_id, score, rank, time_filtered): the best entries of each question, those of the times it names (all if there are none), by word and dense score.

    entries: entry_id, day, text; queries: query, question; ``dense`` has query, entry_id and the dense score of each question's nearest entries. The
    word score is the share of the question's terms that an entry holds. Texts are found by postings: distinct words of texts
    meet distinct terms. Entries of one text and time differ only in their number, so only the latest of them are looked at, as many as are ever
    wanted; where the texts with a term have too few, the latest entries of the named time follow with a score of 0. So neither a table of all questions and
    entries is made, nor one of all entries with a frequent term. Questions of the same terms and times are answered once. Ties go to the greater entry_id.
    """
    deep = max(most, MOST_TIMED_HITS)
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(T.fold(F.col("question")), F.lit(r"\b[a-z][a-z0-9]{3,}\b"), F.lit(0))))
    asked = queries.select("query", T.time_hints(F.col("question")).alias("hints"), terms.alias("terms")).withColumn("keys", _time_keys(F.col("hints")))
    narrow = (F.size("hints.dates") > 0) | (F.size("hints.months") > 0)
    asked = asked.withColumn("limit", F.when(narrow, deep).otherwise(most)).withColumn("own", F.col("query") if dense is not None else F.lit(0))
    asked = asked.withColumn("q", F.xxhash64("own", F.array_join("terms", " "), F.array_join("keys", " "), "limit"))
    once = asked.dropDuplicates(["q"]).select("q", "own", "terms", "keys", "limit")
    dated = entries.select("entry_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array_compact(_day_keys(F.col("day")))).alias("key"))
    # the latest entries of each text and time
    last = F.row_number().over(Window.partitionBy("key", "text").orderBy(F.desc("entry_id")))
    classes = dated.withColumn("k", last).where(F.col("k") <= 2 * deep).select("key", "text", "entry_id")
    # the named times that the log has; a question without one is asked of all entries
    wanted = once.select("q", F.explode("keys").alias("key"))
    there = wanted.join(classes.select("key").distinct(), "key", "left_semi")
    open_ = once.select("q").join(there.select("q").distinct(), "q", "left_anti").select("q", F.lit("").alias("key"))
    keys = there.select("q", "key").unionByName(open_)
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("entry_id")))
    spare = classes.withColumn("k", latest).where(F.col("k") <= 2 * deep).join(keys, "key").select("q", "entry_id", F.lit(0).alias("hits"), F.lit(0.0).alias("d")).distinct()
    held = classes.select("text").distinct().select("text", F.explode(F.array_distinct(F.split(T.fold(F.col("text")), " "))).alias("word"))
    posted = once.select("q", F.explode("terms").alias("term"))
    met = term_hits(posted.select("term").distinct(), held.select("word").distinct())
    postings = held.join(met, "word").select("text", "term").distinct()
    found = posted.join(postings, "term").groupBy("q", "text").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    # a question's entry is in its time if they share a key
    fitting = found.join(keys, "q").join(classes, ["text", "key"]).select("q", "entry_id", "hits", F.lit(0.0).alias("d")).unionByName(spare)
    if dense is not None:
        near = dense.join(once.select("q", "own"), F.col("query") == F.col("own")).select("q", "entry_id", F.col("score").cast("double").alias("d"))
        near = near.join(dated, "entry_id").join(keys, ["q", "key"], "left_semi").join(found, ["q", "text"], "left")
        fitting = fitting.unionByName(near.select("q", "entry_id", F.coalesce("hits", F.lit(0)).alias("hits"), "d"))
    scored = fitting.groupBy("q", "entry_id").agg(F.max("hits").alias("hits"), F.max("d").alias("d")).join(once.select("q", "terms", "limit"), "q")
    scored = scored.withColumn("score", F.coalesce(F.col("hits") / F.nullif(F.size("terms"), F.lit(0)), F.lit(0.0)) + F.col("d"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("entry_id")))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= deep).where(F.col("rank") <= F.col("limit")).select("q", "entry_id", "score", "rank")
    timed = there.select("q").distinct().withColumn("time_filtered", F.lit(True))
    return asked.select("query", "q").join(best, "q").join(timed, "q", "left").select("query", "entry_id", "score", "rank", F.coalesce("time_filtered", F.lit(False)).alias("time_filtered"))


def log_questions(entries: DataFrame) -> DataFrame:
    """(kind, question, entry_ids): a question for each day and for each month that the log has."""
    by_day = entries.groupBy("day").agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"))
    day = by_day.select(F.lit("day").alias("kind"), F.concat(F.lit("What was done on "), F.date_format("day", "yyyy-MM-dd"), F.lit("?")).alias("question"), "entry_ids")
    by_month = entries.groupBy(F.date_format("day", "yyyy-MM").alias("m")).agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"))
    return day.unionByName(by_month.select(F.lit("month").alias("kind"), F.concat(F.lit("What was done in "), "m", F.lit("?")).alias("question"), "entry_ids"))
