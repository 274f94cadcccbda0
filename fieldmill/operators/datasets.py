"""Training sets: splits, hold-outs, preference pairs and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def hash_bucket(key: Column, buckets: int = 1000) -> Column:
    """md5 of a key, as a whole number, modulo ``buckets``: digit by digit, as it doesn't fit a long."""
    digits = F.split(F.md5(key.cast("string")), "")
    hexes = F.filter(digits, lambda d: d != "")
    return F.aggregate(hexes, F.lit(0).cast("long"), lambda acc, d: F.pmod(acc * 16 + F.conv(d, 16, 10).cast("long"), F.lit(buckets).cast("long")))


def split_by_key(rows: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """``rows`` with split: validation for ``share`` of the keys, train for the rest; a key never falls into both."""
    return rows.withColumn("split", F.when(hash_bucket(F.col(key)) < int(share * 1000), "validation").otherwise("train"))


def without_held_out(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return rows.join(held_out.select(key).distinct(), key, "left_anti")


def preference_pairs(rows: DataFrame, group: str, key: str, good: Column) -> DataFrame:
    """(group, chosen, rejected): each row of a group with one of the other kind at least.

    The k-th row of the larger side meets the k-th of the smaller, which is begun anew at its end. Every
    row of either side is in a pair and the pairs grow with the rows; all pairs of a group follow from its
    rows and aren't made. A group without one of the kinds has no pairs.
    """
    sizes = rows.groupBy(group).agg(F.count_if(good).alias("__g"), F.count_if(~good).alias("__b")).where("__g > 0 AND __b > 0")
    ranked = rows.withColumn("__good", good).join(sizes, group).withColumn("__k", F.row_number().over(Window.partitionBy(group, "__good").orderBy(key)) - 1)
    # the larger side carries the rank in the smaller one
    at = F.pmod(F.col("__k"), F.least("__g", "__b"))
    side = ranked.select(group, F.col(key).alias("__key"), "__good", "__k", at.alias("__at"), (F.col("__good") == (F.col("__g") >= F.col("__b"))).alias("__larger"))
    larger = side.where("__larger").select(group, F.col("__at").alias("__k"), F.col("__key").alias("a"), F.col("__good").alias("__first"))
    pairs = larger.join(side.where("NOT __larger").select(group, "__k", F.col("__key").alias("b")), [group, "__k"])
    return pairs.select(group, F.when(F.col("__first"), F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(F.col("__first"), F.col("b")).otherwise(F.col("a")).alias("rejected"))


def choose_pairs(candidates: DataFrame, prompt: str, least_gap: float = 0.1) -> DataFrame:
    """By prompt the best candidate that breaks no rule (a card on ties) and the worst, where they are ``least_gap`` apart. candidates: answer, reward, gate, is_card."""
    best = F.max_by("answer", F.when(F.col("gate") > 0, F.struct("reward", F.col("is_card").cast("int"), F.col("answer"))))
    found = candidates.groupBy(prompt).agg(
        best.alias("chosen"), F.max(F.when(F.col("gate") > 0, F.col("reward"))).alias("best"), F.min_by("answer", F.struct("reward", "answer")).alias("rejected"), F.min("reward").alias("worst")
    )
    return found.where((F.col("best") - F.col("worst") >= least_gap) & (F.col("chosen") != F.col("rejected")))


#: Fixed: the weights of an answer's parts, and the lengths from which it is too long.
WEIGHTS = {"coverage": 0.35, "focus": 0.20, "grounding": 0.10, "numeric": 0.15, "complete": 0.10, "concise": 0.10}
CONCISE_WORDS, MAX_WORDS = 250, 600
#: Fixed: words that the form of an answer brings in.
FORMAT_WORDS = [
    "bronnen", "fragment", "fragmenten", "vermijd", "effect", "waarom", "actie", "gevolg", "observatie", "kaart", "status", "bevestigd", "kennisbank", "kersenteelt", "problemen", "samenstelling",
    "internet", "crawl", "ctgb_toelating", "databank", "etiket", "toelating", "slechtste", "reactie", "praktisch", "relevante", "belangrijk", "daarom", "omdat", "waarbij", "tijdens", "voordat",
    "zodat", "wanneer", "bijvoorbeeld", "eigen", "logboek",
]


def stems(text: Column) -> Column:
    """The first six letters of words of six letters or more."""
    found = F.filter(F.regexp_extract_all(T.fold(text), F.lit("[a-z]{6,}"), F.lit(0)), lambda w: ~w.isin(FORMAT_WORDS))
    return F.array_distinct(F.transform(found, lambda w: F.substring(w, 1, 6)))


def focus(answer: Column, gold: Column, question: Column) -> Column:
    own = stems(answer)
    allowed = F.array_union(stems(gold), stems(question))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, allowed)) / F.size(own))


def numbers(text: Column) -> Column:
    # fixed: numbers of fragments, pages and steps don't count
    plain = F.regexp_replace(text, r"(?im)(fragment|kaart|p\.|pagina|blz\.?|stap)\s*\d+(?:\s*[-–,]\s*\d+)*|^\s*\d+[.)]\s", " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![\w.])\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")))


def numeric_faithfulness(answer: Column, context: Column) -> Column:
    own, given = numbers(answer), numbers(context)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.filter(own, lambda n: F.array_contains(given, n))) / F.size(own))


def names_sources(answer: Column) -> Column:
    # fixed: how an answer names its sources
    return F.regexp(answer, F.lit(r"(?im)^\W*bronnen?\s*:"))


def is_complete(answer: Column) -> Column:
    # fixed: the ends of a complete answer
    t = F.trim(answer)
    open_thought = F.contains(t, F.lit("<think>")) & ~F.contains(t, F.lit("</think>"))
    ends = F.when(names_sources(t), ~F.regexp(t, F.lit(r"(?:,|-|\(| en| of)\s*$"))).otherwise(F.regexp(t, F.lit(r"(?:[.!?)\]]|\*\*)$")))
    return (t != "") & ~open_thought & ends


def conciseness(answer: Column) -> Column:
    n = T.word_count(answer)
    return F.when(n <= CONCISE_WORDS, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - (n - CONCISE_WORDS) / (MAX_WORDS - CONCISE_WORDS)))


def score_answers(rows: DataFrame) -> DataFrame:
    """``rows`` (answer, context, question, gold_text or null, key_facts) with each part, the rules broken, the gate and the reward. Without a gold text focus is left out and the other weights are scaled."""
    a, q = F.col("answer"), F.coalesce("question", F.lit(""))
    has_gold = F.col("gold_text").isNotNull()
    parts = {
        "coverage": T.fact_coverage(a, F.col("key_facts")), "focus": F.when(has_gold, focus(a, F.coalesce("gold_text", F.lit("")), q)), "grounding": names_sources(a).cast("double"),
        "numeric": numeric_faithfulness(a, F.concat(F.coalesce("context", F.lit("")), F.lit(" "), q)), "complete": is_complete(a).cast("double"), "concise": conciseness(a), "violations": T.forbidden(a),
    }
    found = rows.withColumns(parts)
    total = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    weight = F.when(has_gold, sum(WEIGHTS.values())).otherwise(sum(WEIGHTS.values()) - WEIGHTS["focus"])
    gate = F.when(F.size("violations") > 0, 0.0).otherwise(1.0)
    return found.withColumn("gate", gate).withColumn("reward", F.col("gate") * total / weight)


def within_length(rows: DataFrame, tokens: str, most: int) -> DataFrame:
    """Examples that are too long are dropped, never cut."""
    return rows.where(F.col(tokens) <= most)


def card_examples(cards: DataFrame, held_out: DataFrame, hits: DataFrame) -> DataFrame:
    """Examples of three kinds for each card: its answer (sft), the answer over the worst reaction (preference), and the correction of it (reflection).

    A card is skipped, with the reason, if it is held out, names a dose, has no worst reaction, or is not among the hits of its own question
    (hits: card_no, found).
    """
    rows = cards.join(held_out.select("card_no").distinct().withColumn("__held", F.lit(True)), "card_no", "left").join(hits, "card_no", "left")
    # fixed: units of a dose and labels of an answer
    text = F.concat_ws(" ", "observation", "action", "consequence", "why")
    dose = F.regexp(text, F.lit(r"(?i)\d+(?:[.,]\d+)?\s*(?:ml|l|liter|kg|g|gram)\b"))
    skip = F.when(F.col("__held"), "held out").when(dose, "names a dose").when(F.coalesce("worst_case", F.lit("")) == "", "no worst reaction").when(~F.coalesce("found", F.lit(False)), "not retrieved")
    answer = F.concat_ws("\n", F.concat(F.lit("Actie: "), "action"), F.when(F.coalesce("why", F.lit("")) != "", F.concat(F.lit("Waarom: "), "why")), F.concat(F.lit("Vermijd: "), "worst_case"), F.concat(F.lit("Bronnen: "), F.coalesce("sources", F.lit("kaart"))))
    worst = F.concat(F.lit("Actie: "), "worst_case")
    kinds = F.array(F.struct(F.lit("sft").alias("kind"), answer.alias("chosen"), F.lit(None).cast("string").alias("rejected")), F.struct(F.lit("preference").alias("kind"), answer.alias("chosen"), worst.alias("rejected")), F.struct(F.lit("reflection").alias("kind"), answer.alias("chosen"), worst.alias("rejected")))
    return rows.select("card_no", F.col("observation").alias("question"), skip.alias("skipped"), F.explode(F.when(skip.isNull(), kinds).otherwise(F.array(F.struct(F.lit("skipped").alias("kind"), F.lit(None).cast("string").alias("chosen"), F.lit(None).cast("string").alias("rejected"))))).alias("e")).select("card_no", "question", "skipped", "e.*")


#: Entries in a part of the ring that is sorted at once, or so.
RING_PART = 1024
#: Fixed: how many distractors a question has, the entries of a month that is asked about, the days that questions without an answer are about, and where a remark names its target.
DISTRACTORS, MONTH_LEAST, MONTH_MOST = 3, 2, 8
ABSTAIN_MONTHS, ABSTAIN_DAYS = (4, 9), 28
TARGET = r"\b[Tt]egen ([A-Za-z][A-Za-z\- ]{2,30}?)(?:[.,;]|$)"


def _number(text: Column) -> Column:
    """32 bits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def ring(entries: DataFrame, seed: int) -> DataFrame:
    """``entries`` (entry_id, year) with ``place`` from 0 to ``n`` - 1 of each year, in the order of a hash.

    A year is sorted in parts of about a thousand entries, cut by the hash, and the parts' sizes are added up.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col("entry_id").cast("string"))
    rows = entries.join(entries.groupBy("year").agg(F.count(F.lit(1)).alias("n")), "year").withColumn("__h", F.md5(text))
    rows = rows.withColumn("__part", F.floor(_number(text) * F.ceil(F.col("n") / RING_PART) / F.lit(float(1 << 32))))
    sizes = rows.groupBy("year", "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("year").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    inside = F.row_number().over(Window.partitionBy("year", "__part").orderBy("__h", "entry_id")) - 1
    return rows.join(sizes.withColumn("__before", before).drop("__size"), ["year", "__part"]).withColumn("place", F.col("__before") + inside).drop("__h", "__part", "__before")


def log_question_set(entries: DataFrame, distractors: int = DISTRACTORS, month_most: int = MONTH_MOST, abstain: int = 40, seed: int = 13) -> DataFrame:
    """(kind, question, period, entry_id, role) of questions about a log (entry_id, day, remarks): a row for each entry that a question shows.

    Four kinds: what was done on a day (all its entries), against the target that a remark names (the entry), in a month of 2 to
    ``month_most`` entries (all of them), and on a day in summer without an entry (role near: the three nearest of its year; ``abstain`` such
    days at most, the first by hash). The first two kinds also show distractors, entries of the same year outside the question's own period:
    those that follow the question's place on the year's ring, where its own are skipped, so that there are as many as asked for wherever
    the year has them (see :func:`shortfalls`). No list of a period is gathered in one place.
    """
    rows = entries.where("day IS NOT NULL").select("entry_id", "day", F.coalesce("remarks", F.lit("")).alias("remarks"), F.year("day").alias("year"))
    iso = F.date_format("day", "yyyy-MM-dd")
    day = rows.select(F.lit("recall_day").alias("kind"), F.concat(F.lit("Wat is er gedaan op "), iso, F.lit("?")).alias("question"), iso.alias("period"), "year", "entry_id")
    target = F.trim(F.regexp_extract("remarks", TARGET, 1))
    aimed = rows.where(target != "").select(F.lit("recall_target").alias("kind"), F.concat(F.lit("Wat is er in "), "year", F.lit(" gebruikt tegen "), target, F.lit("?")).alias("question"), F.col("entry_id").cast("string").alias("period"), "year", "entry_id")
    own = day.unionByName(aimed)
    on_ring = ring(rows.select("entry_id", "year", iso.alias("day_text")), seed)
    asked = own.groupBy("kind", "question", "period", "year").agg(F.count(F.lit(1)).alias("m"))
    asked = asked.join(on_ring.groupBy("year").agg(F.first("n").alias("n")), "year")
    start = F.pmod(_number(F.concat_ws("|", F.lit(str(seed + 1)), "kind", "period")), F.col("n"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("n"), F.col("m") + distractors) - 1)
    spots = asked.select("kind", "question", "period", "year", F.posexplode(F.transform(steps, lambda k: F.pmod(start + k, F.col("n")))).alias("turn", "place"))
    met = spots.join(on_ring.select("year", "place", "entry_id", "day_text"), ["year", "place"])
    met = met.where(F.when(F.col("kind") == "recall_day", F.col("day_text") != F.col("period")).otherwise(F.col("entry_id").cast("string") != F.col("period")))
    k = F.row_number().over(Window.partitionBy("kind", "period").orderBy("turn"))
    others = met.withColumn("k", k).where(F.col("k") <= distractors).select("kind", "question", "period", "entry_id", F.lit("distractor").alias("role"))
    month = F.date_format("day", "yyyy-MM")
    full = rows.groupBy(month.alias("period")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m").between(MONTH_LEAST, month_most)).select("period")
    by_month = rows.select("entry_id", month.alias("period")).join(full, "period").select(F.lit("recall_month").alias("kind"), F.concat(F.lit("Welke middelen zijn in "), "period", F.lit(" gebruikt?")).alias("question"), "period", "entry_id", F.lit("own").alias("role"))
    first, last = ABSTAIN_MONTHS
    days = F.flatten(F.transform(F.sequence(F.lit(first), F.lit(last)), lambda m: F.transform(F.sequence(F.lit(1), F.lit(ABSTAIN_DAYS)), lambda d: F.make_date(F.col("year"), m, d))))
    empty = rows.select("year").distinct().select("year", F.explode(days).alias("day")).join(rows.select("day").distinct(), "day", "left_anti")
    empty = empty.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed + 2)), iso)), "day").limit(abstain).select("year", F.col("day").alias("asked"))
    # ``abstain`` rows at most
    gap = F.abs(F.date_diff("day", "asked"))
    near = rows.join(F.broadcast(empty), "year").withColumn("k", F.row_number().over(Window.partitionBy("asked").orderBy(gap, "day", "entry_id"))).where("k <= 3")
    asked_day = F.date_format("asked", "yyyy-MM-dd")
    without = near.select(F.lit("abstain_day").alias("kind"), F.concat(F.lit("Wat is er gedaan op "), asked_day, F.lit("?")).alias("question"), asked_day.alias("period"), "entry_id", F.lit("near").alias("role"))
    return own.select("kind", "question", "period", "entry_id", F.lit("own").alias("role")).unionByName(others).unionByName(by_month).unionByName(without)


def shortfalls(questions: DataFrame, distractors: int = DISTRACTORS) -> DataFrame:
    """(kind, period, short) of the questions of :func:`log_question_set` with fewer distractors than they should have."""
    counts = questions.where(F.col("kind").isin("recall_day", "recall_target")).groupBy("kind", "period").agg(F.count_if(F.col("role") == "distractor").alias("n"))
    return counts.where(F.col("n") < distractors).select("kind", "period", (distractors - F.col("n")).alias("short"))


def mixed_examples(cards: DataFrame, extras: DataFrame, key: str, seed: int = 13) -> DataFrame:
    """Cards and extra examples of the same columns in one table with ``place``, a number in the order of a seeded hash; an example that is in both counts once, as a card.

    The order doesn't depend on the partitioning; ``place`` is the hash itself, to sort or to cut by where the table is written.
    """
    rows = cards.withColumn("origin", F.lit("card")).unionByName(extras.join(cards.select(key), key, "left_anti").withColumn("origin", F.lit("extra")))
    return rows.withColumn("place", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))


def example_report(examples: DataFrame) -> DataFrame:
    """(kind, skipped, n): how many examples of each kind there are, and for what reasons cards were skipped."""
    return examples.groupBy("kind", "skipped").agg(F.count(F.lit(1)).alias("n"))


#: Templates meet all targets.
MOST_TEMPLATES = 1_000


def templated_examples(templates: DataFrame, targets: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n distinct questions from templates (template with %s, weight) and targets, heavier templates first by a weighted hash. More than MOST_TEMPLATES templates are an error."""
    if templates.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    pairs = targets.crossJoin(F.broadcast(templates))
    u = (F.xxhash64(F.lit(seed), "template", "target").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float((1 << 53) + 1))
    question = F.replace("template", F.lit("%s"), F.col("target"))
    rows = pairs.select(question.alias("question"), "target", (-F.log(u) / F.col("weight")).alias("key"))
    rows = rows.groupBy("question", "target").agg(F.min("key").alias("key"))
    return rows.orderBy("key", "question").limit(n).drop("key")


def gold_card_numbers(items: DataFrame, document: str) -> DataFrame:
    """(card_no) of the cards of a document that gold items name as doc#n in their ``sources``."""
    source = items.select(F.explode("sources").alias("s"))
    number = F.regexp_extract("s", r"^[^#]*#(\d+)$", 1)
    return source.where((F.split_part("s", F.lit("#"), F.lit(1)) == document) & (number != "")).select(number.cast("int").alias("card_no")).distinct()


#: Fixed: states of a card's sources that count as verified, and a feedback's preferences.
VERIFIED_STATUSES, PREFERENCES = ("bevestigd",), ("chosen", "rejected")


def compliance_extras(targets: DataFrame, hits: DataFrame, cards: DataFrame) -> DataFrame:
    """(target, action): of the hits (target, chunk_id, rank) of each target, the action of the first whose card is verified, names no dose and is about the target, by its first six letters.

    ``cards`` has chunk_id, title, observation, action and sources_status.
    """
    letters = lambda c, keep: F.regexp_replace(F.lower(c), f"[^{keep}]", "")
    stem = F.substring(letters(F.col("target"), "a-z"), 1, 6)
    about = F.contains(F.replace(letters(F.concat_ws(" ", "title", "observation"), "a-z "), F.lit(" "), F.lit("")), stem)
    dose = F.regexp(F.concat_ws(" ", "observation", "action"), F.lit(r"(?i)\d+(?:[.,]\d+)?\s*(?:ml|l|liter|kg|g|gram)\b"))
    rows = targets.join(hits, "target").join(cards, "chunk_id").where(F.col("sources_status").isin(*VERIFIED_STATUSES) & ~dose & (stem != "") & about)
    return rows.groupBy("target").agg(F.min_by("action", "rank").alias("action"))


def feedback_records(rows: DataFrame, as_of: Column) -> DataFrame:
    """``rows`` as feedback, with ``timestamp`` filled from ``as_of``; a preference that is neither chosen nor rejected is an error when the rows are read."""
    bad = F.raise_error(F.concat(F.lit("preference must be chosen or rejected, not "), F.coalesce("preference", F.lit("null"))))
    checked = F.when(F.coalesce(F.col("preference").isin(*PREFERENCES), F.lit(False)), F.col("preference")).otherwise(bad.cast("string"))
    stamp = F.coalesce(F.col("timestamp"), as_of) if "timestamp" in rows.columns else as_of
    return rows.withColumn("preference", checked).withColumn("timestamp", stamp)
