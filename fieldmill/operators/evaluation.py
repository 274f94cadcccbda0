"""Evaluation: retrieval ranks, answer summaries, repeats and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import nearest_rank

KS = (1, 3, 5, 6, 10)


#: Parts into which a group's values are cut to find ranks.
RANK_PARTS = 256


def latency_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, nearest-rank 95th percentile and maximum of each group; null values and null keys' groups count as such.

    Equal values are counted first. A group's distinct values are cut into parts at approximate quantiles, the parts' sizes are added up, and
    ranks are counted within a part, so that no task sorts a whole group.
    """
    some = rows.where(F.col(value).isNotNull())
    shares = F.array(*[F.lit(i / RANK_PARTS) for i in range(1, RANK_PARTS)])
    whole = some.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.percentile_approx(value, shares, 1000).alias("__cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    counts = some.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")).join(whole, on)
    cut = F.size(F.filter(F.array_distinct("__cuts"), lambda x: x < F.col(value)))
    counts = counts.select(*keys, value, "__c", "n", "mean", "max", cut.alias("__part"))
    sizes = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], "__part").agg(F.sum("__c").alias("__size")).withColumnRenamed("__part", "__at")
    below = F.sum("__size").over(Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    placed = counts.join(sizes.withColumn("__below", below), on & (F.col("__part") == F.col("__at")))
    upto = F.col("__below") + F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("__upto", upto)
    at = lambda k: F.max(F.when((k <= F.col("__upto")) & (k > F.col("__upto") - F.col("__c")), F.col(value)))
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.col("n") * 0.95).cast("long")))
    first = lambda c: F.first(c).alias(c)
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2
    return placed.groupBy(*keys).agg(first("n"), first("mean"), middle.alias("p50"), at(rank).alias("p95"), first("max"))


def small_latency_stats(values: Column) -> Column:
    """The same 95th percentile of an array."""
    return nearest_rank(F.array_sort(values), 0.95)


def first_hit_rank(hits: DataFrame, expected: DataFrame, query: str, rank: str) -> DataFrame:
    """The rank of the first hit of each query that is an expected source, null without one.

    ``hits`` has query, rank, doc_id and title; ``expected`` has query and source, which is a doc_id or "doc_id#n" for the titles that begin with "n. ".
    """
    parts = expected.select(query, F.split_part("source", F.lit("#"), F.lit(1)).alias("doc_id"), F.nullif(F.split_part("source", F.lit("#"), F.lit(2)), F.lit("")).alias("number"))
    fits = F.col("number").isNull() | F.startswith("title", F.concat("number", F.lit(". ")))
    first = hits.join(parts, [query, "doc_id"]).where(fits).groupBy(query).agg(F.min(rank).alias("first_rank"))
    return expected.select(query).distinct().join(first, query, "left")


def retrieval_summary(ranks: DataFrame, rank: str, group: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """hit@k, mean reciprocal rank and miss rate, over all queries (level 1) and by group (level 0)."""
    hits = [F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("double")).alias(f"hit_{k}") for k in ks]
    return ranks.groupingSets([(), (F.col(group),)], F.col(group)).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *hits, F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"), F.avg(F.col(rank).isNull().cast("double")).alias("miss_rate")
    )


def repeat_summary(runs: DataFrame, item: str, run: str, measures: list[str]) -> DataFrame:
    """Mean and sample deviation over runs of each run's mean (0 for a single run), and the items whose result differs between runs."""
    by_run = runs.groupBy(run).agg(*[F.avg(m).alias(m) for m in measures])
    stats = [x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd"))]
    unstable = runs.groupBy(item).agg(*[(F.max(m) != F.min(m)).alias(m) for m in measures]).agg(*[F.count_if(m).alias(f"{m}_unstable") for m in measures])
    return by_run.agg(F.count(F.lit(1)).alias("n_runs"), *stats).crossJoin(unstable)


def robust_outliers(sentences: DataFrame, language: str, item: str, loss: str, text: str, limit: float = 4.0) -> DataFrame:
    """By item: sentences, outliers by median and median absolute deviation of the language, their share, the largest z and the worst sentence. A row for each language is broadcast."""
    center = sentences.groupBy(language).agg(F.median(loss).alias("__m"))
    rows = sentences.join(F.broadcast(center), language).withColumn("__d", F.abs(F.col(loss) - F.col("__m")))
    spread = rows.groupBy(language).agg(F.greatest(F.median("__d") * 1.4826, F.lit(1e-6)).alias("__s"))
    rows = rows.join(F.broadcast(spread), language).withColumn("z", (F.col(loss) - F.col("__m")) / F.col("__s"))
    out = F.col("z") > limit
    return rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("outliers"), (F.count_if(out) / F.count(F.lit(1))).alias("outlier_share"), F.max("z").alias("max_z"), F.max_by(text, F.struct("z", text)).alias("worst"))


def validate_gold(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, problem): duplicate ids, no question, no sources, unknown documents, and facts that no expected source holds."""
    sources = items.select("item", F.explode_outer("sources").alias("source")).withColumn("doc_id", F.split_part("source", F.lit("#"), F.lit(1)))
    known = chunks.select("doc_id").distinct()
    duplicate = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item", F.lit("duplicate id").alias("problem"))
    empty = items.where(F.trim(F.coalesce("question", F.lit(""))) == "").select("item", F.lit("no question").alias("problem"))
    none = items.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0).select("item", F.lit("no sources").alias("problem"))
    unknown = sources.where("source IS NOT NULL").join(known, "doc_id", "left_anti").select("item", F.concat(F.lit("unknown source "), "source").alias("problem"))
    found = duplicate.union(empty).union(none).union(unknown)
    return found.union(_unsupported(items, sources, chunks)) if "key_facts" in items.columns and "text" in chunks.columns else found


def _unsupported(items: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts (any of whose alternatives would do) that no expected document holds. Only the texts of expected documents meet facts, and only of their own items."""
    facts = items.select("item", F.posexplode("key_facts").alias("k", "fact")).withColumn("fact", F.transform("fact", lambda a: T.fold(a)))
    texts = sources.where("source IS NOT NULL").select("item", "doc_id").distinct().join(chunks.select("doc_id", T.fold(F.col("text")).alias("text")), "doc_id").select("item", "text")
    held = facts.join(texts, "item", "left").groupBy("item", "k").agg(F.max(F.coalesce(F.exists("fact", lambda a: F.contains(F.col("text"), a)), F.lit(False))).alias("held"), F.first("fact").alias("fact"))
    return held.where("NOT held").select("item", F.concat(F.lit("unsupported fact "), F.coalesce(F.try_element_at("fact", F.lit(1)), F.lit(""))).alias("problem"))


def answer_summary(answers: DataFrame, keys: list[str]) -> DataFrame:
    """By group: answers, failed ones (error), and over the others the mean coverage of those that have facts, the grounded share, answers that break a rule and mean seconds. An item that failed counts and doesn't stop the rest."""
    fine = F.col("error").isNull()
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~fine).alias("n_failed"), F.avg(F.when(fine, F.col("coverage"))).alias("coverage"), F.avg(F.when(fine, F.col("grounded").cast("double"))).alias("grounded_share"),
        F.count_if(fine & (F.col("n_forbidden") > 0)).alias("n_forbidden"), F.avg(F.when(fine, F.col("seconds"))).alias("seconds"),
    )


def recall_by_kind(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """By kind of question: items, the mean share of their expected entries (item, kind, entry_id) among the hits (item, entry_id), and items without any."""
    found = expected.join(hits.distinct().withColumn("__hit", F.lit(1)), ["item", "entry_id"], "left")
    by_item = found.groupBy("item", "kind").agg((F.count("__hit") / F.count(F.lit(1))).alias("share"))
    return by_item.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("recall"), F.count_if(F.col("share") == 0).alias("n_missed"))


def sampling_summary(candidates: DataFrame) -> DataFrame:
    """One row: prompts, candidates (prompt, reward, gate), those that a rule stops, the mean reward and the mean of each prompt's best."""
    by_prompt = candidates.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gate") <= 0).alias("g"), F.sum("reward").alias("s"), F.max("reward").alias("best"))
    return by_prompt.agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_candidates"), F.sum("g").alias("n_gated"), (F.sum("s") / F.sum("n")).alias("mean_reward"), F.avg("best").alias("mean_best"))


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """Each stored answer with answered, coverage, missing_facts, violations, mentions and guardrail_pass; a failed item keeps its error and has nulls, and stops no other.

    ``answers`` has item, category, answer, error (null where the answer came), seconds, grounding, key_facts and must_mention (arrays of groups of alternatives). Rules
    count for the category guardrail only: there an answer passes that breaks none and mentions one of each group.
    """
    fine, text = F.col("error").isNull(), F.coalesce("answer", F.lit(""))
    none = F.array().cast("array<array<string>>")
    facts, groups = F.coalesce("key_facts", none), F.coalesce("must_mention", none)
    folded = T.fold(text)
    said = lambda group: F.exists(group, lambda a: F.contains(folded, T.fold(a)))
    guardrail = F.col("category") == "guardrail"
    found = answers.withColumns(
        {
            "answered": F.when(fine, (F.trim(text) != "") & ~F.startswith(text, F.lit("(geen antwoord"))), "coverage": F.when(fine, T.fact_coverage(text, facts)), "missing_facts": F.when(fine, F.filter(facts, lambda g: ~said(g))),
            "violations": F.when(fine & guardrail, T.forbidden(text)), "mentions": F.when(fine & guardrail, F.forall(groups, said)),
        }
    )
    return found.withColumn("guardrail_pass", (F.size("violations") == 0) & F.col("mentions"))


def answer_report(evaluated: DataFrame) -> DataFrame:
    """One row over all items of :func:`evaluate_answers`: failures, shares of answered and grounded answers, coverage of content, guardrails, and seconds."""
    fine, guardrail = F.col("error").isNull(), F.col("category") == "guardrail"
    share = lambda when, what: F.avg(F.when(when, what.cast("double")))
    content = fine & ~guardrail
    whole = evaluated.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~fine).alias("n_failed"), share(fine, F.col("answered")).alias("answered_share"), share(fine, F.col("grounding") == "green").alias("green_share"),
        F.count_if(content).alias("n_content"), share(content, F.col("coverage")).alias("coverage"), share(content, F.col("coverage") == 1.0).alias("full_share"),
        F.count_if(fine & guardrail).alias("n_guardrail"), share(fine & guardrail, F.col("guardrail_pass")).alias("pass_share"), F.count_if(fine & guardrail & (F.size("violations") > 0)).alias("n_violating"),
    )
    seconds = latency_stats(evaluated.where(fine).withColumn("__all", F.lit(1)), ["__all"], "seconds").select("mean", "p50", "p95", "max").toDF("seconds_mean", "seconds_p50", "seconds_p95", "seconds_max")
    # one row each; without a fine item the seconds are null
    return whole.withColumn("__one", F.lit(1)).join(seconds.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def observation_items(chunks: DataFrame) -> DataFrame:
    """(item, category, question, source) of the numbered problem cards among ``chunks`` (doc_id, type, title, text): the card's observation is the question, the card its source."""
    number = F.regexp_extract(F.coalesce("title", F.lit("")), r"^(\d+)\.\s", 1)
    question = F.trim(F.regexp_extract("text", r"(?m)^- Observatie:[^\S\n]*(\S.*)$", 1))
    rows = chunks.where("type = 'probleem'").select(number.alias("no"), question.alias("question"), "doc_id").where("no <> '' AND question <> ''")
    return rows.select(F.concat(F.lit("obs"), "no").alias("item"), F.lit("kennisbank").alias("category"), "question", F.concat_ws("#", "doc_id", "no").alias("source"))
