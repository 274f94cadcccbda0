"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts
are raked: in rounds, each margin is scaled to its target shares, until all margins
fit within ``TOLERANCE``. Targets that the cells can't meet together end in a round that
changes nothing; then, or after ``MOST_ROUNDS``, a warning tells the gap that is left. A
cell's probability is its share of the token budget over its own tokens; what a cell
can't give, because no document is taken twice, is spread over the others in proportion
(the scale that spends the budget is found by a few sums). A document is sampled if a hash of its doc_id, a uniform number, lies
below the probability of its cell.

Tokens are counted over all documents and summed per cell before any shuffle, so
that a source with a third of all rows costs no more than another. Raking works
on the table of cells. Up to ``SMALL_TABLE`` cells, which is checked, all rounds are one
fold over one row and the cells join documents by broadcast; beyond, each step is shuffled.
Both do the same rounds and stop by the same rule.

The topic is a column ``topic`` of the input or else the form of the text, by the
rules in ``TOPICS``. Targets are shares by value; a margin without any gets its
own shares to the power ``TEMPER``, which evens out large and small values.

Defined results: a null source, language or topic is the value ``(none)``; a null
text has no tokens; a value without a target, where targets are given, has target 0;
a target whose value doesn't occur is left out and the others are scaled up; a
cell without tokens has probability 0. Repeated rows share a fate. An empty
table gives an empty result; extra columns are left out or, by ``sample``, kept.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, checkpoint, table, text_or_empty

MARGINS = ("source", "lang", "topic")
#: The part of all tokens that the sample holds.
BUDGET = 0.5
TEMPER = 0.5
TOLERANCE = 1e-4
#: The most rounds, whatever the size; a gap that is left is reported.
MOST_ROUNDS = 1000
#: A gap that changes less than this from one round to the next stays.
STILL = 1e-12
SMALL_TABLE = 100_000
SEED = 17
NONE = "(none)"

#: Topics by the form of the text, the first that fits; the rest is prose.
TOPICS = (
    ("legal", lambda t: t.rlike(r"Licensed under|Copyright \(c\)|All rights reserved")),
    ("table", lambda t: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("|"), F.lit("")))) * 60 > F.octet_length(t)),
    ("note", lambda t: F.octet_length(t) < 400),
    ("long", lambda t: F.octet_length(t) > 12000),
)


def form_topic(text: Column) -> Column:
    found = F.lit("prose")
    for name, rule in reversed(TOPICS):
        found = F.when(rule(text), name).otherwise(found)
    return found


def _featured(docs: DataFrame) -> DataFrame:
    """``docs`` with the working columns source, lang, topic, tokens (all prefixed)."""
    rows = docs.withColumn(f"{OWN}t", text_or_empty())
    topic = F.col("topic").cast("string") if "topic" in docs.columns else form_topic(F.col(f"{OWN}t"))
    named = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    rows = rows.withColumns({f"{OWN}{m}": F.coalesce(c, F.lit(NONE)) for m, c in named.items()})
    return rows.withColumn(f"{OWN}tokens", F.regexp_count(f"{OWN}t", F.lit(r"\S++")).cast("long")).drop(f"{OWN}t")


def count_cells(featured: DataFrame) -> tuple[DataFrame, bool]:
    """source, lang, topic and the tokens of each cell that has any, and whether the table is small; then it is one partition."""
    cells = featured.groupBy(*[F.col(f"{OWN}{m}").alias(m) for m in MARGINS]).agg(F.sum(f"{OWN}tokens").cast("double").alias("tokens"))
    cells = checkpoint(cells.where("tokens > 0"))
    small = cells.count() <= SMALL_TABLE
    return (checkpoint(cells.coalesce(1)) if small else cells), small


def target_shares(cells: DataFrame, margin: str, targets: dict[str, float] | None) -> DataFrame:
    """margin and its target, up to a factor, for the values that occur."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        wanted = F.pow(F.col("tokens"), F.lit(TEMPER))
    else:
        wanted = F.lit(0.0)
        for value, share in targets.items():
            wanted = F.when(F.col(margin) == value, F.lit(float(share))).otherwise(wanted)
    return shares.select(margin, wanted.alias(f"{OWN}{margin}"))


def _with_targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``cells`` with the target share of its value in each margin; the shares of the values that occur sum to 1."""
    found = cells
    for m in MARGINS:
        wanted = target_shares(cells, m, (targets or {}).get(m))
        total = wanted.agg(F.sum(f"{OWN}{m}")).first()[0] or 1.0
        found = found.join(wanted.select(m, (F.col(f"{OWN}{m}") / F.lit(float(total))).alias(f"{OWN}{m}")), m)
    return found


def _gap(share: Column, target: Column) -> Column:
    return F.abs(share - target) / F.greatest(target, F.lit(1e-12))


def _factor(share: Column, target: Column) -> Column:
    return F.when(share > 0, target / share).otherwise(F.lit(0.0))


def _fold_rounds(cells: DataFrame) -> DataFrame:
    """The rounds of a small table: one row holds the cells by value of each margin and three arrays of factors, and a fold scales one margin at each of its steps."""
    # the margins' values are numbered; a cell's weight is tokens * a[i] * b[j] * c[k]
    numbered = cells.coalesce(1)
    for m in MARGINS:
        numbered = numbered.withColumn(f"{OWN}n_{m}", F.dense_rank().over(Window.orderBy(m)) - 1)
    n = [F.col(f"{OWN}n_{m}") for m in MARGINS]
    entries = [
        F.struct(F.lit(g).alias("g"), n[g].alias("own"), F.col(f"{OWN}{m}").alias("target"), *[n[o].alias(x) for x, o in zip("pq", [o for o in range(3) if o != g], strict=True)], F.struct(*MARGINS, *[n[o].alias(x) for o, x in enumerate("ijk")]).alias("cell"))
        for g, m in enumerate(MARGINS)
    ]
    rows = numbered.select("tokens", F.explode(F.array(*entries)).alias("e")).select("tokens", "e.*")
    by_value = rows.groupBy("g", "own").agg(F.first("target").alias("target"), F.collect_list(F.struct("p", "q", "tokens", "cell")).alias("c"))
    one = by_value.coalesce(1).agg(*[F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct("own", "target", "c")))).alias(f"m{g}") for g in range(3)])
    ones = [F.transform(f"m{g}", lambda v: F.lit(1.0)) for g in range(3)]
    # sums of the margin whose turn it is, then factors from these sums: two steps a margin, six a round
    kind = "struct<a:array<double>,b:array<double>,c:array<double>,sums:array<double>,gap:double,last:double,done:boolean>"
    start = F.struct(ones[0].alias("a"), ones[1].alias("b"), ones[2].alias("c"), F.array().alias("sums"), F.lit(0.0).alias("gap"), F.lit(-1.0).alias("last"), F.lit(False).alias("done")).cast(kind)

    def sums(g: int, acc: Column) -> Column:
        p, q = [acc["abc"[o]] for o in range(3) if o != g]
        return F.transform(f"m{g}", lambda v: F.aggregate(v["c"], F.lit(0.0), lambda s, x: s + x["tokens"] * F.get(p, x["p"]) * F.get(q, x["q"])))

    def off(g: int, acc: Column, factors: Column) -> Column:
        return F.transform(f"m{g}", lambda v, i: _gap(F.get(acc["sums"], i) * F.get(factors, i), v["target"]))

    def step(acc: Column, at: Column) -> Column:
        turn, scaling = F.floor(F.pmod(at, F.lit(6)) / 2), at % 2 == 1
        found, own, gaps = acc["sums"], {}, F.lit(0.0)
        for g, name in enumerate("abc"):
            mine = turn == g
            found = F.when(mine & ~scaling, sums(g, acc)).otherwise(found)
            own[name] = F.when(mine & scaling, F.transform(f"m{g}", lambda v, i: _factor(F.get(acc["sums"], i), v["target"]))).otherwise(acc[name])
            gaps = F.when(mine & scaling, F.coalesce(F.array_max(off(g, acc, acc[name])), F.lit(0.0))).otherwise(gaps)
        first, end = F.pmod(at, F.lit(6)) == 0, F.pmod(at, F.lit(6)) == 5
        gap = F.when(first, F.lit(0.0)).otherwise(F.greatest(acc["gap"], gaps))
        settled = end & ((gap <= TOLERANCE / 3) | (F.abs(gap - acc["last"]) <= STILL))
        after = F.struct(*[own[x].alias(x) for x in "abc"], found.alias("sums"), gap.alias("gap"), F.when(end, gap).otherwise(acc["last"]).alias("last"), settled.alias("done")).cast(kind)
        return F.when(acc["done"], acc).otherwise(after)

    folded = one.select("m0", F.aggregate(F.sequence(F.lit(0), F.lit(6 * MOST_ROUNDS - 1)), start, step).alias("f"))
    # the row has to be made once, before it is exploded
    folded = checkpoint(folded)
    cell = folded.select("f", F.explode("m0").alias("v")).select("f", F.explode("v.c").alias("x"))
    weight = F.col("x.tokens") * F.get("f.a", F.col("x.cell.i")) * F.get("f.b", F.col("x.cell.j")) * F.get("f.c", F.col("x.cell.k"))
    return checkpoint(cell.select(*[F.col(f"x.cell.{m}").alias(m) for m in MARGINS], "x.tokens", weight.alias("weight"), F.col("f.gap").alias(f"{OWN}gap")))


def _shuffled_rounds(cells: DataFrame) -> tuple[DataFrame, float]:
    """The rounds of a large table: a value's sum is made before it is joined, and each step is checkpointed."""
    found, last = cells.withColumn("weight", F.col("tokens")), -1.0
    for _ in range(MOST_ROUNDS):
        found = found.withColumn(f"{OWN}gap", F.lit(0.0))
        for m in MARGINS:
            sums = found.groupBy(m).agg(F.sum("weight").alias(f"{OWN}sum"))
            gap = F.greatest(f"{OWN}gap", _gap(F.col(f"{OWN}sum"), F.col(f"{OWN}{m}")))
            found = found.join(sums, m).withColumn(f"{OWN}gap", gap).withColumn("weight", F.col("weight") * _factor(F.col(f"{OWN}sum"), F.col(f"{OWN}{m}")))
            found = checkpoint(found.drop(f"{OWN}sum"))
        gap = found.agg(F.max(f"{OWN}gap")).first()[0] or 0.0
        if gap <= TOLERANCE / 3 or abs(gap - last) <= STILL:
            break
        last = gap
    return found, gap


def rake(cells: DataFrame, small: bool, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``cells`` with their weight, a share of all tokens that fits the target shares of every margin.

    A round scales each margin once. It is the last one if no margin was off by more than a
    third of ``TOLERANCE`` when its turn came, so that none is off by more than that after it, or if the gap
    is what it was a round before, as targets that the cells can't meet together leave it.
    """
    rows = checkpoint(_with_targets(cells, targets))
    if small:
        found = _fold_rounds(rows)
        gap = found.agg(F.max(f"{OWN}gap")).first()[0] or 0.0
    else:
        found, gap = _shuffled_rounds(rows)
    if gap > TOLERANCE / 3:
        warnings.warn(f"a margin was off by {gap:.3g} of its target in the last round: the cells can't meet the targets together, or {MOST_ROUNDS} rounds are too few", stacklevel=2)
    return found.select(*MARGINS, "tokens", "weight")


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` with the probability that spends the budget, given as a part of all tokens."""
    wanted = budget * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    scale, full = wanted, -1
    while True:  # each time more cells are taken whole
        short = F.lit(float(scale)) * F.col("weight") >= F.col("tokens")
        spent, rest, n = cells.agg(F.sum(F.when(short, F.col("tokens")).otherwise(0.0)), F.sum(F.when(short, 0.0).otherwise(F.col("weight"))), F.count_if(short)).first()
        if n <= full or not rest or spent >= wanted:
            break
        scale, full = (wanted - spent) / rest, n
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(scale)) * F.col("weight") / F.col("tokens")))


def _with_cells(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> DataFrame:
    rows = _featured(docs)
    cells, small = count_cells(rows)
    cells = checkpoint(calibrate(rake(cells, small, targets), budget)).select(*[F.col(m).alias(f"{OWN}cell_{m}") for m in MARGINS], F.col("weight").alias(f"{OWN}weight"), F.col("probability").alias(f"{OWN}p"))
    same = [F.col(f"{OWN}{m}") == F.col(f"{OWN}cell_{m}") for m in MARGINS]
    rows = rows.join(F.broadcast(cells) if small else cells, same, "left")
    number = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE))).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return rows.withColumn(f"{OWN}p", F.coalesce(f"{OWN}p", F.lit(0.0))).withColumn(f"{OWN}sampled", number < F.col(f"{OWN}p"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """doc_id, cell, n_tokens, the cell's weight and probability, and whether the document is sampled, for each row of ``docs``."""
    rows = _with_cells(docs, targets, budget)
    named = [F.col(f"{OWN}{m}").alias(m) for m in MARGINS]
    return rows.select("doc_id", *named, F.col(f"{OWN}tokens").alias("n_tokens"), F.coalesce(f"{OWN}weight", F.lit(0.0)).alias("weight"), F.col(f"{OWN}p").alias("probability"), F.col(f"{OWN}sampled").alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that are sampled, with the columns of ``docs``."""
    return _with_cells(docs, targets, budget).where(f"{OWN}sampled").select(*[f"`{c}`" for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
