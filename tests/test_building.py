"""Broken words, topic pieces, maps of counts and questions about a log, against loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from fieldmill.operators import datasets, hyphens, procedures, retrieval


def test_broken_words(spark):
    known = ["long", "distance", "continued", "well", "known", "side", "effect", "sideeffect"]
    texts = [
        ("en", "a long-\ndistance run, contin-\nued well-\nknown Side-\neffect"), ("nl", "long-\ndistance"), (None, "well-\nknown"), ("en", "no break-\nBig and a-\nb and x-\nyy"), ("en", None), ("en", ""), ("en", "plain"),
        ("en", "well-\nknown-\nknown and well-\nlongdistance"), ("en", "éé-\nlong WELL-\nknown"),
    ]
    rng = random.Random(1)
    texts += [(rng.choice(["en", "de"]), "".join(rng.choice([*known, "-\n", " ", "-\n", "x", "É"]) for _ in range(30))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(texts)], "doc_id long, lang string, text string")
    found = {r["doc_id"]: r for r in hyphens.join_line_breaks(docs, "doc_id", spark.createDataFrame([(w,) for w in known + ["long"]], "word string")).collect()}
    assert len(found) == len(texts)
    for i, (language, text) in enumerate(texts):
        if text is None:
            assert found[i]["text"] is None
            continue
        kept = 0

        def glue(m):
            nonlocal kept
            left = re.search(r"[^\W\d_]+$", text[: m.start()])[0].lower()
            right = re.match("[a-z]+", text[m.end() :])[0]
            keep = language == "en" and left + right not in known and left in known and right in known
            kept += keep
            return "-" if keep else ""

        wanted = re.sub(r"(?<=[^\W\d_]{2})-\n(?=[a-z]{2})", glue, text)
        assert (found[i]["text"], found[i]["kept_hyphens"]) == (wanted, kept), text


def test_broken_words_read_a_text_once(spark):
    """A text that is an expression is made once for its breaks and once for its result, in whatever language; a large lexicon gives the same."""
    docs = spark.createDataFrame([(1, "en", "nwonk\n-llew fo"), (2, "nl", "nwonk\n-llew")], "doc_id long, lang string, text string").withColumn("text", F.reverse("text"))
    lexicon = spark.createDataFrame([("well",), ("known",), (None,)], "word string")
    found = hyphens.join_line_breaks(docs, "doc_id", lexicon)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 3
    wanted = {(1, "of well-known", 1), (2, "wellknown", 0)}
    assert {(r["doc_id"], r["text"], r["kept_hyphens"]) for r in found.collect()} == wanted
    most, hyphens.MOST_BROADCAST_WORDS = hyphens.MOST_BROADCAST_WORDS, 1
    try:
        assert {(r["doc_id"], r["text"], r["kept_hyphens"]) for r in hyphens.join_line_breaks(docs, "doc_id", lexicon).collect()} == wanted
    finally:
        hyphens.MOST_BROADCAST_WORDS = most


def pieces_by_loop(words, vectors):
    n = len(words)
    if sum(words) <= 600:
        return [1] * n
    parts = [0] * n
    if n >= 4:
        s = [float(a @ b) for a, b in zip(vectors, vectors[1:])]
        depth = [max(s[: i + 1]) + max(s[i:]) - 2 * s[i] for i in range(n - 1)]
        limit = max(float(np.percentile(depth, 75)), 0.05)
        for i in range(1, n):
            parts[i] = parts[i - 1] + (depth[i - 1] >= limit - 1e-12)
    sizes = [sum(w for w, p in zip(words, parts) if p == k) for k in range(parts[-1] + 1)]
    groups = []
    for k, size in enumerate(sizes):
        if groups and size < 30:
            groups[-1].append(k)
        else:
            groups.append([k])
    if len(groups) > 1 and sum(sizes[k] for k in groups[0]) < 30:
        groups[0:2] = [groups[0] + groups[1]]
    place = {k: g for g, group in enumerate(groups, 1) for k in group}
    return [place[p] for p in parts]


def test_topic_pieces(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for chunk in range(60):
        n = int(rng.integers(1, 30))
        words = [int(x) for x in rng.choice([2, 10, 40, 90, 200], n)]
        v = np.repeat(rng.standard_normal((n, 8)), rng.integers(1, 5, n), axis=0)[:n] + 0.2 * rng.standard_normal((n, 8))
        v /= np.linalg.norm(v, axis=1)[:, None]
        rows += [(chunk, i, words[i], v[i].tolist()) for i in range(n)]
        wanted[chunk] = pieces_by_loop(words, list(v))
    found = {}
    for r in retrieval.topic_pieces(spark.createDataFrame(rows, "chunk long, pos int, words int, v array<double>"), "chunk", "pos", "words", "v").orderBy("pos").collect():
        found.setdefault(r["chunk"], []).append(r["piece"])
        assert r["pieces"] == wanted[r["chunk"]][-1]
    assert found == wanted and sum(max(w) > 1 for w in wanted.values()) > 20


def test_maps_of_counts(spark):
    steps = spark.createDataFrame([(1, 1, "a", "f"), (1, 2, "b", "f"), (2, 1, "b", "g"), (2, 2, "a", "g"), (3, 1, "a", None), (4, 1, "b", "f"), (4, 2, "b", "f")], "t int, k int, node string, family string")
    nodes = procedures.graph_nodes(steps, "t", "k", "node", "family")
    assert {r["node"]: tuple(r)[1:] for r in nodes.collect()} == {"a": (3, 2, 2, {"f": 1, "g": 1}), "b": (4, 2, 2, {"f": 3, "g": 1})}
    x, y = (spark.range(1).select(procedures.F.create_map(*[procedures.F.lit(v) for kv in m for v in kv]).cast("map<string,bigint>").alias("m")) for m in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    both = x.crossJoin(y.withColumnRenamed("m", "n")).select(procedures.merged_counts(procedures.F.col("m"), procedures.F.col("n")).alias("s")).first()["s"]
    assert both == {"a": 1, "b": 5, "c": 4}


def test_questions_about_a_log(spark):
    rng = random.Random(2)
    entries = [(i, f"20{rng.choice([19, 20])}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 20):02d}", rng.choice(["tegen luis.", "Tegen zwarte vlieg, vroeg", "tegen x", "niets", None])) for i in range(120)]
    entries += [(1000 + i, "2019-05-05", None) for i in range(80)] + [(2000, "2021-06-01", "tegen luis"), (2001, "2021-06-01", None), (3000, None, "tegen luis.")]  # a hot day, and a year of one day
    log = spark.createDataFrame(entries, "entry_id long, day string, remarks string").withColumn("day", datasets.F.to_date("day"))
    day_of = {i: d for i, d, _ in entries}
    table = datasets.log_question_set(log, abstain=25)
    found = {}
    for r in table.collect():
        found.setdefault((r["kind"], r["period"]), {}).setdefault(r["role"], []).append(r["entry_id"])
    dated = [e for e in entries if e[1]]
    assert {p for k, p in found if k == "recall_day"} == {d for _, d, _ in dated}
    for (kind, period), roles in found.items():
        if kind == "recall_day":
            assert sorted(roles["own"]) == sorted(i for i, d, _ in dated if d == period)
            others = [i for i, d, _ in dated if d[:4] == period[:4] and d != period]
        elif kind == "recall_target":
            assert roles["own"] == [int(period)]
            others = [i for i, d, _ in dated if d[:4] == day_of[int(period)][:4] and i != int(period)]
        elif kind == "recall_month":
            assert sorted(roles["own"]) == sorted(i for i, d, _ in dated if d[:7] == period) and 2 <= len(roles["own"]) <= 8
            continue
        else:
            gap = lambda i: abs((np.datetime64(day_of[i]) - np.datetime64(period)).astype(int))
            assert period not in day_of.values() and "04" <= period[5:7] <= "09"
            assert sorted(map(gap, roles["near"])) == sorted(gap(i) for i, d, _ in dated if d[:4] == period[:4])[:3]
            continue
        given = roles.get("distractor", [])
        assert len(set(given)) == len(given) == min(3, len(others)) and set(given) <= set(others)
    assert sum(k == "recall_target" for k, _ in found) == sum(bool(re.search(datasets.TARGET, r or "")) and d is not None for _, d, r in entries)
    short = {(r["kind"], r["period"]): r["short"] for r in datasets.shortfalls(table).collect()}
    assert short == {("recall_day", "2021-06-01"): 3, ("recall_target", "2000"): 2}
    again = datasets.log_question_set(log.repartition(6), abstain=25)
    assert sorted(map(repr, table.collect())) == sorted(map(repr, again.collect()))


def test_mixed_examples(spark):
    cards, extras = spark.createDataFrame([(i, "card") for i in range(5)], "k int, text string"), spark.createDataFrame([(i, "extra") for i in range(3, 9)], "k int, text string")
    rows = datasets.mixed_examples(cards, extras, "k").collect()
    assert sorted((r["k"], r["text"], r["origin"]) for r in rows) == [(i, "card", "card") for i in range(5)] + [(i, "extra", "extra") for i in range(5, 9)]
    assert len({r["place"] for r in rows}) == 9
    report = spark.createDataFrame([("sft", None), ("sft", None), ("skipped", "held out")], "kind string, skipped string")
    assert {(r["kind"], r["skipped"]): r["n"] for r in datasets.example_report(report).collect()} == {("sft", None): 2, ("skipped", "held out"): 1}
