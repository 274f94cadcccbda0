import numpy as np
import pytest

from fieldmill.llm import op09_mixing as mixing


def numpy_rake(cells, targets, rounds=400):
    weights = np.array([c["tokens"] for c in cells], dtype=float)
    weights /= weights.sum()
    for _ in range(rounds):
        for m, wanted in targets.items():
            for value, share in wanted.items():
                own = np.array([c[m] == value for c in cells])
                if own.any() and weights[own].sum() > 0:
                    weights[own] *= share / weights[own].sum()
    return weights


def test_rake_equals_numpy(spark):
    rng = np.random.default_rng(5)
    cells = [{"source": f"s{i}", "lang": f"l{j}", "topic": f"t{k}", "tokens": float(rng.integers(1, 10_000))} for i in range(6) for j in range(3) for k in range(3) if rng.random() < 0.9]
    targets = {"source": {f"s{i}": (i + 1) / 21 for i in range(6)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {"t0": 0.1, "t1": 0.2, "t2": 0.7}}
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double").coalesce(1)
    wanted = {(c["source"], c["lang"], c["topic"]): w for c, w in zip(cells, numpy_rake(cells, targets), strict=True)}
    for small in (True, False):
        for r in mixing.rake(table, small, targets).collect():
            assert abs(r["weight"] - wanted[r["source"], r["lang"], r["topic"]]) < 1e-3 * wanted[r["source"], r["lang"], r["topic"]] + 1e-9


def test_probabilities_spend_the_budget(spark):
    cells = spark.createDataFrame([("a", 100.0, 0.6), ("b", 10_000.0, 0.3), ("c", 5_000.0, 0.1)], "source string, tokens double, weight double")
    found = {r["source"]: r for r in mixing.calibrate(cells, 0.5).collect()}
    assert found["a"]["probability"] == 1.0
    assert abs(sum(r["tokens"] * r["probability"] for r in found.values()) - 7550) < 1e-6
    assert abs(found["b"]["probability"] * 10_000 / (found["c"]["probability"] * 5_000) - 3) < 1e-9


def test_whole_table(spark, sf_dir):
    rows = mixing.op9_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == len(texts)
    assert all(r["n_tokens"] == len([t for t in texts[r["doc_id"]].replace("　", "x").split() if t]) for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    assert abs(sum(r["n_tokens"] * r["probability"] for r in rows) / total - mixing.BUDGET) < 1e-6
    kept = {r["doc_id"] for r in mixing.sample(docs).collect()}
    assert kept == {r["doc_id"] for r in rows if r["sampled"]}
    assert 0.35 < sum(r["n_tokens"] for r in rows if r["sampled"]) / total < 0.65
    cells = {}
    for r in rows:
        cells.setdefault((r["source"], r["lang"], r["topic"]), r["weight"])
    sources = {}
    for r in rows:
        sources[r["source"]] = sources.get(r["source"], 0) + r["n_tokens"]
    scale = sum(n**mixing.TEMPER for n in sources.values())
    for source, n in sources.items():
        got = sum(w for (s, _, _), w in cells.items() if s == source)
        assert abs(got - n**mixing.TEMPER / scale) < 1e-3


def test_defined_cases(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["source"] for r in rows} >= {"(none)", "src0"} and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.sample(no_docs).count() == 0
    only = mixing.sample(odd_docs, targets={"source": {"src0": 1.0}})
    assert only.columns == odd_docs.columns and only.where("source IS NULL OR source <> 'src0'").count() == 0


def correlated(spark, few):
    """Sources that almost determine the language, so that the first rounds hardly lower the gap."""
    rows = [("a", "x", "t", 10_000.0), ("b", "y", "t", 10_000.0), ("a", "y", "t", few)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens double").coalesce(1)


SLOW = {"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 1.0}}


def test_slow_convergence_goes_on_until_it_fits(spark):
    rows = mixing.rake(correlated(spark, 1.0), True, SLOW).collect()
    for m, wanted in SLOW.items():
        for value, share in wanted.items():
            assert abs(sum(r["weight"] for r in rows if r[m] == value) - share) <= mixing.TOLERANCE * share


def test_same_rounds_at_every_size(spark):
    small, large = ({(r["source"], r["lang"]): r["weight"] for r in mixing.rake(correlated(spark, 30_000.0), s, SLOW).collect()} for s in (True, False))
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-12 for k in small)


def test_targets_that_the_cells_cannot_meet_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", "t", 5.0), ("b", "y", "t", 5.0)], "source string, lang string, topic string, tokens double").coalesce(1)
    with pytest.warns(UserWarning, match="can't meet the targets together"):
        mixing.rake(cells, True, SLOW).collect()


def test_budget_is_spent_however_many_cells_run_out(spark):
    n = 40
    cells = spark.createDataFrame([(f"s{i}", 2.0**i, 4.0 ** -min(i, n - 2)) for i in range(n)], "source string, tokens double, weight double")
    found = mixing.calibrate(cells.coalesce(1), 0.9999).collect()
    assert abs(sum(r["tokens"] * r["probability"] for r in found) / sum(r["tokens"] for r in found) - 0.9999) < 1e-9
