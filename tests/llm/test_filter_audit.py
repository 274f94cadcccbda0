import itertools
import re

import duckdb
import numpy as np
import pytest

from fieldmill.llm import op13_filter_audit as op

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, earlier):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": earlier,
    }


def audit_by_loops(docs, labels):
    """Documents one by one through all 120 orders."""
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(r["doc_id"], first.get(r["text"] or "", r["doc_id"]))
    marks = {}
    for r in labels:
        old = marks.get(r["doc_id"], (0, 0))
        marks[r["doc_id"]] = (max(old[0], r["quality"] or 0), max(old[1], r["toxic"] or 0))
    rows, shapley = {}, {}
    for r in docs:
        text = r["text"] or ""
        part = r["lang"] if r["lang"] is not None else ""
        bad = fails(text, r["doc_id"] is not None and r["doc_id"] > first[text])
        good, toxic = marks.get(r["doc_id"], (0, 0)) if r["doc_id"] is not None else (0, 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = rows.setdefault((part, order, step), [0] * 6)
                removed = bad[f] and not gone
                row[0] += not (gone or bad[f])
                row[1] += removed
                row[2] += bad[f] and gone
                row[3] += bad[f] and sum(bad.values()) == 1
                row[4] += removed and good
                row[5] += removed and toxic
                shapley[part, f] = shapley.get((part, f), 0) + removed
                gone = gone or bad[f]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table_equals_loops(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "labels"))
    found = result(op.op13_filter_audit(spark, sf_dir))
    assert found == audit_by_loops(docs, labels)
    assert len(found) == 600 * len({r["lang"] for r in docs})


def test_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = sorted(c.sql(f"SELECT {', '.join(COLUMNS)} FROM ({op.ORACLE_OP13})").fetchall())
    assert result(op.op13_filter_audit(spark, sf_dir)) == wanted


def audited(docs, labels):
    return op.audit(op.flagged_documents(docs, labels), op.FILTERS, list(op.LABELS), "part")


def test_defined_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert result(audited(odd_docs, labels)) == audit_by_loops(odd_docs.collect(), labels.collect())
    assert result(audited(odd_docs, labels.where("false"))) == audit_by_loops(odd_docs.collect(), [])
    assert audited(no_docs, labels).count() == 0
    clash = odd_docs.withColumn("part", op.F.lit("x")).withColumn("A", op.F.lit(1)).withColumn("mask", op.F.lit(1))
    assert result(audited(clash, labels)) == result(audited(odd_docs, labels))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_bitmaps_of_many_parts(parts):
    rng = np.random.default_rng(parts)
    bits, part = rng.random((5, 333)) < 0.3, np.append(rng.integers(0, parts, 333 - parts), np.arange(parts))
    counts = op.subset_counts(*op.packed(bits, part), 3)
    for k, (mask, f) in enumerate(op.subsets(3)):
        before = np.any([bits[g] for g in range(3) if mask >> g & 1] or [np.zeros(333, bool)], axis=0)
        others = np.any([bits[g] for g in range(3) if g != f], axis=0)
        for p in range(parts):
            here = part == p
            wanted = [~before & ~bits[f], bits[f] & ~before, bits[f] & before, bits[f] & ~others, bits[f] & ~before & bits[3], bits[f] & ~before & bits[4]]
            assert counts[p, k].tolist() == [int((here & w).sum()) for w in wanted]


def test_any_number_of_filters(spark):
    rows = spark.createDataFrame([("p", True, False), ("p", True, True), ("q", False, True)], "part string, x boolean, y boolean")
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in op.audit(rows, ["x", "y"], [], "part").collect()}
    assert found["p", "xy", 1] == (0, 2, 0, 3) and found["p", "xy", 2] == (0, 0, 1, 1) and found["q", "yx", 1] == (0, 1, 0, 2)
    with pytest.raises(ValueError, match="filters"):
        op.audit(rows, list("abcdefghi"), [], "part")


def test_a_hot_text_is_spread(spark):
    """Copies that hold most rows meet the first one by doc_id and digest, so one key never holds them."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN 'the same' ELSE concat('text ', id) END AS text", "'en' AS lang")
    flagged = op.flagged_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert flagged.where("E").count() == 1999
    assert "BroadcastNestedLoopJoin" not in flagged._jdf.queryExecution().toString()
