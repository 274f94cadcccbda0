"""The gate reads a text once for all its signals, and odd texts get what the SQL says."""

import duckdb
import pytest

from fieldmill.functions import prose
from fieldmill.operators import gate
from fieldmill.plans.registry import ORACLES, QUERIES
from tests.test_catalogue import rows_of

LONG = "The growing of early cherries in the north asks for much care of all trees."
ODD = [
    "One\x0btwo three four five six seven eight. This one is a sentence of more than eight words in all.",
    "\xa0Spaced\xa0words stay one token here. Ends with a space of its own.\xa0",
    "- Een lijst van vier woorden\n1) kort\n* Another list item without an end\n** not a heading\n**A heading**\nText. of the (see fig. 3 a) kind.",
    "Cafés et déjà vus sont ici. Straße ñeshed élan 中文字 İstanbul Ünlaut. Überall stehen Bäume und Äpfel, sagt Dr. Äpfel.",
    "A (b. c) d? e! f; 12. Then (5) 1999 1900 2001: 4 (5) Vol. 3 al. 2 sp. x regen- kappen en- of ends",
    "ALL IN CAPITALS 1999 Abc. 2000 Def. 12 (4)\r\nline two\r\n\r\nline three",
    "", "\n\n\n", "...", "x", "\n".join([LONG] * 9), "\n".join(f"{LONG} Part {i}." for i in range(20)),
]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, t, [None, "en", "fr", "de"][i % 4], f"s{i % 2}", len(t)) for i, t in enumerate(ODD)])
    c.execute(f"COPY documents TO '{folder}/documents.parquet'")
    return folder


@pytest.mark.parametrize("name", ["qc_verdict", "qc_verdict_counts", "failing_chunks"])
def test_odd_texts_equal_sql(spark, odd_dir, name):
    found = QUERIES[name](spark, str(odd_dir))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet'")
    wanted = c.sql(ORACLES[name])
    assert rows_of(found.columns, found.collect()) == rows_of(wanted.columns, wanted.fetchall())


def test_texts_are_read_once_for_all_signals(spark, sf_dir):
    plan = QUERIES["failing_chunks"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("ArrowEvalPython") == 1


def test_words_counted_in_python(spark):
    rows = [(k, "Kers is Kers. De kers, de boom Kers" if k < 3 else "ooit. Zelden ooit weer", "nl" if k % 2 else "en") for k in range(4)]
    chunks = spark.createDataFrame(rows, "k long, text string, lang string")
    columns = ["word", "n", "inner", "__small", "__splits", "__from0", "__to0"]
    wanted = {r["word"]: tuple(r[c] for c in columns) for r in gate.vocabulary(gate.chunk_words(chunks, "k"), "k").collect()}
    found = {r["word"]: tuple(r[c] for c in columns) for r in gate.counted_words(chunks, "k").collect()}
    assert found.keys() == wanted.keys()
    for w, r in found.items():
        assert r[:5] == wanted[w][:5] or r[1] > 2 and r[:4] == wanted[w][:4]
        assert r[1] > 2 or r[5:] == wanted[w][5:]
    assert prose.sentence_words("Van Kers. Kers kers")[2] == {"kers"}
