"""Small rules: dates in questions, chill seasons, quotes, aliases, feedback, cards, manifests and the layouts of an index."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import dates as D
from fieldmill.functions import text as T
from fieldmill.operators import datasets, evaluation, gate, lexicon, logbook, thresholds
from fieldmill.sources import files


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expression(F.col("v")).alias("x")).orderBy("i")
    return [r["x"] for r in rows.collect()]


def test_dates(spark):
    found = column(spark, [None, "", "2021-05-03 graag", "2021-02-31", "Mei", "in sep", "septembers", "mrt", "maa", "x mar y"], lambda v: D.calendar_argument(v, F.lit(dt.date(2024, 6, 9))))
    today, middle = dt.date(2024, 6, 9), lambda m: dt.date(2024, m, 15)
    assert [(r["day"], r["window"]) for r in found] == [(today, 14), (today, 14), (dt.date(2021, 5, 3), 14), (today, 14), (middle(5), 15), (middle(9), 15), (middle(9), 15), (today, 14), (middle(3), 15), (today, 14)]
    assert column(spark, [dt.date(2021, 5, 3), None], D.dutch_date, "date") == ["3 mei 2021", "-"]
    windows = column(spark, [dt.date(2024, 1, 5), dt.date(2024, 6, 1), dt.date(2024, 10, 31), dt.date(2024, 11, 1)], D.chill_window, "date")
    assert [tuple(w) for w in windows] == [(dt.date(2023, 11, 1), dt.date(2024, 1, 5)), (dt.date(2023, 11, 1), dt.date(2024, 2, 28)), (dt.date(2023, 11, 1), dt.date(2024, 2, 28)), (dt.date(2024, 11, 1), dt.date(2024, 11, 1))]
    assert column(spark, [2, 8], thresholds.default_stage, "int") == ["bud swell", "harvest"]


def test_texts(spark):
    assert column(spark, ["the *Corum' and ^Spalding\\ ones", "PN-3067 A photo", "5 * 3", "end\\"], T.clean_quotes) == ["the 'Corum' and 'Spalding' ones", "A photo", "5 * 3", "end'"]
    assert column(spark, ["Dit project is gefinancierd door", "gewone tekst", None, "{menu}", "12/1/2020"], T.boilerplate) == [True, False, False, True, True]
    kinds = spark.createDataFrame([("paragraph", "Lees meer"), ("paragraph", "Lees meer."), ("list_item", "een twee drie"), ("list_item", "een twee"), ("heading", "x")], "k string, t string")
    assert [r["f"] for r in kinds.select(T.web_fragment(F.col("k"), F.col("t")).alias("f")).collect()] == [True, False, False, True, False]
    concepts = spark.createDataFrame([("a", ["Vlieg", "vlíeg", "x"]), ("b", ["vlieg"])], "concept string, aliases array<string>")
    assert {r["alias"]: r["concepts"] for r in lexicon.alias_table(concepts).collect()} == {"vlieg": ["a", "b"], "x": ["a"]}


def test_feedback_and_cards(spark):
    rows = spark.createDataFrame([("q", "chosen", None), ("q", "rejected", "t")], "question string, preference string, timestamp string")
    assert [r["timestamp"] for r in datasets.feedback_records(rows, F.lit("now")).collect()] == ["now", "t"]
    with pytest.raises(Exception, match="preference must be chosen or rejected"):
        datasets.feedback_records(rows.withColumn("preference", F.lit("maybe")), F.lit("now")).collect()
    items = spark.createDataFrame([(["d#1", "d#12", "e#3", "d"],), ([],), (None,)], "sources array<string>")
    assert sorted(r["card_no"] for r in datasets.gold_card_numbers(items, "d").collect()) == [1, 12]
    cards = spark.createDataFrame([("c1", "Bladluis", "luizen", "Geef 5 ml", "bevestigd"), ("c2", "Blad luis", "op blad", "Knip het weg", "bevestigd"), ("c3", "Bladluis", "x", "later", "bevestigd"), ("c4", "bladluis", "x", "y", "onbekend")], "chunk_id string, title string, observation string, action string, sources_status string")
    hits = spark.createDataFrame([("Bladluizen", c, k) for k, c in enumerate(["c4", "c1", "c2", "c3"])] + [("!!", "c2", 1)], "target string, chunk_id string, rank int")
    targets = spark.createDataFrame([("Bladluizen",), ("!!",), ("none",)], "target string")
    assert [tuple(r) for r in datasets.compliance_extras(targets, hits, cards).collect()] == [("Bladluizen", "Knip het weg")]
    manifest = spark.createDataFrame([(s,) for s in ["acquired", "already_acquired", "blocked", "failed", "missing"]], "status string")
    assert tuple(files.manifest_counts(manifest).first()) == (5, 2, 1, 1)


def test_latencies_of_hot_and_null_groups(spark):
    import statistics

    values = {"a": [1.0] * 500 + [2.0, 3.0, 1000.0], "b": [float(i * i % 997) for i in range(2001)], "c": [5.0], None: [1.0, 2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    for r in evaluation.latency_stats(rows.repartition(5), ["k"], "v").collect():
        vs = sorted(values[r["k"]])
        at = max(1, min(len(vs), round(len(vs) * 0.95)))
        assert (r["n"], r["p50"], r["p95"], r["max"]) == (len(vs), statistics.median(vs), vs[at - 1], vs[-1]) and abs(r["mean"] - statistics.mean(vs)) < 1e-9


GOOD = "This is the first complete sentence of the text. And this is one more of the same kind."


def test_the_gate_repairs_and_obeys(spark):
    rows = [("c1", "d", GOOD, "en"), ("c2", "d", GOOD + " " + GOOD + " It ends without a", "en"), ("c3", "e", GOOD + " This develop^ment is damaged by something. " + GOOD, "en"), ("c4", "e", GOOD + " Here the ñeshed word is damage too. " + GOOD, "en"), ("c5", "e", None, "en")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, lang string")
    losses = spark.createDataFrame([("c1", "en", f"s{i}", 1.0 + i % 3 / 10) for i in range(20)] + [("c3", "en", "odd", 50.0), ("c3", "en", "odder", 60.0)], "chunk_id string, lang string, sentence string, loss double")
    overrides = spark.createDataFrame([("c2", "ok")], "chunk_id string, override string")
    run = lambda c, **k: {r["chunk_id"]: r for r in gate.run_gate(c, "chunk_id", "doc_id", known_from=1, accents={"en": ""}, **k).collect()}
    plain = run(chunks, losses=losses, overrides=overrides)
    assert {k: r["verdict"] for k, r in plain.items()} == {"c1": "ok", "c2": "ok", "c3": "fail", "c4": "ok", "c5": "fail"}
    assert plain["c2"]["overruled"] and plain["c2"]["incomplete_examples"] == ["It ends without a"] and not plain["c1"]["overruled"]
    assert plain["c3"]["reasons"] == ["mixed columns"] and plain["c3"]["worst"] == "odder" and plain["c4"]["oov_words"] == ["ñeshed"]
    fixed = run(chunks, repair=True)
    assert {k: r["verdict"] for k, r in fixed.items() if k != "c5"} == {"c1": "ok", "c2": "ok", "c3": "ok", "c4": "ok"}
    assert fixed["c2"]["text"] == f"{GOOD} {GOOD}" and fixed["c3"]["repairs"] == ["This develop^ment is damaged by something."] and fixed["c4"]["repairs"] == ["Here the ñeshed word is damage too."]
    once = gate.run_gate(chunks, "chunk_id", "doc_id", known_from=1, accents={"en": ""}, repair=True).select("chunk_id", "doc_id", "text", "lang", "text_raw")
    assert {k: (r["text"], r["repairs"]) for k, r in run(once, repair=True).items()} == {k: (r["text"], r["repairs"]) for k, r in fixed.items()}
    table = gate.document_table(gate.run_gate(chunks, "chunk_id", "doc_id", known_from=1, accents={"en": ""}), "doc_id")
    assert {r["doc_id"]: (r["n"], r["n_ok"], r["n_warn"] + r["n_fail"], r["issue_page_break"]) for r in table.collect()} == {"d": (2, 1, 1, 1), "e": (3, 2, 1, 0)}


def test_page_headers_in_chunks(spark):
    head = "The growing of cherries in the north"
    rows = [(f"c{i}", "d", f"{head} goes on {i}.\n\nText of its own {i} that is not like the others here.", "en") for i in range(4)] + [("c9", "d", f"Inside a text of {head}.", "en"), ("x1", "e", f"{head} once.", "en")]
    found = gate.residue_chunks(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, lang string"), "chunk_id", "doc_id")
    assert sorted(r["chunk_id"] for r in found.collect()) == ["c0", "c1", "c2", "c3", "c9"]


def test_both_layouts_of_an_index(spark):
    old = spark.createDataFrame([("a", "d", ["T1", "T2"], ["kaart"], 4, "en"), ("b", "d", [], [], None, None)], "chunk_id string, doc_id string, section_titles array<string>, types array<string>, page_num int, language string")
    new = spark.createDataFrame([("a", "d", "T", ["H", "T"], "prose", [1, 2])], "chunk_id string, doc_id string, title string, heading_path array<string>, type string, pages array<int>")
    columns = ["title", "heading_path", "type", "pages", "chunk_index", "lang"]
    assert [tuple(r) for r in gate.indexed_chunks(old).orderBy("chunk_id").select(*columns).collect()] == [("T1", ["T1"], "kaart", [4], 0, "en"), ("", [], "prose", [1], 1, "nl")]
    assert [tuple(r) for r in gate.indexed_chunks(new).select(*columns).collect()] == [("T", ["H", "T"], "prose", [1, 2], 0, "nl")]


def test_answers_and_cards_as_questions(spark):
    schema = "item int, category string, answer string, error string, seconds double, grounding string, key_facts array<array<string>>, must_mention array<array<string>>"
    rows = [
        (1, "kennisbank", "Knip de Tákken weg", None, 1.0, "green", [["takken"], ["blad", "loof"]], None), (2, "kennisbank", None, "TimeoutError: x", 9.0, None, [["a"]], None), (3, "guardrail", "Gebruik 2 l/ha", None, 2.0, "red", None, [["etiket"]]),
        (4, "guardrail", "Zie het etiket.", None, 3.0, "green", [], [["etiket", "ctgb"]]), (5, "kennisbank", "(geen antwoord)", None, 4.0, "red", None, None),
    ]
    found = evaluation.evaluate_answers(spark.createDataFrame(rows, schema))
    by = {r["item"]: r for r in found.collect()}
    assert (by[1]["coverage"], by[1]["missing_facts"], by[1]["guardrail_pass"]) == (0.5, [["blad", "loof"]], None)
    assert (by[2]["answered"], by[2]["coverage"], by[2]["error"]) == (None, None, "TimeoutError: x")
    assert (by[3]["violations"], by[3]["mentions"], by[3]["guardrail_pass"], by[4]["guardrail_pass"], by[5]["answered"]) == (["DOSE"], False, False, True, False)
    r = evaluation.answer_report(found).first()
    assert (r["n"], r["n_failed"], r["n_content"], r["n_guardrail"], r["pass_share"], r["n_violating"], r["seconds_p50"], r["seconds_max"], r["coverage"]) == (5, 1, 2, 2, 0.5, 1, 2.5, 4.0, 0.75)
    empty = evaluation.answer_report(found.where("false")).first()
    assert (empty["n"], empty["seconds_mean"]) == (0, None)
    cards = [("d", "probleem", "12. Gele bladeren", "- Observatie: plassen na regen\n- Actie: x"), ("d", "probleem", "Zonder nummer", "- Observatie: y"), ("d", "prose", "1. x", "- Observatie: y"), ("d", "probleem", "3. Leeg", "- Observatie:  \n- Actie: z"), ("d", "probleem", None, "- Observatie: y")]
    items = evaluation.observation_items(spark.createDataFrame(cards, "doc_id string, type string, title string, text string")).collect()
    assert [tuple(i) for i in items] == [("obs12", "kennisbank", "plassen na regen", "d#12")]


def test_words_and_chunks_are_made_in_their_row(spark, sf_dir):
    from fieldmill.plans import gate_queries

    words = gate.chunk_words(gate_queries._chunks(spark, sf_dir).where("doc_id >= 0"), "chunk_id")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "RoundRobin" not in x and "REPARTITION" not in x]
    by_word = {(r["word"], r["n"]) for r in gate.vocabulary(gate.chunk_words(spark.createDataFrame([("a", "Kers is Kers. De kers", "nl")], "k string, text string, lang string"), "k")).collect()}
    assert by_word == {("kers", 3)}


def test_words_beyond_ascii_are_those_of_all_words(spark):
    """What a repair needs of a corpus' words: the same rows as of all words, and a word's place in its sentence as before."""
    chunks = spark.createDataFrame([("a", "Kers Ürk äpfel. De kers. Größe GRÖSSE is él", "de"), ("b", None, "en"), ("c", "plain words only", None)], "k string, text string, lang string")
    rows = lambda **kw: sorted(tuple(r) for r in gate.chunk_words(chunks, "k", **kw).collect() if not r["word"].isascii())
    assert rows(beyond_ascii=True) == rows() != []
    assert gate.chunk_words(chunks, "k", beyond_ascii=True).count() == len(rows())
    assert "size(flatten" not in gate.chunk_words(chunks, "k")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["string", "long"])
def test_noise_names_its_chunks_and_shuffles_no_words(spark, kind):
    """Unknown words come from the vocabulary with their chunks, as counted plainly; the words of texts aren't shuffled once more (F13)."""
    rng = random.Random(5)
    pool = ["kers", "blad", "bladkers", "Kers", "ñeshed", "él", "größe", "Größe", "ÉL"] + [f"{a}{b}x" for a in "abcdefg" for b in "abcdefg"] + [f"Q{a}{a}z" for a in "abcd"] + [f"q{a}{a}z" for a in "abcd"]
    texts = [" ".join(rng.choice(pool) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(9))) for _ in range(24)] + ["", "éenmaal tweemaal tweemaal", "Kers bladkers eenling blad kers"]
    data = [(i if kind == "long" else f"c{i}", t, ["nl", "en", "es", None][i % 4]) for i, t in enumerate(texts)] + [(99 if kind == "long" else "null", None, "en"), (100 if kind == "long" else "nl", "bladkersje kersblad kersblad", "nl")]
    chunks = spark.createDataFrame(data, f"k {kind}, text string, lang string").repartition(3)
    known_from, accents = 3, {"en": "", "es": "áéíñóúü"}
    n, inner = Counter(), set()
    for _, text, _ in data:
        for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
            found = re.findall(r"[^\W\d_]{3,}", sentence)
            n.update(w.lower() for w in found)
            inner |= {w.lower() for w in found[1:] if w[0].isupper()}
    known = {w for w in n if n[w] >= known_from}
    wanted = {}
    for key, text, lang in data:
        found = re.findall(r"[^\W\d_]{3,}", text or "")
        odd = lambda w: not w.translate({ord(c): None for c in accents.get(lang, "")}).isascii()  # noqa: B023, E731
        made = lambda w: lang == "nl" and any(w[:i] in known and w[i:] in known for i in range(3, len(w) - 2))  # noqa: B023, E731
        bad = [w for w in found if not w[0].isupper() and (odd(w) or n[w] < known_from and w not in inner and not made(w))]
        wanted[key] = (len(found), len(bad), round(len(bad) / len(found), 3) if found else 0.0, sorted(set(bad)))
    terms = gate.settled(gate.vocabulary(gate.chunk_words(chunks, "k"), "k"))
    found = gate.noise(chunks, "k", terms, known_from, accents)
    assert {r["k"]: tuple(r)[1:] for r in found.collect()} == wanted
    assert {"kersblad", "tweemaal", "éenmaal", "eenling"} & {w for v in wanted.values() for w in v[3]} == {"tweemaal", "éenmaal", "eenling"}
    plain = gate.noise(chunks, "k", terms, known_from, accents, compound_languages=())
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" not in plan and "explode(flatten" not in plan


def test_a_drill_down_deals_by_rows(spark, monkeypatch):
    """What a task holds doesn't grow with the log (F20): as many tasks as there are rows for, and nothing sorted or broadcast for a join."""
    monkeypatch.setattr(logbook, "TASK_ROWS", 40)
    entries = spark.createDataFrame([(i, dt.date(2020, 1, 1) if i % 5 else None) for i in range(200)], "entry_id long, day date")
    applications = spark.createDataFrame([(i, p % 2, f"p{p}", None if p == 2 else f"{i} kg") for i in range(0, 200, 2) for p in range(4)] + [(999, 0, "none", "x")], "entry_id long, pos int, product string, amount string")
    wanted = spark.createDataFrame([(i,) for i in [*range(0, 200, 3), 3, 6, 6, 500, 999]], "entry_id long")
    found = logbook.drill_down(entries, applications, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    text = lambda i: "" if i % 2 else f"p0 ({i} kg); p2; p1 ({i} kg); p3 ({i} kg)"
    assert sorted((r["entry_id"], r["applications"]) for r in found.collect()) == [(i, text(i)) for i in range(0, 200, 3)]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning(entry_id") == 4
    assert found.rdd.getNumPartitions() == 1 + 601 // 40
    nothing = logbook.drill_down(entries.where("false"), applications.where("false"), wanted)
    assert nothing.collect() == []
