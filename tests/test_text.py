import re

import pyarrow as pa
from pyspark.sql import functions as F

from fieldmill.functions import text as T
from fieldmill.operators import assistant, datasets, evaluation, layout, lexicon, procedures, quality, registrations, retrieval, structure, usage
from fieldmill.sources import files, markup


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression.alias("x")).first()["x"]


def test_quantities(spark):
    cases = {"0,6 liter": (600.0, "ml"), "300 ml": (300.0, "ml"), "15 kg op 200 liter water": (15000.0, "g"), "2.5 GR": (2.5, "g"), "naam zonder getal": None, "": None}
    t = spark.createDataFrame([(k,) for k in cases], "t string").select("t", usage.parse_quantity(F.col("t")).alias("q")).collect()
    assert {r["t"]: r["q"] and (r["q"]["value"], r["q"]["unit"]) for r in t} == cases


def test_text_rules(spark):
    loop = "This is a long sentence. " * 3 + "Ja. And an unfinished"
    assert one(spark, T.collapse_repetition(F.col("t")), t=loop) == "This is a long sentence. Ja."
    assert one(spark, T.collapse_repetition(F.col("t")), t="Ja. Ja. Ja. Ja.") == "Ja. Ja. Ja. Ja."
    assert tuple(one(spark, T.strip_think(F.col("t")), t="<think> a </think> b")) == ("a", "b")
    assert tuple(one(spark, T.strip_think(F.col("t")), t="x <think> a")) == ("a", "")
    assert one(spark, T.tool_call(F.col("t")), t='```json\n{"call_tool": "rain", "args": null}\n```') == "rain"
    assert one(spark, T.forbidden(F.col("t")), t="Gebruik 2 l/ha. Middel X is niet toegelaten.") == ["DOSE", "CLAIM"]
    assert one(spark, T.forbidden(F.col("t")), t="controleer of X is toegelaten") == []
    assert one(spark, T.normalize_text(F.col("t")), t="contin-\nued  text­\n here​") == "continued texthere"
    assert one(spark, T.caps_heading(F.col("t")), t="BOTANICAL CLASSIFICATION") and not one(spark, T.caps_heading(F.col("t")), t="1955. FRESH FRUIT")
    assert one(spark, T.page_number(F.col("t")), t="- p. 12 / 40 -") and not one(spark, T.page_number(F.col("t")), t="12 apples")
    assert one(spark, T.format_pages(F.array(F.lit(3), F.lit(2), F.lit(4)))) == "p.2-4" and one(spark, T.format_pages(F.array(F.lit(5), F.lit(2)))) == "p.2, 5"
    hints = one(spark, T.time_hints(F.col("t")), t="wat deed ik op 3 mei 2021, en in juni?")
    assert (hints["years"], hints["months"], [str(d) for d in hints["dates"]]) == ([2021], [5, 6], ["2021-05-03"])


def test_cards_and_steps(spark):
    card = "- Observatie: gele bladeren\n- Actie: Controleer de bodem, en geef water; meet pH.\n- Bronnen (Bevestigd): boek"
    r = one(spark, T.parse_card(F.col("t")), t=card)
    assert (r["observation"], r["why"], r["sources"], r["sources_status"]) == ("gele bladeren", "", "boek", "bevestigd")
    assert one(spark, T.split_steps(F.col("t")), t=r["action"]) == ["controleer de bodem", "geef water", "meet pH"]


def test_verdicts(spark):
    good = "This is the first complete sentence of the text. And this is one more of the same kind. " * 3
    rows = [(1, good), (2, "starts in the middle and goes on for a while. Ends well here."), (3, "12 34 56 78 9 10 11 12 13 14 15 16 17"), (4, None)]
    found = {r["id"]: r["verdict"] for r in quality.verdict(quality.signals(spark.createDataFrame(rows, "id int, text string").withColumn("lang", F.lit("en")))).collect()}
    assert found == {1: "ok", 2: "fail", 3: "fail", 4: "fail"}


def python_sentences(text):
    """By loops: pieces after . ! or ?, glued where the full stop ends no sentence."""
    out = []
    for piece in [p for p in (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", text)) if p]:
        before = out[-1] if out else ""
        word = re.search(r"(?:^|\s)[(\[{\"'‘“]*([A-Za-z]+)\.$", before)
        word = word.group(1) if word else ""
        small = piece[0].islower()
        opened = sum(before.count(c) for c in "([{") > sum(before.count(c) for c in ")]}")
        rules = [
            piece[0] in ";,)",
            word.lower() in T.ABBREVIATIONS,
            len(word) == 1 and word.isupper(),
            0 < len(word) <= 3 and word.islower() and (small or piece[0].isdigit()),
            small and (opened or before.endswith((").", "?", "!"))),
            re.fullmatch(r"\d+(?:[\s,;]+[A-Za-z0-9]{1,2})*\)+\.?", piece) is not None,
            re.fullmatch(r"\d+\.", before) is not None,
        ]
        if out and any(rules):
            out[-1] = f"{before} {piece}"
        else:
            out.append(piece)
    return out


def test_whole_sentences_equal_loops(spark, sf_dir):
    texts = [
        "Smith et al. found M. laxa spp. here. It was 5 lb. per tree. it goes on.", "See (fig. 3). Then (table 1, A). more. ; and so", "1. First of all. 2. Second (an open. bracket) here! what? yes. Ja.", "", "no end", "A. B. C. done? Fine!",
        "Wrapped\nlines. With breaks.\n\nAnd more etc. Then vs. others.",
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.whole_sentences(F.col("text")).alias("s")).collect()
    assert all(r["s"] == python_sentences(texts[r["id"]]) for r in rows)


def test_every_rule_of_the_gate(spark):
    good = "This is the first complete sentence of the text. And this is one more of the same kind. " * 3
    base = {"title": "", "heading_path": [], "type": "", "oov_ratio": 0.0, "page_residue": False, "outliers": 0, "outlier_share": 0.0, "text": good}
    cases = [
        ({}, "ok", "", ""),
        ({"title": "Literature cited"}, "references", "bibliography", "references"),
        ({"heading_path": ["Verder lezen"]}, "references", "bibliography", "references"),
        ({"title": "Nieuwsbrief juni"}, "fail", "part of the site", "chrome"),
        ({"oov_ratio": 0.2}, "fail", "many unknown words", "ocr"),
        ({"oov_ratio": 0.07}, "warn", "unknown words", "ocr"),
        ({"outliers": 2, "outlier_share": 0.3}, "fail", "mixed columns", "columns"),
        ({"outliers": 1}, "warn", "unlikely sentences", "columns"),
        ({"page_residue": True}, "fail", "page residue", "page_break"),
        ({"text": "Too short."}, "fail", "begins inside a sentence; ends inside a sentence; too little text", "page_break,incomplete"),
        ({"text": "Water it well now.", "type": "probleem"}, "ok", "", ""),
        ({"text": good + "A regen- kappen was left here. "}, "warn", "hyphens of line ends", "page_break"),
        ({"text": "In the middle of it all. " .lower() + good}, "fail", "begins inside a sentence", "page_break"),
        ({"text": good + "And no end"}, "fail", "ends inside a sentence", "page_break"),
        ({"text": "alpha beta\n" * 30}, "fail", "no running sentences; language; begins inside a sentence", "table,language,page_break"),
    ]
    rows = [(i, *(base | case[0]).values()) for i, case in enumerate(cases)]
    table = spark.createDataFrame(rows, "id int, title string, heading_path array<string>, type string, oov_ratio double, page_residue boolean, outliers int, outlier_share double, text string").withColumn("lang", F.lit("en"))
    found = {r["id"]: r for r in quality.verdict(quality.signals(table)).collect()}
    for i, (_, verdict, reasons, categories) in enumerate(cases):
        r = found[i]
        if i != len(cases) - 1:
            assert (r["verdict"], "; ".join(r["reasons"]), ",".join(r["categories"])) == (verdict, reasons, categories), cases[i]
        else:
            assert r["verdict"] == "fail" and r["reasons"][:2] == ["no running sentences", "language"]


def test_repair_drops_garbled_sentences(spark):
    text = "A first good sentence here. Another with developn^ent inside it. One more good one here. And the last good one."
    rows = spark.createDataFrame([(1, text, ["developn^ent"])], "id int, text string, bad array<string>")
    assert quality.repair(rows, garbled="bad").first()["repairs"] == ["Another with developn^ent inside it."]


def test_noise_compounds_and_garbled(spark):
    docs = spark.createDataFrame([(1, "bladmonsters en kaliumgehaltenmeting zijn ñeshed en xqzzy bladmonsters", "nl"), (2, "bladmonsters ñeshed p.stils f(irtilized developn^ent", "en")], "id int, text string, lang string")
    known = spark.createDataFrame([("blad",), ("monsters",), ("kalium",), ("gehalten",), ("meting",), ("zijn",)], "word string")
    none = spark.createDataFrame([], "term string")
    unknown = {(r["id"], r["word"]): r["n"] for r in lexicon.unknown_words(docs, "id", known, none).collect()}
    assert unknown == {(1, "ñeshed"): 1, (1, "xqzzy"): 1, (2, "bladmonsters"): 1, (2, "ñeshed"): 1, (2, "stils"): 1, (2, "irtilized"): 1, (2, "developn"): 1, (2, "ent"): 1}
    assert {r["token"] for r in lexicon.garbled_tokens(docs, "lang", none).where("lang = 'en'").collect()} == {"ñeshed", "f(i", "developn^ent"}
    words = spark.createDataFrame([("bladmonsters",), ("kaliumgehaltenmeting",), ("bladxmonsters",), ("bladsmonsters",)], "word string")
    assert {r["word"] for r in lexicon.compounds(words, known).collect()} == {"bladmonsters", "kaliumgehaltenmeting", "bladsmonsters"}
    assert {r["word"] for r in lexicon.compounds(words, known, depth=1).collect()} == {"bladmonsters", "bladsmonsters"}


def test_every_row_is_in_a_preference_pair(spark):
    rows = spark.createDataFrame([("a", i, i < 9) for i in range(10)] + [("b", i, i == 20) for i in range(20, 24)] + [("c", 30, True)], "g string, k int, good boolean")
    pairs = datasets.preference_pairs(rows, "g", "k", F.col("good")).collect()
    assert sorted((r["chosen"], r["rejected"]) for r in pairs) == [(i, 9) for i in range(9)] + [(20, 21), (20, 22), (20, 23)]


def test_repair_drops_only_and_repeats(spark):
    text = "A first good sentence here. broken start of a line. Another good sentence follows. One more good one here. And the last good one."
    once = quality.repair(spark.createDataFrame([(1, text)], "id int, text string"))
    twice = quality.repair(once)
    assert once.first()["repairs"] == ["broken start of a line."] and once.first() == twice.first()


HTML = '<html><body><nav><a href="/x">x</a></nav><main><h1>Top</h1><p>First <b>bold text.<p>Second.</b><ul><li>one two three<li>four</ul><ul><li><a>alpha</a></li><li><a>beta</a></li><li><a>gamma</a></li></ul><table><tr><td>1</td><td>2</td></tr></table><p>Second.</p><p>Second.</p></main></body></html>'


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    rows = [(r["kind"], r["text"]) for r in markup.html_blocks(pages, "page_id", "html").where("doc_id = '1'").orderBy("pos").collect()]
    assert rows == [("heading", "Top"), ("paragraph", "First bold text."), ("paragraph", "Second."), ("list_item", "one two three"), ("list_item", "four"), ("table", "1 | 2"), ("paragraph", "Second.")]


def test_markdown_blocks(spark):
    text = "# Title\nline one\nline [two](https://a.b/c)\n\n- item **bold**\n| a | b |\n|---|---|\n| 1 | 2 |\n**1. Card one**\n**2. Card two**\n**3. Card three**\nend"
    rows = markup.markdown_blocks(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("pos").collect()
    got = [(r["kind"], r["text"], r["level"]) for r in rows]
    assert got == [("heading", "Title", 1), ("paragraph", "line one line two", None), ("list_item", "item bold", None), ("table", "a | b\n1 | 2", None), ("heading", "1. Card one", 3), ("heading", "2. Card two", 3), ("heading", "3. Card three", 3), ("paragraph", "end", None)]
    assert rows[1]["urls"] == ["https://a.b/c"]


def blocks(spark, rows):
    return spark.createDataFrame([("d", i, k, t, 1, lv, None) for i, (k, t, lv) in enumerate(rows)], structure.BLOCK_SCHEMA)


def test_merge_sections_and_chunks(spark):
    long = "word " * 40
    rows = [("paragraph", "It goes on", None), ("figure", "", None), ("paragraph", "and ends here.", None), ("heading", "A", 1), ("heading", "A1", 2), ("paragraph", "Short one.", None), ("heading", "A2", 2), ("paragraph", "Short two.", None), ("heading", "B", 1), ("paragraph", long + "end.", None)]
    merged = structure.merge_continuations(blocks(spark, rows))
    assert merged.where("pos = 0").first()["text"] == "It goes on and ends here."
    found = structure.sections(merged)
    assert [r["heading_path"] for r in found.orderBy("pos").collect()] == [[], [], ["A", "A1"], ["A", "A2"], ["B"]]
    chunks = structure.finish_chunks(structure.define_chunks(found.repartition(3))).orderBy("chunk_index").collect()
    assert [(c["title"], c["merged"]) for c in chunks] == [("d", False), ("A1 / A2", True), ("B", False)] and len({c["chunk_id"] for c in chunks}) == 3


def test_cap_and_rank(spark):
    rows = [(1, i + 1, g, t) for i, (g, t) in enumerate([("a", "x"), ("a", "card"), ("a", "x"), ("a", "x"), ("b", "x")])]
    t = spark.createDataFrame(rows, "query int, rank int, doc string, type string")
    kept = retrieval.cap_per_group(t, "query", "doc", "rank", 2, F.col("type") == "card").orderBy("rank").collect()
    assert [(r["doc"], r["type"], r["rank"]) for r in kept] == [("a", "x", 1), ("a", "card", 2), ("a", "x", 3), ("b", "x", 4)]


def test_expected_sources(spark):
    hits = spark.createDataFrame([(1, 1, "d1", "3. x"), (1, 2, "d1", "7. y"), (2, 1, "d2", "z")], "query int, rank int, doc_id string, title string")
    expected = spark.createDataFrame([(1, "d1#7"), (2, "d2"), (3, "d9")], "query int, source string")
    assert {r["query"]: r["first_rank"] for r in evaluation.first_hit_rank(hits, expected, "query", "rank").collect()} == {1: 2, 2: 1, 3: None}


def test_rewards_and_pairs(spark):
    rows = [(1, "Zorg voor drainage. Bronnen: fragment 1", "q", None, [["drainage"]]), (1, "Gebruik 3 l/ha zonder meer", "q", None, [["drainage"]])]
    t = spark.createDataFrame([(p, a, "", q, g, k) for p, a, q, g, k in rows], "prompt int, answer string, context string, question string, gold_text string, key_facts array<array<string>>")
    scored = datasets.score_answers(t)
    assert [r["gate"] for r in scored.orderBy(F.desc("reward")).collect()] == [1.0, 0.0]
    pair = datasets.choose_pairs(scored.withColumn("is_card", F.lit(False)), "prompt").first()
    assert pair["chosen"].startswith("Zorg") and pair["rejected"].startswith("Gebruik")


def test_steps_and_registrations(spark):
    traces = spark.createDataFrame([("f", [(2, "second step", None), (1, "first step", "why"), (3, "x", None)])], "family string, steps array<struct<step:int,action:string,why:string>>")
    assert [s["action"] for s in procedures.collect_steps(traces).first()["steps"]] == ["first step", "second step"]
    payload = '{"data": {"id": 5, "name": "P", "authorisation": {"actual": [{"wCodings": [{"expirationDate": "2030-01-01T23:00:00Z"}]}]}, "uses": [{"nameOfUse": {"name": "# U"}, "targetCrops": [{"group": "G", "complete": true, "items": [{"crop": "Pear"}]}], "maximumProductDose": {"ratio": 0.5}}]}}'
    r = registrations.product_uses(spark.createDataFrame([(payload,), ("bad",), (None,)], "payload string")).collect()
    assert len(r) == 1 and (r[0]["use_name"], r[0]["crops"], str(r[0]["expires"]), r[0]["dose"]) == ("U", ["G", "Pear"], "2030-01-02", 0.5)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbroken\n{"k": 2}\n')
    assert sorted(r["k"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.json").write_text('{"bestand": "f", "pagina": 1, "entries": [{"datum_iso": "2020-02-30", "opmerkingen": "x", "toepassingen": [{"middel": "M", "hoeveelheid": "1 l"}]}]}')
    (tmp_path / "t" / "2.json").write_text('{"bestand": "f", "pagina": 1, "entries": []}')
    (tmp_path / "t" / "3.json").write_text("no json")
    pages, entries, applications, bad = files.read_transcripts(spark, str(tmp_path / "t"))
    assert (pages.count(), entries.count(), applications.count(), bad.count()) == (1, 1, 1, 1) and entries.first()["day"] is None
    assert files.nested_entries(entries, applications).first()["applications"][0]["product"] == "M"
    rain = spark.createDataFrame([("109|10:05",), ("000|10:10",), ("bad",)], "value string")
    assert [(r["time"], r["mm_per_hour"]) for r in files.rain_nowcast(rain).collect()] == [("10:05", 1.0), ("10:10", 0.0)]


def test_documents_are_folded_in_batches(spark):
    """A call for each of many small documents would cost more than its work."""
    rows = spark.createDataFrame([(str(d), p, "paragraph", t, None, None, None) for d in range(130) for p, t in enumerate(["It goes", "on here.", None, "Else."])], structure.BLOCK_SCHEMA)
    merged = structure.merge_continuations(rows.repartition(5))
    texts = {}
    for r in merged.orderBy("doc_id", "pos").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert len(texts) == 130 and set(map(tuple, texts.values())) == {("It goes on here.", None, "Else.")}
    chunks = structure.define_chunks(structure.sections(merged))
    assert {(r["doc_id"], r["text"], tuple(r["pages"])) for r in chunks.collect()} == {(str(d), "It goes on here.\n\n\n\nElse.", ()) for d in range(130)}
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_few_pages_are_held_at_once():
    pages = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(600)], "html": ["<p>one</p><p>two</p>", None] * 300})
    found = list(markup._in_batches(iter([pages])))
    assert [b.num_rows for b in found] == [256, 256, 88]
    assert [(r["doc_id"], r["pos"], r["text"]) for b in found for r in b.to_pylist()] == [(str(k), n, t) for k in range(0, 600, 2) for n, t in enumerate(["one", "two"])]


def test_page_residue_keeps_a_null_document_and_moves_few_runs(spark):
    """As in SQL a null document is a group; runs that don't begin two units are dropped before they are shuffled, and bounds don't change the result."""
    head = "annual report of the fruit station"
    rows = [(d, c, f"{head} {c} and some more words that differ {c * c}") for d in (None, "x") for c in range(4)] + [(None, 9, f"so {head} it goes"), ("y", 1, "short"), ("y", 1, None)]
    units = spark.createDataFrame(rows, "d string, c int, t string")
    found = lambda: {(r["d"], r["gram"], r["n_chunks"], r["n"], r["n_start"]) for r in quality.page_residue(units, "d", "c", "t").collect()}
    wanted = {(None, head, 5, 5, 4), ("x", head, 4, 4, 4)}
    assert found() == wanted
    most, quality.MOST_BROADCAST_RUNS = quality.MOST_BROADCAST_RUNS, 0
    try:
        assert found() == wanted
    finally:
        quality.MOST_BROADCAST_RUNS = most


def test_normalized_text_is_the_same_the_short_way(spark):
    """Each of the rules, apart and mixed, against loops; and a visible text is one of which something is left."""
    import random
    import re

    rng = random.Random(3)
    bits = ["a", "bc", "Zz", "-", "\n", " ", "\t", "\u00a0", "\u00ad", "\u2010", "\u200b", "\x00", "\x0b", "\r", "\ue000", "\u2028", "\u00e9t"]
    texts = ["".join(rng.choice(bits) for _ in range(n % 7)) for n in range(600)]

    def plain(t):
        t = re.sub("[\x00-\x08\x0b-\x1f\x7f\ue000-\uf8ff\u200b-\u200d\u2060\ufeff]", "", t)
        t = re.sub("[\u2010\u2011\u00ad]", "-", re.sub("\u00ad[ \t\n]*\n[ \t\n]*", "", t))
        t = re.sub(r"([^\W\d_]{2,})-\n([a-z]{2,})", r"\1\2", t)
        return re.sub("[ \t\u00a0]+", " ", re.sub("[ \t\n]*\n[ \t\n]*", " ", t)).strip(" ")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text(F.col("t")).alias("n"), T.is_visible(F.col("t")).alias("v")).collect()
    for r in rows:
        assert (r["n"], r["v"]) == (plain(r["t"]), plain(r["t"]) != ""), r["t"]


def test_texts_are_made_once(spark):
    """Neither lines with labels nor blocks put a text together once more for a filter."""
    spans = spark.createDataFrame([("d", 1, 1, 0.0, True, "Label "), ("d", 1, 1, 1.0, False, "Text")], "doc_id string, page int, line int, x0 double, bold boolean, text string")
    plan = layout.run_in_headings(spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "size(CASE" not in plan
    plan = markup.markdown_blocks(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(l") <= 2


def test_log_search_looks_at_the_latest_of_a_text(spark):
    """Many entries of few texts, with a dense score for old ones, against a loop; only the latest entries of a text and time are dealt out."""
    import datetime

    texts = ["spray copper", "spray sulphur", "pruned copper trees", None]
    entries = [(i, datetime.date(2023 + i % 2, 1 + i % 3, 1), texts[i % 4]) for i in range(300)]
    asked = [(1, "copper in januari 2023?"), (2, "sulphur spray in 2024"), (3, "something else"), (4, "copper trees")]
    dense = [(1, 0, 0.9), (2, 1, 0.4), (3, 5, 0.2), (4, 2, 0.7), (4, 3, 0.1)]
    found = assistant.search_log(spark.createDataFrame(entries, "entry_id long, day date, text string"), spark.createDataFrame(asked, "query long, question string"), dense=spark.createDataFrame(dense, "query long, entry_id long, score double"))
    assert re.search(r"WindowGroupLimit \[key#\d+, text#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())
    fits = {1: lambda d: d.year == 2023 and d.month == 1, 2: lambda d: d.year == 2024, 3: lambda d: True, 4: lambda d: True}
    words = {1: ["copper", "januari"], 2: ["spray", "sulphur"], 3: ["else", "something"], 4: ["copper", "trees"]}
    extra, wanted = {(q, e): s for q, e, s in dense}, set()
    for q, _ in asked:
        scored = [(sum(w in (t or "") for w in words[q]) / len(words[q]) + extra.get((q, e), 0.0), e) for e, d, t in entries if fits[q](d)]
        wanted |= {(q, e, round(s, 9), k + 1) for k, (s, e) in enumerate(sorted(scored, reverse=True)[: 8 if q == 1 else 6])}
    assert {(r["query"], r["entry_id"], round(r["score"], 9), r["rank"]) for r in found.collect()} == wanted
