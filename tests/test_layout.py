from pyspark.sql import functions as F

from fieldmill.operators import datasets, layout, structure


def test_page_to_sections(spark):
    spans = [
        ("d", 1, 50.0, 200.0, 40.0, 18.0, True, "The Title"), ("d", 1, 50.0, 60.0, 80.0, 30.0, False, "O"), ("d", 1, 62.0, 300.0, 84.0, 10.0, False, "nce there was a page that"),
        ("d", 1, 50.0, 150.0, 96.0, 10.0, False, "went on with a sec-"), ("d", 1, 151.0, 160.0, 96.5, 10.0, False, "ret"), ("d", 1, 50.0, 300.0, 108.0, 10.0, False, "and then it ended."),
        ("d", 1, 50.0, 300.0, 150.0, 10.0, False, "Figure 1. A picture."), ("d", 1, 50.0, 300.0, 190.0, 10.0, False, "- an item of a list"), ("d", 1, 50.0, 300.0, 220.0, 10.0, False, "12 13 14 15"), ("d", 1, 280.0, 300.0, 400.0, 10.0, False, "- 7 -"),
    ]
    t = spark.createDataFrame(spans, "doc_id string, page int, x0 double, x1 double, y double, size double, bold boolean, text string")
    lines = layout.merge_drop_caps(layout.visual_lines(t))
    blocks = layout.page_blocks(layout.classify_lines(lines, structure.body_size(t)))
    visuals = spark.createDataFrame([("d", 1, 130.0, None)], "doc_id string, page int, y double, text string")
    rows = layout.interleave(blocks, visuals).orderBy("pos").collect()
    assert [r["kind"] for r in rows] == ["heading", "paragraph", "figure", "caption", "list_item", "table", "furniture"]
    assert rows[1]["text"].startswith("Once there was a page that went on") and rows[1]["text"].endswith("and then it ended.") and rows[0]["level"] == 1


def test_captions_and_tables_of_a_page(spark):
    line = lambda y, text, x=50.0: ("d", 1, x, x + 200, float(y), 10.0, False, text)
    spans = [
        line(40, "Figure 2. Overgrowth of the"), line(52, "variety, as the arrow shows."), line(100, "Table 1. Yields"), line(120, "of trees in kilograms"), line(160, "Kordia 12 13 14 15"), line(190, "Regina 1 2 3 4"), line(220, "†Means of three years"),
        line(260, "After the table the text goes on with a sentence that is long enough to be prose, as it should be."),
    ]
    t = spark.createDataFrame(spans, "doc_id string, page int, x0 double, x1 double, y double, size double, bold boolean, text string")
    found = layout.page_blocks(layout.classify_lines(layout.visual_lines(t), structure.body_size(t))).orderBy("block").collect()
    assert [(r["kind"], r["text"]) for r in found] == [
        ("caption", "Figure 2. Overgrowth of the variety, as the arrow shows."), ("caption", "Table 1. Yields of trees in kilograms"), ("table", "Kordia 12 13 14 15\nRegina 1 2 3 4\n†Means of three years"),
        ("paragraph", "After the table the text goes on with a sentence that is long enough to be prose, as it should be."),
    ]


def test_example_sets(spark):
    cards = [(1, "obs", "do this", "then", "why", "bad", "s"), (2, "obs", "geef 5 ml", "x", "y", "bad", "s"), (3, "obs", "do", "x", "y", "", "s"), (4, "obs", "do", "x", "y", "bad", "s")]
    t = spark.createDataFrame(cards, "card_no int, observation string, action string, consequence string, why string, worst_case string, sources string")
    held, hits = spark.createDataFrame([(4,)], "card_no int"), spark.createDataFrame([(1, True), (2, True), (3, True), (4, True)], "card_no int, found boolean")
    rows = datasets.card_examples(t, held, hits).collect()
    assert sorted(r["kind"] for r in rows if r["card_no"] == 1) == ["preference", "reflection", "sft"]
    assert {r["card_no"]: r["skipped"] for r in rows if r["skipped"]} == {2: "names a dose", 3: "no worst reaction", 4: "held out"}
    templates, targets = spark.createDataFrame([("ask %s", 1.0), ("tell %s", 5.0)], "template string, weight double"), spark.createDataFrame([(x,) for x in "abc"], "target string")
    found = datasets.templated_examples(templates, targets, 4).collect()
    assert len({r["question"] for r in found}) == 4
