"""Table zones, caption pieces and run-in labels against loops over random pages."""

import random
import re

from fieldmill.operators import layout

ENDS = re.compile(r"[.!?:;…][\"'”’)\]]*\s*$")
TABLE = re.compile(r"^(?:[A-Z]{1,3}-?\d{2,6}\s+)?(?:table|tabel)\s*[\dIVX]+\s*[.:—–-]", re.I)
TEXTS = [
    "Table 3. Yields of trees", "Tabel IV: opbrengst.", "AB-123 table 2 - what is it?", "Figure 3. Not a table", "table of contents", "", None, "* Footnote about it that goes on", "†Also one", "* not one",
    "12 13 14", "a short fragment", "a short one that ends.", "lower case continuation of something that is quite long and goes on for more than twelve words in all", "Running prose of more than twelve words that begins with a capital and ends as it should do.",
    "word " * 45, "Word " * 46, "* Word " * 30, "quoted end.'\")", "ends with a colon:", "Éen hoofdletter",
]
KINDS = ["caption", "paragraph", "paragraph", "paragraph", "table", "figure", "heading", None]


def pages(n, seed):
    rng = random.Random(seed)
    for page in range(n):
        for pos in range(rng.randrange(0, 16)):
            kind = rng.choice(KINDS + ["table", "table", "caption"])
            text = rng.choice(TEXTS[:5] if kind == "caption" and rng.random() < 0.8 else TEXTS)
            y = pos * 14 + rng.choice([0, 0, 0, 3, -8, 20])
            yield ("d", page, pos * 3, kind, text, rng.choice([50.0, 50.0, 60.0, 64.5, 80.0, None]), float(y), y + 12.0)


SCHEMA = "doc_id string, page int, pos int, kind string, text string, x double, y double, y1 double"


def by_page(rows):
    found = {}
    for r in rows:
        found.setdefault((r[0], r[1]), []).append({"pos": r[2], "kind": r[3] or "", "text": r[4] or "", "x": r[5], "y": r[6], "y1": r[7]})
    return found


def zones_by_loop(blocks):
    out, i = [], 0
    while i < len(blocks):
        b = blocks[i]
        i += 1
        if not (b["kind"] == "caption" and TABLE.search(b["text"])):
            out.append((b["pos"], b["kind"], b["text"]))
            continue
        caption, rows, at = b["text"], [], None
        open_, k = True, i
        while open_ and k < len(blocks):
            x, n = blocks[k], len(blocks[k]["text"].split())
            if x["kind"] == "paragraph" and k == i and not re.search(r"[.?]\s*$", caption) and (x["text"][:1].islower() or n < 40):
                caption += " " + x["text"]
            elif x["kind"] == "table" or x["kind"] == "paragraph" and (re.match(r"[\^*†‡]\s?[A-Z][a-z]", x["text"]) and n <= 70 or n < 12 and not ENDS.search(x["text"])):
                at = x["pos"] if at is None else at
                rows.append(x["text"])
            elif x["kind"] != "figure":
                open_ = False
                continue
            k += 1
        i = k
        out.append((b["pos"], "caption", caption))
        if rows:
            out.append((at, "table", "\n".join(rows)))
    return sorted(out)


def test_table_zones(spark):
    rows = list(pages(400, 1))
    found = {}
    for r in layout.table_zones(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault((r["doc_id"], r["page"]), []).append((r["pos"], r["kind"], r["text"]))
    wanted = {k: zones_by_loop(v) for k, v in by_page(rows).items()}
    assert {k: sorted(v) for k, v in found.items()} == wanted
    assert sum("\n" in t for v in wanted.values() for _, _, t in v) > 30
    assert layout.table_zones(spark.createDataFrame([], SCHEMA)).count() == 0


def captions_by_loop(blocks):
    out, caption = [], None
    for b in blocks:
        if caption and b["kind"] == "paragraph" and b["x"] is not None and abs(b["x"] - caption["x"]) <= 14 and -14 <= b["y"] - caption["y1"] <= 12 and len(b["text"].split()) <= 45 and (not ENDS.search(caption["last"]) or not b["text"][:1].isupper()):
            caption["text"] += " " + b["text"]
            caption["y1"], caption["last"], caption["n"] = b["y1"], b["text"], caption["n"] + 1
            continue
        b = b | {"last": b["text"], "n": 1}
        caption = b if b["kind"] == "caption" and b["x"] is not None else None
        out.append(b)
    return [(b["pos"], b["kind"], b["text"], b["x"], b["y"], b["y1"], b["n"]) for b in out]


def test_caption_pieces(spark):
    rows = list(pages(500, 2))
    found = {}
    for r in layout.fold_captions(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        found.setdefault((r["doc_id"], r["page"]), []).append((r["pos"], r["kind"], r["text"], r["x"], r["y"], r["y1"], r["pieces"]))
    wanted = {k: captions_by_loop(v) for k, v in by_page(rows).items()}
    assert {k: sorted(v, key=lambda b: b[0]) for k, v in found.items()} == wanted
    assert max(b[6] for v in wanted.values() for b in v) >= 3


def test_run_in_headings(spark):
    rng = random.Random(3)
    words = ["Label ", "Black ", "beetle ", " ", "​", "een ", "Één ", "2 ", ". ", "", None]
    rows = [("d", 1, line, float(x), rng.random() < 0.6, rng.choice(words)) for line in range(600) for x in range(rng.randrange(1, 14))]
    found = {}
    for r in layout.run_in_headings(spark.createDataFrame(rows, "doc_id string, page int, line int, x0 double, bold boolean, text string")).collect():
        found.setdefault(r["line"], []).append((r["part"], r["kind"], r["text"]))
    clean = lambda parts: re.sub(r"\s+", " ", "".join(p or "" for p in parts).replace("​", "")).strip()
    wanted = {}
    for line in range(600):
        spans = [(b, t) for _, _, n, _, b, t in rows if n == line]
        k = next((i for i, (b, t) in enumerate(spans) if not b and clean([t])), len(spans))
        label, body, whole = clean([t for _, t in spans[:k]]), clean([t for _, t in spans[k:]]), clean([t for _, t in spans])
        if label and body and len(label.split()) <= 8 and body[0].isupper():
            wanted[line] = [(0, "heading", label), (1, None, body)]
        elif whole:
            wanted[line] = [(0, None, whole)]
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()} == wanted
    assert sum(len(v) == 2 for v in wanted.values()) > 50


def test_junk_and_good_lines(spark):
    from pyspark.sql import functions as F

    from fieldmill.functions import text as T

    texts = ["It is ok.", "> u td O o", "^a^ *b* 'c'", "een twee drie", "a b", "", None, "a b c d e f g h i", "No. 1", "it is so"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.coalesce(T.ocr_junk(F.col("text")), F.lit(False)).alias("junk")).collect()
    assert [r["text"] for r in rows if r["junk"]] == ["> u td O o", "^a^ *b* 'c'", "a b", "No. 1", "it is so"]
