"""From positioned text (the layout rows of a scanned or typeset page) to blocks.

A span has doc_id, page, x0, x1, y, size, bold and text. Everything is windows over the
lines of a page in reading order, so a document's pages spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_PAGE = ("doc_id", "page")
#: Fixed: what begins the caption of a table, and a footnote.
TABLE_CAPTION = r"(?i)^(?:[A-Z]{1,3}-?\d{2,6}\s+)?(?:table|tabel)\s*[\dIVX]+\s*[.:\u2014\u2013-]"
FOOTNOTE = r"^[\^*\u2020\u2021]\s?[A-Z][a-z]"
#: Fixed: how far the left edge of a caption's next piece may be off, how far above or below the last piece it may begin, and its most words.
CAPTION_INDENT, CAPTION_GAP, CAPTION_WORDS = 14, (-14, 12), 45
#: Fixed: most words of a label at the start of a line.
LABEL_WORDS = 8


def visual_lines(spans: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Spans on one baseline as one line, from left to right; its size is that of most characters, and it is bold if all its spans are."""
    order = Window.partitionBy(*_PAGE).orderBy("y", "x0")
    new = F.coalesce(F.col("y") - F.lag("y").over(order) > tolerance, F.lit(True)).cast("int")
    rows = spans.withColumn("__new", new).withColumn("line", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    found = rows.groupBy(*_PAGE, "line").agg(parts.alias("p"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"), F.max_by("size", F.length("text")).alias("size"), F.min(F.col("bold").cast("int")).cast("boolean").alias("bold"))
    return found.withColumn("text", T.normalize_text(F.array_join(F.transform("p", lambda x: x["text"]), " "))).drop("p").where("text <> ''")


def merge_drop_caps(lines: DataFrame, factor: float = 1.8) -> DataFrame:
    """A single large capital joined to the line after it, which it begins."""
    order = Window.partitionBy(*_PAGE).orderBy("line")
    cap = F.regexp("text", F.lit(r"^\p{Lu}$"))
    rows = lines.withColumn("__cap", cap & (F.col("size") >= factor * F.lead("size").over(order)))
    before = F.lag(F.when(F.col("__cap"), F.col("text"))).over(order)
    rows = rows.withColumn("text", F.concat(F.coalesce(before, F.lit("")), "text"))
    return rows.where(~F.coalesce("__cap", F.lit(False))).drop("__cap")


def classify_lines(lines: DataFrame, body: DataFrame, furniture: DataFrame | None = None) -> DataFrame:
    """``lines`` with kind and level. body has doc_id and body (see :func:`structure.body_size`), furniture doc_id and key."""
    rows = lines.join(body.select("doc_id", "body"), "doc_id", "left") if "body" not in lines.columns else lines
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " "))
    rows = rows.withColumn("key", key)
    repeated: Column = F.lit(False)
    if furniture is not None:
        rows = rows.join(furniture.withColumn("__repeats", F.lit(True)), ["doc_id", "key"], "left")
        repeated = F.coalesce("__repeats", F.lit(False))
    t = F.col("text")
    styled = (F.col("size") >= 1.15 * F.col("body")) | (F.col("bold") & (F.col("size") >= F.col("body")))
    heading = (styled & (T.word_count(t) <= 12) & ~F.regexp(t, F.lit(r"[.,;]$"))) | T.caps_heading(t)
    kind = (
        F.when(T.page_number(t) | repeated, "furniture")
        .when(F.regexp(t, F.lit(r"(?i)^(?:fig(?:ure|uur)?|table|tabel|photo|foto)\b\.?\s*\d")), "caption")
        .when(F.regexp(t, F.lit(T.LIST_MARKER)), "list_item")
        .when((T.tabular_score(t) >= 0.45) & (T.word_count(t) >= 3), "table")
        .when(T.ocr_junk(t), "furniture")
        .when(F.coalesce(heading, F.lit(False)), "heading")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.when(F.col("size") >= 1.6 * F.col("body"), 1).when(F.col("size") >= 1.3 * F.col("body"), 2).otherwise(3))
    return rows.withColumn("level", level).drop("key", "__repeats", "body")


def line_blocks(lines: DataFrame, gap: float = 1.8) -> DataFrame:
    """Consecutive lines of one kind, close to each other, as one block with its left edge x, top y and bottom y1."""
    order = Window.partitionBy(*_PAGE).orderBy("line")
    last = lambda c: F.lag(c).over(order)
    close = F.col("y") - last("y") <= gap * F.col("size")
    joins = close & (F.col("kind") == last("kind")) & F.col("kind").isin("paragraph", "table", "caption")
    rows = lines.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("block", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*_PAGE, "block").agg(F.first("kind").alias("kind"), F.max("level").alias("level"), F.min("x0").alias("x"), F.min("y").alias("y"), F.max(F.col("y") + F.col("size")).alias("y1"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    glue = F.when(F.col("kind") == "table", F.array_join(F.transform("l", lambda x: x["text"]), "\n")).otherwise(T.normalize_text(F.array_join(F.transform("l", lambda x: x["text"]), "\n")))
    return found.withColumn("text", glue).drop("l")


def page_blocks(lines: DataFrame, gap: float = 1.8) -> DataFrame:
    """The blocks of classified lines, with the pieces of captions and the zones of tables put together: doc_id, page, block, kind, level, y and text."""
    blocks = line_blocks(lines, gap)
    folded = table_zones(fold_captions(blocks, order="block"), order="block")
    own = blocks.select(*_PAGE, "block", "level", "y")
    return folded.join(own, [*_PAGE, "block"]).select(*_PAGE, "block", "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"), "y", "text")


def interleave(text_blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """Blocks and figures of a page in the order of their height, numbered over the document."""
    columns = ["doc_id", "page", "y", "kind", "text", "level"]
    both = text_blocks.select(*columns).unionByName(visuals.select("doc_id", "page", "y", F.lit("figure").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("level")))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y", "kind", "text"))
    return both.withColumn("pos", pos).withColumn("section_type", F.lit(None).cast("string")).select("doc_id", "pos", "kind", "text", "page", "level", "section_type")


def is_scan(spread: Column, least: float = 2.0) -> Column:
    """A recognised scan has sizes all over the place; typeset text has few."""
    return spread >= least


def _until_broken(rows: DataFrame, group: tuple[str, ...], order: str, opens: Column, fits: Column) -> DataFrame:
    """``rows`` with __chain: the place of the opening row for it and for every row after it up to the first that doesn't fit; null for others.

    A row belongs to the last opening row before it. The first row that breaks its chain ends it for good, whatever fits after it.
    """
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__opens", F.coalesce(opens, F.lit(False))).withColumn("__fits", F.coalesce(fits, F.lit(False)))
    rows = rows.withColumn("__chain", F.last(F.when(F.col("__opens"), F.col(order)), ignorenulls=True).over(upto))
    end = F.min(F.when(~F.col("__opens") & ~F.col("__fits"), F.col(order))).over(Window.partitionBy(*group, "__chain"))
    return rows.withColumn("__end", end).withColumn("__chain", F.when(F.col("__end").isNull() | (F.col(order) < F.col("__end")), F.col("__chain"))).drop("__end")


def table_zones(blocks: DataFrame, group: tuple[str, ...] = _PAGE, order: str = "pos") -> DataFrame:
    """``group``, ``order``, kind, text and the number of pieces of blocks, where what follows the caption of a table is one block.

    A zone opens at a caption that names a table and closes before the first block that reads as running prose or is neither
    table, paragraph nor figure. In it the caption's second line goes to the caption, tables, footnotes and short fragments become
    the lines of one table, and figures are left out. Nulls in kind count as no kind, null texts as empty.
    """
    at = Window.partitionBy(*group).orderBy(order)
    text, n = F.col("text"), T.word_count(F.col("text"))
    rows = blocks.select(*group, order, F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    opens = (F.col("kind") == "caption") & F.regexp(text, F.lit(TABLE_CAPTION))
    rows = rows.withColumn("__caption", F.lag(F.when(opens, text)).over(at))
    paragraph = F.col("kind") == "paragraph"
    second = paragraph & F.col("__caption").isNotNull() & ~F.regexp("__caption", F.lit(r"[.?]\s*$")) & (F.regexp(text, F.lit(r"^\p{Ll}")) | (n < 40))
    row = (F.col("kind") == "table") | (paragraph & ((F.regexp(text, F.lit(FOOTNOTE)) & (n <= 70)) | ((n < 12) & ~T.ends_sentence(text))))
    rows = rows.withColumn("__second", F.coalesce(second, F.lit(False))).withColumn("__row", row & ~F.col("__second"))
    rows = _until_broken(rows, group, order, opens, F.col("__second") | F.col("__row") | (F.col("kind") == "figure"))
    inner = F.col("__chain").isNotNull() & ~F.col("__opens")
    more = F.lead(F.when(F.col("__second"), text)).over(at)
    rows = rows.withColumn("text", F.when(F.col("__opens") & more.isNotNull(), F.concat_ws(" ", text, more)).otherwise(text))
    rows = rows.where(~inner | F.col("__row")).withColumn("__block", F.when(inner, F.col("__chain")).otherwise(F.col(order))).withColumn("__inner", inner)
    found = rows.groupBy(*group, "__block", "__inner").agg(F.min(order).alias(order), F.when(F.first("__inner"), "table").otherwise(F.first("kind")).alias("kind"), F.array_sort(F.collect_list(F.struct(order, "text"))).alias("__lines"))
    return found.select(*group, order, "kind", F.array_join(F.transform("__lines", lambda x: x["text"]), "\n").alias("text"), F.size("__lines").alias("pieces"))


def fold_captions(blocks: DataFrame, group: tuple[str, ...] = _PAGE, order: str = "pos") -> DataFrame:
    """``group``, ``order``, kind, text, x, y, y1 and the number of pieces of blocks, with the later pieces of a caption taken into it.

    A piece is a paragraph of few words at the caption's left edge, right below (or a little above) the end of the piece before,
    where the caption hasn't ended a sentence yet or the piece doesn't begin with a capital. The anchor moves down with each
    piece; x, y and y1 are the left edge, the top and the bottom. A null x can neither open nor continue a caption.
    """
    at = Window.partitionBy(*group).orderBy(order)
    rows = blocks.select(*group, order, F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "x", "y", "y1")
    opens = (F.col("kind") == "caption") & F.col("x").isNotNull()
    edge = F.last(F.when(opens, F.col("x")), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    # within a chain the row before is the piece before
    gap, unfinished = F.col("y") - F.lag("y1").over(at), ~T.ends_sentence(F.lag("text").over(at)) | ~F.regexp("text", F.lit(r"^\p{Lu}"))
    fits = (F.col("kind") == "paragraph") & (F.abs(F.col("x") - edge) <= CAPTION_INDENT) & gap.between(*CAPTION_GAP) & (T.word_count(F.col("text")) <= CAPTION_WORDS) & unfinished
    rows = _until_broken(rows, group, order, opens, fits)
    rows = rows.withColumn("__block", F.coalesce("__chain", order))
    first = lambda c: F.min_by(c, order).alias(c)
    found = rows.groupBy(*group, "__block").agg(F.min(order).alias(order), first("kind"), F.array_sort(F.collect_list(F.struct(order, "text"))).alias("__lines"), first("x"), first("y"), F.max_by("y1", order).alias("y1"))
    return found.select(*group, order, "kind", F.array_join(F.transform("__lines", lambda x: x["text"]), " ").alias("text"), "x", "y", "y1", F.size("__lines").alias("pieces"))


def run_in_headings(spans: DataFrame, line: tuple[str, ...] = ("doc_id", "page", "line")) -> DataFrame:
    """The lines of ``spans`` (x0, bold, text) as text, and where a line begins with a short bold label before regular text that begins with a capital, the label apart.

    Returns ``line``, part (0 for a label or a whole line, 1 for what follows a label), kind (heading, or null for what is to be
    classified) and text. Spans without a visible character don't end a label. A line without text gives no row.
    """
    c = F.col
    plain = F.when(~F.coalesce("bold", F.lit(False)) & T.is_visible(c("text")), c("x0"))
    pieces = spans.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("p"), F.min(plain).alias("__from"))
    joined = lambda keep: T.normalize_text(F.array_join(F.transform(F.filter("p", keep), lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    rest = lambda s: F.coalesce(s["x0"] >= c("__from"), F.lit(False))
    # a line of bold or of regular spans only has no label; others are put together whole only where theirs doesn't count
    pieces = pieces.withColumns({"__label": joined(lambda s: ~rest(s)), "__body": joined(rest)})
    apart = (c("__label") != "") & (T.word_count(c("__label")) <= LABEL_WORDS) & F.regexp("__body", F.lit(r"^\p{Lu}"))
    part = lambda n, kind, text: F.struct(F.lit(n).alias("part"), F.lit(kind).cast("string").alias("kind"), text.alias("text"))
    alone = F.when(c("__body") == "", c("__label")).when(c("__label") == "", c("__body")).otherwise(joined(lambda s: F.lit(True)))
    parts = F.when(apart, F.array(part(0, "heading", c("__label")), part(1, None, c("__body")))).otherwise(F.array(part(0, None, alone)))
    # an outer explode, as a plain one has its array made once more for a filter
    return pieces.select(*line, F.explode_outer(parts).alias("q")).select(*line, "q.*").where("text <> ''")
