"""Personal data: regular expressions as seeds, bootstrapped lexical patterns for the rest.

Base spans are e-mail addresses, IP addresses, card and phone numbers by their
regular expressions. They seed a bootstrap over all documents. Every word that
holds a digit or an at sign is an instance, as are up to seven groups of digits with single
spaces between them; the words before it (one, and two) and the word after it are its
lexical patterns. In the bipartite graph of patterns and distinct instances

* a pattern's score for a kind is the mean score of its instances, where an
  instance of a base span counts 1;
* an instance that isn't a seed has the score 1 - prod(1 - s) over its confident
  patterns, which have a score of ``PATTERN_SCORE`` and ``SUPPORT`` distinct
  instances behind it;

and the two are computed in turns, ``ROUNDS`` times. Instances of a score of
``INSTANCE_SCORE`` whose form fits the kind become spans, wherever a confident
pattern stands before them; they never displace a base span.

All of it is DataFrame expressions: matches come from ``regexp_extract_all`` and
their places from the pieces that ``split`` leaves between them. Lookbehinds and
possessive repeats keep the expressions linear and let them find what the plain
forms find: a match begins at the start of a run of its characters, or where the
last match ended (``\\G``). The graph holds words, not texts; a pattern or an
instance that is very frequent is counted before it is shuffled. Places and redacted
texts are made ``BLOCK`` matches at a time, so that their cost follows the length of the
text and the number of matches, not their square.

Defined results: a null text counts as empty; repeated rows get the same spans
each; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, checkpoint, count_of, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
PATTERN_SCORE = 0.6
SUPPORT = 3
INSTANCE_SCORE = 0.75
#: Documents with added spans that are broadcast.
MOST_BROADCAST = 50_000

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# 14 to 19 digits of a maximal run; a run is cut off by two separators, or by what is neither
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Groups of digits with single spaces between them, or a word with a digit or an at sign.
_WORD = r"(?<!\S)(?:[(+]*+[0-9][0-9().-]*+(?: [(]?[0-9][0-9().-]*+){1,6}+(?![^\s,;:!?])|[^\s0-9@]*+[0-9@]\S*+)"
#: Characters before and after an instance in which its patterns lie.
CONTEXT = 80
#: Matches that are folded at a time.
BLOCK = 64

#: What an added span of a kind looks like, when the word is stripped of punctuation.
_FORMS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?:[0-9]{1,3}(?:[.,-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[ .-]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9](?:[ ().-]{0,2}[0-9]){5,14}$",
}


_PLACES = "array<struct<start:int,end:int,word:string,before:string,after:string>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """An array's elements in arrays of ``size``."""
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(size)), lambda at: F.slice(x, at, F.lit(size)))
    return F.when(F.size(items) > 0, _let(items, cut)).otherwise(F.array_repeat(items, 0))


def _offsets(lengths: Column) -> Column:
    """By element: the sum of those before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def _places(text: Column, regex: str) -> Column:
    """array<struct<start,end,word,before,after>> of all matches: code points, the match, and the ends of the texts around it: up to the matches beside it, or with these where nothing but space is between."""
    found, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    pairs = F.zip_with(found, between, lambda w, b: F.struct(w.alias("word"), b.alias("gap")))

    def near(word: Column, gap: Column, *, left: bool) -> Column:
        """The text before a match (left) or after one, as far as patterns need it."""
        edge = F.right(gap, F.lit(CONTEXT)) if left else F.left(gap, F.lit(CONTEXT))
        word = F.coalesce(F.right(word, F.lit(CONTEXT)) if left else F.left(word, F.lit(CONTEXT)), F.lit(""))
        return F.when(F.trim(gap) != "", edge).otherwise(F.concat(word, gap) if left else F.concat(gap, word))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["word"])
        row = F.struct(start.alias("start"), end.alias("end"), p["word"].alias("word"), p["before"].alias("before"), p["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def placed(pairs: Column) -> Column:
        # the last pair is the text after the last match
        rows = F.transform(
            F.slice(pairs, F.lit(1), F.size(pairs) - 1),
            lambda p, i: F.struct(p["word"].alias("word"), p["gap"].alias("gap"), near(F.get(pairs, i - 1)["word"], p["gap"], left=True).alias("before"), near(F.get(pairs, i + 1)["word"], F.get(pairs, i + 1)["gap"], left=False).alias("after")),
        )
        return _let(_blocks(rows), in_blocks)

    def in_blocks(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["word"])))
        return F.flatten(F.zip_with(blocks, _offsets(lengths), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(_PLACES).alias("out")), step)["out"]))

    return F.when(F.size(found) > 0, _let(pairs, placed)).otherwise(F.array().cast(_PLACES))


def _luhn(word: Column) -> Column:
    digits = F.reverse(F.regexp_replace(word, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _n_digits(word: Column) -> Column:
    return F.length(F.regexp_replace(word, "[^0-9]", ""))


def _base(text: Column) -> Column:
    """All base spans, array<struct<start,end,kind,value>>, by kind. A cheap test keeps most texts from an expression that can't match."""
    none = F.array().cast(_PLACES)
    has_digit = text.rlike("[0-9]")
    places = {
        "email": F.when(F.contains(text, F.lit("@")), _places(text, _EMAIL)).otherwise(none),
        "ip": F.when(has_digit, F.filter(_places(text, _IP), lambda p: F.regexp(p["word"], F.lit(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")))).otherwise(none),
        "card": F.when(has_digit, F.filter(_places(text, _CARD), lambda p: _luhn(p["word"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_places(text, _PHONE), lambda p: _n_digits(p["word"]).between(10, 15))).otherwise(none),
    }
    return F.concat(*[_with_kind(places[k], k) for k in KINDS])


def _with_kind(places: Column, kind: str) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), p["word"].alias("value")))


def _kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _sorted(spans: Column) -> Column:
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _kind_order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    return F.transform(by_start, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def _without_value(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _marked(words: Column, base: Column) -> Column:
    """``words`` (start, end, ...; in order) with the kind and value of the base span that each begins, and whether a base span covers any of it. Words are taken in blocks of blocks, each with the base spans about it."""

    def about(spans: Column, block: Column) -> Column:
        first, last = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        return F.filter(spans, lambda s: (s["start"] < last) & (s["end"] > first))

    def one(w: Column, spans: Column) -> Column:
        begins = F.get(F.filter(spans, lambda s: (s["start"] >= w["start"]) & (s["start"] < w["end"])), F.lit(0))
        covers = F.exists(spans, lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))
        return F.struct(*[w[f].alias(f) for f in ("start", "end", "word", "before", "after")], begins["kind"].alias("seed"), begins["value"].alias("value"), covers.alias("covered"))

    def within(block: Column, spans: Column) -> Column:
        return _let(about(spans, block), lambda near: F.transform(block, lambda w: one(w, near)))

    def split(block: Column, spans: Column) -> Column:
        return _let(about(spans, block), lambda near: F.flatten(F.transform(_blocks(block), lambda b: within(b, near))))

    return F.flatten(F.transform(_blocks(words, BLOCK * BLOCK), lambda b: split(b, base)))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, base spans and the words with a digit or an at sign; one row for each of ``docs``."""
    text = text_or_empty()
    words = F.when(text.rlike("[0-9@]"), _places(text, _WORD)).otherwise(F.array().cast(_PLACES))
    # of the text before a word only its last two words matter, of that after it the first
    words = F.transform(
        words, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["word"].alias("word"), F.regexp_extract(p["before"], r"(\S+\s+)?(\S+)\s*$", 0).alias("before"), F.regexp_extract(p["after"], r"^\s*(\S+)", 1).alias("after"))
    )
    both = _let(_sorted(_base(text)), lambda base: F.struct(base.alias("base"), _marked(words, base).alias("words")))
    rows = docs.select("doc_id", F.xxhash64(text).alias(f"{OWN}text"), both.alias("m"))
    return rows.select("doc_id", f"{OWN}text", "m.base", "m.words")


def _instances(found: DataFrame) -> DataFrame:
    """A row for each distinct place of a word: text key, span, stripped word (of a seed the base span's text), kind of the base span it begins or null, whether a base span covers any of it, and its patterns."""
    rows = found.where(F.size("words") > 0).dropDuplicates(["doc_id", f"{OWN}text"]).select("doc_id", f"{OWN}text", F.explode("words").alias("w"))
    bare = F.regexp_extract("w.word", r"^[^\p{L}\p{N}(+]*+(.*?)[^\p{L}\p{N}]*$", 1)
    start = F.col("w.start") + F.length(F.regexp_extract("w.word", r"^([^\p{L}\p{N}(+]*+)", 1))
    rows = rows.select("doc_id", f"{OWN}text", start.cast("int").alias("start"), bare.alias("word"), "w.seed", "w.value", "w.covered", F.lower("w.before").alias("before"), F.lower("w.after").alias("after"))
    rows = rows.withColumn("end", F.col("start") + F.length("word"))
    one = F.regexp_extract("before", r"(\S+)\s*$", 1)
    two = F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1)
    patterns = F.array_compact(F.array(*[F.when(F.length(p) > 0, F.concat(F.lit(side), p)) for side, p in (("before ", one), ("before ", F.regexp_replace(two, r"\s+", " ")), ("after ", F.col("after")))]))
    return rows.select("doc_id", f"{OWN}text", "start", "end", F.coalesce("value", "word").alias("word"), "seed", "covered", F.array_distinct(patterns).alias("patterns"))


def bootstrap(instances: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(kind, pattern, score) of confident patterns and (kind, word, score) of the unseen instances they reach."""
    edges = instances.where(F.col("seed").isNotNull() | ~F.col("covered")).select(F.explode("patterns").alias("pattern"), "word", "seed")
    edges = checkpoint(edges.groupBy("pattern", "word").agg(F.max("seed").alias("seed")))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    known = edges.where("seed IS NOT NULL").select(F.col("seed").alias("kind"), "word", F.lit(1.0).alias("score")).distinct()
    reached = patterns = None
    for _ in range(rounds):
        scored = known if reached is None else known.unionByName(reached)
        patterns = edges.join(scored, "word").groupBy("kind", "pattern").agg(F.sum("score").alias("total"), F.count_if(F.col("score") >= INSTANCE_SCORE).alias("support"))
        patterns = patterns.join(size, "pattern").select("kind", "pattern", (F.col("total") / F.col("n")).alias("score"), "support")
        patterns = checkpoint(patterns.where((F.col("score") >= PATTERN_SCORE) & (F.col("support") >= SUPPORT)))
        fits = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN word RLIKE r'{x}'" for k, x in _FORMS.items()) + " END")
        reached = edges.where("seed IS NULL").join(patterns, "pattern").where(fits).groupBy("kind", "word")
        reached = checkpoint(reached.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("score")).join(known.select("kind", "word"), ["kind", "word"], "left_anti"))
    return patterns.select("kind", "pattern", "score"), reached.where(F.col("score") >= INSTANCE_SCORE)


def added_spans(found: DataFrame) -> DataFrame:
    """doc_id, text key and added spans of the documents that have any; found is a checkpointed :func:`base_spans`."""
    instances = _instances(found)
    patterns, reached = bootstrap(instances)
    free = instances.where("NOT covered").select("doc_id", f"{OWN}text", "start", "end", "word", F.explode("patterns").alias("pattern"))
    hits = free.join(patterns.select("kind", "pattern"), "pattern").join(reached.select("kind", "word"), ["kind", "word"])
    # one kind a place: the first in the order of kinds
    best = hits.groupBy("doc_id", f"{OWN}text", "start", "end").agg(F.min(_kind_order(F.col("kind"))).alias("order"))
    span = F.struct("start", "end", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("order").cast("int")).alias("kind"), F.lit(None).cast("string").alias("value"))
    return best.groupBy("doc_id", f"{OWN}text").agg(F.collect_list(span).alias("added"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the regular expressions) and spans (these and the added ones), sorted, for each row of ``docs``."""
    found = checkpoint(base_spans(docs))
    added = added_spans(found)
    joined = found.alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col(f"f.{OWN}text") == F.col(f"a.{OWN}text")), "left")
    every = F.when(F.col("a.added").isNull(), F.col("f.base")).otherwise(_sorted(F.concat("f.base", F.coalesce("a.added", F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")))))
    return joined.select("f.doc_id", _without_value(F.col("f.base")).alias("base"), _without_value(every).alias("spans"))


def _redacted(text: Column, blocks: Column) -> Column:
    """A text with its spans, sorted and in blocks, replaced by their kind."""
    # by block: where the text goes on, the end of the farthest span before it
    farthest = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    reached = F.aggregate(farthest, begin, lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def replaced(b: Column, at: Column) -> Column:
        # a piece of the text that is cut out once, so that places in it are near its start
        end = F.greatest(at, F.array_max(F.transform(b, lambda s: s["end"])))
        return _let(F.substring(text, at + 1, end - at), lambda piece: F.aggregate(b, F.struct(at.alias("at"), F.lit("").alias("out")), lambda acc, s: step(acc, s, piece, at))["out"])

    def step(acc: Column, s: Column, piece: Column, first: Column) -> Column:
        out = F.concat(acc["out"], F.substring(piece, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(out).alias("out"))

    def whole(r: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(blocks, r["out"], replaced), ""), F.substring(text, r["at"] + 1, F.length(text)))

    return _let(reached, whole)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets, and n_chars, if there, as it then is. Spans that overlap become one."""
    found = checkpoint(base_spans(docs))
    added = checkpoint(added_spans(found))
    text = text_or_empty()
    key = added.select(F.col("doc_id").alias(f"{OWN}id"), F.col(f"{OWN}text").alias(f"{OWN}key"), F.col("added").alias(f"{OWN}added"))
    rows = docs
    spans = _base(text)
    if key.head(1):
        rows = docs.join(F.broadcast(key) if key.count() <= MOST_BROADCAST else key, docs["doc_id"].eqNullSafe(key[f"{OWN}id"]) & (F.xxhash64(text) == key[f"{OWN}key"]), "left")
        spans = F.concat(spans, F.coalesce(f"{OWN}added", F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")))
    rows = rows.withColumn(f"{OWN}spans", _sorted(spans))
    done = _let(_blocks(F.col(f"{OWN}spans")), lambda blocks: _redacted(text, blocks))
    clean = F.when(F.size(f"{OWN}spans") > 0, done).otherwise(F.col("text"))
    rows = rows.withColumn("text", clean)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(f"{OWN}spans") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def _spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_of("base", "kind", k) for k in KINDS], F.sha2(_spans_string(F.col("base")), 256).alias("base_sha256"), _spans_string(F.col("spans")).alias("spans"))
