"""Text measures and rewrites as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: sentence ends, and what may stand after one.
TERMINALS = ".!?:;…"
_CLOSING = "[\"'”’)\\]]"
#: Fixed: stop words by language.
STOPWORDS = {
    "nl": ["de", "het", "een", "en", "van", "in", "is", "dat", "op", "te", "met", "voor", "niet", "zijn", "als", "bij", "om", "ook"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "on", "are", "by", "this", "be", "from", "or"],
}
#: Fixed: patterns of the reference score: years, abbreviations, volume and page.
REFERENCE_PATTERNS = (r"\b(?:18|19|20)\d{2}\b", r"\b[A-Z][a-z]{1,5}\.", r"\b\d{1,3}\s*[:(]\s*\d")
#: Fixed: what counts as a table cell, a list marker, a word, a claim about a legal status and a hedge.
NUMERIC_TOKEN = r"^[\d.,%±()/\-–+<>=°]+[a-zA-Z%°]{0,3}$"
LIST_MARKER = r"^\s*(?:[-•*]|\d{1,2}[.)])\s+"
WORD = r"[^\W\d_]{3,}"
#: Fixed: a dose per area, and per volume.
DOSE_PER_AREA = r"\d+([.,]\d+)?\s*(l|liter|ltr|kg|ml|g|gr|gram)\s*(/|per)\s*(ha|hectare)"
DOSE_PER_VOLUME = r"\d+([.,]\d+)?\s*(ml|g|gr|gram|l|kg)\s*(/|per)\s*(hl|100\s*l|100\s*liter|10\s*l|10\s*liter)"
AUTHORISATION_CLAIM = r"\b(is|zijn)\s+(wel\s+|niet\s+|nog\s+|niet\s+meer\s+)?(toegelaten|toegestaan|verboden)\b"
HEDGE = r"\b(of|controleer|raadpleeg|kan ik niet|weet ik niet|kan niet zeggen|niet te zeggen|zoek)\b"


def tokens(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without the space around them; empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def ends_sentence(text: Column) -> Column:
    return F.coalesce(F.regexp(text, F.lit(rf"[{TERMINALS}]{_CLOSING}*\s*$")), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """0 for an empty whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def tabular_score(text: Column) -> Column:
    """The share of tokens that look like table cells."""
    t = tokens(text)
    return ratio(F.size(F.filter(t, lambda x: F.regexp(x, F.lit(NUMERIC_TOKEN)))), F.size(t))


def fragment_ratio(text: Column) -> Column:
    """The share of lines under four words that neither end a sentence nor begin a list item."""
    all_lines = lines(text)
    short = lambda x: (F.regexp_count(x, F.lit(r"\S+")) < 4) & ~F.regexp(x, F.lit(r"[.!?:;]$")) & ~F.regexp(x, F.lit(LIST_MARKER))
    return ratio(F.size(F.filter(all_lines, short)), F.size(all_lines))


def reference_score(text: Column) -> Column:
    """Years, abbreviations and volume-page marks for each word."""
    found = sum((F.regexp_count(text, F.lit(p)) for p in REFERENCE_PATTERNS[1:]), F.regexp_count(text, F.lit(REFERENCE_PATTERNS[0])))
    return F.coalesce(found, F.lit(0)) / F.greatest(F.lit(1), word_count(text))


def words(text: Column) -> Column:
    """Lower-cased words of three letters or more."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)" + WORD), F.lit(0)), lambda w: F.lower(w))


def stopword_ratio(text: Column, language: Column) -> Column:
    """The larger share of stop words, of the language's own and of English."""
    w = words(text)
    share = lambda lang: ratio(F.size(F.filter(w, lambda x: x.isin(STOPWORDS[lang]))), F.size(w))
    own = F.when(language == "nl", share("nl")).otherwise(F.lit(0.0))
    return F.greatest(own, share("en"))


def digit_ratio(text: Column) -> Column:
    return ratio(F.regexp_count(text, F.lit(r"[0-9]")), F.length(text))


def caps_ratio(text: Column) -> Column:
    return ratio(F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}")))


def duplicate_lines(text: Column) -> Column:
    x = lines(text)
    return F.size(x) - F.size(F.array_distinct(x))


def split_sentences(text: Column) -> Column:
    """Cut after . ! or ? where white space follows."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


#: Fixed: words whose full stop ends no sentence, and the tail of a reference to a figure or table.
ABBREVIATIONS = [
    "spp", "vs", "al", "ca", "bv", "nr", "no", "fig", "figs", "tab", "table", "tables", "dr", "prof", "ir", "inc",
    "ltd", "st", "etc", "enz", "resp", "incl", "excl", "dept", "proc", "agr", "hort", "sci", "soc", "bul", "amer",
    "vol", "pp", "cf", "sp", "var", "subsp", "syn", "approx", "max", "min", "gem", "evt", "sec", "pl", "sq",
]
REFERENCE_TAIL = r"^\d+(?:[\s,;]+[A-Za-z0-9]{1,2})*\)+\.?$"
HEADING_LINE = r"(?m)^[^\S\n]*\*\*[^*\n]+\*\*[^\S\n]*$"


def _same_sentence(before: Column, piece: Column) -> Column:
    """Whether a piece that was cut off after ``before`` belongs to its sentence: after an abbreviation, an initial, a unit, an open bracket or a number of its own."""

    def rules(word: Column) -> Column:
        known = F.lower(word).isin(ABBREVIATIONS) | F.regexp(word, F.lit("^[A-Z]$")) | F.regexp(before, F.lit(r"^\d+\.$"))
        small = F.regexp(piece, F.lit(r"^\p{Ll}"))
        unit = F.regexp(word, F.lit("^[a-z]{1,3}$")) & F.regexp(piece, F.lit(r"^[\p{Ll}\p{Nd}]"))
        is_open = F.regexp_count(before, F.lit(r"[(\[{]")) > F.regexp_count(before, F.lit(r"[)\]}]"))
        other = F.regexp(piece, F.lit("^[;,)]")) | unit | (small & (is_open | F.regexp(before, F.lit(r"(?:\)\.|[?!])$")))) | F.regexp(piece, F.lit(REFERENCE_TAIL))
        # no other rule holds for a piece that begins with a capital
        return known | (~F.regexp(piece, F.lit(r"^\p{Lu}")) & other)

    # the word before is taken out once
    return F.element_at(F.transform(F.array(F.regexp_extract(before, r"(?:^|\s)[(\[{\"'‘“]*([A-Za-z]+)\.$", 1)), rules), 1)


def whole_sentences(text: Column) -> Column:
    """Sentences cut after . ! or ?, with those that a full stop inside a sentence parted put together again. A piece that begins small after a plain full stop stays one of its own."""
    pieces = split_sentences(text)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.coalesce(_same_sentence(acc["last"], piece), F.lit(False))
        done = F.when(joined | acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        return F.struct(done.alias("done"), F.when(joined, F.concat_ws(" ", acc["last"], piece)).otherwise(piece).alias("last"))

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))


def prose_view(text: Column) -> Column:
    """A text as its sentences are judged: without heading lines and list markers; a list item of four words or more that begins with a capital is a statement."""
    plain = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), HEADING_LINE, ""), "\n")

    def line(x: Column) -> Column:
        body = F.trim(F.regexp_replace(x, LIST_MARKER, ""))
        statement = (word_count(body) >= 4) & F.regexp(body, F.lit(r"^\p{Lu}")) & ~F.regexp(body, F.lit(rf"[{TERMINALS}]$"))
        return F.when(F.regexp(x, F.lit(LIST_MARKER)), F.when(statement, F.concat(body, F.lit("."))).otherwise(body)).otherwise(x)

    return F.regexp_replace(F.array_join(F.transform(plain, line), "\n"), r"\n+", " \n ")


def sentence_ratio(text: Column, sentences: Column) -> Column:
    """The share of a text's words that are in complete sentences of four words or more and mostly letters."""
    # fixed: four words and seven tenths letters
    total = word_count(F.regexp_replace(F.coalesce(text, F.lit("")), HEADING_LINE, ""))
    complete = lambda s: (
        (word_count(s) >= 4) & F.regexp(s, F.lit(r"^[\p{Lu}\p{Nd}]")) & F.regexp(s, F.lit(r"[.!?:;][\"')”]*$")) & (F.regexp_count(s, F.lit(r"\p{L}")) >= 0.7 * F.length(s))
    )
    good = F.aggregate(F.filter(sentences, complete), F.lit(0), lambda n, s: n + word_count(s))
    return ratio(good, total)


def hyphen_artifacts(text: Column) -> Column:
    """Hyphens of line ends that were left in a text; an ellipsis compound is none. Five at most."""
    # fixed: the words after which a hyphen stays
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[a-zà-ÿ]- ([a-zà-ÿ]+)"), F.lit(0))
    return F.slice(F.filter(found, lambda x: ~F.regexp_extract(x, r"- (.*)$", 1).isin("en", "of", "tot", "and", "or", "en/of")), 1, 5)


#: Fixed: control, private-use and zero-width characters, which are no text.
_UNSEEN = "\\x00-\\x08\\x0b-\\x1f\\x7f\\ue000-\\uf8ff\\u200b-\\u200d\\u2060\\ufeff"


def normalize_text(text: Column) -> Column:
    """Control, private-use and zero-width characters out, words that a hyphen broke joined, white space collapsed. A text without these, other hyphens and line ends only has its spaces collapsed."""

    def whole(t: Column) -> Column:
        t = F.regexp_replace(t, f"[{_UNSEEN}]", "")
        t = F.regexp_replace(t, "\\u00ad\\s*\\n\\s*", "")
        t = F.regexp_replace(t, "[\\u2010\\u2011\\u00ad]", "-")
        t = F.regexp_replace(t, r"(\p{L}{2,})-\n([a-z]{2,})", "$1$2")
        return F.regexp_replace(t, r"\s*\n\s*", " ")

    spaces = lambda t: F.regexp_replace(F.when(F.regexp(t, F.lit(f"[{_UNSEEN}\\n\\u00ad\\u2010\\u2011]")), whole(t)).otherwise(t), "[ \\t\\u00a0]+", " ")
    # the text, often an expression, is taken once
    return F.trim(F.element_at(F.transform(F.array(F.coalesce(text, F.lit(""))), spaces), 1))


def is_visible(text: Column) -> Column:
    """Whether :func:`normalize_text` leaves something; most texts have a character that decides it at once."""
    return F.when(F.regexp(text, F.lit(f"[^{_UNSEEN} \\t\\n\\u00a0\\u00ad]")), True).otherwise(normalize_text(text) != "")


def repetition_loop(text: Column) -> Column:
    """Whether a sentence of four words or more occurs three times."""
    long = F.filter(split_sentences(text), lambda s: F.size(tokens(s)) >= 4)
    return F.exists(F.array_distinct(long), lambda s: F.size(F.filter(long, lambda x: x == s)) >= 3)


def collapse_repetition(text: Column) -> Column:
    """A text with a loop without the repeats of its long sentences and an unfinished end; others as they are."""
    sentences = split_sentences(text)
    is_long = lambda s: F.size(tokens(s)) >= 4
    kept = F.filter(sentences, lambda s, i: ~is_long(s) | (F.array_position(sentences, s) == i + 1))
    ends = F.transform(kept, lambda s: F.regexp(s, F.lit(r"[.!?)*:]\s*$")))
    last = F.coalesce(F.array_max(F.transform(ends, lambda e, i: F.when(e, i + 1).otherwise(0))), F.lit(0))
    return F.when(repetition_loop(text), F.array_join(F.slice(kept, F.lit(1), last), " ")).otherwise(text)


def needs_deep_thinking(question: Column) -> Column:
    """A question of more than eighteen words or with a mark of several conditions."""
    # fixed: the marks of several conditions and the length of a question that needs thought
    marks = [" en ", " maar ", " zowel ", " rekening houdend", " gelijktijdig", " allebei", " beide", " tegelijk", " waarom ", " hoe kan het dat", " welke van de", " of moet ik"]
    padded = F.concat(F.lit(" "), F.lower(F.trim(question)), F.lit(" "))
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(padded, F.lit(m))
    return (word_count(question) > 18) | found


def strip_think(text: Column) -> Column:
    """struct(reasoning, rest): the first closed think block taken out; an open one leaves no rest."""
    closed = F.regexp(text, F.lit(r"(?s)<think>.*?</think>"))
    opened = F.contains(text, F.lit("<think>"))
    rest = F.trim(F.regexp_replace(text, r"(?s)^(.*?)<think>.*?</think>", "$1"))
    reasoning = F.when(closed, F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))).when(opened, F.trim(F.regexp_extract(text, r"(?s)<think>(.*)$", 1))).otherwise(F.lit(""))
    return F.struct(reasoning.alias("reasoning"), F.when(closed, rest).when(opened, F.lit("")).otherwise(F.trim(text)).alias("rest"))


def tool_call(text: Column) -> Column:
    """The name of the tool that a JSON object in a text calls, null without one."""
    body = F.regexp_extract(F.regexp_replace(F.trim(text), r"(?m)^```(json)?|```$", ""), r"(?s)\{.*\}", 0)
    return F.get_json_object(F.nullif(body, F.lit("")), "$.call_tool")


def assess_grounding(answer: Column, sources: Column, tools: Column) -> Column:
    """Green if there was a source or tool result and the answer names its sources or a tool."""
    had = (F.coalesce(F.size(sources), F.lit(0)) > 0) | (F.coalesce(F.size(tools), F.lit(0)) > 0)
    low = F.lower(answer)
    cites = F.contains(low, F.lit("bronnen:")) | F.contains(low, F.lit("bron:")) | F.coalesce(F.exists(tools, lambda t: F.contains(low, F.lower(t))), F.lit(False))
    return F.when(had & cites, "green").otherwise("red")


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """Matches of each pattern replaced by its name in brackets."""
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def _accents() -> tuple[str, str]:
    """Small letters up to Latin Extended-B and in Latin Extended Additional that decompose, and the plain letters they decompose to."""
    import unicodedata

    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    plain = {x: unicodedata.normalize("NFKD", x)[0] for x in letters}
    plain = {x: y for x, y in plain.items() if x != y and y.isascii() and len([c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)]) == 1}
    return "".join(plain), "".join(plain.values())


def fold(text: Column) -> Column:
    """Lower case, white space collapsed, accents dropped from Latin letters and as marks of their own."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())
    plain = F.regexp_replace(plain, r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def claims_authorisation(folded: Column) -> Column:
    """Whether a clause states a legal status without a hedge."""
    return F.exists(F.split(folded, r"[.;:?!\n]"), lambda c: F.regexp(c, F.lit(AUTHORISATION_CLAIM)) & ~F.regexp(c, F.lit(HEDGE)))


def forbidden(text: Column) -> Column:
    """The names of the rules that a text breaks."""
    f = fold(text)
    return F.array_compact(F.array(F.when(F.regexp(f, F.lit(DOSE_PER_AREA)), "DOSE"), F.when(F.regexp(f, F.lit(DOSE_PER_VOLUME)), "DOSE2"), F.when(claims_authorisation(f), "CLAIM")))


def fact_coverage(text: Column, facts: Column) -> Column:
    """The share of facts of which any alternative is in a text; 1 without facts."""
    f = fold(text)
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda alt: F.exists(alt, lambda a: F.contains(f, fold(a))))) / F.size(facts)).otherwise(F.lit(1.0))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8))


def merge_guard(action: Column) -> Column:
    """What two steps must share to be one: their numbers and whether they negate."""
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(action, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))))
    negation = F.regexp(F.lower(action), F.lit(r"\b(geen|niet|nooit|zonder|niet meer|no|not|never|without)\b"))
    return F.struct(numbers.alias("numbers"), negation.alias("negation"))


#: Fixed: labels of the lines of a card.
_CARD_FIELDS = {"Observatie": "observation", "Actie": "action", "Gevolg": "consequence", "Waarom": "why", "Slechtste reactie": "worst_case", "Bronnen": "sources"}


def parse_card(text: Column) -> Column:
    """struct of the labelled lines of a card ("- Label (note): value"); of several the last; empty where there is none."""
    fields = []
    for label, name in _CARD_FIELDS.items():
        found = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*-\s*{label}(?:\s*\([^)]*\))?:[^\S\n]*(.*?)\s*$"), F.lit(1))
        fields.append(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")).alias(name))
    status = F.lower(F.regexp_extract(text, r"(?m)^\s*-\s*Bronnen\s*\(([^)]*)\):", 1))
    return F.struct(*fields, F.when(status == "", F.lit("onbekend")).otherwise(status).alias("sources_status"))


def split_steps(action: Column) -> Column:
    """The steps of an action line: its sentences, cut at semicolons and commas, without leading conjunctions, from six characters on."""
    pieces = F.flatten(F.flatten(F.transform(F.split(F.trim(action), r"(?<=[.!?])\s+"), lambda s: F.transform(F.split(s, ";"), lambda c: F.split(c, ", ")))))

    def clean(p: Column) -> Column:
        p = F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"\.+$", ""), r"(?i)^(?:en dan|en daarna|en vervolgens|daarna|vervolgens|en|of|dan)\s+", ""))
        lower = F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
        return F.when(F.regexp(p, F.lit(r"^\p{L}\p{L}")) & ~F.regexp(p, F.lit(r"^\p{Lu}\p{Lu}")), lower).otherwise(p)

    return F.filter(F.transform(pieces, clean), lambda p: F.length(p) >= 6)


#: Fixed: names of the months.
_MONTHS = {"januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12}


def time_hints(query: Column) -> Column:
    """struct(years, months, dates) named in a question."""
    q = fold(query)
    years = F.transform(F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b(20[0-3]\d)\b"), F.lit(1))), lambda y: y.cast("int"))
    months = F.array_compact(F.array(*[F.when(F.regexp(q, F.lit(rf"\b{name}\b")), F.lit(n)) for name, n in _MONTHS.items()]))
    number = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])
    found = F.regexp_extract_all(q, F.lit(r"\b(\d{1,2} [a-z]+ 20[0-3]\d)\b"), F.lit(1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda d, n: F.split_part(d, F.lit(" "), F.lit(n))
    dates = F.transform(found, lambda d: F.try_to_date(F.concat_ws("-", part(d, 3), two(F.coalesce(F.try_element_at(number, part(d, 2)), F.lit(0))), two(part(d, 1)))))
    return F.struct(years.alias("years"), months.alias("months"), F.array_distinct(F.array_compact(dates)).alias("dates"))


def matches_time(day: Column, hints: Column) -> Column:
    """A named date decides; else year and month must fit where named."""
    by_part = ((F.size(hints["years"]) == 0) | F.array_contains(hints["years"], F.year(day))) & ((F.size(hints["months"]) == 0) | F.array_contains(hints["months"], F.month(day)))
    return F.when(F.size(hints["dates"]) > 0, F.array_contains(hints["dates"], day)).otherwise(by_part)


def lexical_overlap(text: Column, terms: Column) -> Column:
    """The share of terms in a text, whole or by the first five letters of a word."""
    hay = fold(text)
    found = F.filter(terms, lambda t: F.contains(hay, t) | ((F.length(t) >= 5) & F.contains(F.concat(F.lit(" "), hay), F.concat(F.lit(" "), F.substring(t, 1, 5)))))
    return ratio(F.size(found), F.size(terms))


def caps_heading(text: Column) -> Column:
    """A short line in capitals that is neither a sentence nor an entry of a list of references."""
    # fixed: lengths and shares
    t = F.trim(text)
    n = F.regexp_count(t, F.lit(r"\p{L}"))
    return (
        (n >= 4) & word_count(t).between(1, 9) & (F.length(t) <= 70) & ~F.regexp(t, F.lit(r"[.,;-]$")) & F.regexp(t, F.lit("^[A-Za-zÀ-ſ0-9 \\-:,&'()/]+$"))
        & ~F.regexp(t, F.lit(r"^\d{4}\b")) & (F.regexp_count(t, F.lit(r"\d")) <= 2) & (F.regexp_count(t, F.lit(r"\p{Lu}")) >= 0.9 * n)
    )


def page_number(text: Column) -> Column:
    # fixed: the forms of a page number
    return F.regexp(F.trim(text), F.lit(r"(?i)^\W*(?:p(?:ag(?:ina|e)?|\.)?\s*)?\d{1,4}(?:\s*(?:/|of|van)\s*\d{1,4})?\W*$"))


def ocr_junk(text: Column) -> Column:
    """Eight tokens or fewer, of which three fifths have two characters or fewer without the marks around them; never a text that ends a sentence."""
    t = tokens(text)
    bare = lambda x: F.regexp_replace(x, r"^[\^*'\".,;:]+|[\^*'\".,;:]+$", "")  # noqa: E731  fixed: the marks
    return F.size(t).between(1, 8) & (F.size(F.filter(t, lambda x: F.length(bare(x)) <= 2)) >= 0.6 * F.size(t)) & ~ends_sentence(text)


#: Fixed: what legal and site boilerplate says.
BOILERPLATE = (
    r"(?i)subsidieovereenkomst|dit project is gefinancierd|research executive agency|project has received funding|grant agreement n|alle rechten voorbehouden|accepteer (alle )?cookies|cookie-?(instellingen|beleid|voorkeuren)|"
    r"html public|<!doctype|^\s*\{\w+\}|\u00b7 @\w+|^\s*\d{1,2}/\d{1,2}/\d{4}\s*$|please click here if you are not redirected|google tag manager|vrijblijvende offerte|commentaarfunctie|disqus|zich registreren bij de|abonneer u|schrijf je in voor de nieuwsbrief"
)


def boilerplate(text: Column) -> Column:
    """Whether a paragraph is a notice of funding, rights or cookies, or a part of the site."""
    return F.coalesce(F.regexp(text, F.lit(BOILERPLATE)), F.lit(False))


def web_fragment(kind: Column, text: Column) -> Column:
    """Whether a block of a web page is a label and not text: a paragraph under four words or a list item under three that ends no sentence."""
    least = F.when(kind == "paragraph", 4).when(kind == "list_item", 3).otherwise(0)
    return F.coalesce((word_count(text) < least) & ~ends_sentence(text), F.lit(False))


def clean_quotes(text: Column) -> Column:
    """Quotes around a name that recognition misread (*Corum' and the like), and catalogue numbers of photographs taken out."""
    # fixed: the marks that stand for quotes, and the form of a catalogue number
    t = F.regexp_replace(text, r"(?<![\w'])[\^*\u25a0](?=[A-Z][A-Za-z\-]{2,}['\\\u2019\"])", "'")
    t = F.regexp_replace(t, r"(?<=[A-Za-z])\\(?=[\s,.;)]|$)", "'")
    return F.regexp_replace(t, r"\b[A-Z]{1,3}-\d{3,5}\b\s*", "")


def format_pages(pages: Column) -> Column:
    """p.2-4 for a run of pages, p.2, 5 for others; empty without pages."""
    p = F.array_sort(F.array_distinct(pages))
    run = (F.size(p) > 1) & (F.try_element_at(p, F.lit(-1)) - F.try_element_at(p, F.lit(1)) == F.size(p) - 1)
    text = F.transform(p, lambda x: x.cast("string"))
    return F.when(F.size(p) == 0, F.lit("")).when(run, F.concat(F.lit("p."), F.element_at(text, 1), F.lit("-"), F.element_at(text, -1))).otherwise(F.concat(F.lit("p."), F.array_join(text, ", ")))
