"""The gate's measures of a text as plain Python, for the workers: one reading of a text gives all of them.

Patterns mean what they mean in the SQL of the gate's queries: white space and digits are ASCII, letters are those of Unicode. The column
expressions in :mod:`text` measure the same, one expression each.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import cache

from . import text as T

_SPACE = "\t\n\f\r "
#: What DuckDB and a reader trim: the spaces of Unicode, but no tabs and line ends.
_TRIM = " \xa0              　"
#: Where str.split() cuts though a pattern's white space wouldn't.
_OTHER_SPACE = re.compile("[\x0b\x1c-\x1f\x85\xa0  -     　]")
_TOKEN = re.compile(rf"[^{_SPACE}]+")
_CUT = re.compile(rf"(?<=[.!?])[{_SPACE}]+")
_HEADING = re.compile(r"^[\t\f\r ]*\*\*[^*\n]+\*\*[\t\f\r ]*$", re.M)
_LIST = re.compile(rf"[{_SPACE}]*(?:[-•*]|[0-9]{{1,2}}[.)])[{_SPACE}]+")
_NUMERIC = re.compile(rf"(?<![^{_SPACE}])[0-9.,%±()/\-–+<>=°]+[a-zA-Z%°]{{0,3}}(?![^{_SPACE}])")
_REFERENCES = [re.compile(p, re.A) for p in T.REFERENCE_PATTERNS]
_TAIL = re.compile(rf"[0-9]+(?:[{_SPACE},;]+[A-Za-z0-9]{{1,2}})*\)+\.?\Z")
_HYPHEN = re.compile(r"[a-zà-ÿ]- ([a-zà-ÿ]+)")
_KEEPS_HYPHEN = {"en", "of", "tot", "and", "or", "en/of"}
_LAST_WORD = re.compile(r"[A-Za-z]+\Z")
_ABBREVIATIONS = frozenset(T.ABBREVIATIONS)
_LONGEST = max(map(len, T.ABBREVIATIONS))
_STOP = {lang: frozenset(words) for lang, words in T.STOPWORDS.items()}
#: Characters of Latin-1 by kind, as bytes. Whatever is beyond is rare and looked at one by one.
_LATIN = [chr(c) for c in range(256)]
_LETTERS, _CAPITALS, _DIGITS = ("".join(c for c in _LATIN if f(c)).encode("latin-1") for f in (lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c) == "Lu", "0123456789".__contains__))
_BEYOND = re.compile("[^\x00-\xff]")
_LATIN_WORD = re.compile(f"[{''.join(re.escape(c) for c in _LETTERS.decode('latin-1'))}]{{3,}}")
_ENDS, _GOOD_ENDS = frozenset(".!?:;…"), frozenset(".!?:;")


@cache
def _any_word() -> re.Pattern[str]:
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]{3,}")


def _is(c: str, *categories: str) -> bool:
    return unicodedata.category(c) in categories if c else False


def _word_pattern(text: str) -> re.Pattern[str]:
    latin = text.isascii() or not any(unicodedata.category(c)[0] == "L" for c in set(_BEYOND.findall(text)))
    return _LATIN_WORD if latin else _any_word()


def find_words(text: str) -> list[str]:
    """Runs of three letters or more."""
    return _word_pattern(text).findall(text)


def _count(text: str, kind: bytes, category: str) -> int:
    """Characters of a kind: those of Latin-1 that are in ``kind``, and those beyond whose category begins so."""
    latin = text.encode("latin-1", "ignore")
    beyond = len(text) - len(latin)
    return len(latin) - len(latin.translate(None, kind)) + (sum(unicodedata.category(c).startswith(category) for c in _BEYOND.findall(text)) if beyond else 0)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text) if _OTHER_SPACE.search(text) else text.split()


def pieces(text: str) -> list[str]:
    """Cut after . ! or ? where white space follows."""
    return [p for p in (s.strip(_TRIM) for s in _CUT.split(text)) if p]


def _abbreviation(before: str) -> str:
    """The letters before a last full stop that stand alone but for opening marks, if they are no longer than an abbreviation."""
    if before[-1:] != ".":
        return ""
    m = _LAST_WORD.search(before[-_LONGEST - 2 : -1])
    if not m or len(m[0]) > _LONGEST:
        return ""
    at = len(before) - 1 - len(m[0])
    while at and before[at - 1] in "([{\"'‘“":
        at -= 1
    return m[0] if not at or before[at - 1] in _SPACE else ""


def _same_sentence(before: str, piece: str) -> bool:
    first = piece[0]
    if first in ";,)":
        return True
    word = _abbreviation(before)
    if word and (word.lower() in _ABBREVIATIONS or len(word) == 1 and word.isupper()):
        return True
    kind = unicodedata.category(first)
    if kind != "Lu":
        if word and len(word) <= 3 and word.islower() and kind in ("Ll", "Nd"):
            return True
        if kind == "Ll" and (before.endswith((").", "?", "!")) or sum(map(before.count, "([{")) > sum(map(before.count, ")]}"))):
            return True
        if first.isascii() and first.isdigit() and _TAIL.match(piece):
            return True
    return before[-1] == "." and before[:-1].isascii() and before[:-1].isdigit()


def whole_sentences(text: str) -> list[str]:
    """Pieces put together again where a full stop was inside a sentence."""
    done: list[list[str]] = []
    last = ""
    for piece in pieces(text):
        if last and _same_sentence(last, piece):
            done[-1].append(piece)
            last = f"{last} {piece}"
        else:
            done.append([piece])
            last = piece
    return [p[0] if len(p) == 1 else " ".join(p) for p in done]


def _prose(plain: str) -> str:
    """A text without headings as its sentences are judged: without list markers; a list item of four words or more that begins with a capital is a statement."""
    found = plain.split("\n")
    for i, x in enumerate(found):
        m = _LIST.match(x)
        if m:
            body = x[m.end() :].strip(_TRIM)
            found[i] = body + "." if _is(body[:1], "Lu") and body[-1] not in T.TERMINALS and len(tokens(body)) >= 4 else body
    return re.sub("\n+", " \n ", "\n".join(found))


def measures(text: str | None, language: str | None) -> tuple:
    """The counts behind the signals of a text, in the order of ``MEASURES``."""
    t = text or ""
    plain = _HEADING.sub("", t) if "**" in t else t
    words = len(tokens(t))
    n_plain = words if plain is t else len(tokens(plain))
    sentences = whole_sentences(_prose(plain))
    good, flags = 0, []
    for s in sentences:
        kind, n = unicodedata.category(s[0]), len(tokens(s))
        begins = kind in ("Lu", "Nd")
        flags.append(n >= 3 and (begins or s[0] in "\"'“‘(") and s.rstrip("\"')”’")[-1:] in _ENDS)
        if n >= 4 and begins and s.rstrip("\"')”")[-1:] in _GOOD_ENDS and _count(s, _LETTERS, "L") >= 0.7 * len(s):
            good += n
    lines = [x for x in (y.strip(_SPACE) for y in t.split("\n")) if x]
    fragments = sum(1 for x in lines if x[-1] not in ".!?:;" and len(tokens(x)) < 4 and not _LIST.match(x))
    found = find_words(t.lower()) if t.isascii() else [w.lower() for w in find_words(t)]
    stop = lambda lang: sum(map(_STOP[lang].__contains__, found))
    digits = _count(t, _DIGITS, "none")
    # all but abbreviations have a digit
    references = sum(len(p.findall(t)) for p in (_REFERENCES if digits else _REFERENCES[1:2]))
    hyphens = [m[0] for m in _HYPHEN.finditer(t) if m[1] not in _KEEPS_HYPHEN][:5] if "- " in t else []
    bad = [s[:80] for s, f in zip(sentences, flags, strict=True) if not f]
    return (
        words, good, n_plain, len(lines), fragments, len(_NUMERIC.findall(t)), digits, len(t), references,
        len(found), max(stop("en"), stop("nl") if language == "nl" else 0), len(lines) - len(set(lines)), _count(t, _CAPITALS, "Lu"), _count(t, _LETTERS, "L"),
        len(flags), len(bad), bool(flags) and not flags[0], bool(flags) and not flags[-1], hyphens, bad[:3],
    )


#: Names and types of what :func:`measures` gives.
MEASURES = (
    [(n, "int") for n in ("words", "good", "plain", "lines", "fragments", "numeric", "digits", "length", "references", "terms", "stop", "duplicate_lines", "capitals", "letters", "n_sentences", "incomplete_sentences")]
    + [("first_incomplete", "boolean"), ("last_incomplete", "boolean"), ("hyphens", "array<string>"), ("incomplete_examples", "array<string>")]
)


def impossible_words(text: str | None, language: str | None, accents: dict[str, str]) -> list[str]:
    """Words that begin small, in small letters, that have a letter beyond ASCII that their language doesn't have; each occurrence."""
    if not text or text.isascii():
        return []
    own = accents.get(language or "", "")
    low = (w.lower() for w in find_words(text) if not w.isascii() and not w[0].isupper())
    return [w for w in low if not all(c.isascii() or c in own for c in w)]


def sentence_words(text: str) -> tuple[list[str], list[str], set[str]]:
    """Words in small letters: those that begin small, those with a capital, and of these the ones inside a sentence."""
    pattern = _word_pattern(text)
    words = pattern.findall(text)
    small = [w for w in words if not w[0].isupper()]
    if len(small) == len(words):
        return [w.lower() for w in small], [], set()
    capital = [w for w in words if w[0].isupper()]
    inside = Counter(capital)
    inside.subtract(m[0] for s in _CUT.split(text) if (m := pattern.search(s)) and m[0][0].isupper())
    return [w.lower() for w in small], [w.lower() for w in capital], {w.lower() for w, n in inside.items() if n > 0}
