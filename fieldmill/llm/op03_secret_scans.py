"""Secret scans over a trigram inverted index.

Each rule's regular expression is compiled to a Boolean query over trigrams that
any match must hold (AND over a literal, OR over alternatives). Documents are
indexed block by block, where a block is a slice of an Arrow batch: the index maps
each trigram of the queries to its posting list, kept as a bitmap over the rows
of the block. A query intersects and unites postings, the surviving candidates
are verified with the regular expression itself, and rules without a mandatory
trigram scan every row. The index is partitioned by document, so no row moves:
there is no shuffle, and a lost executor costs its own blocks only.

Trigrams are of UTF-8 bytes with A-Z folded to a-z, which keeps the index a
superset for rules of either case.

Defined results: a null text counts as empty and has no secrets; repeated rows
are scanned one by one; an empty table gives an empty result; other columns
than doc_id and text are left out. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, count_of, table, text_offsets

#: Bytes of text in a block of the index.
BLOCK_BYTES = 4 << 20
#: An exact set beyond this size is given up for its trigrams.
EXACT_LIMIT = 48
#: A character class beyond this size counts as any character.
CLASS_LIMIT = 8


@dataclass(frozen=True)
class SecretRule:
    """A match of ``pattern`` is dropped where ``group`` is shorter than ``min_chars``."""

    name: str
    pattern: str
    min_chars: int = 0
    group: int = 0


BASE_RULES = (
    SecretRule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    # {24,} finds the same maximal runs as + with a length check: a shorter run never starts a match
    SecretRule("hex", r"[0-9a-f]{24,}", 24),
)

#: What the scan adds to the base: public formats of credentials.
ADDED_RULES = (
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    SecretRule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("stripe", r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("url_login", r"://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)

# ---------------------------------------------------------------- queries
# A query is True (no mandatory trigram), a trigram, or ("and" | "or", frozenset of queries).


def _and(*queries):
    parts = set()
    for q in queries:
        if q is not True:
            parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _or(*queries):
    parts = set()
    for q in queries:
        if q is True:
            return True
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _trigrams(literals: set[bytes]):
    if not literals or any(len(x) < 3 for x in literals):
        return True
    return _or(*[_and(*[x[i : i + 3] for i in range(len(x) - 2)]) for x in literals])


@dataclass(frozen=True)
class _Part:
    """``exact``: all strings it matches, or None; then what they begin and end with, and the query for the rest."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes] = frozenset({b""})
    suffix: frozenset[bytes] = frozenset({b""})
    query: object = True

    def opened(self) -> _Part:
        """The same without an exact set."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(x[:2] for x in self.exact), frozenset(x[-2:] for x in self.exact), _trigrams(set(self.exact)))


_EMPTY = _Part(frozenset({b""}))
_UNKNOWN = _Part(None)


def _concat(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= EXACT_LIMIT:
        return _Part(frozenset(a + b for a in x.exact for b in y.exact))
    begin = x.exact if x.exact is not None else x.suffix
    end = y.exact if y.exact is not None else y.prefix
    joint = {a + b for a in begin for b in end} if len(begin) * len(end) <= EXACT_LIMIT else set()
    p, q = x.opened(), y.opened()
    prefix = frozenset((a + b)[:2] for a in x.exact for b in q.prefix) if x.exact is not None else p.prefix
    suffix = frozenset((a + b)[-2:] for a in p.suffix for b in y.exact) if y.exact is not None else q.suffix
    return _Part(None, prefix, suffix, _and(p.query, q.query, _trigrams(joint)))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= EXACT_LIMIT:
        return _Part(frozenset().union(*[p.exact for p in parts]))
    opened = [p.opened() for p in parts]
    return _Part(None, frozenset().union(*[p.prefix for p in opened]), frozenset().union(*[p.suffix for p in opened]), _or(*[p.query for p in opened]))


def _folded(code: int) -> bytes:
    return chr(code).encode().lower()


def _class(items) -> _Part:
    found: set[bytes] = set()
    for op, arg in items:
        if op == sre.LITERAL:
            found.add(_folded(arg))
        elif op == sre.RANGE and arg[1] - arg[0] < CLASS_LIMIT:
            found |= {_folded(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return _UNKNOWN
        if len(found) > CLASS_LIMIT:
            return _UNKNOWN
    return _Part(frozenset(found))


def _analyse(tree, flags: int = 0) -> _Part:
    whole = _EMPTY
    for op, arg in tree:
        if op == sre.LITERAL:
            # beyond ASCII, a letter in either case has more forms than its lower case
            part = _UNKNOWN if flags & re.IGNORECASE and not (flags & re.ASCII and arg < 128) else _Part(frozenset({_folded(arg)}))
        elif op == sre.IN:
            part = _UNKNOWN if flags & re.IGNORECASE and not flags & re.ASCII else _class(arg)
        elif op == sre.SUBPATTERN:
            part = _analyse(arg[3], (flags | arg[1]) & ~arg[2])
        elif op == sre.BRANCH:
            part = _either([_analyse(x, flags) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            once = _analyse(body, flags)
            if (low, high) == (0, 1):
                part = _either([_EMPTY, once])
            elif low == 0:
                part = _UNKNOWN
            elif low == high == 1:
                part = once
            else:
                part = once.opened()
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _EMPTY
        elif op == sre.ATOMIC_GROUP:
            part = _analyse(arg, flags)
        else:
            part = _UNKNOWN
        whole = _concat(whole, part)
    return whole


@cache
def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; True where none is mandatory."""
    tree = sre_parser.parse(pattern)
    return _analyse(tree, tree.state.flags & ~re.UNICODE).opened().query


def _leaves(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_leaves, query[1]))


# ---------------------------------------------------------------- blocks

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class TrigramIndex:
    """Postings of the given trigrams over the rows of a block."""

    def __init__(self, vocabulary: dict[bytes, int], lookup: np.ndarray, texts: pa.StringArray):
        self.vocabulary, self.rows = vocabulary, len(texts)
        self.postings = np.zeros((len(vocabulary) + 1, self.rows), dtype=bool)
        offsets = text_offsets(texts)
        if not vocabulary or offsets[-1] - offsets[0] < 3:
            return
        data = _FOLD[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
        code = data[:-2].astype(np.uint32)
        code <<= 8
        code |= data[1:-1]
        code <<= 8
        code |= data[2:]
        which = lookup[code]
        at = np.flatnonzero(which)
        row = np.searchsorted(offsets[1:] - offsets[0], at, side="right")
        inside = at + 2 < (offsets[1:] - offsets[0])[row]  # not across two documents
        self.postings[which[at[inside]], row[inside]] = True

    def rows_for(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.rows, dtype=bool)
        if isinstance(query, bytes):
            return self.postings[self.vocabulary[query]]
        found = [self.rows_for(q) for q in query[1]]
        return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


@cache
def _lookup(grams: tuple[bytes, ...]) -> tuple[dict[bytes, int], np.ndarray]:
    vocabulary = {g: i for i, g in enumerate(grams, 1)}
    lookup = np.zeros(1 << 24, dtype=np.uint8 if len(grams) < 256 else np.uint16)
    for g, i in vocabulary.items():
        lookup[g[0] << 16 | g[1] << 8 | g[2]] = i
    return vocabulary, lookup


def scanner(rules: tuple[SecretRule, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    queries = [trigram_query(r.pattern) for r in rules]
    grams = tuple(sorted(set().union(*map(_leaves, queries))))
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        vocabulary, lookup = _lookup(grams)
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                texts = block.column(1)
                index = TrigramIndex(vocabulary, lookup, texts)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
                tried = np.zeros(len(texts), dtype=np.int32)
                plain = texts.to_pylist()
                for k, rule in enumerate(rules):
                    candidates = index.rows_for(queries[k])
                    tried += candidates
                    for row in np.flatnonzero(candidates):
                        for m in compiled[k].finditer(plain[row]):
                            start, end = m.span(rule.group)
                            if end - start >= rule.min_chars:
                                found[row].append((m.start(), k, m.end()))
                secrets = [[{"rule": rules[k].name, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(secrets, kind), pa.array(tried)], ["doc_id", "secrets", "rules_tried"])

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """doc_id, secrets (rule, start, end in code points; by start, then in the rules' order) and the number of rules whose pattern ran."""
    plain = docs.select("doc_id", "text")
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInArrow(scanner(tuple(rules)), f"doc_id {kind}, secrets array<struct<rule:string,start:int,end:int>>, rules_tried int")


def spans_string(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    names = [r.name for r in BASE_RULES]
    base = F.filter("secrets", lambda s: s["rule"].isin(names))
    return found.select("doc_id", *[count_of("secrets", "rule", n) for n in names], F.sha2(spans_string(base), 256).alias("base_sha256"), spans_string(F.col("secrets")).alias("spans"), "rules_tried")
