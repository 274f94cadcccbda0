"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled once, on the driver, to a regular expression over
``host + NUL + path`` and to the set of literal tokens that each URL it fits
must hold. The rule is filed under the rarest of these tokens, where rarity is
the number of rules that hold the token (ties: the longer, then the smaller
token). The tokens of a URL fetch candidate rules from that index, and only
candidates run their regular expression. A rule without a literal token is a
candidate for all URLs.

Everything runs as DataFrame expressions. Up to ``INLINE_RULES`` rules the index
is one map literal, so that no join and no shuffle is needed. Larger rule sets
are a DataFrame that is joined by token; see :func:`judge_urls_indexed`.

Defined results: a null url and one without ``://`` have empty host and path;
no rule fits them and the default verdict applies. Repeated rows are judged one
by one. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OWN, ascii_lower, table

#: Rule sets up to this size are carried as a literal in the plan.
INLINE_RULES = 2000
TOKEN_SPLIT = r"[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``host`` fits itself and its subdomains; ``path`` is a prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return r"(?s)^(?:[^\x00]*\.)?" + java_quote(self.host) + r"\x00" + java_quote(self.path)

    @property
    def tokens(self) -> set[str]:
        """Tokens that a fitting URL holds whole. The last token of the path may go on in the URL."""
        path = self.path if re.search(r"[^A-Za-z0-9]\Z", self.path) else re.sub(r"[A-Za-z0-9]+\Z", "", self.path)
        return {t for t in re.split(TOKEN_SPLIT, f"{self.host} {path}") if t}


@dataclass(frozen=True)
class Pattern:
    """A regular expression over ``host + NUL + path`` with the literal tokens it implies; weaker than any rule."""

    name: str
    regex: str
    tokens: frozenset[str]
    verdict: str


CONTRACT_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]

#: Applied where no rule fits: hosts that name themselves as link farms or gambling pages.
DEFAULT_PATTERNS = [
    Pattern(f"host-{word}", rf"(?s)^[^\x00]*(?<![a-z0-9]){word}(?![a-z0-9])[^\x00]*\x00", frozenset({word}), "block")
    for word in ("spam", "casino", "porn", "phishing", "malware")
]


def java_quote(literal: str) -> str:
    return "".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in literal)


def rarest_tokens(rules: Iterable[Rule | Pattern]) -> list[str | None]:
    rules = list(rules)
    held = Counter(t for r in rules for t in r.tokens)
    return [min(r.tokens, key=lambda t: (held[t], -len(t), t)) if r.tokens else None for r in rules]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _ranked(rules: list[Rule], patterns: list[Pattern]) -> list[tuple[str | None, int, str, str | None, str]]:
    """(token, rank, regex, name, verdict); of several that fit the highest rank wins: rules before patterns, longer before shorter, then the smaller name."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
    both: list[Rule | Pattern] = [*order, *sorted(patterns, key=lambda p: p.name)]
    tokens = rarest_tokens(both)
    return [(t, len(both) - i, r.regex, r.name if isinstance(r, Rule) else None, r.verdict) for i, (r, t) in enumerate(zip(both, tokens, strict=True))]


def _prepared(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    subject = F.concat("host", F.lit("\0"), "path")
    return cut.select("page_id", "host", "path", subject.alias(f"{OWN}subject"), F.array_distinct(F.split(subject, TOKEN_SPLIT)).alias(f"{OWN}tokens"))


def judge_urls(pages: DataFrame, rules: list[Rule] = CONTRACT_RULES, patterns: list[Pattern] = DEFAULT_PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and the number of candidate rules of each row of ``pages``."""
    if len(rules) + len(patterns) > INLINE_RULES:
        return judge_urls_indexed(pages, rules, patterns, default)
    index: dict[str, list[Column]] = {}
    always: list[Column] = []
    for token, rank, regex, name, verdict in _ranked(rules, patterns):
        entry = F.struct(F.lit(rank).alias("rank"), F.lit(regex).alias("regex"), F.lit(name).cast("string").alias("name"), F.lit(verdict).alias("verdict"))
        (index.setdefault(token, []) if token else always).append(entry)
    kind = "array<struct<rank:int,regex:string,name:string,verdict:string>>"
    found = _prepared(pages)
    fetched = F.array(*always).cast(kind) if always else F.array().cast(kind)
    if index:
        by_token = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.array(*e).cast(kind)) for t, e in index.items()]))
        hits = F.filter(F.transform(f"{OWN}tokens", lambda t: F.try_element_at(by_token, t)), lambda hit: hit.isNotNull())
        fetched = F.concat(fetched, F.flatten(hits))
    found = found.withColumn(f"{OWN}candidates", fetched)
    best = F.array_max(F.filter(f"{OWN}candidates", lambda c: F.regexp(f"{OWN}subject", c["regex"])))
    found = found.withColumn(f"{OWN}best", best)
    return _verdicts(found, F.size(f"{OWN}candidates"), default)


def judge_urls_indexed(pages: DataFrame, rules: list[Rule], patterns: list[Pattern] = (), default: str = "allow") -> DataFrame:
    """As :func:`judge_urls`, for rule sets of any size: the index is a table that is joined by token.

    Equal (host, path) pairs are judged once, which bounds the effect of hot hosts.
    """
    spark = pages.sparkSession
    kind = f"{OWN}token string, rank int, regex string, name string, verdict string"
    ranked = _ranked(list(rules), list(patterns))
    index = spark.createDataFrame([r for r in ranked if r[0]], kind)
    found = _prepared(pages)
    urls = found.select("host", "path", f"{OWN}subject", f"{OWN}tokens").dropDuplicates(["host", "path"])
    by_token = urls.withColumn(f"{OWN}token", F.explode(f"{OWN}tokens")).join(index, f"{OWN}token")
    candidates = by_token.select("host", "path", f"{OWN}subject", "rank", "regex", "name", "verdict")
    if any(not r[0] for r in ranked):
        everywhere = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(x).alias("regex"), F.lit(n).cast("string").alias("name"), F.lit(v).alias("verdict")) for t, k, x, n, v in ranked if not t]))
        candidates = candidates.unionByName(urls.select("host", "path", f"{OWN}subject", everywhere.alias("r")).select("host", "path", f"{OWN}subject", "r.*"))
    best = candidates.groupBy("host", "path").agg(
        F.max(F.when(F.regexp(f"{OWN}subject", "regex"), F.struct("rank", "regex", "name", "verdict"))).alias(f"{OWN}best"), F.count(F.lit(1)).cast("int").alias(f"{OWN}n")
    )
    return _verdicts(found.join(best, ["host", "path"], "left"), F.coalesce(F.col(f"{OWN}n"), F.lit(0)), default)


def _verdicts(found: DataFrame, n: Column, default: str) -> DataFrame:
    best = F.col(f"{OWN}best")
    return found.select("page_id", "host", "path", best["name"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"), n.alias("n_candidates"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


ORACLE_OP7 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), judged AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, '(^|[^a-z0-9])(spam|casino|porn|phishing|malware)([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""
