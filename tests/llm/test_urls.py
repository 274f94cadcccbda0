import re

from fieldmill.llm import op07_url_filters as urls

CASES = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/", "https://a.example.net/en/x?q#f", "http://example.net/fr/", "http://example.net", "http://notexample.com/de/", "http://x.example.com/de/1", "ftp://b.org/fr/://x.net/", "http://org/fr/", "http://spam-farm.example.org/en/1", "http://nospam.example.org/", "http://net?/", "http://user@a.net:80/p"]


def brute(url, rules=urls.CONTRACT_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def table(spark):
    return spark.createDataFrame(list(enumerate(CASES)) + [(1, ""), (None, "http://a.net/")], "page_id long, url string")


def test_inline_and_indexed_rules_equal_brute_force(spark):
    pages = table(spark)
    for judge in (urls.judge_urls, lambda p: urls.judge_urls_indexed(p, urls.CONTRACT_RULES, urls.DEFAULT_PATTERNS)):
        rows = judge(pages).collect()
        assert len(rows) == len(CASES) + 2
        for r in rows:
            if r["page_id"] is not None:
                host, path, rule, verdict = brute(CASES[r["page_id"]])
                assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
                assert r["verdict"] == (verdict or ("block" if "spam-farm" in host else "allow"))


def test_rarest_token_spares_rules(spark):
    rules = [urls.Rule(f"site{i}.example.com", "/a/", "block") for i in range(50)]
    assert all(t.startswith("site") for t in urls.rarest_tokens(rules))
    pages = spark.createDataFrame([(1, "http://site7.example.com/a/x"), (2, "http://example.com/a/")], "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge_urls(pages, rules, []).collect()}
    assert (found[1]["n_candidates"], found[1]["verdict"]) == (1, "block") and found[2]["n_candidates"] == 0


def test_path_token_may_go_on(spark):
    pages = spark.createDataFrame([(1, "http://a.com/downloads"), (2, "http://a.com/down/x")], "page_id long, url string")
    assert [r["rule"] for r in urls.judge_urls(pages, [urls.Rule("a.com", "/down", "block")], []).orderBy("page_id").collect()] == ["a.com/down"] * 2


def test_empty_table(spark):
    assert urls.judge_urls(table(spark).where("false")).count() == 0
    assert urls.judge_urls_indexed(table(spark).where("false"), urls.CONTRACT_RULES).count() == 0


def test_thousands_of_rules_equal_brute_force(spark):
    """More rules than fit a literal, very long urls, and columns whose names clash with outputs."""
    import random

    rng = random.Random(9)
    hosts = [f"{a}{i}.example.{b}" for i in range(40) for a in ("www", "cdn", "img") for b in ("com", "org")]
    rules = list({r.name: r for r in (urls.Rule(rng.choice(hosts)[rng.choice((0, 3)) :].lstrip("."), rng.choice(("/", "/a/", "/a/b", "/x-y/", "/q")), rng.choice(("allow", "block"))) for _ in range(4000))}.values())
    made = [f"http://{rng.choice(('', 'sub.'))}{rng.choice(hosts)}{rng.choice(('/a/b/c', '/x-y/1', '/', '/quick', ''))}" for _ in range(300)]
    made += ["http://www1.example.com/a/" + "b" * 200_000, "http://" + "a." * 50_000 + "example.com/"]
    pages = spark.createDataFrame([(i, u, "rule", "verdict", 1) for i, u in enumerate(made)], "page_id long, url string, rule string, verdict string, n_candidates int")
    judged = urls.judge_urls_indexed(pages, rules).collect()
    assert len(judged) == len(made) and len(rules) > 500
    for r in judged:
        host, path, rule, verdict = brute(made[r["page_id"]], rules)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
