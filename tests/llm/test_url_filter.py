"""URL filters against a plain reading of the rules."""

import re

import pytest

from pathlight.llm.url_filter import PATTERN_RULES, SITE_RULES, compiled, judge, rule_index, rule_table, with_parts

from .conftest import records

URLS = [
    "http://example.com/en/1", "https://www.EXAMPLE.com/en/", "https://www.example.com/EN/", "http://badexample.com/en/",
    "http://x.y.example.com/en/?q", "http://example.com", "http://example.com?x=/en/", "http://com/", "http://a.net/es/1#x",
    "http://a.net/es", "http://a.net/fr/", "http://net/fr/", "http://a.net:80/fr/", "https://m.casino-win.example.org/en/1",
    "https://mycasino-win.example.org/", "https://x.example.org/?a=1&SESSIONID=9", "https://x-bets.example.org/robots.txt",
    "https://x-bets.example.org/robots.txt?x", "x.org/phishing/", "ftp://x.org/phishing", "ftp://x.org/éphishing/", "ftp://x.org/phishingé",
    "http://phishing", "http://doubleclick.org", "http://x.doubleclick", "http://a://b/robots.txt", "://", "", None, "http://ADSERVER/x\ny",
    "http://h/a\n?x\n&sessionid=1", "http://Straße.net/es/ü", "http://user@x.net/es/", "http://ads-1.net/de/", "http://x.org/wp-login.php",
]


def plain(url, rules, otherwise="allow"):
    """Every rule is tried on every URL."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    target = lower + rest[len(host) :]
    fits = []
    for kind, action, rule in rules:
        if kind == "site":
            name, slash, tail = rule.partition("/")
            if (lower == name or lower.endswith("." + name)) and path.startswith(slash + tail):
                fits.append((True, len(rule), action == "allow", rule))
            continue
        begin, body, end = "", rule, ""
        if body.startswith("||"):
            begin, body = r"\A(?:[^/?#]*\.)?", body[2:]
        elif body.startswith("|"):
            begin, body = r"\A", body[1:]
        if body.endswith("|"):
            body, end = body[:-1], r"\Z"
        gap = r"(?:[\x00-\x7F](?<![A-Za-z0-9_.%-])|\A|\Z)"
        body = "".join(".*" if c == "*" else gap if c == "^" else re.escape(c) for c in body)
        if re.search("(?isa)" + begin + body + end, target):
            fits.append((False, 0, action == "allow", rule))
    if not fits:
        return lower, path, None, None, otherwise
    site, _, allows, rule = max(fits)
    return lower, path, rule if site else None, None if site else rule, "allow" if allows else "block"


def judged(frame):
    return [tuple(row[c] for c in ("host", "path", "rule", "pattern", "verdict")) for row in records(frame.orderBy("page_id"))]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_every_rule_on_every_url(spark, limit):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = SITE_RULES + PATTERN_RULES + [
        ("pattern", "block", "x.org/*/y|"), ("pattern", "block", "|h/a*"), ("pattern", "allow", "*ü"), ("pattern", "block", "1"),
        ("site", "block", "org"), ("site", "allow", "x.org"), ("site", "block", "x.org"), ("pattern", "block", "||"),
    ]
    for some in (rules, rules[:-1], rules[:-4], SITE_RULES, PATTERN_RULES):
        got = judged(judge(pages, rule_table(spark, some), limit=limit))
        assert got == [plain(url, some) for url in URLS]


def test_rules_stand_under_their_rarest_token(spark):
    urls = [(n, f"http://host{n}.example.com/en/") for n in range(20)] + [(99, "http://m.casino-win.net/")]
    rows = with_parts(spark.createDataFrame(urls, "row bigint, url string"))
    index = {r["rule"]: r["token"] for r in records(rule_index(rule_table(spark, SITE_RULES + [("pattern", "block", "*a*")]), rows))}
    assert index == {"com/": "com", "example.com/en/": "com", "www.example.com/en/": "www", "net/es/": "es", "net/fr/": "fr", "*a*": ""}
    tokens = {r["rule"]: r["tokens"] for r in records(compiled(rule_table(spark, [("pattern", "block", "||one.two*three^FOUR")])))}
    assert tokens == {"||one.two*three^FOUR": ["one"]}


def test_odd_tables(spark):
    schema = "page_id bigint, url string, row bigint, host string, token string, rule string, `a.b` string, action string, _best string"
    extra = (1, "h", "t", "r", "x", "y", "b")
    rows = [(1, URLS[0], *extra), (1, URLS[0], *extra), (1, URLS[8], *extra), (None, URLS[8], *extra), (2, None, *extra), (3, "http://" + "a/" * 100_000, *extra)]
    found = judge(spark.createDataFrame(rows, schema), rule_table(spark))
    got = sorted((repr(r["page_id"]), r["rule"] or "", r["verdict"]) for r in records(found))
    assert got == [("1", "example.com/en/", "block")] * 2 + [("1", "net/es/", "block"), ("2", "", "allow"), ("3", "", "allow"), ("None", "net/es/", "block")]
    assert judge(spark.createDataFrame([], schema), rule_table(spark)).count() == 0
    none = spark.createDataFrame([], "kind string, action string, rule string")
    assert {r["verdict"] for r in records(judge(spark.createDataFrame(rows, schema), none, otherwise="block"))} == {"block"}
    with pytest.raises(Exception, match="unknown kind or action"):
        judge(spark.createDataFrame(rows, schema), rule_table(spark, [("site", "maybe", "com/")])).collect()
