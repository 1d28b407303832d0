import random
import re

import pytest

from jobtide.llm.url_filter import PATTERN_RULES, Rule, filter_urls, site_rule

SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
RULES = [site_rule(*s) for s in SITES] + PATTERN_RULES


def parts(url):
    url = url or ""
    at = url.find("://")
    rest = "" if at < 0 else url[at + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path, rest[len(host):]


def brute(url):
    host, path, tail = parts(url)
    best = None
    for name, verdict in SITES:
        site, _, prefix = name.partition("/")
        fits = (host == site or host.endswith("." + site)) and path.startswith("/" + prefix)
        if fits and (best is None or len(name) > len(best[0])):
            best = name, verdict
    if best:
        return host, path, *best
    blocked = any(re.search(r.pattern, host + tail) for r in PATTERN_RULES)
    return host, path, None, "block" if blocked else "allow"


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/", "http://anet/",
        "http://example.net/en/", "http://x.example.net/en/1?a", "http://example.net/en", "http://example.net/de/",
        "https://example.com/de/x", "https://example.com/DE/x", "http://a.b.org/fr/", "http://org/fr/#x",
        "http://a.net:80/", "http://user@a.net/", "a://b://c.net/", "http://é.net/", "http://x.com?y=/net/",
        "http://x.com#/de/", "http://adserver.x.com/a", "http://x.com/ads/y.gif", "http://x.com/cgi-bin/z",
        "http://x.com/login", "http://x.com/login.php?x", "http://x.com/banner/a.png", "http://x.com/pixel.gif",
        "http://x.com/?date=2024-01-02", "http://sub.doubleclick.net.com/", "http://www.doubleclick.com/x",
        "http://K.net/", "x\n://a\nb.net/\n/", "http://" + "a" * 20_000 + ".net/" + "b" * 20_000]


@pytest.fixture(params=["10MB", "-1"])
def broadcast_limit(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_against_brute_force(spark, broadcast_limit):
    draw = random.Random(1)
    made = ["".join(draw.choice(["http", "://", "/", "?", "#", ".", "net", "example", "com", "org", "en", "fr", "de", "ads", "A"])
                    for _ in range(draw.randrange(2, 12))) for _ in range(300)]
    urls = URLS + made + ["http://a.net/"] * 3
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rows = filter_urls(table, RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url


def test_rules_without_tokens_and_ties(spark):
    table = spark.createDataFrame([(1, "http://a.b/c-d"), (2, "http://x.y/")], "page_id long, url string")
    rules = [Rule("dash", "block", "-", ()), Rule("abc", "allow", "/c", ("c",)), Rule("abd", "block", "/c", ("c",))]
    found = {r.page_id: (r.rule, r.verdict) for r in filter_urls(table, rules).collect()}
    assert found == {1: ("dash", "block"), 2: (None, "allow")}
    assert filter_urls(table.filter("false"), rules).count() == 0


def test_only_the_rarest_token_fetches_a_rule(spark):
    table = spark.createDataFrame([(i, f"http://common.com/{i}") for i in range(50)] + [(99, "http://common.com/rare/")],
                                  "page_id long, url string")
    rule = Rule("both", "block", "common.*rare", ("common", "rare"))
    judged = filter_urls(table, [rule])
    assert [r.page_id for r in judged.filter("verdict = 'block'").collect()] == [99]
    judged.collect()
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_that_clash_and_many_rules(spark, broadcast_limit):
    table = spark.createDataFrame([(i, f"http://h{i}.com/", "a", "b") for i in range(40)] + [(99, None, "a", "b")],
                                  "page_id long, url string, host string, other string")
    rules = [site_rule(f"h{i}.com/", "block") for i in range(0, 3000, 2)]
    rows = {r.page_id: r for r in filter_urls(table, rules).collect()}
    assert [rows[i].rule for i in range(40)] == [None if i % 2 else f"h{i}.com/" for i in range(40)]
    assert (rows[3].host, rows[3].other, rows[99].host, rows[99].verdict) == ("h3.com", "b", "", "allow")
    assert {r.verdict for r in filter_urls(table, []).collect()} == {"allow"}
