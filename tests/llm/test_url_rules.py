import itertools

from gossamer.llm import queries as Q
from gossamer.llm import url_rules as U

URLS = [
    None, "", "no scheme", "http://", "https://Example.com/en/a?x#y", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://example.com",
    "http://example.com/", "http://notexample.com/en/", "http://com/x", "http://a.b.net/es/1", "http://net/fr/", "http://net/frx", "http://x.org/en/", "a://b://c/d",
    "http://example.com/en#/", "http://m.example.com/en/?q=/fr/", "http://EXAMPLE.NET/es/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u, rules) for u in urls]


def test_contract_rules(spark):
    check(spark, URLS * 2, Q.URL_RULES)


def test_many_nested_rules(spark):
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ab.com", "a.org", "org"]
    rules = [(h, p, "block" if (i + j) % 2 else "allow") for i, h in enumerate(hosts) for j, p in enumerate(["/", "/x/", "/x/y"]) if (i * 3 + j) % 5]
    urls = [f"http://{s}{h}{p}" for s, h, p in itertools.product(["", "w.", "a-b."], [*hosts, "de", "a.com.de"], ["", "/", "/x/", "/x/y/z", "/xy"])]
    check(spark, urls, rules)


def test_no_rules_no_pages_and_clashes(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://a.b/c", 1), (None, "http://a.b/c", 1)], "page_id long, url string, verdict int")
    assert [(r.page_id, r.host, r.rule, r.verdict) for r in U.judge_urls(pages, none).collect()] == [(None, "a.b", None, "allow")] * 2
    assert U.judge_urls(pages.limit(0), spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")).count() == 0
