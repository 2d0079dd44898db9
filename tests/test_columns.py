import pytest
from pyspark.sql import functions as F

from gossamer.functions import columns as C


def values(spark, rows, **made):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return df.select(*(c.alias(n) for n, c in made.items())).collect()


def test_urls(spark):
    want = {
        "https://secure-bank-login.xyz/verify?id=123": ("", "secure-bank-login", "xyz", "secure-bank-login.xyz", False),
        "http://185.220.101.47/login": ("", "185.220.101.47", "", "", True),
        "https://www.google.com/search?q=test": ("www", "google", "com", "google.com", False),
        "http://paypal-secure.update.co.uk/account": ("paypal-secure", "update", "co.uk", "update.co.uk", False),
        "https://login.microsoftonline.com.phish.cc/": ("login.microsoftonline.com", "phish", "cc", "phish.cc", False),
        "http://u:p@10.0.0.1:8080/x": ("", "10.0.0.1", "", "", True),
    }
    got = values(spark, list(want), **C.url_parts(F.col("x")))
    assert [(r.subdomain, r.domain, r.suffix, r.full_domain, r.is_ip) for r in got] == list(want.values())
    assert (got[0].scheme, got[0].path, got[0].query) == ("https", "/verify", "id=123")


@pytest.mark.parametrize("host,ip", [("1.2.3.4", True), ("1.2.3.256", False), ("1.2.3", False), ("a.2.3.4", False), ("255.255.255.255:80", True)])
def test_addresses(spark, host, ip):
    assert values(spark, [host], a=C.is_ip(F.col("x")))[0].a is ip


def test_predicates(spark):
    names = ["evil.com", "Evil.com", "EVIL.com", "a b.com", "localhost", "x" * 97 + ".com", None]
    assert [r.a for r in values(spark, names, a=C.looks_real(F.col("x")))] == [True, False, True, False, False, False, False]
    s = C.signals(F.col("x"), F.substring_index("x", ".", -1), F.lit(89))
    assert values(spark, ["a-b-c.xyz"], a=s)[0].a == ["suspicious_tld:xyz", "hyphen_heavy:2_hyphens", "new_domain:89_days_old"]
    assert values(spark, ["a-b.com"], a=C.signals(F.lit("a-b"), F.lit("com"), F.lit(90)))[0].a == []


def test_pages(spark):
    html = '<TITLE a="b">\n Pay\xa0Pal </TITLE><meta content=" hello " name="Description"><link href="/m.svg" rel="mask-icon"><link type="image/png" href="i.png" rel="icon"><link rel="other" href="x">'
    r = values(spark, [html], t=C.title(F.col("x")), d=C.meta_description(F.col("x")), i=C.icon_candidates(F.lit("https://x.com/a/"), F.col("x")))[0]
    assert r.t.startswith("Pay") and r.d == "hello"
    assert [(s.url, s.relation) for s in r.i] == [("https://x.com/a/i.png", "icon"), ("https://x.com/m.svg", "mask-icon")]
    assert values(spark, ["no"], t=C.title(F.col("x")), d=C.meta_description(F.col("x")))[0] == (None, None)
    assert values(spark, ["My PayPal bank"], b=C.mismatched(C.brands(F.col("x")), F.lit("mybank.com")))[0].b == ["paypal"]


@pytest.mark.parametrize("href,want", [("//c.d/e", "https://c.d/e"), ("/r", "https://x.com/r"), ("z", "https://x.com/a/z"), ("http://q", "http://q")])
def test_absolute(spark, href, want):
    assert values(spark, [href], a=C.absolute(F.lit("https://x.com/a/b"), F.col("x")))[0].a == want


def test_weights_and_distances(spark):
    df = spark.range(1)
    ttl = df.select(*(C.ttl_weight(F.lit(t).cast("int")) for t in (300, 3600, 7200, 0, None))).first()
    assert [round(x, 6) for x in ttl] == [0.083333, 1, 1, 0.5, 0.5]
    assert list(df.select(*(C.age_weight(F.lit(t).cast("int")) for t in (365, 3650, None))).first()) == [0.1, 1, 0]
    v = lambda *x: F.array(*map(F.lit, x))
    assert list(df.select(C.distance(v(1.0, 0.0), v(0.0, 2.0)), C.distance(v(0.0, 0.0), v(1.0, 1.0)), C.distance(v(0.0, 3.0), v(4.0, 0.0), "euclidean")).first()) == [1.0, 1.0, 5.0]
    h = df.select(C.security_headers(F.create_map(F.lit("X-Frame-Options"), F.lit("1"))), C.file_name(F.lit("a.b/c")), C.short_error(F.lit("e" * 201))).first()
    assert h[0] == ["x-frame-options"] and h[1] == "a_b_c" and len(h[2]) == 203
