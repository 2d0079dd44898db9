"""A small set of captured answers with known results, for the readers' queries. Fixed values throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gossamer.functions.sqltext import values

_OK, _SSL = "<html><head><title> Sign in to PayPal\n</title>", "SSLError: handshake failure"

#: table: (Spark schema, DuckDB types, rows)
TABLES: dict[str, tuple[str, str, list[tuple]]] = {
    "hops": (
        "url string, next string, status int", "VARCHAR, VARCHAR, INTEGER",
        [("http://s.co/1", "https://pay-pal-login.xyz/a", 301), ("https://pay-pal-login.xyz/a", "https://pay-pal-login.xyz/b?c=1", 302), ("http://loop.com/", "http://loop.com/x", 301), ("http://loop.com/x", "http://loop.com/", 302),
         ("http://good.org", None, 200), ("https://pay-pal-login.xyz/b?c=1", None, 200)],
    ),
    "dns": (
        "domain string, outcome string, ips array<string>, ttl int", "VARCHAR, VARCHAR, VARCHAR[], INTEGER",
        [("pay-pal-login.xyz", "ok", ["185.220.101.47", "185.220.101.48"], 300), ("good.org", "ok", ["93.184.216.34"], 86400), ("old.net", "ok", ["10.0.0.9"], 0), ("gone.com", "NXDOMAIN", None, None), ("quiet.com", "NoAnswer", None, None),
         ("slow.com", "Timeout", None, None), ("odd.com", "broken packet", None, None), ("www.good.org", "ok", ["93.184.216.34"], 60), ("mail.good.org", "ok", ["93.184.216.35"], 60), ("login.pay-pal-login.xyz", "ok", ["185.220.101.47"], 60),
         ("admin.good.org", "NXDOMAIN", None, None)],
    ),
    "whois": (
        "domain string, registrar array<string>, creation_date string, error string", "VARCHAR, VARCHAR[], VARCHAR, VARCHAR",
        [("pay-pal-login.xyz", ["NameCheap", "Other"], "2024-12-20", None), ("good.org", ["Gandi"], "1999-01-01", None), ("old.net", None, None, "Timeout"), ("https://bad.com", ["X"], "2020-01-01", None)],
    ),
    "ct": (
        "domain string, name_value string, issuer string", "VARCHAR, VARCHAR, VARCHAR",
        [("pay-pal-login.xyz", "secure-pay.tk\n login.pay-pal-login.xyz \n*.pay-pal-login.xyz", "R3"), ("pay-pal-login.xyz", "secure-pay.tk\nbank-verify-now.top", "E1"), ("pay-pal-login.xyz", "not-pay-pal-login.xyz.evil.cc\n", "R3"), ("good.org", "good.org\nwww.good.org\n*.good.org", "DigiCert")],
    ),
    "spotter": (
        "domain string, dns_names array<string>, issuer string", "VARCHAR, VARCHAR[], VARCHAR",
        [("old.net", ["[old-shop.com](http://old-shop.com)", " old.net ", "www.old.net", "old-news.com"], "GoDaddy"), ("old.net", ["old-news.com"], "Sectigo"), ("good.org", ["other.org"], "X")],
    ),
    "tls": (
        "domain string, issuer map<string,string>, subject map<string,string>, not_before string, not_after string", "VARCHAR, MAP(VARCHAR, VARCHAR), MAP(VARCHAR, VARCHAR), VARCHAR, VARCHAR",
        [("pay-pal-login.xyz", {"CN": "pay-pal-login.xyz"}, {"CN": "pay-pal-login.xyz"}, "Dec  1 00:00:00 2024 GMT", "Mar  1 00:00:00 2025 GMT"), ("good.org", {"O": "DigiCert Inc", "CN": "G2"}, {"CN": "good.org"}, "Jan 15 08:30:00 2024 GMT", "Feb 14 23:59:59 2025 GMT")],
    ),
    "fetches": (
        "domain string, scheme string, status int, error string, headers map<string,string>, final_url string, html string", "VARCHAR, VARCHAR, INTEGER, VARCHAR, MAP(VARCHAR, VARCHAR), VARCHAR, VARCHAR",
        [("pay-pal-login.xyz", "https", None, _SSL, None, None, None),
         ("pay-pal-login.xyz", "http", 200, None, {"Server": "nginx", "X-Frame-Options": "DENY"}, "http://pay-pal-login.xyz/a/", _OK + '<META content=" log in to your Microsoft bank " NAME="Description"><link href="../i.png" rel="icon"><link rel="shortcut icon" href="/s.ico">'),
         ("good.org", "https", 200, None, {"server": "Apache", "STRICT-Transport-Security": "max-age=1", "Content-Security-Policy": "x"}, "https://good.org/", "<title></title><link rel='mask-icon' href='//cdn.org/m.svg'>"),
         ("slow.com", "https", None, "Timeout", None, None, None), ("slow.com", "http", 200, None, {"Server": "never asked"}, "http://slow.com/", ""), ("both.com", "https", None, "SSLError: x", None, None, None), ("both.com", "http", None, "RequestError: refused", None, None, None)],
    ),
    "resources": (
        "url string, status int, content string", "VARCHAR, INTEGER, VARCHAR",
        [("http://pay-pal-login.xyz/i.png", 200, "tiny"), ("http://pay-pal-login.xyz/s.ico", 200, "a shared icon of some bytes"), ("https://cdn.org/m.svg", 404, "not found at all here"), ("https://good.org/favicon.ico", 404, "no such file on this host"), ("https://old.net/favicon.ico", 200, "the icon of an old origin")],
    ),
    "jarm": (
        "domain string, jarm string, error string", "VARCHAR, VARCHAR, VARCHAR",
        [("pay-pal-login.xyz", "27d40d40d29d40d1dc42d43d00041d4689ee210389f4f6b4b5b1b93f92252d", None), ("good.org", "0" * 62, None), ("old.net", "", None), ("gone.com", None, "JarmScanError: timed out"), ("http://x.com", "1" * 62, None)],
    ),
    "rdap": (
        "ip string, body string", "VARCHAR, VARCHAR",
        [("185.220.101.47", '{"autnum":"44477","name":"STARK","country":"DE"}'), ("185.220.101.48", '{"handle":"as62212","entities":[{"roles":["abuse"],"name":"A"},{"roles":["registrant"],"name":"SmartApe"}],"country":"NL"}'), ("93.184.216.34", '{"handle":"NET-93","name":"EDGECAST","country":"US"}'), ("10.0.0.9", "no json")],
    ),
    "geo": (
        "ip string, body string", "VARCHAR, VARCHAR",
        [("185.220.101.47", '{"status":"success","country":"Germany","city":"Frankfurt","lat":50.1,"lon":8.7,"isp":"Stark"}'), ("185.220.101.48", '{"status":"success","country":"Netherlands","city":"Amsterdam","lat":52.4,"lon":4.9,"isp":"SA"}'), ("93.184.216.34", '{"status":"fail","message":"reserved range"}')],
    ),
    "shared": (
        "ip string, body string", "VARCHAR, VARCHAR",
        [("185.220.101.47", "pay-pal-login.xyz\n\nsecure-bank-now.top\nnice.com\nNot a domain\nlocalhost\n"), ("185.220.101.48", "API count exceeded - Increase Quota"), ("93.184.216.34", "error check your parameters " + "x" * 220), ("10.0.0.9", "\n".join(f"site{k}.com" for k in range(20)))],
    ),
    "seeds": ("graph_id string, url string, label int", "VARCHAR, VARCHAR, INTEGER", [("g1", "http://s.co/1", 1), ("g2", "http://good.org", 0), ("g3", "https://old.net", 0), ("g4", "https://gone.com", 0), ("g5", "http://loop.com/", None)]),
}

#: URLs and pages with known parts: (page_id, url, html). Ids are below those of the table ``pages``.
PAGES = [
    (-1, "https://user:pw@www.my-pay-pal.co.uk:8443/a/b?q=1#f", '<title>PayPal</title><meta name="description" content="Your bank">'),
    (-2, "http://192.168.0.1:80/login", "<TITLE>\n Microsoft\tOutlook </TITLE><link rel='icon' href='i.ico'><link href=\"/t.png\" rel=\"apple-touch-icon\">"),
    (-3, "http://256.1.1.1/x", '<meta content="no name here"><link rel="stylesheet" href="s.css">'),
    (-4, "bare-domain.xyz", None),
    (-5, "ftp://A.B.Example.TK/", '<title></title><meta CONTENT=" two\nlines " NAME="description">'),
    (-6, "https://secure-login-bank.top", "<title>" + "t" * 250 + '</title><link rel="ICON" href="//cdn.net/x.png">'),
    (-7, "https://localhost/", '<meta name="keywords" content="k"><meta name="description" content="' + "d" * 320 + '">'),
    (-8, "http://a.b.city.kawasaki.jp/p", "<title>Amazon &amp; DHL</title>"),
    (-9, "http://www.ck/", ""), (-10, "http://x.y.zz.ck/", "<title>ups"), (-11, "https://shop.com.sg/", "<title>Chase</title>"), (-12, "path/only", "<title>x</title>"),
]
PAGE = "page_id long, url string, html string"

#: Public suffix rules of the kinds there are: plain, wildcard, exception.
SUFFIX_RULES = ["com", "net", "org", "xyz", "tk", "top", "jp", "co.uk", "com.sg", "co.il", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck"]


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, _, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def sql(*names: str) -> str:
    """The tables as common table expressions for DuckDB."""
    out = []
    for name in names:
        schema, types, rows = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        kinds = types.replace("MAP(VARCHAR, VARCHAR)", "MAP").split(", ")
        cast = ", ".join(f"{c}::{k if k != 'MAP' else 'MAP(VARCHAR, VARCHAR)'} AS {c}" for c, k in zip(columns, kinds))
        out.append(f"{name} AS (SELECT {cast} FROM (VALUES {values(rows)}) t({', '.join(columns)}))")
    return ",\n".join(out)
