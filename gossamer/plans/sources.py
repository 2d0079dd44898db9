"""Queries of the readers, parsers and sinks over captured answers, with their DuckDB twins."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.functions import fixed as X
from gossamer.functions.sqltext import literal, values
from gossamer.operators import build as B
from gossamer.operators import graph as G
from gossamer.plans.registry import query, rounded
from gossamer.sources import captured, scratch, signals
from gossamer.sources.tables import campaign, read

AS_OF = "2025-01-15"
_as_of = lambda: F.lit(AS_OF).cast("date")

# ------------------------------------------------------------------------------------ feeds and lists


@query("S1_feed", "SELECT page_id AS phish_id, url FROM pages ORDER BY page_id LIMIT 100")
def _(spark, d):
    """The first lines of a dated feed that K5's sink wrote."""
    raw = read(spark, d, "pages").select(F.col("page_id").alias("phish_id"), "url").orderBy("phish_id").coalesce(1)
    path = signals.write_dated(raw, scratch.new_path(spark, "raw"), "phishtank", "2025-01-15")
    return signals.phishing_feed(spark, path, 100).select(F.col("phish_id").cast("long").alias("phish_id"), "url")


@query("S2_benign_list", "SELECT rank::INTEGER AS rank, domain, 0 AS label FROM (SELECT domain, row_number() OVER (ORDER BY domain) AS rank FROM (SELECT DISTINCT trim(p_type) AS domain FROM part)) WHERE rank <= 100")
def _(spark, d):
    """The first lines of a zipped list."""
    import io
    import zipfile

    import pyarrow as pa

    names = read(spark, d, "part").select(F.trim("p_type").alias("domain")).distinct().groupBy().agg(F.array_sort(F.collect_list("domain")).alias("names"))

    def pack(batches):
        for batch in batches:
            for row in batch.column(0).to_pylist():
                with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("top.csv", "".join(f"{k + 1}, {x} \n" for k, x in enumerate(row)))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])

    return signals.benign_rows(signals.unzipped(names.mapInArrow(pack, "content binary")), 100)


@query("K5_dated_csv", "SELECT p_brand AS domain, count(*) AS n, '2025-01-15' AS date FROM part GROUP BY 1")
def _(spark, d):
    path = scratch.new_path(spark, "benign")
    signals.write_dated(read(spark, d, "part").select(F.col("p_brand").alias("domain")), path, "benign", "2025-01-15")
    back = spark.read.option("header", True).schema("domain string").csv(f"{path}/benign_*")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"benign_(\d{4}-\d{2}-\d{2})/", 1)
    return back.groupBy("domain", name.alias("date")).agg(F.count("*").alias("n"))


@query("S22_results_scan", "SELECT 'row' AS kind, count(*) AS n, sum(doc_id)::BIGINT AS total FROM labels UNION ALL SELECT 'bad', count(*), NULL FROM labels WHERE toxic = 1")
def _(spark, d):
    """A results CSV in which some lines have too many fields: those are set aside and counted."""
    r = read(spark, d, "labels")
    lines = r.select(F.concat_ws(",", F.concat(F.lit("u"), "doc_id"), "doc_id").alias("value")).unionByName(r.where("toxic = 1").select(F.concat_ws(",", F.lit("broken"), "doc_id", F.lit("1"), F.lit("2")).alias("value")))
    path = scratch.new_path(spark, "results")
    spark.createDataFrame([("url,id",)], "value string").unionByName(lines).coalesce(1).write.text(path)
    good, bad = signals.scanned_results(spark, path, "url string, id long")
    n = lambda df, kind, total: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), total.cast("long").alias("total"))
    return n(good, "row", F.sum("id")).unionByName(n(bad, "bad", F.lit(None)))


@query("K1_graph_tables", "SELECT s_nationkey % 2 = 0 AS even, count(DISTINCT s_nationkey) AS graphs, count(DISTINCT s_nationkey) + count(*) AS nodes, count(*) AS edges FROM supplier GROUP BY 1")
def _(spark, d):
    from gossamer.sources.tables import stars

    n, e = stars(spark, d)
    even = (F.col("graph_id").cast("int") % 2 == 0).alias("even")
    path = scratch.new_path(spark, "corpus")
    signals.write_graphs(n.select("graph_id").distinct().withColumn("label", F.col("graph_id").cast("int") % 2), n, e, path)
    g, n, e = signals.read_graphs(spark, path)
    count = lambda df, name: df.groupBy(even).agg(F.count("*").alias(name))
    return count(g, "graphs").join(count(n, "nodes"), "even").join(count(e, "edges"), "even")


@query("K2_append_results", "SELECT version, count(*) AS n FROM (SELECT unnest(['v1', 'v1', 'v2']) AS version FROM labels) GROUP BY 1")
def _(spark, d):
    """Two appends of one schema, then one of another: K4 begins a new version and leaves the old as it is."""
    r, path = read(spark, d, "labels").select("doc_id", "quality"), scratch.new_path(spark, "appended")
    for rows in (r, r, r.withColumn("status", F.lit("ok"))):
        signals.append_results(rows, path)
    v = lambda k: spark.read.parquet(f"{path}/{k}").agg(F.lit(k).alias("version"), F.count("*").alias("n"))
    return v("v1").unionByName(v("v2"))


@query("S21_first_graphs", "SELECT DISTINCT s_nationkey::VARCHAR AS graph_id FROM supplier ORDER BY 1 LIMIT 5")
def _(spark, d):
    from gossamer.sources.tables import stars

    return signals.first_graphs(*stars(spark, d), 5)[0].select("graph_id").distinct()


# -------------------------------------------------------------------------------------------- answers

_HITS = "CASE WHEN outcome IN ('NXDOMAIN', 'NoAnswer', 'Timeout') THEN outcome WHEN outcome <> 'ok' THEN 'UnknownError: ' || outcome END"


@query("S5_dns_rows", f"WITH {captured.sql('dns')} SELECT domain, unnest(CASE WHEN outcome = 'ok' THEN ips ELSE [NULL] END) AS ip, CASE WHEN outcome = 'ok' THEN round(CASE WHEN coalesce(ttl, 0) = 0 THEN 0.5 ELSE least(ttl, 3600) / 3600 END, 6) END AS weight, {_HITS} AS error FROM dns")
def _(spark, d):
    a = signals.dns_answers(captured.frame(spark, "dns"))
    return a.select("domain", "error").join(signals.dns_rows(a), "domain", "left").select("domain", "ip", rounded("weight").alias("weight"), "error")


@query("S6_whois_rows", f"WITH {captured.sql('whois')} SELECT domain, registrar[1] AS registrar, date_diff('day', creation_date::DATE, DATE '{AS_OF}')::INTEGER AS age_days, round(least(date_diff('day', creation_date::DATE, DATE '{AS_OF}'), 3650) / 3650, 6) AS weight FROM whois WHERE registrar IS NOT NULL AND NOT contains(domain, '/')")
def _(spark, d):
    return signals.whois_rows(captured.frame(spark, "whois"), _as_of()).where("registrar IS NOT NULL").withColumn("weight", rounded("weight"))


_NAMES = "names AS (SELECT DISTINCT domain, trim(n) AS name, issuer FROM (SELECT domain, issuer, unnest(string_split(name_value, chr(10))) AS n FROM ct) WHERE trim(n) <> '')"
_RECORDS = "SELECT domain, coalesce(list_sort(list_distinct(list(name) FILTER (NOT contains(name, domain)))), []) AS shared_domains, min(issuer) AS issuer, count(DISTINCT name) FILTER (NOT contains(name, domain)) AS cert_count FROM names GROUP BY domain"
_LISTED = r"names AS (SELECT DISTINCT domain, trim(CASE WHEN regexp_matches(n, '^\[[^\]]*\]\(') THEN regexp_extract(n, '^\[([^\]]*)\]', 1) ELSE n END) AS name, issuer FROM (SELECT domain, issuer, unnest(dns_names) AS n FROM spotter))"


def _record(df):
    return df.select("domain", "shared_domains", "issuer", F.col("cert_count").cast("long").alias("cert_count"))


@query("S7_certificate_log", f"WITH {captured.sql('ct')}, {_NAMES} {_RECORDS}")
def _(spark, d):
    return _record(signals.cert_peers(captured.frame(spark, "ct")))


@query("S8_certificate_list", f"WITH {captured.sql('spotter')}, {_LISTED} {_RECORDS}")
def _(spark, d):
    return _record(signals.peer_records(signals.listed_names(captured.frame(spark, "spotter"))))


@query("S9_source_fallback", "WITH a AS (SELECT c_custkey AS k, c_name AS v, c_acctbal > 0 AS resolved FROM customer), b AS (SELECT c_custkey AS k, c_mktsegment AS v, c_acctbal > -500 AS resolved FROM customer WHERE c_nationkey < 20) SELECT a.k, CASE WHEN a.resolved OR NOT coalesce(b.resolved, false) THEN a.v ELSE b.v END AS v, a.resolved OR coalesce(b.resolved, false) AS resolved FROM a LEFT JOIN b USING (k)")
def _(spark, d):
    c = read(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), (F.col("c_acctbal") > 0).alias("resolved"))
    b = c.where("c_nationkey < 20").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), (F.col("c_acctbal") > -500).alias("resolved"))
    return signals.first_resolved("k", a, b)


_WHEN = lambda c: rf"strptime(regexp_replace({c}, '\s+', ' ', 'g'), '%b %d %H:%M:%S %Y GMT')::DATE"


@query(
    "S10_tls_facts",
    f"WITH {captured.sql('tls')}, t AS (SELECT *, {_WHEN('not_before')} AS a, {_WHEN('not_after')} AS b FROM tls) SELECT domain, coalesce(issuer['O'], issuer['CN']) AS issuer, strftime(a, '%Y-%m-%d') AS valid_from, strftime(b, '%Y-%m-%d') AS valid_until, date_diff('day', a, b)::INTEGER AS validity_days, date_diff('day', DATE '{AS_OF}', b)::INTEGER AS days_until_expiry, issuer = subject AS is_self_signed FROM t",
)
def _(spark, d):
    return signals.tls_facts(captured.frame(spark, "tls"), _as_of())


_TAG = lambda tag, name: rf"""regexp_extract({tag}, '(?is)\b{name}\s*=\s*["'']([^"'']*)["'']', 1)"""
TITLE = r"CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')[1:200] END"
_METAS = rf"list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: lower({_TAG('t', 'name')}) = 'description')"
DESCRIPTION = rf"CASE WHEN len({_METAS}) > 0 THEN regexp_replace({_TAG(_METAS + '[1]', 'content')}, '^\s+|\s+$', '', 'g')[1:300] END"
BRANDS = f"list_filter({literal(X.BRANDS)}, lambda b: contains(lower(coalesce({TITLE}, '') || ' ' || coalesce({DESCRIPTION}, '')), b))"
_HEADERS = "list_transform(map_keys(headers), lambda h: lower(h))"
_WANTED = literal(X.SECURITY_HEADERS)


@query(
    "S11_page_records",
    f"""WITH {captured.sql('fetches')}, f AS (SELECT s.domain, CASE WHEN starts_with(s.error, 'SSLError') AND h.domain IS NOT NULL THEN h ELSE s END AS f FROM (FROM fetches WHERE scheme = 'https') s LEFT JOIN (FROM fetches WHERE scheme = 'http') h USING (domain)),
p AS (SELECT domain, f.scheme AS scheme, f.status AS status, f.error AS error, f.headers AS headers, f.html AS html FROM f)
SELECT domain, scheme, status, error, error IS NULL AS resolved, {TITLE} AS page_title, {DESCRIPTION} AS meta_description, {BRANDS} AS brands,
  map_values(map_from_entries(list_filter(map_entries(headers), lambda e: lower(e.key) = 'server')))[1] AS server_header,
  CASE WHEN headers IS NOT NULL THEN list_filter({_WANTED}, lambda w: list_contains({_HEADERS}, w)) END AS headers_present,
  CASE WHEN headers IS NOT NULL THEN list_filter({_WANTED}, lambda w: NOT list_contains({_HEADERS}, w)) END AS headers_missing FROM p""",
)
def _(spark, d):
    return signals.page_records(captured.frame(spark, "fetches")).drop("final_url", "html")


@query("X9_server_header", f"WITH {captured.sql('fetches')} SELECT domain, scheme, map_values(map_from_entries(list_filter(map_entries(headers), lambda e: lower(e.key) = 'server')))[1] AS server FROM fetches")
def _(spark, d):
    return captured.frame(spark, "fetches").select("domain", "scheme", C.server(F.col("headers")).alias("server"))


@query("X8_security_headers", f"WITH {captured.sql('fetches')} SELECT domain, list_filter({_WANTED}, lambda w: list_contains({_HEADERS}, w)) AS present, list_filter({_WANTED}, lambda w: NOT list_contains({_HEADERS}, w)) AS missing FROM fetches WHERE headers IS NOT NULL")
def _(spark, d):
    h = F.col("headers")
    return captured.frame(spark, "fetches").where("headers IS NOT NULL").select("domain", C.security_headers(h).alias("present"), C.security_headers(h, False).alias("missing"))


@query(
    "S12_jarm",
    f"WITH {captured.sql('jarm')}, j AS (SELECT domain, jarm, CASE WHEN contains(domain, '/') THEN 'InvalidInput: pass a bare domain, not a full URL' ELSE error END AS error FROM jarm) SELECT domain, CASE WHEN error IS NULL THEN jarm END AS jarm, CASE WHEN error IS NULL THEN jarm IN ('', repeat('0', 62)) END AS is_null_jarm, CASE WHEN error IS NULL AND jarm NOT IN ('', repeat('0', 62)) THEN 'jarm:' || jarm END AS node, error IS NULL AS resolved, error FROM j",
)
def _(spark, d):
    return signals.jarm_facts(captured.frame(spark, "jarm"))


_J = lambda path: f"json_extract_string(j, '{path}')"
_AS = f"coalesce({_J('$.autnum')}, {_J('$.handle')})"
_WHO = "list_filter(CAST(json_extract(j, '$.entities') AS STRUCT(roles VARCHAR[], name VARCHAR)[]), lambda e: list_contains(e.roles, 'registrant'))[1].name"


@query("S13_rdap", f"WITH {captured.sql('rdap')}, r AS (SELECT ip, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM rdap) SELECT ip, {_AS} AS asn, coalesce({_J('$.name')}, {_WHO}) AS as_name, {_J('$.country')} AS country FROM r")
def _(spark, d):
    return signals.rdap_facts(captured.frame(spark, "rdap"))


@query("S14_geo", f"WITH {captured.sql('geo')}, r AS (SELECT ip, body::JSON AS j, {_J('$.status')} = 'fail' AS bad FROM (SELECT ip, body, body::JSON AS j FROM geo)) SELECT ip, {_J('$.country')} AS country, {_J('$.city')} AS city, {_J('$.lat')}::DOUBLE AS lat, {_J('$.lon')}::DOUBLE AS lon, {_J('$.isp')} AS isp, NOT bad AS resolved, CASE WHEN bad THEN {_J('$.message')} END AS error FROM r")
def _(spark, d):
    return signals.geo_facts(captured.frame(spark, "geo"))


_LINES = "list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_SHARED = f"shared2 AS (SELECT ip, body, {_LINES} AS lines, contains(lower(body), 'error') OR contains(body, 'API count exceeded') OR len({_LINES}) > {X.SHARED_LINES} AS bad FROM shared)"
_REAL = lambda c: rf"{c} <> '' AND NOT contains({c}, ' ') AND contains({c}, '.') AND length({c}) <= 100 AND NOT regexp_matches({c}, '^\p{{Lu}}\p{{Ll}}')"


@query("S15_shared_hosts", f"WITH {captured.sql('shared')}, {_SHARED} SELECT ip, NOT bad AS resolved, CASE WHEN NOT bad THEN len(lines)::INTEGER END AS count, CASE WHEN NOT bad THEN lines END AS co_hosted_domains FROM shared2")
def _(spark, d):
    return signals.shared_hosts(captured.frame(spark, "shared")).drop("error")


@query("W5_co_hosts", f"WITH {captured.sql('shared')}, {_SHARED} SELECT ip, co_host FROM (SELECT ip, unnest(lines[1:{X.CO_HOSTS}]) AS co_host FROM shared2 WHERE NOT bad) WHERE {_REAL('co_host')}")
def _(spark, d):
    return signals.co_hosts(signals.shared_hosts(captured.frame(spark, "shared")))


@query("X12_short_error", f"WITH {captured.sql('shared')} SELECT ip, CASE WHEN length(body) > 200 THEN body[1:200] || '...' ELSE body END AS error FROM shared")
def _(spark, d):
    return captured.frame(spark, "shared").select("ip", C.short_error(F.col("body")).alias("error"))


_WALKED = f"walked AS (SELECT DISTINCT url, url AS spot, [url] AS chain, 0 AS k FROM hops UNION ALL SELECT w.url, h.next, list_append(w.chain, h.next), k + 1 FROM walked w JOIN hops h ON h.url = w.spot AND h.next IS NOT NULL WHERE k < {X.HOPS}), ends AS (SELECT w.*, h.url IS NULL AS resolved FROM (SELECT url, arg_max(spot, k) AS spot, arg_max(chain, k) AS chain FROM walked GROUP BY url) w LEFT JOIN (FROM hops WHERE next IS NOT NULL) h ON h.url = w.spot)"


@query("S16_redirects", f"WITH RECURSIVE {captured.sql('hops')}, {_WALKED} SELECT url, CASE WHEN resolved THEN spot END AS final_url, chain, (len(chain) - 1)::INTEGER AS hop_count, resolved, CASE WHEN NOT resolved THEN 'TooManyRedirects' END AS error FROM ends")
def _(spark, d):
    return signals.redirect_ends(captured.frame(spark, "hops"))


_CT_SUBS = "ct_subs AS (SELECT domain, list_sort(list(DISTINCT name) FILTER (ends_with(name, '.' || domain) AND NOT starts_with(name, '*'))) AS subs FROM names GROUP BY domain)"
_DNS_SUBS = f"dns_subs AS (SELECT d.domain, list_sort(list(DISTINCT w || '.' || d.domain)) AS subs FROM (SELECT DISTINCT domain FROM dns) d, (SELECT unnest({literal(X.SUBDOMAIN_WORDS)}) AS w) JOIN dns r ON r.domain = w || '.' || d.domain AND r.outcome = 'ok' GROUP BY d.domain)"


@query("S17_logged_subdomains", f"WITH {captured.sql('ct')}, {_NAMES}, {_CT_SUBS} SELECT domain, coalesce(subs, []) AS subdomains FROM ct_subs")
def _(spark, d):
    return signals.subdomains_of(captured.frame(spark, "ct"))


@query("S18_guessed_subdomains", f"WITH {captured.sql('dns')}, {_DNS_SUBS} SELECT domain, subs AS subdomains FROM dns_subs")
def _(spark, d):
    dns = signals.dns_answers(captured.frame(spark, "dns"))
    return signals.guessed_subdomains(dns.select("domain").distinct(), dns)


@query("S19_subdomains", f"WITH {captured.sql('ct', 'dns')}, {_NAMES}, {_CT_SUBS}, {_DNS_SUBS}, m AS (SELECT DISTINCT dns.domain, coalesce(c.subs, []) AS via_ct, coalesce(g.subs, []) AS via_dns FROM dns LEFT JOIN ct_subs c USING (domain) LEFT JOIN dns_subs g USING (domain)) SELECT domain, list_sort(list_distinct(list_concat(via_ct, via_dns))) AS subdomains, len(list_distinct(list_concat(via_ct, via_dns)))::INTEGER AS count, via_ct, via_dns, true AS resolved FROM m")
def _(spark, d):
    dns = signals.dns_answers(captured.frame(spark, "dns"))
    domains = dns.select("domain").distinct()
    return signals.merged_subdomains(domains, signals.subdomains_of(captured.frame(spark, "ct")), signals.guessed_subdomains(domains, dns))


_ICON_PAGES = [("http://pay-pal-login.xyz/a/", "http://s.co/1"), ("https://good.org/", "https://old.net/x"), ("https://none.com/", "https://none.com/")]


@query(
    "X4_icons",
    "SELECT * FROM (VALUES ('http://pay-pal-login.xyz/a/', 'http://pay-pal-login.xyz/s.ico', md5('a shared icon of some bytes'), 'link'), ('https://good.org/', 'https://old.net/favicon.ico', md5('the icon of an old origin'), 'origin'), ('https://none.com/', NULL, NULL, 'none')) t(url, icon_url, icon_hash, strategy)",
)
def _(spark, d):
    pages = spark.createDataFrame(_ICON_PAGES, "url string, origin string")
    html = captured.frame(spark, "fetches").select(F.col("final_url").alias("url"), "html")
    return signals.icons(pages.join(html, "url", "left"), captured.frame(spark, "resources"))


_JOINS = [(b, h) for b in ("http://a.com/x/y.html?q=1", "https://a.com", "http://a.com/d/") for h in ("i.ico", "/i.ico", "//b.net/i.ico", "https://c.org/i", "p/i.ico")]


@query("X6_urljoin", f"SELECT * FROM (VALUES {values([(b, h, urljoin(b, h)) for b, h in _JOINS])}) t(base, href, url)")
def _(spark, d):
    return spark.createDataFrame(_JOINS, "base string, href string").withColumn("url", C.absolute(F.col("base"), F.col("href")))


@query("X5_md5", "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


@query("X11_joined_lists", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS joined, '{' || string_agg('\"' || p || '\":' || n, ',' ORDER BY p) || '}' AS counts FROM (SELECT o_custkey, o_orderpriority, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def _(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    row = n.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("p"), "n"))).alias("c"))
    return row.select("o_custkey", C.joined(F.transform("c", lambda x: x["p"])).alias("joined"), F.to_json(F.map_from_entries("c")).alias("counts"))


@query("X10_weights", f"WITH {captured.sql('dns', 'whois')} SELECT d.domain, round(CASE WHEN coalesce(ttl, 0) = 0 THEN 0.5 ELSE least(ttl, 3600) / 3600 END, 6) AS ttl, round(least(coalesce(date_diff('day', creation_date::DATE, DATE '{AS_OF}'), 0), 3650) / 3650, 6) AS age FROM dns d LEFT JOIN whois w USING (domain)")
def _(spark, d):
    age = F.datediff(_as_of(), F.to_date("creation_date"))
    j = captured.frame(spark, "dns").join(captured.frame(spark, "whois"), "domain", "left")
    return j.select("domain", rounded(C.ttl_weight(F.col("ttl"))).alias("ttl"), rounded(C.age_weight(age)).alias("age"))


@query("A14_excluded_rows", "SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS n_excluded, count(*) AS n FROM labels")
def _(spark, d):
    return signals.excluded(read(spark, d, "labels").select(F.col("quality").alias("label"), F.when(F.col("toxic") == 1, "dns:NXDOMAIN|x").otherwise("ssl:Timeout").alias("modules_failed")))


# ------------------------------------------------------------------------------------- hosts and names

_IPS = [(x,) for x in ("1.2.3.4", "1.2.3.4:80", "256.1.1.1", "1.2.3", "01.2.3.4", "a.b.c.d", "1.2.3.4.5", "", "255.255.255.255", "1.2.3.-4")]
_FOUR = r"^(0*(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])\.){3}0*(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])$"


@query("F3_plain_ip", f"SELECT h, regexp_matches(h, '{_FOUR}') AS plain, regexp_matches(regexp_replace(h, ':\\d+$', ''), '{_FOUR}') AS without_port FROM (VALUES {values(_IPS)}) t(h)")
def _(spark, d):
    return spark.createDataFrame(_IPS, "h string").select("h", C.is_ip(F.col("h"), port=False).alias("plain"), C.is_ip(F.col("h")).alias("without_port"))


PAGES_SQL = f"pg AS (SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM (VALUES {values(captured.PAGES)}) t(page_id, url, html))"


def pages(spark, d):
    """The pages, and some with known tags, suffixes and hyphens."""
    return read(spark, d, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(captured.PAGES, captured.PAGE))


HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


@query(
    "F1_public_suffix",
    rf"""WITH {PAGES_SQL}, rules AS (SELECT unnest({literal(captured.SUFFIX_RULES)}) AS rule), r AS (SELECT string_split(replace(rule, '!', ''), '.') AS labels, starts_with(rule, '!') AS x FROM rules),
h AS (SELECT page_id, {HOST} AS host FROM pg), l AS (SELECT page_id, host, regexp_matches(host, '{_FOUR}') AS ip, string_split(host, '.') AS labels FROM h),
fit AS (SELECT l.page_id, r.x, len(r.labels) - r.x::INT AS n FROM l JOIN r ON len(r.labels) <= len(l.labels) AND NOT l.ip AND list_reduce(list_transform(list_zip(l.labels[-len(r.labels):], r.labels), lambda z: z[1] = z[2] OR z[2] = '*'), lambda a, b: a AND b)),
best AS (SELECT page_id, coalesce(max(n) FILTER (x), max(n)) AS n FROM fit GROUP BY page_id)
SELECT page_id, CASE WHEN ip OR host = '' THEN '' WHEN n IS NOT NULL THEN array_to_string(labels[-n:], '.') WHEN len(labels) > 1 THEN labels[-1] ELSE '' END AS public_suffix FROM l LEFT JOIN best USING (page_id)""",
)
def _(spark, d):
    rules = spark.createDataFrame([(r,) for r in captured.SUFFIX_RULES], "rule string")
    return signals.with_public_suffix(pages(spark, d), rules).select("page_id", "public_suffix")


# ------------------------------------------------------------------------------ graphs from the answers

_ENDS = f"t AS (SELECT s.graph_id, s.label, CASE WHEN e.resolved THEN e.spot ELSE s.url END AS url, coalesce(e.resolved, false) AS ok, CASE WHEN e.url IS NULL THEN 'not captured' WHEN NOT e.resolved THEN 'TooManyRedirects' END AS error, regexp_extract({{host}}, '([^.]+\\.[^.]+)$', 1) AS domain FROM seeds s LEFT JOIN ends e USING (url))".replace("{host}", HOST.replace("url", "CASE WHEN e.resolved THEN e.spot ELSE s.url END"))
_BASE = f"{captured.sql('seeds', 'hops', 'dns', 'whois', 'ct', 'spotter', 'tls', 'fetches', 'jarm', 'rdap', 'geo', 'shared')}, {_WALKED}, {_ENDS}"
_IP = "ips AS (SELECT DISTINCT t.graph_id, unnest(ips) AS ip FROM t JOIN dns USING (domain) WHERE outcome = 'ok')"
_LOG = f"""log AS (
SELECT graph_id, 1 AS k, 'redirect_chain' AS m, ok, error FROM t
UNION ALL SELECT graph_id, 2, 'dns', coalesce(outcome = 'ok', false), CASE WHEN outcome IS NULL THEN 'not captured' ELSE {_HITS} END FROM t LEFT JOIN dns USING (domain)
UNION ALL SELECT graph_id, 3, 'whois', coalesce(registrar[1] IS NOT NULL, false), CASE WHEN w.domain IS NULL THEN 'not captured' ELSE w.error END FROM t LEFT JOIN whois w USING (domain)
UNION ALL SELECT graph_id, 4, 'cert', domain IN (SELECT domain FROM ct UNION SELECT domain FROM spotter), 'not captured' FROM t
UNION ALL SELECT graph_id, 5, 'ssl', domain IN (SELECT domain FROM tls), 'not captured' FROM t
UNION ALL SELECT graph_id, 6, 'page_meta', f.domain IS NOT NULL AND f.error IS NULL, CASE WHEN f.domain IS NULL THEN 'not captured' ELSE f.error END FROM t LEFT JOIN (SELECT s.domain, CASE WHEN starts_with(s.error, 'SSLError') AND h.domain IS NOT NULL THEN h.error ELSE s.error END AS error FROM (FROM fetches WHERE scheme = 'https') s LEFT JOIN (FROM fetches WHERE scheme = 'http') h USING (domain)) f USING (domain)
UNION ALL SELECT graph_id, 7, 'subdomains', domain IN (SELECT domain FROM dns UNION SELECT domain FROM ct UNION SELECT domain FROM spotter), 'not captured' FROM t
UNION ALL SELECT graph_id, 8, 'jarm', j.domain IS NOT NULL AND j.error IS NULL AND jarm NOT IN ('', repeat('0', 62)), CASE WHEN j.domain IS NULL THEN 'not captured' ELSE coalesce(j.error, 'null_jarm') END FROM t LEFT JOIN jarm j USING (domain)
UNION ALL SELECT graph_id, 9, 'asn', coalesce(json_valid(body) AND coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.autnum'), json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.handle')) IS NOT NULL, false), CASE WHEN body IS NULL THEN 'not captured' END FROM ips LEFT JOIN rdap USING (ip)
UNION ALL SELECT graph_id, 10, 'geo', coalesce(json_extract_string(body, '$.status') = 'success', false), CASE WHEN body IS NULL THEN 'not captured' ELSE json_extract_string(body, '$.message') END FROM ips LEFT JOIN geo USING (ip)
UNION ALL SELECT graph_id, 11, 'shared', coalesce(NOT (contains(lower(body), 'error') OR contains(body, 'API count exceeded')), false), CASE WHEN body IS NULL THEN 'not captured' WHEN length(body) > 200 THEN body[1:200] || '...' ELSE body END FROM ips LEFT JOIN shared USING (ip))"""


def _built(spark):
    a = B.answers({k: captured.frame(spark, k) for k in captured.TABLES if k != "seeds"}, _as_of())
    return B.build_graphs(captured.frame(spark, "seeds"), a, _as_of())


@query(
    "G1_module_log",
    f"WITH RECURSIVE {_BASE}, {_IP}, {_LOG} SELECT graph_id, coalesce(list_transform(list_sort(list_distinct(list({{'k': k, 't': m}}) FILTER (ok))), lambda x: x.t), []) AS modules_succeeded, coalesce(list_transform(list_sort(list_distinct(list({{'k': k, 't': m || ':' || coalesce(error, 'None')}}) FILTER (NOT ok))), lambda x: x.t), []) AS modules_failed FROM log GROUP BY graph_id",
)
def _(spark, d):
    return _built(spark)[0].select("graph_id", "modules_succeeded", "modules_failed")


@query(
    "G1_built_graphs",
    """SELECT * FROM (VALUES ('g1', 'pay-pal-login.xyz', 'https://pay-pal-login.xyz/b?c=1', 2, 1, 15, 14, true), ('g2', 'good.org', 'http://good.org', 0, 0, 6, 5, false), ('g3', 'old.net', 'https://old.net', 0, 0, 19, 18, NULL),
('g4', 'gone.com', 'https://gone.com', 0, 0, 1, 0, NULL), ('g5', 'loop.com', 'http://loop.com/', 8, NULL, 1, 0, NULL)) t(graph_id, domain, url, redirect_hop_count, label, node_count, edge_count, is_self_signed)""",
)
def _(spark, d):
    g = _built(spark)[0]
    return g.select("graph_id", "domain", "url", "redirect_hop_count", "label", F.col("node_count").cast("int").alias("node_count"), F.col("edge_count").cast("int").alias("edge_count"), "is_self_signed")


@query("K2_result_rows", f"WITH RECURSIVE {_BASE}, {_IP}, {_LOG} SELECT t.domain, '{{}}' AS truncated_counts, string_agg(DISTINCT m, '|' ORDER BY m) FILTER (log.ok) AS ok FROM log JOIN t USING (graph_id) GROUP BY t.domain")
def _(spark, d):
    r = B.batch_results(_built(spark)[0])
    return r.select("domain", "truncated_counts", F.when(F.col("modules_succeeded") != "", F.array_join(F.array_sort(F.split("modules_succeeded", r"\|")), "|")).alias("ok"))


@query("F16_findings", "SELECT * FROM (VALUES ('g1', 1, '44477|STARK', '⚠ Hosted by a provider flagged as: bulletproof'), ('g1', 2, 'as62212|SmartApe', '⚠ Hosted by a provider flagged as: threat actor linked'), ('g1', 3, 'pay-pal-login.xyz', '⚠ Page claims to be \"Paypal\" but the address doesn''t match')) t(graph_id, rank, node, text)")
def _(spark, d):
    graphs, nodes, _ = _built(spark)
    return B.findings(graphs, nodes)


@query("F10_expandable_leaves", "SELECT * FROM (VALUES ('g1', 'bank-verify-now.top'), ('g1', 'secure-pay.tk'), ('g1', 'secure-bank-now.top'), ('g3', 'old-shop.com')) t(graph_id, leaf)")
def _(spark, d):
    """Peers of the certificate all, co-hosts only if suspicious; one has been expanded before."""
    done = spark.createDataFrame([("g3", "old-news.com"), ("g1", "not-pay-pal-login.xyz.evil.cc")], "graph_id string, leaf string")
    return G.expandable_leaves(_built(spark)[1], done).select("graph_id", "leaf")


_EXPANDED = f"""size1 AS (SELECT n_regionkey AS r, count(*) + 1 AS base FROM nation GROUP BY 1),
l1 AS (SELECT n_regionkey AS r, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation),
c1 AS (SELECT l1.*, base + coalesce(sum(k) OVER (PARTITION BY l1.r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l1 JOIN size1 USING (r) WHERE pos <= 5),
e1 AS (SELECT * FROM c1 WHERE before < {X.CAMPAIGN_NODES}),
after1 AS (SELECT r, max(base) + sum(k) AS n FROM e1 JOIN size1 USING (r) GROUP BY r),
l2 AS (SELECT e1.r, s_suppkey AS s, row_number() OVER (PARTITION BY e1.r ORDER BY e1.pos, s_suppkey) AS pos FROM e1 JOIN supplier ON s_nationkey = e1.n),
e2 AS (SELECT l2.* FROM l2 JOIN after1 USING (r) WHERE pos <= 5 AND after1.n < {X.CAMPAIGN_NODES})"""


def _campaigns(spark, d):
    """Regions as seeds; a region's graph has its nations as peers, a nation's its suppliers, a supplier's its nation."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    name = lambda prefix, c: F.concat(F.lit(prefix), c)
    pair = lambda df, a, b: df.select(a.alias("graph_id"), b.alias("node"), F.lit("cert_peer").alias("type"))
    peers = pair(n, name("R", "n_regionkey"), name("N", F.lpad(F.col("n_nationkey").cast("string"), 4, "0")))
    peers = peers.unionByName(pair(s, name("N", F.lpad(F.col("s_nationkey").cast("string"), 4, "0")), name("S", F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))))
    peers = peers.unionByName(pair(s, name("S", F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), name("N", F.lpad(F.col("s_nationkey").cast("string"), 4, "0"))))
    own = peers.select("graph_id", F.col("graph_id").alias("node"), F.lit("domain").alias("type")).distinct()
    egos = own.unionByName(peers)
    from pyspark.sql import Window

    egos = egos.withColumn("node_idx", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("type") != "domain", "node")) - 1)
    seeds = read(spark, d, "region").select(name("R", "r_regionkey").alias("seed"))
    return G.expanded(seeds, egos)


@query("G2_expansion", f"WITH {_EXPANDED} SELECT 'R' || r_regionkey AS seed, 'R' || r_regionkey AS domain FROM region UNION ALL SELECT 'R' || r, 'N' || lpad(n::VARCHAR, 4, '0') FROM e1 UNION ALL SELECT 'R' || r, 'S' || lpad(s::VARCHAR, 9, '0') FROM e2")
def _(spark, d):
    return _campaigns(spark, d)[0]


@query("G3_expansion_log", f"WITH {_EXPANDED} SELECT 'R' || r AS seed, 1 AS depth, 'N' || lpad(n::VARCHAR, 4, '0') AS domain, CASE WHEN k > 0 THEN 'expanded' ELSE 'empty' END AS status, CASE WHEN k > 0 THEN k + 1 END AS nodes_added FROM e1 UNION ALL SELECT 'R' || r, 2, 'S' || lpad(s::VARCHAR, 9, '0'), 'expanded', 2 FROM e2")
def _(spark, d):
    return _campaigns(spark, d)[1].select("seed", "depth", "domain", "status", "nodes_added")


_LEFT, _RIGHT = "('resolves-to', 'registered-by')", "('hosted-in', 'located-in')"


def composed_parts(spark, d):
    """Two graphs a campaign: domains with servers and registrars, and servers (as co-hosts) with hosts and places."""
    n, e = campaign(spark, d)
    part = lambda rel: e.where(F.col("relation").isin(*rel))
    ends = lambda x: x.select("graph_id", F.col("src").alias("node")).unionByName(x.select("graph_id", F.col("dst").alias("node"))).distinct()
    left, right = part(("resolves-to", "registered-by")), part(("hosted-in", "located-in"))
    ln, rn = n.join(ends(left), ["graph_id", "node"], "left_semi"), n.join(ends(right), ["graph_id", "node"], "left_semi")
    return (ln, left), (rn.withColumn("type", F.when(F.col("type") == "ip", "co_host").otherwise(F.col("type"))), right)
