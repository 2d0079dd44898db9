"""Registered queries of the graph engine over the star schema's tables, with their DuckDB twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.functions import fixed as X
from gossamer.operators import blocks as B
from gossamer.operators import graph as G
from gossamer.operators import links as L
from gossamer.operators import spectral as S
from gossamer.plans import sources as P
from gossamer.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from gossamer.plans.registry import rounded as _r
from gossamer.plans.sources import BRANDS as _BRANDS_IN_TEXT
from gossamer.plans.sources import DESCRIPTION as _DESCRIPTION
from gossamer.plans.sources import TITLE as _TITLE
from gossamer.plans.sources import pages
from gossamer.sources import fixtures, signals
from gossamer.sources.tables import campaign, mixed_stars, read, stars

# ------------------------------------------------------------------------------------------ SQL parts

CAMPAIGN = """
met AS (SELECT c_nationkey || '-' || c_mktsegment || '-' || strftime(o_orderdate, '%Y%m') AS graph_id, 'c' || c_custkey AS domain, l_suppkey, max(l_quantity) AS q
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
dns AS (SELECT graph_id, domain, 's' || l_suppkey AS ip, l_suppkey, least(q * 72, 3600) / 3600 AS weight FROM met),
ips AS (SELECT DISTINCT graph_id, ip, s_nationkey, n_regionkey FROM dns JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey),
raw AS (SELECT graph_id, domain AS src, ip AS dst, 'resolves-to' AS relation, weight, 0 AS step FROM dns
        UNION ALL SELECT DISTINCT graph_id, domain, 'm' || split_part(graph_id, '-', 2), 'registered-by', 1.0, 1 FROM dns
        UNION ALL SELECT * FROM (SELECT graph_id, domain, lead(domain) OVER (PARTITION BY graph_id ORDER BY domain) AS peer, 'shares-cert', 1.0, 2 FROM (SELECT DISTINCT graph_id, domain FROM dns)) WHERE peer IS NOT NULL
        UNION ALL SELECT graph_id, ip, 'AS' || s_nationkey, 'hosted-in', 1.0, 3 FROM ips
        UNION ALL SELECT graph_id, ip, 'R' || n_regionkey, 'located-in', 1.0, 4 FROM ips),
edges AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id ORDER BY step, src, dst) - 1 AS edge_idx, relation, weight FROM raw),
kinds AS (SELECT DISTINCT graph_id, src AS node, CASE WHEN relation IN ('resolves-to', 'registered-by') THEN 'domain' ELSE 'ip' END AS type, CASE WHEN relation IN ('resolves-to', 'registered-by') THEN 0 ELSE 1 END AS step FROM raw WHERE relation <> 'shares-cert'
          UNION SELECT DISTINCT graph_id, dst, CASE relation WHEN 'resolves-to' THEN 'ip' WHEN 'registered-by' THEN 'registrar' WHEN 'hosted-in' THEN 'asn' ELSE 'geo' END,
                CASE relation WHEN 'resolves-to' THEN 1 WHEN 'registered-by' THEN 3 WHEN 'hosted-in' THEN 5 ELSE 7 END FROM raw WHERE relation <> 'shares-cert'),
nodes AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY step, node) - 1 AS node_idx, type FROM kinds),
way AS (SELECT graph_id, src AS node, dst AS other, relation, weight FROM edges UNION ALL SELECT graph_id, dst, src, relation, weight FROM edges),
degree AS (SELECT graph_id, node, count(*) AS degree, sum(weight) AS weighted FROM way GROUP BY ALL)"""

_values = lambda rows: ", ".join("(" + ", ".join(repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
TYPES = f"types(type_a, type_b, relation, template) AS (VALUES {_values(X.LINK_TYPES)})"
PAIRS = f"""{CAMPAIGN}, {TYPES},
pairs AS (SELECT a.graph_id, a.node_idx AS i, b.node_idx AS j, a.node AS node_a, b.node AS node_b, a.type AS type_a, b.type AS type_b, t.relation, t.type_a AS first_type, t.template
          FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_idx < b.node_idx
          JOIN types t ON (t.type_a = a.type AND t.type_b = b.type) OR (t.type_a = b.type AND t.type_b = a.type)
          WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = a.graph_id AND ((e.src = a.node AND e.dst = b.node) OR (e.src = b.node AND e.dst = a.node))))"""
SCORES = f"""{PAIRS},
common AS (SELECT x.graph_id, x.other AS node_a, y.other AS node_b, sum(1 / greatest(ln(d.degree), 1e-10)) AS s
           FROM way x JOIN way y ON x.graph_id = y.graph_id AND x.node = y.node AND x.other <> y.other
           JOIN degree d ON d.graph_id = x.graph_id AND d.node = x.node GROUP BY ALL),
scored AS (SELECT p.*, coalesce(s, 0) AS score FROM pairs p LEFT JOIN common USING (graph_id, node_a, node_b)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(score, 12) DESC, i, j) AS rank FROM scored)"""

_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_LONG = ", ".join(f"'{s}'" for s in X.LONG_SUFFIXES)
_BAD = ", ".join(f"'{s}'" for s in X.SUSPICIOUS_SUFFIXES)
URLS = rf"""{P.PAGES_SQL},
h AS (SELECT page_id, url, html, {_HOST} AS host FROM pg),
h2 AS (SELECT *, regexp_matches(host, '^(0*(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])\.){{3}}0*(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])$') AS is_ip, string_split(host, '.') AS labels FROM h),
h3 AS (SELECT *, CASE WHEN is_ip THEN '' WHEN array_to_string(labels[-2:], '.') IN ({_LONG}) THEN array_to_string(labels[-2:], '.') WHEN len(labels) > 1 THEN labels[-1] ELSE '' END AS suffix FROM h2),
h4 AS (SELECT *, CASE WHEN suffix = '' THEN host ELSE host[1:length(host) - length(suffix) - 1] END AS front FROM h3),
u AS (SELECT *, CASE WHEN is_ip THEN host ELSE string_split(front, '.')[-1] END AS domain FROM h4),
parsed AS (SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
             CASE WHEN is_ip OR length(front) = length(domain) THEN '' ELSE front[1:length(front) - length(domain) - 1] END AS subdomain, domain, suffix,
             CASE WHEN suffix = '' OR domain = '' THEN '' ELSE domain || '.' || suffix END AS full_domain,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, is_ip FROM u)"""
_BRANDS = ", ".join(f"'{b}'" for b in X.BRANDS)


# ---------------------------------------------------------------------------------- URLs, pages, jobs


@query("F1_parse_url", f"WITH {URLS} SELECT page_id, scheme, subdomain, domain, suffix, full_domain, path, query, is_ip FROM parsed")
def _(spark, d):
    p = pages(spark, d).withColumn("_suffix", C.suffix(C.host(F.col("url"))))
    return p.select("page_id", *(c.alias(n) for n, c in C.url_parts(F.col("url"), F.col("_suffix")).items()))


def _suspicion(spark, d):
    parts = C.url_parts(F.col("url"))
    p = pages(spark, d).select("page_id", *(parts[k].alias(k) for k in ("domain", "suffix", "full_domain")), (F.pmod("page_id", F.lit(7)) * 20).cast("int").alias("age"))
    return p.withColumn("signals", C.signals(F.col("domain"), F.col("suffix"), F.col("age"))).withColumn("score", F.size("signals"))


_AGE = "((page_id % 7 + 7) % 7) * 20"
_HYPHENS = "length(domain) - length(replace(domain, '-', ''))"
_SIGNALS = f"list_filter([CASE WHEN suffix IN ({_BAD}) THEN 'suspicious_tld:' || suffix END, CASE WHEN {_HYPHENS} >= {X.MANY_HYPHENS} THEN 'hyphen_heavy:' || ({_HYPHENS}) || '_hyphens' END, CASE WHEN {_AGE} < {X.NEW_DOMAIN_DAYS} THEN 'new_domain:' || {_AGE} || '_days_old' END], lambda x: x IS NOT NULL)"


@query("F6_suspicion_score", f"WITH {URLS} SELECT page_id, full_domain, {_SIGNALS} AS signals, len({_SIGNALS})::INTEGER AS score FROM parsed")
def _(spark, d):
    return _suspicion(spark, d).select("page_id", "full_domain", "signals", "score")


@query("F7_suspicious_filter", f"WITH {URLS} SELECT page_id, full_domain FROM parsed WHERE len({_SIGNALS}) >= 1")
def _(spark, d):
    return _suspicion(spark, d).where("score >= 1").select("page_id", "full_domain")


@query("F2_ip_predicate", f"WITH {URLS} SELECT host, is_ip, count(*) AS n FROM h2 GROUP BY ALL")
def _(spark, d):
    host = C.host(F.col("url"))
    return pages(spark, d).groupBy(host.alias("host"), C.is_ip(host).alias("is_ip")).agg(F.count("*").alias("n"))


@query("F5_real_domains", f"WITH {URLS}, names AS (SELECT host FROM h UNION ALL SELECT unnest(['Paris city', 'Acme.com', 'x' || repeat('y', 100) || '.com', 'ok.net'])) SELECT host, count(*) AS n, host <> '' AND host NOT LIKE '% %' AND host LIKE '%.%' AND length(host) <= 100 AND NOT regexp_matches(host, '^[A-Z][a-z]') AS real FROM names GROUP BY host")
def _(spark, d):
    names = pages(spark, d).select(C.host(F.col("url")).alias("host")).unionByName(spark.createDataFrame([("Paris city",), ("Acme.com",), ("x" + "y" * 100 + ".com",), ("ok.net",)], "host string"))
    return names.groupBy("host").agg(F.count("*").alias("n")).withColumn("real", C.looks_real(F.col("host")))


@query("F4_bare_domain_guard", f"WITH {URLS} SELECT page_id, NOT contains(x, '/') AS resolved FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN host ELSE url END AS x FROM h)")
def _(spark, d):
    x = F.when(F.col("page_id") % 2 == 0, C.host(F.col("url"))).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", C.bare_domain(x).alias("resolved"))


@query("X1_title", f"WITH {P.PAGES_SQL} SELECT page_id, {_TITLE} AS title FROM pg")
def _(spark, d):
    return pages(spark, d).select("page_id", C.title(F.col("html")).alias("title"))


@query("X2_meta_description", f"WITH {P.PAGES_SQL} SELECT page_id, {_DESCRIPTION} AS description FROM pg")
def _(spark, d):
    return pages(spark, d).select("page_id", C.meta_description(F.col("html")).alias("description"))


_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_LINK = P._TAG("t", "href")


@query(
    "X3_icon_candidates",
    rf"""WITH {P.PAGES_SQL}, tags AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<link\b[^>]*>'), 1) AS pos FROM pg),
c AS (SELECT page_id, url, pos, {_LINK} AS href, list_position({P.literal(X.ICON_RELATIONS)}, lower({P._TAG('t', 'rel')})) AS priority FROM tags)
SELECT page_id, list(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || href WHEN starts_with(href, '/') THEN {_ROOT} || href
  ELSE {_ROOT} || regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END, '^(.*/)', 1) || href END ORDER BY priority, pos) AS urls
FROM c WHERE priority > 0 AND href <> '' GROUP BY page_id""",
)
def _(spark, d):
    found = C.icon_candidates(F.col("url"), F.col("html"))
    return pages(spark, d).select("page_id", F.transform(found, lambda c: c["url"]).alias("urls")).where(F.size("urls") > 0)


@query("X7_brand_keywords", f"WITH {P.PAGES_SQL} SELECT page_id, {_BRANDS_IN_TEXT} AS brands FROM pg")
def _(spark, d):
    return pages(spark, d).select("page_id", C.brands(C.title(F.col("html")), C.meta_description(F.col("html"))).alias("brands"))


@query("F9_brand_mismatch", f"WITH {URLS} SELECT page_id, list_filter({_BRANDS_IN_TEXT}, lambda b: NOT contains(domain, b)) AS mismatch FROM parsed")
def _(spark, d):
    found = C.brands(C.title(F.col("html")), C.meta_description(F.col("html")))
    return pages(spark, d).select("page_id", C.mismatched(found, C.url_parts(F.col("url"))["domain"]).alias("mismatch"))


@query("X13_file_name", f"WITH {URLS} SELECT DISTINCT replace(replace(full_domain, '.', '_'), '/', '_') AS file_name FROM parsed")
def _(spark, d):
    return pages(spark, d).select(C.file_name(C.url_parts(F.col("url"))["full_domain"]).alias("file_name")).distinct()


@query("S3_phishing_jobs", f"WITH {URLS} SELECT arg_min(trim(url), page_id) AS url, full_domain, 1 AS label FROM parsed WHERE trim(url) <> '' GROUP BY full_domain")
def _(spark, d):
    return signals.phishing_jobs(pages(spark, d).select("page_id", "url"), "page_id")


@query("S4_benign_jobs", "SELECT DISTINCT 'https://' || trim(p_type) AS url, trim(p_type) AS full_domain, 0 AS label FROM part WHERE trim(p_type) <> '' AND trim(p_type) NOT IN (SELECT trim(p_brand) FROM part WHERE p_brand IS NOT NULL)")
def _(spark, d):
    p = read(spark, d, "part")
    return signals.benign_jobs(p.select(F.col("p_type").alias("domain")), p.select(F.trim("p_brand").alias("full_domain")))


@query("K3_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    jobs = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("url"))
    results = read(spark, d, "orders").select(F.col("o_custkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))
    return signals.unfinished(jobs, results).select("c_custkey")


@query("F13_usable_rows", "SELECT label, usable_for_training, count(*) AS n FROM (SELECT quality AS label, NOT (quality = 0 AND toxic = 1) AS usable_for_training FROM labels) GROUP BY ALL")
def _(spark, d):
    r = read(spark, d, "labels").select(F.col("quality").alias("label"), F.when(F.col("toxic") == 1, "dns:NXDOMAIN|whois:timeout").otherwise("").alias("modules_failed"))
    return signals.usable(r).groupBy("label", "usable_for_training").agg(F.count("*").alias("n"))


@query("S20_cache", "WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type, count(*) AS n, sum(length(props))::BIGINT AS size FROM events, m WHERE epoch(t)::BIGINT - epoch(ts)::BIGINT <= 7 * 86400 GROUP BY event_type")
def _(spark, d):
    e = read(spark, d, "events")
    dated = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return signals.cached(dated.withColumnRenamed("ts", "cached_at"), F.col("now")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("size"))


@query("S13_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S6_whois_age", "SELECT 'c' || o_custkey AS domain, date_diff('day', min(o_orderdate)::DATE, DATE '2030-01-01')::INTEGER AS age_days, round(least(date_diff('day', min(o_orderdate)::DATE, DATE '2030-01-01'), 3650) / 3650, 6) AS weight FROM orders GROUP BY o_custkey")
def _(spark, d):
    w = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("creation_date"))
    w = w.select(F.concat(F.lit("c"), "o_custkey").alias("domain"), F.array(F.lit("m")).alias("registrar"), "creation_date")
    return signals.whois_rows(w, F.lit("2030-01-01").cast("date")).select("domain", "age_days", _r("weight").alias("weight"))


_TIERS = P.values([(f"AS{n}", t, label, r) for (t, r), known in X.ASN_TIERS.items() for n, label in known.items()])


@query("F8_asn_reputation", f"WITH t(asn, tier, label, risk) AS (VALUES {_TIERS}), n AS (SELECT p_partkey AS k, ' as' || (9000 + p_partkey) AS asn FROM part UNION ALL SELECT -k, CASE k % 3 WHEN 0 THEN replace(asn, 'AS', '') WHEN 1 THEN lower(asn) ELSE asn || ' ' END FROM (SELECT asn, row_number() OVER (ORDER BY asn) AS k FROM t)) SELECT n.k, coalesce(tier, 'unknown') AS tier, label, coalesce(risk, 0)::INTEGER AS risk_score, tier IS NOT NULL AS is_flagged FROM n LEFT JOIN t ON t.asn = CASE WHEN regexp_matches(trim(n.asn), '^[0-9]+$') THEN 'AS' || trim(n.asn) ELSE upper(trim(n.asn)) END")
def _(spark, d):
    """Every listed system in three spellings, among the parts' numbers."""
    known = sorted(f"AS{n}" for ns in X.ASN_TIERS.values() for n in ns)
    rows = [(-k, a.replace("AS", "") if k % 3 == 0 else a.lower() if k % 3 == 1 else a + " ") for k, a in enumerate(known, 1)]
    p = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.concat(F.lit(" as"), F.col("p_partkey") + 9000).alias("asn"))
    return G.asn_reputation(p.unionByName(spark.createDataFrame(rows, "k long, asn string"))).drop("asn")


# ------------------------------------------------------------------------------------ assembled graphs


@query("G1_nodes", f"WITH {CAMPAIGN} SELECT graph_id, node, node_idx::INTEGER AS node_idx, type FROM nodes")
def _(spark, d):
    return campaign(spark, d)[0]


@query("G1_edges", f"WITH {CAMPAIGN} SELECT graph_id, src, dst, edge_idx::INTEGER AS edge_idx, relation, round(weight, 6) AS weight FROM edges")
def _(spark, d):
    return campaign(spark, d)[1].withColumn("weight", _r("weight"))


@query("A1_graph_sizes", f"WITH {CAMPAIGN} SELECT graph_id, node_count, edge_count FROM (SELECT graph_id, count(*) AS node_count FROM nodes GROUP BY 1) JOIN (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY 1) USING (graph_id)")
def _(spark, d):
    return G.sizes(*campaign(spark, d))


@query("A2_type_histogram", f"WITH {CAMPAIGN} SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY ALL")
def _(spark, d):
    return campaign(spark, d)[0].groupBy("graph_id", "type").agg(F.count("*").alias("n"))


@query("A3_degrees", f"WITH {CAMPAIGN} SELECT graph_id, node, degree, round(weighted, 6) AS weighted_degree FROM degree")
def _(spark, d):
    return G.degrees(campaign(spark, d)[1]).withColumn("weighted_degree", _r("weighted_degree"))


@query("A5_class_balance", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, d):
    return read(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "A6_size_histogram",
    f"WITH {CAMPAIGN}, s AS (SELECT graph_id, split_part(graph_id, '-', 2) = 'BUILDING' AS label, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT greatest(max(n), 10)::DOUBLE AS top FROM s) SELECT label, CASE WHEN n = top THEN 14 ELSE floor(n / (top / 14))::INTEGER + 1 END AS bin, count(*) AS n FROM s, m GROUP BY ALL",
)
def _(spark, d):
    """Fourteen bins up to the largest graph, each label's graphs apart."""
    s = campaign(spark, d)[0].groupBy("graph_id", (F.split("graph_id", "-")[1] == "BUILDING").alias("label")).agg(F.count("*").alias("n"))
    top = s.agg(F.greatest(F.max("n"), F.lit(10)).cast("double").alias("top"))
    k = F.when(F.col("n") == F.col("top"), 14).otherwise(F.floor(F.col("n") / (F.col("top") / 14)).cast("int") + 1)
    return s.crossJoin(F.broadcast(top)).groupBy("label", k.alias("bin")).agg(F.count("*").alias("n"))


@query("A12_first_targets", f"WITH {CAMPAIGN} SELECT graph_id, relation, src, arg_min(dst, edge_idx) AS first_target, count(*) - 1 AS more FROM edges GROUP BY graph_id, relation, src")
def _(spark, d):
    e = campaign(spark, d)[1]
    return e.groupBy("graph_id", "relation", "src").agg(F.min_by("dst", "edge_idx").alias("first_target"), (F.count("*") - 1).alias("more"))


@query(
    "F12_edge_buckets",
    f"WITH {CAMPAIGN}, b(ba, bb) AS (VALUES {_values(X.BUCKETS)}) SELECT e.graph_id, coalesce(ba, 'other') AS bucket_a, coalesce(bb, 'other') AS bucket_b, count(*) AS n FROM edges e JOIN nodes x ON x.graph_id = e.graph_id AND x.node = e.src JOIN nodes y ON y.graph_id = e.graph_id AND y.node = e.dst LEFT JOIN b ON least(ba, bb) = least(x.type, y.type) AND greatest(ba, bb) = greatest(x.type, y.type) GROUP BY ALL",
)
def _(spark, d):
    n, e = campaign(spark, d)
    b = spark.createDataFrame(X.BUCKETS, "bucket_a string, bucket_b string").withColumns({"lo": F.least("bucket_a", "bucket_b"), "hi": F.greatest("bucket_a", "bucket_b")})
    t = lambda k, c: n.select("graph_id", F.col("node").alias(k), F.col("type").alias(c))
    m = e.join(t("src", "ta"), ["graph_id", "src"]).join(t("dst", "tb"), ["graph_id", "dst"]).withColumns({"lo": F.least("ta", "tb"), "hi": F.greatest("ta", "tb")})
    m = m.join(F.broadcast(b), ["lo", "hi"], "left")
    return m.groupBy("graph_id", F.coalesce("bucket_a", F.lit("other")).alias("bucket_a"), F.coalesce("bucket_b", F.lit("other")).alias("bucket_b")).agg(F.count("*").alias("n"))


@query(
    "W4_node_budget",
    f"WITH {CAMPAIGN}, k AS (SELECT *, row_number() OVER (PARTITION BY graph_id, type ORDER BY node_idx) AS r, count(*) OVER (PARTITION BY graph_id) AS n FROM (SELECT graph_id, node, node_idx, CASE type WHEN 'ip' THEN 'co_host' ELSE type END AS type FROM nodes)) SELECT graph_id, node FROM k WHERE NOT (type = 'co_host' AND n > 50 AND r > 3)",
)
def _(spark, d):
    n, e = campaign(spark, d)
    n = n.withColumn("type", F.when(F.col("type") == "ip", "co_host").otherwise(F.col("type")))
    return G.trimmed(n, e)[0].select("graph_id", "node")


# Every server has one place, so components are those of places that share a domain; registrars are alone.
_REACH = """ipgeo AS (SELECT graph_id, src AS ip, dst AS geo FROM edges WHERE relation = 'located-in'),
homes AS (SELECT graph_id, geo AS node, geo FROM ipgeo UNION SELECT graph_id, ip, geo FROM ipgeo
          UNION SELECT e.graph_id, e.dst, g.geo FROM edges e JOIN ipgeo g ON g.graph_id = e.graph_id AND g.ip = e.src WHERE relation = 'hosted-in'
          UNION SELECT e.graph_id, e.src, g.geo FROM edges e JOIN ipgeo g ON g.graph_id = e.graph_id AND g.ip = e.dst WHERE relation = 'resolves-to'),
gg AS (SELECT DISTINCT a.graph_id, a.geo AS x, b.geo AS y FROM homes a JOIN homes b USING (graph_id, node)),
gr AS (SELECT * FROM gg UNION SELECT gr.graph_id, gr.x, gg.y FROM gr JOIN gg ON gr.graph_id = gg.graph_id AND gr.y = gg.x),
cls AS (SELECT graph_id, x AS geo, min(y) AS class FROM gr GROUP BY ALL),
classes AS (SELECT DISTINCT graph_id, node, class FROM homes JOIN cls USING (graph_id, geo))"""
_PARTS = "SELECT n.graph_id, n.node, (min(n.node_idx) OVER (PARTITION BY n.graph_id, coalesce(c.class, n.node)))::INTEGER AS component FROM nodes n LEFT JOIN classes c USING (graph_id, node)"
_SPLIT = CAMPAIGN.replace("edges AS (SELECT graph_id, src, dst, row_number()", "edges AS (SELECT * FROM (SELECT graph_id, src, dst, row_number()").replace("AS edge_idx, relation, weight FROM raw)", "AS edge_idx, relation, weight FROM raw) WHERE relation <> 'registered-by' AND relation <> 'shares-cert')")


def _split(spark, d):
    """The campaigns without registrars' and certificates' links, so that they fall apart."""
    n, e = campaign(spark, d)
    return n, e.where("relation NOT IN ('registered-by', 'shares-cert')")


@query("G19_connected", f"WITH RECURSIVE {_SPLIT}, {_REACH}, parts AS ({_PARTS}) SELECT graph_id, count(DISTINCT component) = 1 AS is_connected FROM parts GROUP BY 1")
def _(spark, d):
    return G.connected(*_split(spark, d))


@query(
    "G19_components",
    f"WITH RECURSIVE {_SPLIT}, {_REACH} {_PARTS}",
)
def _(spark, d):
    return G.components(*_split(spark, d))


_COMPOSED = f"""{CAMPAIGN},
ends AS (SELECT graph_id, src AS node, relation IN {P._RIGHT} AS side FROM edges WHERE relation <> 'shares-cert' UNION SELECT graph_id, dst, relation IN {P._RIGHT} FROM edges WHERE relation <> 'shares-cert'),
both_ AS (SELECT e.graph_id, e.node, n.node_idx, side, CASE WHEN side AND n.type = 'ip' THEN 'co_host' ELSE n.type END AS type FROM ends e JOIN nodes n USING (graph_id, node))"""


@query("J10_compose", f"WITH {_COMPOSED}, u AS (SELECT graph_id, node, arg_max(type, side) AS type, min({{'s': side, 'i': node_idx}}) AS o FROM both_ GROUP BY ALL) SELECT graph_id, node, type, (row_number() OVER (PARTITION BY graph_id ORDER BY o) - 1)::INTEGER AS node_idx FROM u")
def _(spark, d):
    return G.composed(*P.composed_parts(spark, d))[0]


@query("J10_composed_edges", f"WITH {CAMPAIGN} SELECT graph_id, src, dst, relation, (row_number() OVER (PARTITION BY graph_id ORDER BY relation IN {P._RIGHT}, edge_idx) - 1)::INTEGER AS edge_idx FROM edges WHERE relation <> 'shares-cert'")
def _(spark, d):
    return G.composed(*P.composed_parts(spark, d))[1].select("graph_id", "src", "dst", "relation", "edge_idx")


@query("R11_hypergraph", f"WITH {CAMPAIGN} SELECT graph_id, node, type, 180 + 60 * degree AS size FROM nodes JOIN degree USING (graph_id, node)")
def _(spark, d):
    n, e = campaign(spark, d)
    return n.join(G.degrees(e), ["graph_id", "node"]).select("graph_id", "node", "type", (180 + 60 * F.col("degree")).alias("size"))


@query("X14_plain_labels", f"WITH {CAMPAIGN}, w(type, category, label) AS (VALUES {_values(X.TYPE_WORDS)}) SELECT graph_id, category, label, count(*) AS n FROM nodes JOIN w USING (type) GROUP BY ALL")
def _(spark, d):
    w = spark.createDataFrame(X.TYPE_WORDS, "type string, category string, label string")
    return campaign(spark, d)[0].join(F.broadcast(w), "type").groupBy("graph_id", "category", "label").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------------------------- missing links


@query("J4_candidates", f"WITH {PAIRS} SELECT graph_id, i::INTEGER AS i, j::INTEGER AS j, node_a, node_b, type_a, type_b, relation FROM pairs")
def _(spark, d):
    return B.candidates(*campaign(spark, d))


@query("A4_adamic_adar", f"WITH {SCORES} SELECT graph_id, node_a, node_b, relation, round(score, 6) AS score FROM scored")
def _(spark, d):
    return B.adamic_adar(*campaign(spark, d)).select("graph_id", "node_a", "node_b", "relation", _r("score").alias("score"))


@query(
    "W1_ranked_links",
    f"WITH {SCORES}, b AS (SELECT graph_id, count(*) AS n, quantile_cont(round(score, 12), 0.5) AS p50, quantile_cont(round(score, 12), 0.75) AS p75, max(round(score, 12)) AS top FROM scored GROUP BY 1) SELECT graph_id, rank::INTEGER AS rank, node_a, node_b, relation, round(score, 6) AS score, CASE WHEN round(score, 12) >= CASE WHEN n > 3 THEN p75 ELSE top END THEN 'high' WHEN round(score, 12) >= CASE WHEN n > 1 THEN p50 ELSE 0 END THEN 'medium' ELSE 'low' END AS confidence, replace(replace(template, '{{a}}', CASE WHEN type_a = first_type THEN node_a ELSE node_b END), '{{b}}', CASE WHEN type_a = first_type THEN node_b ELSE node_a END) AS explanation FROM ranked JOIN b USING (graph_id) WHERE rank <= 10",
)
def _(spark, d):
    top = L.explained(S.top_common_links(*campaign(spark, d)))
    return top.select("graph_id", "rank", "node_a", "node_b", "relation", _r("score").alias("score"), "confidence", "explanation")


def _last_links(edges):
    e = edges.where("relation = 'resolves-to'")
    return e.groupBy("graph_id").agg(F.max_by("src", "edge_idx").alias("src"), F.max_by("dst", "edge_idx").alias("dst"))


_DAMAGED = SCORES.replace("edges AS (SELECT graph_id, src, dst, row_number()", "whole AS (SELECT graph_id, src, dst, row_number()").replace(
    "kinds AS (", "hidden AS (SELECT graph_id, arg_max(src, edge_idx) AS src, arg_max(dst, edge_idx) AS dst FROM whole WHERE relation = 'resolves-to' GROUP BY graph_id), edges AS (SELECT w.* FROM whole w ANTI JOIN hidden USING (graph_id, src, dst)), kinds AS (", 1
)


@query(
    "M2_hits",
    f"WITH {_DAMAGED}, hit AS (SELECT r.graph_id, r.rank, h.src IS NOT NULL AS found FROM ranked r LEFT JOIN hidden h ON h.graph_id = r.graph_id AND least(h.src, h.dst) = least(r.node_a, r.node_b) AND greatest(h.src, h.dst) = greatest(r.node_a, r.node_b)) SELECT graph_id, count(*) FILTER (found) AS n_found, count(*) AS n_candidates, round(coalesce(sum(1.0 / rank) FILTER (found) / count(*) FILTER (found), 0), 6) AS mrr, round(coalesce(sum(1.0 / rank) FILTER (found), 0), 6) AS mrr_all, (avg(rank) FILTER (found))::DOUBLE AS mean_rank, (count(*) FILTER (found AND rank <= 1))::DOUBLE AS hits_1, (count(*) FILTER (found AND rank <= 3))::DOUBLE AS hits_3, (count(*) FILTER (found AND rank <= 5))::DOUBLE AS hits_5, (count(*) FILTER (found AND rank <= 10))::DOUBLE AS hits_10 FROM hit WHERE graph_id IN (SELECT graph_id FROM hidden) GROUP BY graph_id",
)
def _(spark, d):
    n, e = campaign(spark, d)
    m = B.recovery(n, e, _last_links(e))
    return m.select("graph_id", "n_found", "n_candidates", _r("mrr").alias("mrr"), _r("mrr_all").alias("mrr_all"), "mean_rank", "hits_1", "hits_3", "hits_5", "hits_10")


def _links(top):
    return L.explained(top).select("graph_id", "rank", "node_a", "node_b", "type_a", "type_b", "relation", _r("score").alias("score"), "confidence", "explanation")


@query("G16_missing_links")
def missing_links(spark, d):
    return _links(S.top_walk_links(*campaign(spark, d)))


_STAR_PAIRS = f"""m AS (SELECT s_nationkey AS g, count(*) AS k, count(*) + (SELECT count(*) FROM region) AS n FROM supplier GROUP BY 1),
ips AS (SELECT s_nationkey AS g, 's' || s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY 's' || s_suppkey) AS i FROM supplier),
asns AS (SELECT 'AS' || r_regionkey AS node, row_number() OVER (ORDER BY 'AS' || r_regionkey) AS j FROM region),
t(t) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in X.TIMES)}),
s AS (SELECT g, k, n, avg(pow((cos(sqrt(n) * t) - 1) / n, 2)) AS score FROM m, t GROUP BY ALL),
pairs AS (SELECT s.g, i, j, k, ips.node AS node_a, asns.node AS node_b, score, row_number() OVER (PARTITION BY s.g ORDER BY i, j) AS rank FROM s JOIN ips ON ips.g = s.g CROSS JOIN asns)"""


@query("G16_star_links", f"WITH {_STAR_PAIRS} SELECT g::VARCHAR AS graph_id, rank::INTEGER AS rank, node_a, node_b, 'ip' AS type_a, 'asn' AS type_b, 'hosted-in' AS relation, round(score, 6) AS score, 'high' AS confidence, 'server ' || node_a || ' is probably hosted by ' || node_b AS explanation FROM pairs WHERE rank <= 10")
def _(spark, d):
    """Stars have the walk in closed form: each leaf reaches each other one alike, so ties are broken by place."""
    return _links(S.top_walk_links(*mixed_stars(spark, d)))


@query("G16_walk_scores", f"WITH {_STAR_PAIRS} SELECT g::VARCHAR AS graph_id, i::INTEGER AS i, (k + j)::INTEGER AS j, round(score, 9) AS score FROM pairs")
def _(spark, d):
    """All candidates of the stars with their scores."""
    return S.walk_scores(*mixed_stars(spark, d)).select("graph_id", "i", "j", _r("score", 9).alias("score"))


@query("G17_random_baseline")
def _(spark, d):
    return B.top_by_chance(*campaign(spark, d))


@query("G18_hide_and_recover")
def _(spark, d):
    """Metrics of the walk, of common neighbours and of chance over the same hidden links."""
    return S.recoveries(*campaign(spark, d))


@query("G18_hidden_links", f"WITH {CAMPAIGN}, s AS (SELECT graph_id, (SELECT count(*) FROM nodes x WHERE x.graph_id = g.graph_id) AS n, count(*) AS e FROM edges g GROUP BY graph_id), c AS (SELECT graph_id, n, e, greatest(1, floor(e * 0.2::DOUBLE))::BIGINT AS k FROM s) SELECT graph_id, least(CASE WHEN k >= e - (n - 1) THEN greatest(1, e - n) ELSE k END, e - n + 1) AS n_hidden FROM c WHERE e - n + 1 > 0")
def _(spark, d):
    """How many links each campaign hides: a fifth, less where it is sparse, none that would take it apart."""
    return S.hidden_links(*campaign(spark, d)).groupBy("graph_id").agg(F.count("*").alias("n_hidden"))


@query("G24_recovery_stability")
def _(spark, d):
    """Spread of the mean reciprocal rank of the three methods over ten seeds, by method and seed."""
    r = S.recoveries(*campaign(spark, d), seeds=tuple(range(10)))
    q = lambda p: F.percentile("mrr", p)
    return r.groupBy("method", "seed").agg(F.avg("mrr").alias("mean_mrr"), F.min("mrr").alias("low"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("mrr").alias("high"))


_BINS = 29


def _density(scored, hidden):
    """Densities over 29 bins from 0 to 1.1 times a graph's highest score, of hidden links and of the others."""
    h = hidden.select("graph_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(True).alias("hidden"))
    s = scored.select("graph_id", F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi"), F.round("score", 12).alias("score"))
    s = s.join(h, ["graph_id", "lo", "hi"], "left").select("graph_id", F.coalesce("hidden", F.lit(False)).alias("hidden"), "score")
    width = s.groupBy("graph_id").agg((F.round(F.max("score") * 1.1, 12) / _BINS).alias("width")).where("width > 0")
    n = s.groupBy("graph_id", "hidden").agg(F.count("*").alias("n"))
    k = F.least(F.floor(F.round(F.col("score") / F.col("width"), 9)).cast("int") + 1, F.lit(_BINS))
    g = s.join(width, "graph_id").groupBy("graph_id", "hidden", "width", k.alias("bin")).agg(F.count("*").alias("k")).join(n, ["graph_id", "hidden"])
    return g.select("graph_id", "hidden", "bin", _r(F.col("k") / (F.col("n") * F.col("width")), 4).alias("density"))


@query(
    "A8_score_density",
    f"WITH {_DAMAGED}, s AS (SELECT r.graph_id, h.src IS NOT NULL AS hidden, round(r.score, 12) AS score FROM scored r LEFT JOIN hidden h ON h.graph_id = r.graph_id AND least(h.src, h.dst) = least(r.node_a, r.node_b) AND greatest(h.src, h.dst) = greatest(r.node_a, r.node_b)), w AS (SELECT graph_id, round(max(score) * 1.1, 12) / {_BINS} AS width FROM s GROUP BY 1 HAVING width > 0), n AS (SELECT graph_id, hidden, count(*) AS n FROM s GROUP BY ALL) SELECT graph_id, hidden, least(floor(round(score / width, 9))::INTEGER + 1, {_BINS}) AS bin, round(count(*) / (n * width), 4) AS density FROM s JOIN w USING (graph_id) JOIN n USING (graph_id, hidden) GROUP BY graph_id, hidden, 3, n, width",
)
def _(spark, d):
    n, e = campaign(spark, d)
    return B.density(n, e, _last_links(e), _BINS).withColumn("density", _r("density", 4))


@query("G25_score_separation")
def _(spark, d):
    """The same of the walk's scores, over links hidden at random without the bound on sparse graphs."""
    n, e = campaign(spark, d)
    return B.density(n, e, S.hidden_links(n, e, clamp=False), _BINS, walk=True).withColumn("density", _r("density", 4))


# ----------------------------------------------------------------------------------- spectra and walks

STAR = "star AS (SELECT s_nationkey::VARCHAR AS graph_id, count(*) AS k FROM supplier GROUP BY 1)"
_T = "t(t) AS (VALUES (0.5::DOUBLE), (1.0), (2.0), (5.0), (10.0))"


@query("G4_hamiltonian", f"WITH {CAMPAIGN} SELECT graph_id, a.node_idx::INTEGER AS i, b.node_idx::INTEGER AS j, round(-weight, 6) AS h FROM way JOIN nodes a USING (graph_id, node) JOIN nodes b ON b.graph_id = way.graph_id AND b.node = way.other WHERE weight <> 0".replace("SELECT graph_id, a.", "SELECT way.graph_id, a."))
def _(spark, d):
    return S.hamiltonian_entries(*campaign(spark, d)).withColumn("h", _r("h"))


@query("G4_laplacian", f"WITH {CAMPAIGN} SELECT d.graph_id, n.node_idx::INTEGER AS i, n.node_idx::INTEGER AS j, round(weighted, 6) AS h FROM degree d JOIN nodes n USING (graph_id, node) WHERE weighted <> 0 UNION ALL SELECT way.graph_id, a.node_idx::INTEGER, b.node_idx::INTEGER, round(-weight, 6) FROM way JOIN nodes a USING (graph_id, node) JOIN nodes b ON b.graph_id = way.graph_id AND b.node = way.other WHERE weight <> 0")
def _(spark, d):
    return S.hamiltonian_entries(*campaign(spark, d), variant="laplacian").withColumn("h", _r("h"))


@query("G4_unweighted", f"WITH {CAMPAIGN} SELECT graph_id, count(*) AS n, sum(-1.0)::DOUBLE AS total FROM way GROUP BY graph_id")
def _(spark, d):
    return S.hamiltonian_entries(*campaign(spark, d), weighted=False).groupBy("graph_id").agg(F.count("*").alias("n"), F.sum("h").alias("total"))


_TRADE = "m AS (SELECT c_mktsegment AS graph_id, c_nationkey AS i, s_nationkey AS j, count(*)::DOUBLE AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)"


@query("G6_asymmetries", f"WITH {_TRADE} SELECT a.graph_id, a.i, a.j, a.h FROM m a LEFT JOIN m b ON a.graph_id = b.graph_id AND a.i = b.j AND a.j = b.i WHERE abs(a.h - coalesce(b.h, 0)) > 1e-10")
def _(spark, d):
    """Lines between nations, which are not the same both ways."""
    c, o, l, s = (read(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))  # noqa: E741
    m = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return S.asymmetries(m.groupBy(F.col("c_mktsegment").alias("graph_id"), F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count("*").cast("double").alias("h")))


@query("G6_hermitian", f"WITH {CAMPAIGN} SELECT graph_id, count(*) AS n, round(sum(-weight), 6) AS total FROM way WHERE weight <> 0 GROUP BY graph_id")
def _(spark, d):
    """Entries that passed the check, which raises on a matrix that is not its own mirror."""
    return S.hermitian(S.hamiltonian_entries(*campaign(spark, d))).groupBy("graph_id").agg(F.count("*").alias("n"), _r(F.sum("h")).alias("total"))


@query("G11_permutations", f"WITH {STAR} SELECT graph_id, true AS same FROM star")
def _(spark, d):
    return S.permutation_errors(*stars(spark, d)).select("graph_id", (F.col("max_error") < 1e-8).alias("same"))


@query("G5_spectrum", f"WITH {STAR} SELECT graph_id, p.pos::INTEGER AS pos, round(CASE WHEN p.pos = 0 THEN -sqrt(k) WHEN p.pos = k THEN sqrt(k) ELSE 0 END, 6) AS eigenvalue FROM star, range(0, 100000) p(pos) WHERE p.pos <= k")
def _(spark, d):
    s = S.spectra(*stars(spark, d))
    return s.select("graph_id", F.posexplode("eigenvalues").alias("pos", "v")).select("graph_id", "pos", _r("v").alias("eigenvalue"))


@query(
    "G8_walk",
    f"WITH {STAR}, {_T} SELECT graph_id, t, round(pow(cos(sqrt(k) * t), 2), 6) AS hub, round(pow(sin(sqrt(k) * t), 2) / k, 6) AS hub_leaf, round(pow(1 + (cos(sqrt(k) * t) - 1) / k, 2), 6) AS leaf FROM star, t",
)
def _(spark, d):
    p = S.walks(*stars(spark, d))
    pick = lambda i, j: _r(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("prob"))))
    return p.groupBy("graph_id", "t").agg(pick(0, 0).alias("hub"), pick(0, 1).alias("hub_leaf"), pick(1, 1).alias("leaf"))


@query("G9_unitarity", f"WITH {STAR}, {_T} SELECT graph_id, t, true AS is_unitary FROM star, t")
def _(spark, d):
    return S.unitarity(*stars(spark, d)).select("graph_id", "t", "is_unitary")


@query(
    "A7_eigenvalue_histogram",
    f"WITH {STAR}, v AS (SELECT graph_id, k, unnest([-sqrt(k), 0, sqrt(k)]) AS v, unnest([1, k - 1, 1]) AS n FROM star), b AS (SELECT graph_id, CASE WHEN round(v, 9) = 10 THEN 20 ELSE floor(round(v, 9) + 10)::INTEGER + 1 END AS bin, sum(n) AS n FROM v WHERE round(v, 9) BETWEEN -10 AND 10 AND n > 0 GROUP BY ALL) SELECT graph_id, bin, round(n / sum(n) OVER (PARTITION BY graph_id), 6) AS share FROM b",
)
def _(spark, d):
    f = S.fingerprints(*stars(spark, d), method="eigenvalue_histogram")
    return f.select("graph_id", F.posexplode("phi").alias("bin", "share")).where("share > 0").select("graph_id", (F.col("bin") + 1).alias("bin"), _r("share").alias("share"))


@query(
    "A9_return_statistics",
    f"WITH {STAR}, {_T}, p AS (SELECT graph_id, t, k, pow(cos(sqrt(k) * t), 2) AS h, pow(1 + (cos(sqrt(k) * t) - 1) / k, 2) AS l FROM star, t) SELECT graph_id, t, round((h + k * l) / (k + 1), 6) AS mean, round(sqrt(k) / (k + 1) * abs(h - l), 6) AS std, round(least(h, l), 6) AS low, round(greatest(h, l), 6) AS high, round(l, 6) AS median FROM p",
)
def _(spark, d):
    f = S.fingerprints(*stars(spark, d), method="return_probability")
    t = F.array(*map(F.lit, X.TIMES))
    at = lambda k: _r(F.get("phi", F.col("p") * 5 + k))
    return f.select("graph_id", "phi", F.posexplode(t).alias("p", "t")).select("graph_id", "t", at(0).alias("mean"), at(1).alias("std"), at(2).alias("low"), at(3).alias("high"), at(4).alias("median"))


_BINNED = "v AS (SELECT graph_id, k, unnest([-sqrt(k), 0, sqrt(k)]) AS v, unnest([1, k - 1, 1]) AS n FROM star), b AS (SELECT graph_id, CASE WHEN round(v, 9) = 10 THEN 20 ELSE floor(round(v, 9) + 10)::INTEGER + 1 END AS bin, sum(n) AS n FROM v WHERE round(v, 9) BETWEEN -10 AND 10 AND n > 0 GROUP BY ALL), shares AS (SELECT graph_id, bin, n / sum(n) OVER (PARTITION BY graph_id) AS share FROM b)"
_PHI = f"""{STAR}, {_BINNED}, ts(ti, t) AS (VALUES {", ".join(f"({k}, {x}::DOUBLE)" for k, x in enumerate(X.TIMES))}),
hist AS (SELECT star.graph_id, r.b - 1 AS pos, coalesce(share, 0) AS v FROM star CROSS JOIN range(1, 21) r(b) LEFT JOIN shares ON shares.graph_id = star.graph_id AND bin = r.b),
ret AS (SELECT graph_id, k, ti, pow(cos(sqrt(k) * t), 2) AS h, pow(1 + (cos(sqrt(k) * t) - 1) / k, 2) AS l FROM star, ts),
stats AS (SELECT graph_id, 20 + 5 * ti + r.j AS pos, CASE r.j WHEN 0 THEN (h + k * l) / (k + 1) WHEN 1 THEN sqrt(k) / (k + 1) * abs(h - l) WHEN 2 THEN least(h, l) WHEN 3 THEN greatest(h, l) ELSE l END AS v FROM ret, range(5) r(j)),
parts AS (SELECT * FROM hist UNION ALL SELECT * FROM stats), phis AS (SELECT graph_id, list(v ORDER BY pos) AS phi FROM parts GROUP BY graph_id)"""


def _embedded(seed: int, name: str) -> str:
    """The embedding of a star from the layers' weights, which numpy's generator gives."""
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((16, 16)) * 0.1, rng.standard_normal((16, 32)) * 0.1]
    rows = P.values([(k, r, c, float(x)) for k, m in enumerate(w) for r, row in enumerate(m) for c, x in enumerate(row)])
    d, i = X.EMBEDDED_TYPES.index("domain"), X.EMBEDDED_TYPES.index("ip")
    return f"""w AS (SELECT layer, r, c, v::DOUBLE AS v FROM (VALUES {rows}) t(layer, r, c, v)),
h1 AS (SELECT r, greatest(0, sum(v) FILTER (c IN ({d}, {8 + i}))) AS hub, greatest(0, sum(v) FILTER (c IN ({i}, {8 + d}))) AS leaf FROM w WHERE layer = 0 GROUP BY r),
h2 AS (SELECT w.r, greatest(0, sum(w.v * CASE WHEN w.c < 16 THEN hub ELSE leaf END)) AS hub, greatest(0, sum(w.v * CASE WHEN w.c < 16 THEN leaf ELSE hub END)) AS leaf FROM w JOIN h1 ON h1.r = w.c % 16 WHERE layer = 1 GROUP BY w.r),
{name} AS (SELECT graph_id, list((hub + k * leaf) / (k + 1) ORDER BY r) AS embedding FROM star, h2 GROUP BY graph_id)"""


@query("G10_star_fingerprints", f"WITH {_PHI} SELECT graph_id, pos::INTEGER AS pos, round(v, 6) AS v FROM parts")
def _(spark, d):
    f = S.fingerprints(*stars(spark, d))
    return f.select("graph_id", F.posexplode("phi").alias("pos", "v")).withColumn("v", _r("v"))


@query("G10_fingerprints")
def _(spark, d):
    return S.fingerprints(*campaign(spark, d)).withColumn("phi", F.transform("phi", lambda x: F.round(x, 6)))


@query("G12_star_embeddings", f"WITH {STAR}, {_embedded(0, 'e')} SELECT graph_id, list_transform(embedding, lambda x: round(x, 9)) AS embedding FROM e")
def _(spark, d):
    return S.embeddings(*stars(spark, d)).select("graph_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


@query("G12_embeddings")
def _(spark, d):
    return S.embeddings(*campaign(spark, d)).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("F15_one_hot", f"WITH {CAMPAIGN} SELECT DISTINCT type, list_transform({P.literal(X.EMBEDDED_TYPES)}, lambda t: (t = CASE WHEN list_contains({P.literal(X.EMBEDDED_TYPES)}, type) THEN type ELSE 'unknown' END)::INT::DOUBLE) AS feature FROM (SELECT type FROM nodes UNION ALL SELECT 'favicon')")
def _(spark, d):
    types = campaign(spark, d)[0].select("type").distinct().unionByName(spark.createDataFrame([("favicon",)], "type string"))
    return types.select("type", C.one_hot(F.col("type")).alias("feature"))


@query("A10_neighbour_types", f"WITH {CAMPAIGN} SELECT w.graph_id, w.node, round(avg((n.type = 'domain')::INT), 6) AS mean_domain, round(avg((n.type = 'ip')::INT), 6) AS mean_ip, max((n.type = 'geo')::INT)::DOUBLE AS max_geo FROM way w JOIN nodes n ON n.graph_id = w.graph_id AND n.node = w.other GROUP BY ALL")
def _(spark, d):
    f = G.neighbour_features(*campaign(spark, d))
    at = lambda c, t: F.get(c, F.lit(X.EMBEDDED_TYPES.index(t)))
    return f.select("graph_id", "node", _r(at("mean", "domain")).alias("mean_domain"), _r(at("mean", "ip")).alias("mean_ip"), at("max", "geo").alias("max_geo"))


_COMPARED = f"{_PHI}, {_embedded(1, 'e')}, few AS (SELECT graph_id FROM star ORDER BY graph_id LIMIT {X.COMPARED}), compared AS (SELECT a.graph_id AS graph_a, b.graph_id AS graph_b, 1 - list_cosine_similarity(a.phi, b.phi) AS walk, 1 - list_cosine_similarity(x.embedding, y.embedding) AS gnn FROM phis a JOIN phis b ON a.graph_id < b.graph_id JOIN e x ON x.graph_id = a.graph_id JOIN e y ON y.graph_id = b.graph_id WHERE a.graph_id IN (FROM few) AND b.graph_id IN (FROM few))"


def _star_pairs(spark, d):
    n, e = stars(spark, d)
    return S.compared(S.fingerprints(n, e), S.embeddings(n, e, seed=1))


@query("G15_star_pairs", f"WITH {_COMPARED} SELECT graph_a, graph_b, round(walk, 6) + 0.0 AS walk_distance, round(gnn, 6) + 0.0 AS embedding_distance, walk > 0.05 AND NOT gnn > 0.05 AS blind_spot FROM compared")
def _(spark, d):
    return _star_pairs(spark, d).withColumns({"walk_distance": _r("walk_distance"), "embedding_distance": _r("embedding_distance")})


@query("A13_star_blind_spots", f"WITH {_COMPARED} SELECT count(*) FILTER (walk > 0.05 AND NOT gnn > 0.05) AS blind, count(*) AS total FROM compared")
def _(spark, d):
    return _star_pairs(spark, d).agg(F.count_if("blind_spot").alias("blind"), F.count("*").alias("total"))


@query("G15_compared_graphs")
def _(spark, d):
    n, e = signals.first_graphs(*campaign(spark, d), X.COMPARED)
    return S.compared(S.fingerprints(n, e), S.embeddings(n, e, seed=1))


@query("A13_blind_spots")
def _(spark, d):
    n, e = signals.first_graphs(*campaign(spark, d), X.COMPARED)
    return S.compared(S.fingerprints(n, e), S.embeddings(n, e, seed=1)).agg(F.count_if("blind_spot").alias("blind"), F.count("*").alias("total"))


@query("G14_synthetic_suite", "SELECT * FROM (VALUES ('2C3', 'C6', 0.211722::DOUBLE), ('camp_cert', 'camp_ip', 0.0), ('dstar', 'star8', 0.104633)) t(graph_a, graph_b, walk_distance)")
def _(spark, d):
    suite = fixtures.synthetic_suite()
    n, e = fixtures.frames(spark, [g for _, a, b in suite for g in (a, b)])
    c = S.compared(S.fingerprints(n, e), S.embeddings(n, e, seed=1))
    names = spark.createDataFrame([tuple(sorted((a[0].graph_id[0], b[0].graph_id[0]))) for _, a, b in suite], "graph_a string, graph_b string")
    return c.join(names, ["graph_a", "graph_b"]).select("graph_a", "graph_b", F.abs(_r("walk_distance")).alias("walk_distance"))


@query("G22_signatures", f"WITH {STAR}, v AS (SELECT graph_id, unnest([-sqrt(k), 0, sqrt(k)]) AS v, unnest([1, k - 1, 1]) AS n FROM star), b AS (SELECT graph_id, CASE WHEN round(v, 9) = 4 THEN 3 ELSE floor((round(v, 9) + 4) / 2)::INTEGER END AS bin, sum(n) AS n FROM v WHERE round(v, 9) BETWEEN -4 AND 4 AND n > 0 GROUP BY ALL) SELECT graph_id, bin, round(n / sum(n) OVER (PARTITION BY graph_id), 6) AS share FROM b")
def _(spark, d):
    s = S.signatures(*stars(spark, d))
    return s.select("graph_id", F.posexplode("signature").alias("bin", "share")).where("share > 0").select("graph_id", "bin", _r("share").alias("share"))


_MATCHES = f"""{STAR}, ms AS (SELECT DISTINCT k AS m FROM star UNION SELECT unnest(range(2, 7))),
ev AS (SELECT m, unnest([-sqrt(m), 0, sqrt(m)]) AS v, unnest([1, m - 1, 1]) AS n FROM ms),
bs AS (SELECT m, CASE WHEN round(v, 9) = 4 THEN 3 ELSE floor((round(v, 9) + 4) / 2)::INTEGER END AS bin, sum(n) AS n FROM ev WHERE round(v, 9) BETWEEN -4 AND 4 AND n > 0 GROUP BY ALL),
sh AS (SELECT m, bin, n / sum(n) OVER (PARTITION BY m) AS share FROM bs),
sig AS (SELECT ms.m, list(coalesce(share, 0) ORDER BY r.b) AS s FROM ms CROSS JOIN range(4) r(b) LEFT JOIN sh ON sh.m = ms.m AND bin = r.b GROUP BY ms.m),
sq AS (SELECT m, s, list_sum(list_transform(s, lambda x: x * x)) AS q FROM sig),
arch(archetype, r, extra) AS (VALUES ('shared_ip_star', 1, 1), ('shared_cert_star', 2, 1), ('dense_multi_signal', 3, 2)),
d AS (SELECT graph_id, k + 1 AS n_nodes, archetype, r, b.m AS size, b.m + extra AS full_, round(sqrt(CASE r WHEN 1 THEN pow(list_distance(a.s, b.s), 2) WHEN 2 THEN a.q + b.q ELSE a.q + b.q / 2 END), 12) AS d FROM star JOIN sq a ON a.m = star.k CROSS JOIN arch CROSS JOIN (SELECT * FROM sq WHERE m BETWEEN 2 AND 6) b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY d, r, size) AS rank FROM d)"""


@query("G23_missing_nodes", f"WITH {_MATCHES} SELECT graph_id, CASE WHEN full_ > n_nodes OR d < 0.2 THEN archetype END AS best_archetype, full_::INTEGER AS best_size, round(d, 6) AS match_distance, greatest(0, full_ - n_nodes)::INTEGER AS missing, CASE WHEN full_ > n_nodes THEN 'domain' END AS likely_type, CASE WHEN d < 0.05 THEN 'high' WHEN d < 0.15 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank = 1")
def _(spark, d):
    return S.missing_nodes(S.signatures(*stars(spark, d))).withColumn("match_distance", _r("match_distance"))


@query("W3_archetype_matches", f"WITH {_MATCHES} SELECT graph_id, rank::INTEGER AS rank, archetype, size::INTEGER AS size, round(d, 6) AS d FROM ranked WHERE rank <= 5")
def _(spark, d):
    return S.archetype_matches(S.signatures(*stars(spark, d)), 5).select("graph_id", "rank", "archetype", "size", _r("d").alias("d"))


@query("G23_campaign_nodes")
def _(spark, d):
    return S.missing_nodes(S.signatures(*campaign(spark, d)))


@query("G21_archetypes", "SELECT name || '_' || size AS graph_id, size + CASE WHEN name = 'dense_multi_signal' THEN 2 ELSE 1 END AS nodes FROM (VALUES ('shared_ip_star'), ('shared_cert_star'), ('dense_multi_signal')) a(name), range(2, 7) r(size)")
def _(spark, d):
    n, _e = fixtures.frames(spark, [(a[2], a[3]) for a in fixtures.archetypes()])
    return n.groupBy("graph_id").agg(F.count("*").alias("nodes"))


@query("G27_spectral_layout")
def _(spark, d):
    s = S.spectra(*stars(spark, d), variant="laplacian")
    at = lambda k: F.get("eigenvectors", F.col("pos") * F.col("n") + F.when(F.col("n") > k, k).otherwise(0)) * 10
    return s.select("graph_id", "n", "eigenvectors", F.posexplode("node_order").alias("pos", "node")).select("graph_id", "node", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


@query("G28_demo_graph", "SELECT 19 AS nodes, 26 AS edges")
def _(spark, d):
    n, e = fixtures.frames(spark, [fixtures.demo()])
    return n.agg(F.count("*").cast("int").alias("nodes")).crossJoin(e.agg(F.count("*").cast("int").alias("edges")))


@query("R2_validation")
def _(spark, d):
    return S.unitarity(*stars(spark, d)).groupBy("t").agg(F.max("max_error").alias("max_error"), F.max("series_error").alias("series_error"), F.bool_and("is_unitary").alias("is_unitary"))


# ----------------------------------------------------------------------------------------- embeddings

POOLED = "pooled AS (SELECT label, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"


def _pooled(spark, d):
    flat = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return flat.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))


@query("A11_mean_pooling", f"WITH {POOLED} SELECT label, list_transform(v, lambda x: round(x, 6)) AS v FROM pooled")
def _(spark, d):
    return _pooled(spark, d).withColumn("v", F.transform("v", lambda x: F.round(x, 6)))


@query("J8_pairwise_distance", f"WITH {POOLED} SELECT a.label AS a, b.label AS b, round(1 - list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean FROM pooled a JOIN pooled b ON a.label < b.label")
def _(spark, d):
    p = _pooled(spark, d)
    m = p.toDF("a", "va").join(p.toDF("b", "vb"), F.col("a") < F.col("b"))
    return m.select("a", "b", _r(C.distance(F.col("va"), F.col("vb"))).alias("cosine"), _r(C.distance(F.col("va"), F.col("vb"), "euclidean")).alias("euclidean"))


@query("X15_distance_to_centre", f"WITH {POOLED} SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings JOIN pooled USING (label)")
def _(spark, d):
    return read(spark, d, "embeddings").join(_pooled(spark, d), "label").select("vec_id", _r(C.distance(F.col("embedding"), F.col("v"))).alias("cosine"))


@query("W6_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, d):
    return G.first_of_each(read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


from gossamer.plans import reports  # noqa: E402, F401
