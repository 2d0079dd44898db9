"""Readers of captured signals, job lists, caches, and the sinks of a batch run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.functions import fixed as X

RESULTS = (
    "url string, domain string, label int, node_count long, edge_count long, truncated boolean, truncated_counts string, modules_succeeded string, modules_failed string, status string, error string"
)


def phishing_feed(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """A feed with a header, all of it or its first ``n`` lines; short lines end in nulls, long ones are cut."""
    df = spark.read.option("header", True).csv(path)
    return df if n is None else df.orderBy(F.col("_metadata.file_path"), F.monotonically_increasing_id()).limit(n)


def write_dated(df: DataFrame, path: str, name: str, date: str) -> str:
    """``df`` as CSV with a header under the source's name and the date; returns the path."""
    target = f"{path}/{name}_{date}"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def benign_list(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Lines ``rank,domain`` without a header, in a text file or a zip archive."""
    if path.lower().endswith(".zip"):
        lines = unzipped(spark.read.format("binaryFile").load(path).select("content"))
    else:
        lines = spark.read.text(path).select(F.col("value").alias("line"))
    return benign_rows(lines, n)


def benign_rows(lines: DataFrame, n: int | None = None) -> DataFrame:
    parts = F.split("line", ",", 2)
    df = lines.where(F.size(parts) > 1).select(F.trim(parts[0]).cast("int").alias("rank"), F.trim(parts[1]).alias("domain"), F.lit(0).alias("label"))
    return df if n is None else df.orderBy("rank", "domain").limit(n)


def unzipped(archives: DataFrame) -> DataFrame:
    """(line) of the text files in archives (content); lines stream out in batches."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            held: list[str] = []
                            for line in io.TextIOWrapper(f, "utf-8"):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array(held)], names=["line"])
                                    held = []
                            if held:
                                yield pa.RecordBatch.from_arrays([pa.array(held)], names=["line"])

    return archives.mapInArrow(run, "line string")


def phishing_jobs(feed: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """(url, full_domain, label 1): blank URLs go, and of a registered domain the first by ``order`` stays.

    ``n`` keeps the first jobs by ``order``.
    """
    urls = [F.col(c) for c in feed.columns if c in ("url", "URL", "phish_url")]
    df = feed.withColumn("_u", F.trim(F.coalesce(*urls))).where(F.col("_u") != "")
    df = df.withColumn("full_domain", C.url_parts(F.col("_u"))["full_domain"])
    df = df.groupBy("full_domain").agg(F.min(F.struct(order, "_u")).alias("_f"))
    df = df if n is None else df.orderBy("_f").limit(n)
    return df.select(F.col("_f._u").alias("url"), "full_domain", F.lit(1).alias("label"))


def benign_jobs(domains: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, full_domain, label 0) of distinct domains that no phishing job has."""
    df = domains.select(F.trim("domain").alias("full_domain")).where("full_domain <> ''").distinct()
    return df.join(seen.select("full_domain"), "full_domain", "left_anti").select(F.concat(F.lit("https://"), "full_domain").alias("url"), "full_domain", F.lit(0).alias("label"))


def dns_answers(lookups: DataFrame) -> DataFrame:
    """(domain, ips, ttl, resolved, error) from (domain, outcome, ips, ttl): known outcomes are the error's class."""
    ok = F.col("outcome") == "ok"
    error = F.when(F.col("outcome").isin("NXDOMAIN", "NoAnswer", "Timeout"), F.col("outcome")).otherwise(F.concat(F.lit("UnknownError: "), "outcome"))
    return lookups.select("domain", F.when(ok, F.col("ips")).alias("ips"), F.when(ok, F.col("ttl")).alias("ttl"), ok.alias("resolved"), F.when(~ok, error).alias("error"))


def dns_rows(dns: DataFrame) -> DataFrame:
    """(domain, ip, weight) of resolved lookups."""
    return dns.where("resolved").select("domain", F.explode("ips").alias("ip"), C.ttl_weight(F.col("ttl")).alias("weight"))


def whois_rows(whois: DataFrame, as_of: Column) -> DataFrame:
    """(domain, registrar, age_days, weight): the first of several registrars; age at a given date."""
    age = F.datediff(as_of, F.to_date("creation_date"))
    return whois.where(C.bare_domain(F.col("domain"))).select("domain", F.get("registrar", F.lit(0)).alias("registrar"), age.alias("age_days"), C.age_weight(age).alias("weight"))


def logged_names(log: DataFrame) -> DataFrame:
    """(domain, name, issuer), distinct, from (domain, name_value, issuer) with names apart by lines."""
    names = log.select("domain", "issuer", F.explode(F.split("name_value", "\n")).alias("name"))
    return names.withColumn("name", F.trim("name")).where("name <> ''").distinct()


def listed_names(log: DataFrame) -> DataFrame:
    """(domain, name, issuer), distinct, from (domain, dns_names, issuer); names may be markdown links."""
    names = log.select("domain", "issuer", F.explode("dns_names").alias("name"))
    return names.withColumn("name", clean_name(F.col("name"))).where("name <> ''").distinct()


def peer_rows(names: DataFrame) -> DataFrame:
    """(domain, peer), distinct: a row for each name of another site, however many there are."""
    return names.where(~F.contains(F.col("name"), F.col("domain"))).select("domain", F.col("name").alias("peer")).distinct()


def peer_records(names: DataFrame) -> DataFrame:
    """(domain, shared_domains, cert_count, issuer): one record a domain, its peers sorted; the issuer is the smallest."""
    per = peer_rows(names).groupBy("domain").agg(F.array_sort(F.collect_list("peer")).alias("shared_domains"))
    out = names.groupBy("domain").agg(F.min("issuer").alias("issuer")).join(per, "domain", "left")
    shared = F.coalesce("shared_domains", F.array().cast("array<string>"))
    return out.select("domain", shared.alias("shared_domains"), "issuer", F.size(shared).alias("cert_count"))


def cert_peers(log: DataFrame) -> DataFrame:
    """The record of a domain from the first log."""
    return peer_records(logged_names(log))


def clean_name(c: Column) -> Column:
    """A name without a markdown link around it."""
    return F.trim(F.when(c.rlike(r"^\[[^\]]*\]\("), F.regexp_extract(c, r"^\[([^\]]*)\]", 1)).otherwise(c))


def subdomains_of(log: DataFrame) -> DataFrame:
    """(domain, subdomains) from the same log: names under the domain, without wildcards."""
    own = F.endswith(F.col("name"), F.concat(F.lit("."), F.col("domain"))) & ~F.startswith(F.col("name"), F.lit("*"))
    names = logged_names(log).groupBy("domain", "name").agg(F.lit(1)).withColumn("name", F.when(own, F.col("name")))
    return names.groupBy("domain").agg(F.array_sort(F.collect_list("name")).alias("subdomains"))


def guessed_subdomains(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, subdomains) of the 18 usual names that resolve."""
    words = F.explode(F.array(*map(F.lit, X.SUBDOMAIN_WORDS)))
    guess = domains.select("domain", words.alias("w")).withColumn("n", F.concat_ws(".", "w", "domain"))
    known = dns.where("resolved").select(F.col("domain").alias("n"))
    return guess.join(known, "n", "left_semi").groupBy("domain").agg(F.array_sort(F.collect_set("n")).alias("subdomains"))


def merged_subdomains(domains: DataFrame, logged: DataFrame, guessed: DataFrame) -> DataFrame:
    """(domain, subdomains, count, via_ct, via_dns, resolved): both sources' names, and which source had which.

    Guessing always resolves, so the record does.
    """
    none = F.array().cast("array<string>")
    out = domains.select("domain").distinct().join(logged.withColumnRenamed("subdomains", "ct"), "domain", "left").join(guessed.withColumnRenamed("subdomains", "dns"), "domain", "left")
    out = out.withColumns({"via_ct": F.coalesce("ct", none), "via_dns": F.coalesce("dns", none)})
    both = F.array_sort(F.array_union("via_ct", "via_dns"))
    return out.select("domain", both.alias("subdomains"), F.size(both).alias("count"), "via_ct", "via_dns", F.lit(True).alias("resolved"))


def first_resolved(key: str, *sources: DataFrame) -> DataFrame:
    """Source fallback: of tables with the same columns, a key's row from the first that resolved it."""
    rows = [s.withColumn("_k", F.lit(k)) for k, s in enumerate(sources)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    names = sources[0].columns
    best = out.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(~F.col("resolved"), "_k")).alias("_b"))
    return best.select(*(F.col(f"_b.{c}").alias(c) for c in names))


def cached(cache: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Entries that are not older than ``days``; failures are never in a cache."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("cached_at")
    return cache.where(age <= days * 86400).withColumn("_from_cache", F.lit(True))


def tls_facts(tls: DataFrame, as_of: Column) -> DataFrame:
    """Issuer, dates and days from (domain, issuer map, subject map, not_before, not_after)."""
    when = lambda c: F.to_timestamp(F.regexp_replace(c, r"\s+", " "), "MMM d HH:mm:ss yyyy z")
    a, b = when("not_before"), when("not_after")
    return tls.select(
        "domain", F.coalesce(F.col("issuer")["O"], F.col("issuer")["CN"]).alias("issuer"), F.date_format(a, "yyyy-MM-dd").alias("valid_from"), F.date_format(b, "yyyy-MM-dd").alias("valid_until"),
        F.datediff(b, a).alias("validity_days"), F.datediff(b, as_of).alias("days_until_expiry"), (F.to_json("issuer") == F.to_json("subject")).alias("is_self_signed"),
    )


def with_public_suffix(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the column public_suffix of each host by a table of rules (rule): plain, ``*.x`` and ``!y.x``.

    The longest rule that fits wins, an exception before any; where none fits it is the last label. Hosts are looked up
    once each, and the rules (some ten thousand) are joined by their names.
    """
    host = C.host(F.col(url))
    hosts = urls.select(host.alias("_host")).where("_host <> ''").distinct()
    labels = F.split("_host", r"\.")
    n = F.size(labels)
    ends = hosts.where(~C.is_ip(F.col("_host"))).select("_host", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("name", F.concat_ws(".", F.slice(F.split("_host", r"\."), -F.col("k"), F.col("k"))))
    said = F.when(F.startswith("rule", F.lit("!")), F.substring("rule", 2, 1 << 20)).otherwise(F.regexp_replace("rule", r"^\*\.", ""))
    kind = F.when(F.startswith("rule", F.lit("!")), 2).when(F.startswith("rule", F.lit("*.")), 1).otherwise(0)
    table = rules.select(F.lower(said).alias("name"), kind.alias("kind"))
    # A wildcard covers one label more than it names, an exception one less.
    fits = ends.join(table, "name").withColumn("size", F.col("k") + F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, -1).otherwise(0))
    fits = fits.join(hosts.select("_host", F.size(F.split("_host", r"\.")).alias("n")), "_host").where("size <= n")
    best = fits.groupBy("_host").agg(F.max(F.struct((F.col("kind") == 2).alias("x"), "size")).alias("b"))
    known = best.select("_host", F.concat_ws(".", F.slice(F.split("_host", r"\."), -F.col("b.size"), F.col("b.size"))).alias("_known"))
    out = urls.withColumn("_host", host).join(known, "_host", "left")
    last = F.when(F.instr("_host", ".") > 0, F.substring_index("_host", ".", -1)).otherwise("")
    return out.withColumn("public_suffix", F.when(C.is_ip(F.col("_host")), "").otherwise(F.coalesce("_known", last))).drop("_host", "_known")


def rdap_facts(rdap: DataFrame) -> DataFrame:
    """(ip, asn, as_name, country) from a JSON answer: the number, else the handle; the name, else the registrant's."""
    j = F.from_json("body", "autnum string, handle string, name string, country string, entities array<struct<roles:array<string>,name:string>>")
    who = F.get(F.filter(j["entities"], lambda e: F.array_contains(e["roles"], "registrant")), F.lit(0))["name"]
    return rdap.select("ip", F.coalesce(j["autnum"], j["handle"]).alias("asn"), F.coalesce(j["name"], who).alias("as_name"), j["country"].alias("country"))


def geo_facts(geo: DataFrame) -> DataFrame:
    j = F.from_json("body", "status string, country string, city string, lat double, lon double, isp string, message string")
    bad = j["status"] == "fail"
    return geo.select("ip", *(F.when(~bad, j[c]).alias(c) for c in ("country", "city", "lat", "lon", "isp")), (~bad).alias("resolved"), F.when(bad, j["message"]).alias("error"))


def shared_hosts(answers: DataFrame, most: int = X.SHARED_LINES) -> DataFrame:
    """(ip, co_hosted_domains, count, resolved) from a text with a domain a line; error texts and floods fail."""
    lines = F.filter(F.transform(F.split("body", "\n"), F.trim), lambda x: x != "")
    bad = F.lower("body").contains("error") | F.contains(F.col("body"), F.lit("API count exceeded")) | (F.size(lines) > most)
    return answers.select("ip", F.when(~bad, lines).alias("co_hosted_domains"), F.when(~bad, F.size(lines)).alias("count"), (~bad).alias("resolved"), F.when(bad, F.col("body")).alias("error"))


def co_hosts(shared: DataFrame, most: int = X.CO_HOSTS) -> DataFrame:
    """(ip, co_host): the first ``most``, of which those that look real (in this order)."""
    return shared.where("resolved").select("ip", F.explode(F.filter(F.slice("co_hosted_domains", 1, most), C.looks_real)).alias("co_host"))


def redirect_ends(hops: DataFrame, most: int = X.HOPS) -> DataFrame:
    """(url, final_url, chain, hop_count, resolved, error) from (url, next), next being null at an end.

    Follows at most ``most`` hops; a URL that still goes on then is a failure.
    """
    step = hops.where("next IS NOT NULL").groupBy(F.col("url").alias("at")).agg(F.min("next").alias("to"))
    now = hops.select("url").distinct().select("url", F.col("url").alias("at"), F.array("url").alias("chain"))
    for _ in range(most):
        now = now.join(step, "at", "left").select("url", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("to"))).alias("chain"))
    more = now.join(step, "at", "left").withColumn("resolved", F.col("to").isNull())
    return more.select("url", F.when(F.col("resolved"), F.col("at")).alias("final_url"), "chain", (F.size("chain") - 1).alias("hop_count"), "resolved", F.when(~F.col("resolved"), "TooManyRedirects").alias("error"))


def page_records(fetches: DataFrame) -> DataFrame:
    """One record a domain: the https fetch, or the http one where https failed in the TLS handshake.

    ``fetches`` has (domain, scheme, status, error, headers, final_url, html).
    """
    columns = F.struct("scheme", "status", "error", "headers", "final_url", "html")
    both = fetches.groupBy("domain").agg(F.min_by(columns, F.when(F.col("scheme") == "https", 0)).alias("s"), F.min_by(columns, F.when(F.col("scheme") == "http", 0)).alias("h"))
    f = F.when(F.startswith(F.col("s.error"), F.lit("SSLError")) & F.col("h").isNotNull(), F.col("h")).otherwise(F.col("s"))
    p = both.select("domain", f.alias("f")).select("domain", "f.*")
    title, text = C.title(F.col("html")), C.meta_description(F.col("html"))
    return p.select(
        "domain", "scheme", "final_url", "status", C.server(F.col("headers")).alias("server_header"), C.security_headers(F.col("headers")).alias("headers_present"),
        C.security_headers(F.col("headers"), False).alias("headers_missing"), title.alias("page_title"), text.alias("meta_description"), C.brands(title, text).alias("brands"),
        F.col("error").isNull().alias("resolved"), "error", "html",
    )


def jarm_facts(scans: DataFrame) -> DataFrame:
    """(domain, jarm, is_null_jarm, node, resolved, error) from (domain, jarm, error); a URL is no domain."""
    bad = ~C.bare_domain(F.col("domain"))
    error = F.when(bad, "InvalidInput: pass a bare domain, not a full URL").otherwise(F.col("error"))
    null = F.coalesce(F.col("jarm"), F.lit("")).isin("", X.NULL_JARM)
    ok = error.isNull()
    return scans.select("domain", F.when(ok, F.col("jarm")).alias("jarm"), F.when(ok, null).alias("is_null_jarm"), F.when(ok & ~null, F.concat(F.lit("jarm:"), "jarm")).alias("node"), ok.alias("resolved"), error.alias("error"))


def icons(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """(url, icon_url, icon_hash, strategy) of every page: its best icon that was fetched whole; then /favicon.ico; then that of
    ``origin`` (the first host of the chain, if ``pages`` has such a column); else none."""
    root = lambda c: F.regexp_extract(c, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    listed = pages.select("url", F.posexplode(C.icon_candidates(F.col("url"), F.col("html"))).alias("k", "c")).select("url", "k", F.col("c.url").alias("icon_url"), F.lit("link").alias("strategy"))
    tried = listed.unionByName(pages.select("url", F.lit(1 << 20).alias("k"), F.concat(root("url"), F.lit("/favicon.ico")).alias("icon_url"), F.lit("usual").alias("strategy")))
    if "origin" in pages.columns:
        tried = tried.unionByName(pages.select("url", F.lit(1 << 21).alias("k"), F.concat(root("origin"), F.lit("/favicon.ico")).alias("icon_url"), F.lit("origin").alias("strategy")))
    good = resources.where((F.col("status") == 200) & (F.length("content") >= X.ICON_BYTES)).select(F.col("url").alias("icon_url"), F.md5("content").alias("icon_hash"))
    best = tried.join(good, "icon_url").groupBy("url").agg(F.min(F.struct("k", "icon_url", "icon_hash", "strategy")).alias("b"))
    return pages.select("url").distinct().join(best, "url", "left").select("url", "b.icon_url", "b.icon_hash", F.coalesce("b.strategy", F.lit("none")).alias("strategy"))


def unfinished(jobs: DataFrame, results: DataFrame, retry_errors: bool = True) -> DataFrame:
    """Resume: jobs without a result; with ``retry_errors`` a failed one counts as none."""
    done = results.where("status = 'ok'") if retry_errors else results
    return jobs.join(done.select("url"), "url", "left_anti")


def excluded(results: DataFrame) -> DataFrame:
    """How many rows may not be learnt from."""
    return usable(results).agg(F.count_if(~F.col("usable_for_training")).alias("n_excluded"), F.count("*").alias("n"))


def result_rows(graphs: DataFrame) -> DataFrame:
    """Rows of a batch's results: counts as JSON, modules joined by bars, errors cut."""
    return graphs.withColumns({"truncated_counts": F.to_json("truncated_counts"), "modules_succeeded": C.joined(F.col("modules_succeeded")), "modules_failed": C.joined(F.col("modules_failed"))})


def scanned_results(spark: SparkSession, path: str, schema: str = RESULTS) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a results CSV with a header: lines that don't fit the schema are set aside, not lost."""
    names = [c.split()[0] for c in schema.split(", ")]
    lines = spark.read.text(path).where(F.col("value") != ",".join(names))
    row = F.from_csv("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = lines.select("value", row.alias("r"))
    return df.where(F.col("r._bad").isNull()).select(*(F.col(f"r.{c}").alias(c) for c in names)), df.where(F.col("r._bad").isNotNull()).select(F.col("value").alias("line"))


def usable(results: DataFrame) -> DataFrame:
    dead = (F.col("label") == 0) & F.coalesce(F.col("modules_failed").rlike("dns:NXDOMAIN|dns:NoAnswer"), F.lit(False))
    return results.withColumn("usable_for_training", ~dead)


def append_results(results: DataFrame, path: str) -> str:
    """Append to a Parquet table of results; if its columns differ, a new version is begun beside it.

    Returns the path that was written.
    """
    spark, k = results.sparkSession, 1
    while True:
        target = f"{path}/v{k}"
        try:
            same = set(spark.read.parquet(target).columns) == set(results.columns)
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            same = True
        if same:
            results.write.mode("append").parquet(target)
            return target
        k += 1


def write_graphs(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Three tables; graphs are laid out by label."""
    graphs.write.mode("overwrite").partitionBy("label").parquet(f"{path}/graphs")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def first_graphs(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` graphs by name: the explicit bound of comparisons of all pairs."""
    names = nodes.select("graph_id").distinct().orderBy("graph_id").limit(most)
    return nodes.join(F.broadcast(names), "graph_id", "left_semi"), edges.join(F.broadcast(names), "graph_id", "left_semi")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("graphs", "nodes", "edges"))
