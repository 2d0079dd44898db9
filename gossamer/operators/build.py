"""From seed URLs and captured answers to ego-graphs, all of them in one job, with a log of what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.operators import graph as G
from gossamer.sources import signals as S
from gossamer.sources.scratch import written

#: Modules in the order in which a graph meets them; the last three are asked for each server.
MODULES = ["redirect_chain", "dns", "whois", "cert", "ssl", "page_meta", "subdomains", "jarm", "asn", "geo", "shared"]


def answers(frames: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Captured tables (see ``sources.captured``) read by their parsers."""
    dns = S.dns_answers(frames["dns"])
    first, second = S.peer_records(S.logged_names(frames["ct"])), S.peer_records(S.listed_names(frames["spotter"]))
    peers = written(S.first_resolved("domain", *(x.withColumn("resolved", F.lit(True)) for x in (first, second))), "peers")
    pages = written(S.page_records(frames["fetches"]), "page-records")
    found = pages.where("resolved").select(F.col("final_url").alias("url"), "html", F.concat(F.lit("https://"), "domain").alias("origin"))
    icons = S.icons(found, frames["resources"])
    pages = written(pages.drop("html").join(icons.select(F.col("url").alias("final_url"), "icon_hash"), "final_url", "left"), "pages")
    domains = dns.select("domain").unionByName(peers.select("domain")).distinct()
    return {
        "hops": written(S.redirect_ends(frames["hops"]), "hops"), "dns": dns, "whois": frames["whois"], "cert": peers, "ssl": S.tls_facts(frames["tls"], as_of), "page_meta": pages,
        "subdomains": written(S.merged_subdomains(domains, S.subdomains_of(frames["ct"]), S.guessed_subdomains(domains, dns)), "subdomains"), "jarm": S.jarm_facts(frames["jarm"]),
        "asn": S.rdap_facts(frames["rdap"]), "geo": S.geo_facts(frames["geo"]), "shared": S.shared_hosts(frames["shared"]),
    }


def targets(seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """``seeds`` (graph_id, url, label) with the URL that redirects end at, and its registered domain."""
    s = seeds.join(hops.select("url", "final_url", "hop_count", "resolved", F.col("error").alias("_error")), "url", "left")
    s = s.withColumns({"original_url": F.col("url"), "url": F.when(F.coalesce("resolved", F.lit(False)), F.col("final_url")).otherwise(F.col("url"))})
    return s.select(
        "graph_id", "label", "url", "original_url", F.coalesce("hop_count", F.lit(0)).alias("redirect_hop_count"), C.url_parts(F.col("url"))["full_domain"].alias("domain"),
        F.coalesce("resolved", F.lit(False)).alias("_ok"), F.when(F.col("resolved").isNull(), "not captured").otherwise(F.col("_error")).alias("_error"),
    )


def module_log(roots: DataFrame, ips: DataFrame, a: dict[str, DataFrame]) -> DataFrame:
    """(graph_id, modules_succeeded, modules_failed): each module once, a failure as module:error, distinct."""
    ok, error = F.col("_ok"), F.col("_error")
    state = {
        "dns": a["dns"].select("domain", F.col("resolved").alias("_ok"), error_of("error")),
        "whois": a["whois"].where(C.bare_domain(F.col("domain"))).select("domain", F.get("registrar", F.lit(0)).isNotNull().alias("_ok"), error_of("error")),
        "cert": a["cert"].select("domain", F.lit(True).alias("_ok"), F.lit(None).cast("string").alias("_error")),
        "ssl": a["ssl"].select("domain", F.lit(True).alias("_ok"), F.lit(None).cast("string").alias("_error")),
        "page_meta": a["page_meta"].select("domain", F.col("resolved").alias("_ok"), error_of("error")),
        "subdomains": a["subdomains"].select("domain", F.lit(True).alias("_ok"), F.lit(None).cast("string").alias("_error")),
        "jarm": a["jarm"].select("domain", F.col("node").isNotNull().alias("_ok"), F.coalesce("error", F.lit("null_jarm")).alias("_error")),
    }
    each = {
        "asn": a["asn"].select("ip", F.col("asn").isNotNull().alias("_ok"), F.lit(None).cast("string").alias("_error")),
        "geo": a["geo"].select("ip", (F.col("resolved") & F.col("country").isNotNull()).alias("_ok"), error_of("error")),
        "shared": a["shared"].select("ip", F.col("resolved").alias("_ok"), C.short_error(F.col("error")).alias("_error")),
    }
    rows = roots.select("graph_id", F.lit("redirect_chain").alias("module"), "_ok", "_error")
    for name, df in [*state.items(), *each.items()]:
        base, key = (roots.select("graph_id", "domain"), "domain") if name in state else (ips, "ip")
        got = base.join(df.withColumn("_met", F.lit(True)), key, "left")
        rows = rows.unionByName(got.select("graph_id", F.lit(name).alias("module"), F.coalesce("_ok", F.lit(False)).alias("_ok"), F.when(F.col("_met").isNull(), "not captured").otherwise(error).alias("_error")))
    order = F.array_position(F.array(*map(F.lit, MODULES)), F.col("module")).cast("int")
    rows = rows.withColumns({"ord": order, "text": F.concat("module", F.lit(":"), F.coalesce(error, F.lit("None")))})
    names = lambda c: F.transform(F.array_sort(c), lambda x: x["text"])
    good = F.collect_set(F.when(ok, F.struct("ord", F.col("module").alias("text"))))
    bad = F.collect_set(F.when(~ok, F.struct("ord", "text")))
    return rows.groupBy("graph_id").agg(names(good).alias("modules_succeeded"), names(bad).alias("modules_failed"))


def error_of(column: str) -> Column:
    return F.col(column).alias("_error")


def build_graphs(seeds: DataFrame, a: dict[str, DataFrame], as_of: Column, protect_root: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of seeds whose URL has a registered domain; a module that fails leaves its part out."""
    roots = written(targets(seeds, a["hops"]).where("domain <> ''"), "roots")
    at = roots.select("graph_id", "domain")
    dns = at.join(S.dns_rows(a["dns"]), "domain")
    ips = written(dns.select("graph_id", "ip").distinct(), "servers")
    real = lambda c: F.explode(F.filter(F.col(c), C.looks_real))
    named = F.concat_ws("|", F.coalesce("asn", F.lit("None")), F.coalesce("as_name", F.lit("None")))
    signals = {
        "dns": dns,
        "whois": at.join(S.whois_rows(a["whois"], as_of), "domain").where("registrar IS NOT NULL"),
        "cert": at.join(a["cert"].select("domain", real("shared_domains").alias("peer")), "domain"),
        "icon": at.join(a["page_meta"].where("icon_hash IS NOT NULL").select("domain", F.concat(F.lit("favicon:"), "icon_hash").alias("favicon")), "domain"),
        "subdomain": at.join(a["subdomains"].select("domain", real("subdomains").alias("subdomain")), "domain"),
        "jarm": at.join(a["jarm"].where("node IS NOT NULL").select("domain", F.col("node").alias("jarm")), "domain"),
        "asn": ips.join(a["asn"].where("asn IS NOT NULL").select("ip", named.alias("asn")), "ip"),
        "geo": ips.join(a["geo"].where("country IS NOT NULL").select("ip", F.concat_ws("|", F.coalesce("city", F.lit("None")), "country").alias("geo")), "ip"),
        "shared": ips.join(S.co_hosts(a["shared"]), "ip").withColumn("weight", F.lit(0.5)),
    }
    nodes, edges = G.assemble(signals, protect_root, roots=at.select("graph_id", F.col("domain").alias("node")))
    with_root = written(nodes.join(at, "graph_id"), "nodes")
    nodes, edges, cut = G.trimmed(with_root, edges, F.col("node") == F.col("domain"))
    nodes, edges = written(nodes.drop("domain"), "nodes"), written(edges, "edges")
    graphs = roots.drop("_ok", "_error").join(G.sizes(nodes, edges), "graph_id", "left").join(cut, "graph_id", "left").join(module_log(roots, ips, a), "graph_id", "left")
    page = a["page_meta"].select("domain", C.mismatched(F.col("brands"), F.col("domain")).alias("brand_mismatch"))
    graphs = graphs.join(page, "domain", "left").join(a["ssl"].select("domain", "is_self_signed"), "domain", "left")
    return graphs.withColumn("truncated", F.size("truncated_counts") > 0), nodes, edges


def findings(graphs: DataFrame, nodes: DataFrame, most: int = 3) -> DataFrame:
    """(graph_id, rank, node, text): up to ``most`` findings a graph: flagged hosts, a claimed brand, a self-signed
    certificate, three or more peers of a certificate."""
    hosts = nodes.where("type = 'asn'").withColumn("asn", F.substring_index("node", "|", 1))
    flagged = G.asn_reputation(hosts).where("is_flagged")
    peers = nodes.where("type = 'cert_peer'").groupBy("graph_id").agg(F.count("*").alias("n")).where("n >= 3")
    brand = F.initcap(F.get("brand_mismatch", F.lit(0)))
    row = lambda df, k, at, node, text: df.select("graph_id", F.lit(k).alias("kind"), at.alias("at"), node.alias("node"), text.alias("text"))
    zero, domain = F.lit(0), F.col("domain")
    every = row(flagged, 0, F.col("node_idx"), F.col("node"), F.concat(F.lit("⚠ Hosted by a provider flagged as: "), F.replace("tier", F.lit("_"), F.lit(" "))))
    every = every.unionByName(row(graphs.where(F.size("brand_mismatch") > 0), 1, zero, domain, F.concat(F.lit('⚠ Page claims to be "'), brand, F.lit('" but the address doesn\'t match'))))
    every = every.unionByName(row(graphs.where("is_self_signed"), 2, zero, domain, F.lit("⚠ Uses a self-signed certificate (not independently verified)")))
    every = every.unionByName(row(graphs.join(peers, "graph_id"), 3, zero, domain, F.concat(F.lit("🔗 Shares a security certificate with "), F.col("n").cast("string"), F.lit(" other sites"))))
    first = F.slice(F.array_sort(F.collect_list(F.struct("kind", "at", "node", "text"))), 1, most)
    return every.groupBy("graph_id").agg(first.alias("f")).select("graph_id", F.posexplode("f").alias("k", "f")).select("graph_id", (F.col("k") + 1).alias("rank"), "f.node", "f.text")


def batch_results(graphs: DataFrame) -> DataFrame:
    """Rows of the batch's results table, as text where a list or a map is."""
    rows = graphs.select("url", "domain", "label", "node_count", "edge_count", "truncated", "truncated_counts", "modules_succeeded", "modules_failed", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return S.result_rows(rows)
