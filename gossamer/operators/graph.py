"""Graphs as two tables: nodes (graph_id, node, node_idx, type) and edges (graph_id, src, dst, edge_idx, relation, weight)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.functions import fixed as X
from gossamer.sources.scratch import delete, written

#: Links of a graph beyond which its components are found by rounds over all tasks instead of in one task.
WHOLE = 1 << 20

#: Signals in the order in which they add to a graph; later ones win.
ORDER = ["dns", "whois", "cert", "icon", "subdomain", "jarm", "asn", "geo", "shared"]
#: signal: (source column, target column, source type, target type, relation)
SHAPE = {
    "dns": ("domain", "ip", "domain", "ip", "resolves-to"),
    "whois": ("domain", "registrar", "domain", "registrar", "registered-by"),
    "cert": ("domain", "peer", "domain", "cert_peer", "shares-cert"),
    "icon": ("domain", "favicon", "domain", "favicon", "uses-favicon"),
    "subdomain": ("domain", "subdomain", "domain", "subdomain", "has-subdomain"),
    "jarm": ("domain", "jarm", "domain", "jarm", "server-fingerprint"),
    "asn": ("ip", "asn", "ip", "asn", "hosted-in"),
    "geo": ("ip", "geo", "ip", "geo", "located-in"),
    "shared": ("ip", "co_host", "ip", "co_host", "also-hosts"),
}


def assemble(signals: dict[str, DataFrame], protect_root: bool = True, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Graphs from signal tables, all of them at once.

    Each signal has graph_id, the two columns of its shape, and optionally weight (1.0 if not). A node's
    type is that of the last signal that has it; with ``protect_root`` a domain stays a domain. ``roots`` (graph_id,
    node) are there even if no signal has them.
    """
    used = [n for n in ORDER if n in signals]
    parts = []
    for k, name in enumerate(used):
        a, b, _, _, relation = SHAPE[name]
        df = signals[name]
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        parts.append(df.select("graph_id", F.col(a).alias("src"), F.col(b).alias("dst"), weight.alias("weight"), F.lit(k).alias("step")))
    all_edges = parts[0]
    for p in parts[1:]:
        all_edges = all_edges.unionByName(p)
    # what is aggregated are numbers, so rows are hashed, not sorted: a step says the type, the relation and which weight
    types = [t for name in used for t in SHAPE[name][2:4]]
    end = lambda c, k: F.struct(F.col(c).alias("node"), (2 * F.col("step") + k).alias("step"))
    all_nodes = all_edges.select("graph_id", F.explode(F.array(end("src", 0), end("dst", 1))).alias("x")).select("graph_id", "x.*")
    if roots is not None:
        all_nodes = roots.select("graph_id", "node", F.lit(-1).alias("step")).unionByName(all_nodes)
    word = lambda words, c: F.get(F.array(*map(F.lit, words)), c)
    last = word(["domain", *types], F.max("step") + 1)
    domain = F.max(F.col("step").isin(-1, *(k for k, t in enumerate(types) if t == "domain")))
    kind = F.when(domain, "domain").otherwise(last) if protect_root else last
    nodes = all_nodes.groupBy("graph_id", "node").agg(kind.alias("type"), F.min("step").alias("_step"))
    nodes = nodes.withColumn("node_idx", F.row_number().over(Window.partitionBy("graph_id").orderBy("_step", "node")) - 1).drop("_step")
    # one edge for each unordered pair, as first put; the last signal names and weighs it
    pair = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    turned = (F.col("src") > F.col("dst")).cast("int")
    edges = all_edges.repartition("graph_id").groupBy("graph_id", *pair).agg(  # dealt once, for the order too
        F.min(2 * F.col("step") + turned).alias("_first"), F.max("step").alias("_last"), *(F.max(F.when(F.col("step") == k, F.col("weight"))).alias(f"_w{k}") for k in range(len(used))),
    )
    back = F.col("_first") % 2 == 1
    edges = edges.select(
        "graph_id", F.when(back, F.col("hi")).otherwise(F.col("lo")).alias("src"), F.when(back, F.col("lo")).otherwise(F.col("hi")).alias("dst"), F.floor(F.col("_first") / 2).alias("_step"),
        word([SHAPE[n][4] for n in used], F.col("_last")).alias("relation"), F.get(F.array(*(f"_w{k}" for k in range(len(used)))), F.col("_last")).alias("weight"),
    )
    order = Window.partitionBy("graph_id").orderBy("_step", "src", "dst")
    edges = edges.withColumn("edge_idx", F.row_number().over(order) - 1)
    return nodes.select("graph_id", "node", "node_idx", "type"), edges.select("graph_id", "src", "dst", "edge_idx", "relation", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("other"), "relation", "weight").unionByName(
        edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("other"), "relation", "weight")
    )


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"))
    return n.join(edges.groupBy("graph_id").agg(F.count("*").alias("edge_count")), "graph_id", "left").select("graph_id", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("graph_id", "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def trimmed(nodes: DataFrame, edges: DataFrame, root: Column | None = None, budget: int = X.NODE_BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node budget: while a graph is over it, a type keeps its first few nodes; types are taken in order.

    Returns nodes, edges and (graph_id, truncated_counts).
    """
    root = F.lit(False) if root is None else root
    rank = F.row_number().over(Window.partitionBy("graph_id", "type").orderBy("node_idx"))
    marked = nodes.withColumn("_root", root).withColumn("_rank", F.when(~F.col("_root"), F.row_number().over(Window.partitionBy("graph_id", "type", "_root").orderBy("node_idx"))).otherwise(rank))
    per = marked.groupBy("graph_id").agg(
        F.count("*").alias("n"), *(F.count_if((F.col("type") == t) & ~F.col("_root") & (F.col("_rank") > keep)).alias(f"cut_{t}") for t, keep in X.TRIM)
    )
    left = F.col("n")
    for t, _ in X.TRIM:
        per = per.withColumn(f"do_{t}", F.when(left > budget, F.col(f"cut_{t}")).otherwise(0))
        left = left - F.col(f"do_{t}")
    with_cut = marked.join(per, "graph_id")
    gone = F.lit(False)
    for t, keep in X.TRIM:
        gone = gone | ((F.col("type") == t) & ~F.col("_root") & (F.col("_rank") > keep) & (F.col(f"do_{t}") > 0))
    kept = with_cut.where(~gone).select(nodes.columns)
    names = kept.select("graph_id", F.col("node").alias("k"))
    e = edges.join(names.withColumnRenamed("k", "src"), ["graph_id", "src"], "left_semi").join(names.withColumnRenamed("k", "dst"), ["graph_id", "dst"], "left_semi")
    counts = F.map_filter(F.create_map(*(x for t, _ in X.TRIM for x in (F.lit(t), F.col(f"do_{t}").cast("int")))), lambda _, v: v > 0)
    return kept, e, per.select("graph_id", counts.alias("truncated_counts"))


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places by links between ``x`` and ``y``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root[x], root[y]):
            return root


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node_idx reachable.

    A graph is one task's work; those of more than ``WHOLE`` nodes and links go through rounds over all tasks instead.
    """
    idx, ends = nodes.select("graph_id", "node", "node_idx"), edges.select("graph_id", "src", "dst")
    size = nodes.select("graph_id").unionByName(edges.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("n"))
    large = written(size.where(F.col("n") > WHOLE).select("graph_id"), "large-graphs")
    if large.isEmpty():
        return _components_in_tasks(idx, ends)
    of = lambda df, how: df.join(large, "graph_id", how)
    return _components_in_tasks(of(idx, "left_anti"), of(ends, "left_anti")).unionByName(_components_by_rounds(of(idx, "left_semi"), of(ends, "left_semi")))


def _components_in_tasks(idx: DataFrame, ends: DataFrame) -> DataFrame:
    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("node_idx")
        at = pd.Index(n["node"])
        x, y = at.get_indexer(e["src"]), at.get_indexer(e["dst"])
        both = (x >= 0) & (y >= 0)
        first = n["node_idx"].to_numpy()[roots(len(n), x[both], y[both])]
        return n[["graph_id", "node"]].assign(component=first)

    idx, ends = idx.toDF(*idx.columns), ends.toDF(*ends.columns)  # columns of their own, even of one origin
    kinds = {f.name: f.dataType.simpleString() for f in idx.schema.fields}
    return idx.groupBy("graph_id").cogroup(ends.groupBy("graph_id")).applyInPandas(run, f"graph_id {kinds['graph_id']}, node {kinds['node']}, component {kinds['node_idx']}")


def _components_by_rounds(idx: DataFrame, ends: DataFrame) -> DataFrame:
    """Label propagation with pointer jumps. Each round is written to the shared folder, so lineage stays short and
    executors may be lost; the round before it is deleted."""
    spark = idx.sparkSession
    ways = ends.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("other"))
    ways = ways.unionByName(ways.select("graph_id", F.col("other").alias("node"), F.col("node").alias("other")))
    pairs = ways.join(idx, ["graph_id", "node"]).withColumnRenamed("node_idx", "i")
    pairs = written(pairs.join(idx.select("graph_id", F.col("node").alias("other"), F.col("node_idx").alias("j")), ["graph_id", "other"]).select("graph_id", "i", "j"), "component-pairs")
    now, last = idx.select("graph_id", F.col("node_idx").alias("i"), F.col("node_idx").alias("c")), None
    while True:
        seen = pairs.join(now.select("graph_id", F.col("i").alias("j"), F.col("c").alias("d")), ["graph_id", "j"]).groupBy("graph_id", "i").agg(F.min("d").alias("d"))
        step = now.join(seen, ["graph_id", "i"], "left").select("graph_id", "i", F.col("c").alias("old"), F.least("c", "d").alias("c"))
        up = now.select("graph_id", F.col("i").alias("c"), F.col("c").alias("e"))
        step = written(step.join(up, ["graph_id", "c"]).select("graph_id", "i", "old", F.least("c", "e").alias("c")), "component-round")
        if last is not None:
            delete(spark, last._written_to)
        now, last = step.select("graph_id", "i", "c"), step
        if step.where("old <> c").isEmpty():
            break
    delete(spark, pairs._written_to)
    return idx.join(now.withColumnRenamed("i", "node_idx"), ["graph_id", "node_idx"]).select("graph_id", "node", F.col("c").alias("component"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same keys the first by ``order``; aggregated, so no key's rows come together."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_b"))
    return best.select(*(F.col(f"_b.{c}").alias(c) for c in rows.columns))


def neighbour_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, mean, max): over the one-hot types of a node's neighbours."""
    kinds = nodes.select("graph_id", F.col("node").alias("other"), C.one_hot(F.col("type")).alias("x"))
    met = both_ways(edges).join(kinds, ["graph_id", "other"])
    at = [F.get("x", F.lit(k)) for k in range(len(X.EMBEDDED_TYPES))]
    return met.groupBy("graph_id", "node").agg(F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.max, at)).alias("max"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).groupBy("graph_id").agg((F.count_distinct("component") == 1).alias("is_connected"))


def composed(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of graphs with the same graph_id; the right one's attributes win, the left one's order stays."""
    n = left[0].withColumn("_s", F.lit(0)).unionByName(right[0].withColumn("_s", F.lit(1)))
    n = n.groupBy("graph_id", "node").agg(F.max_by("type", "_s").alias("type"), F.min(F.struct("_s", "node_idx")).alias("_o"))
    n = n.withColumn("node_idx", F.row_number().over(Window.partitionBy("graph_id").orderBy("_o")) - 1).select("graph_id", "node", "node_idx", "type")
    e = left[1].withColumn("_s", F.lit(0)).unionByName(right[1].withColumn("_s", F.lit(1)))
    pair = [F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi")]
    first = F.struct("_s", "edge_idx")
    e = e.groupBy("graph_id", *pair).agg(F.min_by("src", first).alias("src"), F.min_by("dst", first).alias("dst"), F.max_by("relation", "_s").alias("relation"), F.max_by("weight", "_s").alias("weight"), F.min(first).alias("_o"))
    e = e.withColumn("edge_idx", F.row_number().over(Window.partitionBy("graph_id").orderBy("_o")) - 1)
    return n, e.select("graph_id", "src", "dst", "edge_idx", "relation", "weight")


def expandable_leaves(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """(graph_id, leaf, ord): certificate peers, then suspicious co-hosts, each in the graph's order, without those in
    ``done`` (graph_id, leaf)."""
    host = F.concat(F.lit("https://"), "node")
    parts = C.url_parts(host)
    odd = F.size(C.signals(parts["domain"], parts["suffix"])) > 0
    leaves = nodes.where((F.col("type") == "cert_peer") | (F.col("type") == "co_host") & odd)
    order = F.struct((F.col("type") == "co_host").alias("second"), F.col("node_idx").alias("idx"))
    return leaves.select("graph_id", F.col("node").alias("leaf"), order.alias("ord")).join(done, ["graph_id", "leaf"], "left_anti")


def expanded(
    seeds: DataFrame, egos: DataFrame, depth: int = X.CAMPAIGN_DEPTH, per_level: int = X.CAMPAIGN_LEAVES, budget: int = X.CAMPAIGN_NODES
) -> tuple[DataFrame, DataFrame]:
    """Campaigns from ego-graphs, all seeds at once: (members, log).

    ``seeds`` has (seed); ``egos`` the nodes (graph_id, node, node_idx, type) of each domain's own graph. A level takes
    the first ``per_level`` of its frontier, skips what has been expanded, and stops at the leaf before which the campaign has
    ``budget`` nodes. ``members`` is (seed, domain): the graphs that make up the campaign; ``log`` has (seed, depth, pos,
    domain, status, nodes_added).
    """
    members = seeds.select("seed", F.col("seed").alias("domain"), F.lit(0).alias("depth"), F.lit(0).alias("pos"))
    log = None
    size = egos.groupBy(F.col("graph_id").alias("domain")).agg(F.count("*").alias("nodes_added"))
    own = egos.select(F.col("graph_id").alias("domain"), "node")
    for d in range(1, depth + 1):
        members = written(members, "campaign-members")
        last = members.where(F.col("depth") == d - 1)
        found = last.join(egos.withColumnRenamed("graph_id", "domain"), "domain").select(F.concat_ws("\x00", "seed", F.col("pos")).alias("graph_id"), "node", "node_idx", "type", "seed", "pos")
        # A leaf is out if it was expanded before or together with the graph that it was found in.
        done = found.select("graph_id", "seed", "pos").distinct().join(members.select("seed", "domain", "depth", F.col("pos").alias("at")), "seed").where((F.col("depth") < d - 1) | (F.col("at") <= F.col("pos")))
        leaves = expandable_leaves(found, done.select("graph_id", F.col("domain").alias("leaf")))
        leaves = leaves.withColumn("seed", F.split("graph_id", "\x00")[0]).withColumn("ord", F.struct(F.split("graph_id", "\x00")[1].cast("int").alias("pos"), "ord"))
        leaves = leaves.groupBy("seed", F.col("leaf").alias("domain")).agg(F.min("ord").alias("ord"))
        pos = F.row_number().over(Window.partitionBy("seed").orderBy("ord"))
        frontier = leaves.withColumn("pos", pos).where(F.col("pos") <= per_level).join(members.select("seed", "domain"), ["seed", "domain"], "left_anti").select("seed", "domain", "pos")
        # The node count before each leaf: nodes count where they are first met.
        met = members.select("seed", "domain", F.lit(0).alias("pos")).unionByName(frontier).join(own, "domain").groupBy("seed", "node").agg(F.min("pos").alias("pos"))
        fresh = met.groupBy("seed", "pos").agg(F.count("*").alias("fresh"))
        sized = members.select("seed").distinct().withColumn("pos", F.lit(0)).unionByName(frontier.select("seed", "pos")).join(fresh, ["seed", "pos"], "left")
        before = F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy("seed").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        taken = sized.withColumn("before", before).where((F.col("pos") > 0) & (F.col("before") < budget)).select("seed", "pos")
        level = frontier.join(taken, ["seed", "pos"]).join(size, "domain", "left")
        rows = level.select("seed", F.lit(d).alias("depth"), "pos", "domain", F.when(F.col("nodes_added") > 0, "expanded").otherwise("empty").alias("status"), "nodes_added")
        rows = written(rows, "campaign-log")
        log = rows if log is None else log.unionByName(rows)
        members = members.unionByName(rows.select("seed", "domain", "depth", "pos"))
    return members.select("seed", "domain"), log


def asn_reputation(asns: DataFrame) -> DataFrame:
    """``asns`` (asn) with tier, label, risk_score and is_flagged; the tiers are a table of 44 rows."""
    rows = [(f"AS{n}", tier, label, risk) for (tier, risk), known in X.ASN_TIERS.items() for n, label in known.items()]
    tiers = asns.sparkSession.createDataFrame(rows, "_key string, tier string, label string, risk_score int")
    out = asns.withColumn("_key", C.asn_key(F.col("asn"))).join(F.broadcast(tiers), "_key", "left")
    return out.select(*asns.columns, F.coalesce("tier", F.lit("unknown")).alias("tier"), "label", F.coalesce("risk_score", F.lit(0)).alias("risk_score"), F.col("tier").isNotNull().alias("is_flagged"))
