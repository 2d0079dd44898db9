"""Queries that give the data of reports and figures, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions import columns as C
from gossamer.functions import fixed as X
from gossamer.operators import blocks as B
from gossamer.operators import graph as G
from gossamer.operators import links as L
from gossamer.operators import spectral as S
from gossamer.plans import queries as Q
from gossamer.plans.registry import query, rounded
from gossamer.plans.sources import values
from gossamer.sources import fixtures
from gossamer.sources.scratch import written
from gossamer.sources.tables import campaign, mixed_stars, stars

#: Least links of a graph that is validated: end to end, and in the staged report.
ESTIMATED, STAGED = 8, 6


def estimation(nodes: DataFrame, edges: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """End to end: (predictions, validation). Graphs under three nodes give no predictions; those with eight links
    and more that hang together are validated by hiding links."""
    size = written(G.sizes(nodes, edges).join(G.connected(nodes, edges), "graph_id"), "estimation-sizes")
    some = lambda df, which: df.join(size.where(which).select("graph_id"), "graph_id", "left_semi")
    big, whole = F.col("node_count") >= 3, (F.col("edge_count") >= ESTIMATED) & F.col("is_connected")
    return L.explained(S.top_walk_links(some(nodes, big), some(edges, big), k)), S.recoveries(some(nodes, whole), some(edges, whole))


_REACHED = f"""{Q._SPLIT}, {Q._REACH}, whole AS (SELECT graph_id, count(DISTINCT component) = 1 AS whole FROM ({Q._PARTS}) GROUP BY 1),
n_ AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), e_ AS (SELECT graph_id, count(*) AS e FROM edges GROUP BY 1)"""


@query("G20_estimation", f"WITH RECURSIVE {_REACHED}, {Q.TYPES}, p AS (SELECT a.graph_id, count(*) AS k FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_idx < b.node_idx JOIN types t ON (t.type_a = a.type AND t.type_b = b.type) OR (t.type_a = b.type AND t.type_b = a.type) WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = a.graph_id AND ((e.src = a.node AND e.dst = b.node) OR (e.src = b.node AND e.dst = a.node))) GROUP BY 1) SELECT n_.graph_id, least(10, CASE WHEN n >= 3 THEN coalesce(k, 0) ELSE 0 END) AS n_predictions, whole AND e >= {ESTIMATED} AND e > n - 1 AS validated FROM n_ JOIN whole USING (graph_id) LEFT JOIN e_ USING (graph_id) LEFT JOIN p USING (graph_id)")
def _(spark, d):
    n, e = Q._split(spark, d)
    predictions, validation = estimation(n, e)
    each = n.select("graph_id").distinct().join(predictions.groupBy("graph_id").agg(F.count("*").alias("k")), "graph_id", "left")
    out = each.join(validation.select("graph_id", F.lit(True).alias("v")).distinct(), "graph_id", "left")
    return out.select("graph_id", F.coalesce("k", F.lit(0)).alias("n_predictions"), F.coalesce("v", F.lit(False)).alias("validated"))


@query("G26_layered_heights", f"WITH {Q.CAMPAIGN}, z(type, z) AS (VALUES {values([(t, X.LAYERS[c] + X.LAYER_OFFSETS[t]) for t, c, _ in X.TYPE_WORDS])}) SELECT graph_id, node, round(coalesce(z, 3.5) + (('0x' || md5(node)[1:8])::BIGINT / 4294967296 * 2 - 1) * 0.12, 6) AS z FROM nodes LEFT JOIN z USING (type)")
def _(spark, d):
    return campaign(spark, d)[0].select("graph_id", "node", rounded(C.layer_height(F.col("type"), F.col("node"))).alias("z"))


@query("R3_blind_spot_bars", f"WITH {Q._COMPARED} SELECT graph_a || ' vs ' || graph_b AS label, round(walk, 6) + 0.0 AS walk, round(gnn, 6) + 0.0 AS embedding, CASE WHEN walk > 0.05 AND NOT gnn > 0.05 THEN round(greatest(walk, 0.02) + 0.015, 6) END AS mark FROM compared")
def _(spark, d):
    c = Q._star_pairs(spark, d)
    mark = F.when(F.col("blind_spot"), F.greatest("walk_distance", F.lit(0.02)) + 0.015)
    return c.select(F.concat_ws(" vs ", "graph_a", "graph_b").alias("label"), rounded("walk_distance").alias("walk"), rounded("embedding_distance").alias("embedding"), rounded(mark).alias("mark"))


def labelled_spectra(spectra: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, row, eigenvalue): a row of points for each graph, phishing first, one row left free between the labels."""
    s = spectra.join(labels, "graph_id")
    row = F.row_number().over(Window.partitionBy("label").orderBy("graph_id")) - 1
    first = s.where("label = 1").agg((F.count("*") + 1).alias("offset"))  # one row
    s = s.withColumn("row", row).crossJoin(F.broadcast(first))
    return s.select("label", F.when(F.col("label") == 1, F.col("row")).otherwise(F.col("row") + F.col("offset")).cast("int").alias("row"), F.explode("eigenvalues").alias("eigenvalue"))


@query(
    "R4_spectra_by_label",
    f"WITH {Q.STAR}, l AS (SELECT graph_id, k, graph_id::INT % 2 AS label, row_number() OVER (PARTITION BY graph_id::INT % 2 ORDER BY graph_id) - 1 AS i FROM star), o AS (SELECT count(*) + 1 AS offset_ FROM l WHERE label = 1) SELECT label, (CASE WHEN label = 1 THEN i ELSE i + offset_ END)::INTEGER AS row, round(CASE p.pos WHEN 0 THEN -sqrt(k) WHEN k THEN sqrt(k) ELSE 0 END, 6) + 0.0 AS eigenvalue FROM l, o, range(0, 100000) p(pos) WHERE p.pos <= k",
)
def _(spark, d):
    n, e = stars(spark, d)
    labels = n.select("graph_id", (F.col("graph_id").cast("int") % 2).alias("label")).distinct()
    return labelled_spectra(S.spectra(n, e), labels).withColumn("eigenvalue", rounded("eigenvalue"))


def overlay(nodes: DataFrame, edges: DataFrame, predictions: DataFrame, show: int = 5) -> DataFrame:
    """(graph_id, kind, node_a, node_b, text, size): marked nodes by degree, links, and the first predictions."""
    none = F.lit(None).cast("string")
    marks = nodes.join(G.degrees(edges), ["graph_id", "node"], "left").select("graph_id", F.lit("node").alias("kind"), F.col("node").alias("node_a"), none.alias("node_b"), F.col("type").alias("text"), (150 + 50 * F.coalesce("degree", F.lit(0))).alias("size"))
    line = lambda df, kind, a, b, size: df.select("graph_id", F.lit(kind).alias("kind"), F.col(a).alias("node_a"), F.col(b).alias("node_b"), F.col("relation").alias("text"), F.lit(size).cast("long").alias("size"))
    return marks.unionByName(line(edges, "link", "src", "dst", None)).unionByName(line(predictions.where(F.col("rank") <= show), "predicted", "node_a", "node_b", None))


@query("R5_prediction_overlay", f"WITH {Q._STAR_PAIRS} SELECT g::VARCHAR AS graph_id, 'predicted' AS kind, node_a, node_b, 'hosted-in' AS text, NULL::BIGINT AS size FROM pairs WHERE rank <= 5 UNION ALL SELECT g::VARCHAR, 'node', 'hub', NULL, 'registrar', 150 + 50 * n FROM m UNION ALL SELECT g::VARCHAR, 'node', node, NULL, 'ip', 200 FROM ips UNION ALL SELECT g::VARCHAR, 'link', 'hub', node, 'link', NULL FROM ips UNION ALL SELECT g::VARCHAR, 'node', asns.node, NULL, 'asn', 200 FROM m, asns UNION ALL SELECT g::VARCHAR, 'link', 'hub', asns.node, 'link', NULL FROM m, asns")
def _(spark, d):
    n, e = mixed_stars(spark, d)
    return overlay(n, e, S.top_walk_links(n, e))


def hits_by_k(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each k of a metrics table's hits."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits")) for k in S.HITS))
    return metrics.select(*keys, F.explode(pairs).alias("h")).select(*keys, "h.k", "h.hits")


@query("R6_hits_by_k", Q.ORACLES["op_M2_hits"].replace("SELECT graph_id, count(*) FILTER (found) AS n_found", "SELECT graph_id, unnest([1, 3, 5, 10]) AS k, unnest([hits_1, hits_3, hits_5, hits_10]) AS hits FROM (SELECT graph_id, count(*) FILTER (found) AS n_found") + ")")
def _(spark, d):
    n, e = campaign(spark, d)
    return hits_by_k(B.recovery(n, e, Q._last_links(e)), ["graph_id"])


@query("R7_demo_figures")
def _(spark, d):
    """The four figures of the demo campaign in one long table: predictions, hits, stability, separation."""
    n, e = fixtures.frames(spark, [fixtures.demo()])
    row = lambda df, figure, series, x, y: df.select(F.lit(figure).alias("figure"), series.cast("string").alias("series"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    out = row(S.top_walk_links(n, e, 5), "predictions", F.concat_ws(" - ", "node_a", "node_b"), c("rank"), c("score"))
    many = written(S.recoveries(n, e, seeds=tuple(range(10))), "demo-recoveries")
    out = out.unionByName(row(hits_by_k(many.where("seed = 0"), ["method"]), "hits", c("method"), c("k"), c("hits"))).unionByName(row(many, "stability", c("method"), c("seed"), c("mrr")))
    hidden = S.hidden_links(n, e, clamp=False)
    left = e.join(hidden.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
    return out.unionByName(row(Q._density(S.walk_scores(n, left), hidden), "separation", c("hidden"), c("bin"), c("density")))


@query("R8_stage_gates", f"WITH RECURSIVE {_REACHED}, d_ AS (SELECT graph_id, count(*) AS k FROM nodes WHERE type = 'domain' GROUP BY 1) SELECT n_.graph_id, n >= 5 AS heatmap, n >= 3 AND coalesce(k, 0) >= 2 AS estimated, n >= 3 AND coalesce(k, 0) >= 2 AND e >= {STAGED} AND whole AS validated FROM n_ JOIN whole USING (graph_id) LEFT JOIN e_ USING (graph_id) LEFT JOIN d_ USING (graph_id)")
def _(spark, d):
    """Which parts of the staged report each campaign gets."""
    n, e = Q._split(spark, d)
    s = G.sizes(n, e).join(G.connected(n, e), "graph_id").join(n.where("type = 'domain'").groupBy("graph_id").agg(F.count("*").alias("k")), "graph_id", "left")
    estimated = (F.col("node_count") >= 3) & (F.coalesce("k", F.lit(0)) >= 2)
    return s.select("graph_id", (F.col("node_count") >= 5).alias("heatmap"), estimated.alias("estimated"), (estimated & (F.col("edge_count") >= STAGED) & F.col("is_connected")).alias("validated"))


def two_graphs(spectra: DataFrame, a: str, b: str) -> DataFrame:
    """(graph_id, x, eigenvalue): both graphs' spectra over places from 0 to 1."""
    s = spectra.where(F.col("graph_id").isin(a, b)).select("graph_id", "n", F.posexplode("eigenvalues").alias("pos", "eigenvalue"))
    return s.select("graph_id", (F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))).alias("x"), "eigenvalue")


@query("R9_two_spectra", f"WITH {Q.STAR} SELECT graph_id, round(p.pos / k, 6) AS x, round(CASE p.pos WHEN 0 THEN -sqrt(k) WHEN k THEN sqrt(k) ELSE 0 END, 6) + 0.0 AS eigenvalue FROM star, range(0, 100000) p(pos) WHERE p.pos <= k AND graph_id IN ('0', '1')")
def _(spark, d):
    return two_graphs(S.spectra(*stars(spark, d)), "0", "1").withColumns({"x": rounded("x"), "eigenvalue": rounded("eigenvalue")})


@query("R9_two_fingerprints", f"WITH {Q._PHI} SELECT pos::INTEGER AS pos, graph_id, round(v, 6) + 0.0 AS v, pos < 20 AS spectral FROM parts WHERE graph_id IN ('0', '1')")
def _(spark, d):
    f = S.fingerprints(*stars(spark, d)).where(F.col("graph_id").isin("0", "1"))
    return f.select("graph_id", F.posexplode("phi").alias("pos", "v")).select("pos", "graph_id", rounded("v").alias("v"), (F.col("pos") < 20).alias("spectral"))


def heatmap(nodes: DataFrame, edges: DataFrame, least: int = 5, named: int = 30) -> DataFrame:
    """(graph_id, row, column, h): matrices of graphs with ``least`` nodes; up to ``named`` nodes rows have short names."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    short = F.when(F.length("node") > 18, F.concat(F.substring("node", 1, 18), F.lit("…"))).otherwise(F.col("node"))
    names = nodes.join(size, "graph_id").select("graph_id", F.col("node_idx").alias("i"), F.when(F.col("n") <= named, short).otherwise(F.col("node_idx").cast("string")).alias("name"))
    h = S.hamiltonian_entries(nodes, edges).join(names.withColumnRenamed("name", "row"), ["graph_id", "i"])
    return h.join(names.select("graph_id", F.col("i").alias("j"), F.col("name").alias("column")), ["graph_id", "j"]).select("graph_id", "row", "column", "h")


@query("R10_heatmap", f"WITH {Q.CAMPAIGN}, s AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1 HAVING n >= 5), names AS (SELECT graph_id, node, CASE WHEN n <= 30 THEN node ELSE node_idx::VARCHAR END AS name FROM nodes JOIN s USING (graph_id)) SELECT w.graph_id, a.name AS row, b.name AS column, round(-weight, 6) AS h FROM way w JOIN names a USING (graph_id, node) JOIN names b ON b.graph_id = w.graph_id AND b.node = w.other WHERE weight <> 0")
def _(spark, d):
    return heatmap(*campaign(spark, d)).withColumn("h", rounded("h"))


@query("R12_markers", f"WITH {Q.CAMPAIGN}, w(type, category, label) AS (VALUES {values(X.TYPE_WORDS)}) SELECT graph_id, node, 8 + 3 * degree AS size, label || ': ' || node AS hover FROM nodes JOIN degree USING (graph_id, node) JOIN w USING (type)")
def _(spark, d):
    n, e = campaign(spark, d)
    w = spark.createDataFrame(X.TYPE_WORDS, "type string, category string, label string")
    m = n.join(G.degrees(e), ["graph_id", "node"]).join(F.broadcast(w), "type")
    return m.select("graph_id", "node", (8 + 3 * F.col("degree")).alias("size"), F.concat_ws(": ", "label", "node").alias("hover"))


@query("R12_edge_labels", f"WITH {Q.CAMPAIGN}, w(relation, words) AS (VALUES {values(X.RELATION_WORDS.items())}) SELECT graph_id, src, arg_min(dst, edge_idx) AS dst, words || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END AS text FROM edges JOIN w USING (relation) GROUP BY graph_id, relation, src, words")
def _(spark, d):
    """One label for a node's links of a kind, with how many more there are."""
    w = spark.createDataFrame(list(X.RELATION_WORDS.items()), "relation string, words string")
    g = campaign(spark, d)[1].groupBy("graph_id", "relation", "src").agg(F.min_by("dst", "edge_idx").alias("dst"), F.count("*").alias("n")).join(F.broadcast(w), "relation")
    more = F.when(F.col("n") > 1, F.concat(F.lit(" (+"), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return g.select("graph_id", "src", "dst", F.concat("words", more).alias("text"))


@query("R13_summaries", f"WITH {Q.CAMPAIGN}, t AS (SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY ALL) SELECT graph_id, string_agg(type || ': ' || n, chr(10) ORDER BY type) AS summary FROM t GROUP BY graph_id")
def _(spark, d):
    """Each campaign's node types in lines."""
    t = campaign(spark, d)[0].groupBy("graph_id", "type").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(": ", "type", F.col("n").cast("string"))))  # one a type
    return t.groupBy("graph_id").agg(F.array_join(lines, "\n").alias("summary"))
