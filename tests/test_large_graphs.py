"""Graphs that are one task's work against the ways that take any size, and against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gossamer.functions import fixed as X
from gossamer.operators import blocks as B
from gossamer.operators import graph as G
from gossamer.operators import links as L
from gossamer.operators import spectral as S
from gossamer.operators import walks as W
from gossamer.plans import queries as Q


def random_graphs(spark, sizes=((3, 2), (40, 30), (60, 90), (1, 0)), seed=0):
    """Nodes and edges of graphs of many types, in pieces, with links of weight zero."""
    r, nodes, edges = random.Random(seed), [], []
    types = ["domain", "ip", "asn", "geo", "registrar", "other"]
    for k, (n, m) in enumerate(sizes):
        names = [f"n{x}" for x in range(n)]
        r.shuffle(names)
        nodes += [(f"g{k}", x, i, r.choice(types[:2] if r.random() < 0.7 else types)) for i, x in enumerate(names)]
        pairs = r.sample([(a, b) for a in names for b in names if a < b], m)
        edges += [(f"g{k}", *((a, b) if r.random() < 0.5 else (b, a)), i, "link", r.choice([0.0, 0.5, 1.0])) for i, (a, b) in enumerate(pairs)]
    return (
        spark.createDataFrame(nodes, "graph_id string, node string, node_idx int, type string"),
        spark.createDataFrame(edges, "graph_id string, src string, dst string, edge_idx int, relation string, weight double"),
    )


def brute_components(nodes, edges):
    first = {(r.graph_id, r.node): r.node_idx for r in nodes.collect()}
    links = [((r.graph_id, r.src), (r.graph_id, r.dst)) for r in edges.collect()]
    while True:
        before = dict(first)
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
        if first == before:
            return sorted((g, n, c) for (g, n), c in first.items())


@pytest.mark.parametrize("whole", [1 << 20, 100, 0])
def test_components_in_tasks_and_by_rounds(spark, monkeypatch, whole):
    """No rounds while every graph fits a task; mixed and all by rounds, the rows are the same."""
    if whole > 100:
        monkeypatch.setattr(G, "_components_by_rounds", None)
    monkeypatch.setattr(G, "WHOLE", whole)
    n, e = random_graphs(spark)
    assert sorted(map(tuple, G.components(n, e).collect())) == brute_components(n, e)


def test_entries_take_graphs_beyond_the_dense_bound(spark, monkeypatch):
    """The matrices' entries, embeddings, hidden links and signatures make no matrix of a whole graph."""
    monkeypatch.setattr(S, "MAX_NODES", 41)
    n, e = random_graphs(spark)
    nodes, edges = n.toPandas(), e.toPandas()
    for variant in ("adjacency", "laplacian"):
        for weighted in (True, False):
            want = []
            for g, part in nodes.groupby("graph_id"):
                h = S.hamiltonian(S.adjacency(part, edges[edges.graph_id == g], weighted)[1], variant)
                want += [(g, int(i), int(j), round(h[i, j], 9)) for i, j in zip(*np.nonzero(h))]
            got = S.hamiltonian_entries(n, e, variant, weighted)
            assert sorted((*r[:3], round(r[3], 9)) for r in got.collect()) == sorted(want)
            assert sorted(map(tuple, S.hermitian(got).collect())) == sorted(map(tuple, got.collect()))
    found = {r.graph_id: r.embedding for r in S.embeddings(n, e).collect()}
    for g, part in nodes.groupby("graph_id"):
        part = part.sort_values("node_idx")
        a = S.linked(part, edges[edges.graph_id == g])
        for how in ("mean", "max"):
            h = np.array([[float((t if t in X.EMBEDDED_TYPES else "unknown") == k) for k in X.EMBEDDED_TYPES] for t in part["type"]])
            rng = np.random.default_rng(0)
            for _ in range(2):
                w = rng.standard_normal((16, 2 * h.shape[1])) * 0.1
                around = np.array([(h[row].mean(axis=0) if how == "mean" else h[row].max(axis=0)) if row.any() else np.zeros(h.shape[1]) for row in a])
                h = np.maximum(0, np.concatenate([h, around], axis=1) @ w.T)
            assert np.allclose(S.embedding(part["type"].tolist(), a, aggregation=how), h.mean(axis=0))
            assert how == "max" or np.allclose(found[g], h.mean(axis=0))
    assert S.signatures(n, e).count() == 4 and S.hidden_links(n, e, clamp=False).count() >= 0


@pytest.mark.parametrize("seed", range(5))
def test_spectra_by_pieces_equal_those_of_the_whole(seed):
    r = random.Random(seed)
    pairs = [(f"a{r.randrange(30)}", f"b{r.randrange(25)}") for _ in range(35)] + [("hub", f"leaf{k}") for k in range(6)] + [("p", "q"), ("q", "p")]
    names = sorted({x for p in pairs for x in p})
    a = np.zeros((len(names), len(names)))
    for s, d in pairs:
        a[names.index(s), names.index(d)] = a[names.index(d), names.index(s)] = 1
    assert np.allclose(np.sort(S.link_spectrum(pairs)), np.linalg.eigvalsh(-a), atol=1e-9)


def test_return_statistics_equal_the_diagonal_of_the_walk():
    a = np.triu(np.random.default_rng(3).random((30, 30)) < 0.2, 1).astype(float)
    values, vectors = np.linalg.eigh(-(a + a.T))
    p = [np.abs(np.diag(S.walk(values, vectors, t))) ** 2 for t in (0.5, 7.0)]
    assert np.allclose(S.return_statistics(values, vectors, (0.5, 7.0)), [f(x) for x in p for f in (np.mean, np.std, np.min, np.max, np.median)])


@pytest.mark.parametrize("cells, listed", [(1 << 21, 3000), (50, 50)])
def test_blocks_equal_the_joined_way(spark, monkeypatch, cells, listed):
    """Whole and in blocks of few cells: the rows of joins and windows over all candidates."""
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "LISTED", listed)
    n, e = random_graphs(spark)
    hidden = e.where("edge_idx % 5 = 0").select("graph_id", "src", "dst")
    left = e.join(hidden, ["graph_id", "src", "dst"], "left_anti")
    near = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert near(B.candidates(n, e)) == near(L.candidates(n, e).select(B.candidates(n, e).columns))
    got = B.adamic_adar(n, e)
    assert near(got) == near(L.adamic_adar(n, e).select(got.columns))
    got = B.recovery(n, e, hidden)
    assert near(got) == near(L.recovery_metrics(L.ranked(L.adamic_adar(n, left)), hidden).select(got.columns)) and got.count() > 1
    got = B.top_by_chance(n, e)
    assert near(got) == near(L.ranked(S.random_scores(L.candidates(n, e))).where("rank <= 10").select(got.columns))
    for walk, scored in ((False, L.adamic_adar(n, left)), (True, S.walk_scores(n, left))):
        got = B.density(n, e, hidden, 29, walk).withColumn("density", F.round("density", 4))
        assert near(got) == near(Q._density(scored, hidden).select(got.columns)) and got.count() > 10


def hosted(seed, domains=6, servers=40, odd=0):
    """A connected graph: servers meet domains, systems and a place; ``odd`` links are between any nodes, some of weight zero."""
    r = random.Random(seed)
    kinds = {"domain": domains, "ip": servers, "asn": 4, "geo": 2, "registrar": 1, "co_host": 3}
    names = [(f"{t}{k}", t) for t, n in kinds.items() for k in range(n)]
    r.shuffle(names)
    links = {frozenset((f"domain{k}", f"domain{k + 1}")) for k in range(domains - 1)} | {frozenset((f"domain{k}", "registrar0")) for k in range(domains)}
    links |= {frozenset((f"co_host{k}", f"ip{k}")) for k in range(3)}
    for k in range(servers):
        links |= {frozenset((f"ip{k}", f"domain{r.randrange(domains)}")) for _ in range(2)} | {frozenset((f"ip{k}", f"asn{k % 4}")), frozenset((f"ip{k}", f"geo{k % 2}"))}
    for _ in range(odd):
        links.add(frozenset(x for x, _ in r.sample(names, 2)))
    rows = [(f"g{seed}", *r.sample(sorted(p), 2), i, "link", r.choice([0.0, 0.3, 1.0])) for i, p in enumerate(sorted(links, key=sorted))]
    return [(f"g{seed}", x, i, t) for i, (x, t) in enumerate(names)], rows


def hosted_graphs(spark):
    made = [hosted(0), hosted(1, odd=12), hosted(2, 30, 6, odd=9)]
    return (
        spark.createDataFrame([x for n, _ in made for x in n], "graph_id string, node string, node_idx int, type string"),
        spark.createDataFrame([x for _, e in made for x in e], "graph_id string, src string, dst string, edge_idx int, relation string, weight double"),
    )


@pytest.mark.parametrize("odd", [0, 10])
def test_walks_from_a_smaller_matrix_equal_those_of_the_whole(odd):
    """Probabilities, returns, eigenvalues and common neighbours of near and far nodes, which are most."""
    n, e = (pd.DataFrame(rows, columns=c) for rows, c in zip(hosted(7, odd=odd), (["graph_id", "node", "node_idx", "type"], ["graph_id", "src", "dst", "edge_idx", "relation", "weight"])))
    graph, a, times = B.Graph(n, e), S.adjacency(n, e)[1], (0.5, 10.0)
    split = W.Split(graph.n, graph.i, graph.j)
    assert split.size < 0.8 * graph.n
    i, j = (x.ravel() for x in np.indices(a.shape))
    near, links = split.links(graph.i, graph.j, graph.weights(e))
    assert np.abs(W.probabilities(near, links, times).at(split.spots(i, j)) - S.walk_matrix(a, times).ravel()).max() < 1e-12
    off = i != j
    assert np.abs(W.common(split, graph.i, graph.j).at(split.spots(i, j)) - S.common_matrix(S.linked(n, e)).ravel())[off].max() < 1e-12
    values, vectors = np.linalg.eigh(-a)
    small, part = W.spectrum(near, links)
    assert np.allclose(np.sort(np.concatenate([small, np.zeros(graph.n - len(small))])), values, atol=1e-12)
    for t, found in zip(times, W.returns(small, part, links, times)):
        want = np.abs(np.diag(S.walk(values, vectors, t))) ** 2
        assert np.allclose(found, want[np.concatenate([split.near, split.far])], atol=1e-12)


def here(nodes, edges, make, schema, most=None):
    """``_per_graph`` in the test's own process, where patched bounds hold."""
    most, e = most or S.MAX_NODES, edges.toPandas()
    names, rows = [x.split()[0] for x in schema.split(", ")], []
    for g, n in nodes.toPandas().groupby("graph_id"):
        if len(n) > most:
            raise ValueError(f"graph {g} has {len(n)} nodes")
        rows += pd.DataFrame(make(g, n, e[e.graph_id == g]), columns=names).to_dict("records")
    return rows


@pytest.mark.parametrize("cells", [1 << 21, 60])
def test_recoveries_take_graphs_beyond_the_dense_bound(spark, monkeypatch, cells):
    """Rows of dense matrices and full sorts, though a matrix may have fewer rows than a graph nodes."""
    n, e = hosted_graphs(spark)
    nodes, edges, want = n.toPandas(), e.toPandas(), []
    for g, part in nodes.groupby("graph_id"):
        links = edges[edges.graph_id == g]
        for seed in (0, 3):
            gone = S.hide(part, links, seed=seed)
            left = links.drop(links.index[gone])
            i, j, _ = S.open_pairs(part["type"].tolist(), S.linked(part, left))
            was = S.linked(part, links)[i, j]
            for method, score in (("walk", S.walk_matrix(S.adjacency(part, left)[1])), ("common", S.common_matrix(S.linked(part, left))), ("random", None)):
                ranks = np.flatnonzero(was[S.ordered(np.random.default_rng(seed).random(len(i)) if score is None else score[i, j], i, j)]) + 1
                want.append((g, seed, method, len(gone), len(ranks), len(i), round(float((1 / ranks).sum() / len(ranks)), 9), round(float(ranks.mean()), 9), float((ranks <= 5).sum() / len(gone))))
    monkeypatch.setattr(S, "MAX_NODES", 50)
    monkeypatch.setattr(B, "CELLS", cells)
    names = ("graph_id", "seed", "method", "n_hidden", "n_found", "n_candidates", "mrr", "mean_rank", "hits_5")
    rows = lambda got: sorted(tuple(round(r[c], 9) if c in ("mrr", "mean_rank") else r[c] for c in names) for r in got)
    assert rows(S.recoveries(n, e, seeds=(0, 3)).collect()) == sorted(want) and len(want) == 18
    monkeypatch.setattr(S, "_per_graph", here)
    assert rows(S.recoveries(n, e, seeds=(0, 3))) == sorted(want)
    monkeypatch.setattr(S, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="dense operators take 10"):
        S.recoveries(n, e)


def test_fingerprints_take_graphs_beyond_the_dense_bound(spark, monkeypatch):
    n, e = hosted_graphs(spark)
    nodes, edges = n.toPandas(), e.toPandas()
    monkeypatch.setattr(S, "_per_graph", here)
    monkeypatch.setattr(S, "MAX_NODES", 50)
    for method in ("combined", "eigenvalue_histogram", "return_probability"):
        got = {r["graph_id"]: r["phi"] for r in S.fingerprints(n, e, method)}
        assert len(got) == 3
        for g, phi in got.items():
            part = nodes[nodes.graph_id == g]
            assert len(part) > 50 or g == "g2"
            assert np.allclose(phi, S.fingerprint(S.adjacency(part, edges[edges.graph_id == g])[1], method=method), atol=1e-12)


@pytest.mark.parametrize("cells", [1 << 21, 60])
def test_top_links_take_graphs_beyond_the_dense_bound(spark, monkeypatch, cells):
    n, e = hosted_graphs(spark)
    monkeypatch.setattr(S, "_per_graph", here)
    rows = lambda got: [r | {"score": round(r["score"], 12)} for r in got]
    want = rows(S._top_links(n, e, 20, lambda n, e: S.walk_matrix(S.adjacency(n, e)[1])))
    monkeypatch.setattr(S, "MAX_NODES", 50)
    monkeypatch.setattr(B, "CELLS", cells)
    assert rows(S.top_walk_links(n, e, 20)) == want and len(want) == 60


def test_candidates_of_any_size_are_listed_in_tasks(spark, monkeypatch):
    """One shuffle of nodes and links, then batches of few rows: no graph's candidates are joined."""
    monkeypatch.setattr(B, "LISTED", 7)
    n, e = random_graphs(spark, sizes=((3100, 2), (60, 90), (2, 0)))
    n = n.where("graph_id <> 'g0' OR node_idx < 3 OR type = 'ip'").withColumn("type", F.when((F.col("graph_id") == "g0") & (F.col("node_idx") < 3), "asn").otherwise(F.col("type")))
    e = e.where("graph_id <> 'g0'")
    for got, want in ((B.candidates(n, e), L.candidates(n, e)), (B.adamic_adar(n, e), L.adamic_adar(n, e))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(got.columns).collect())  # noqa: B023, E731
        assert near(got) == near(want) and got.groupBy("graph_id").count().count() == 2


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_candidates_without_common_neighbours_are_counted_not_made(spark, monkeypatch, cells):
    """Ranks and densities equal those of all candidates in order, though only those with common neighbours are made."""
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B.Graph, "open", None)
    monkeypatch.setattr(B.Graph, "pairs", None)
    monkeypatch.setattr(S, "_per_graph", here)
    n, e = random_graphs(spark, sizes=((40, 30), (60, 90), (60, 300)))
    hidden = e.where("edge_idx % 5 = 0").select("graph_id", "src", "dst")
    nodes, edges, ranked, zeros = n.toPandas(), e.toPandas(), {}, 0
    for g, part in nodes.groupby("graph_id"):
        links = edges[edges.graph_id == g]
        left = links[links.edge_idx % 5 != 0]
        i, j, _ = S.open_pairs(part["type"].tolist(), S.linked(part, left))
        score = S.common_matrix(S.linked(part, left))[i, j]
        was = S.linked(part, links)[i, j]
        zeros += int((score[was] == 0).sum())
        at = np.flatnonzero(was[S.ordered(score, i, j)]) + 1
        ranked[g] = (len(links) - len(left), len(at), len(i), round(float(at.mean()), 9), round(float((1 / at).sum() / len(at)), 9))
    got = {r["graph_id"]: (r["n_hidden"], r["n_found"], r["n_candidates"], round(r["mean_rank"], 9), round(r["mrr"], 9)) for r in B.recovery(n, e, hidden)}
    assert got == ranked and zeros > 5
    assert {(r["graph_id"], r["hidden"]) for r in B.density(n, e, hidden, 29)} == {(g, h) for g in ranked for h in (False, True)}


@pytest.mark.parametrize("cells", [1 << 21, 60])
def test_walk_densities_take_graphs_beyond_the_dense_bound(spark, monkeypatch, cells):
    n, e = hosted_graphs(spark)
    hidden = S.hidden_links(n, e, clamp=False)
    want = sorted(map(tuple, Q._density(S.walk_scores(n, e.join(hidden, ["graph_id", "src", "dst"], "left_anti")), hidden).collect()))
    monkeypatch.setattr(S, "_per_graph", here)
    monkeypatch.setattr(S, "MAX_NODES", 50)
    monkeypatch.setattr(B, "CELLS", cells)
    got = B.density(n, e, hidden, 29, walk=True)
    assert sorted((r["graph_id"], r["hidden"], r["bin"], round(r["density"], 4)) for r in got) == want and len(want) > 20


def test_graphs_are_assembled_by_hashing(spark):
    """No sort by pairs or nodes, and the same graphs whatever the order of rows: types, directions and weights by signal."""
    dns = spark.createDataFrame([("g", "b", "a", 0.2), ("g", "b", "a", 0.7), ("g", "c", "d", None), ("g", "x", None, 1.0)], "graph_id string, domain string, ip string, weight double")
    cert = spark.createDataFrame([("g", "c", "b"), ("g", "b", "c"), ("g", "c", "c")], "graph_id string, domain string, peer string")
    asn = spark.createDataFrame([("g", "d", "c"), ("g", "a", "n")], "graph_id string, ip string, asn string")
    root = spark.createDataFrame([("g", "r"), ("g", "d")], "graph_id string, node string")
    n, e = G.assemble({"dns": dns, "cert": cert, "asn": asn}, protect_root=False, roots=root)
    assert "SortAggregate" not in n._jdf.queryExecution().toString() + e._jdf.queryExecution().toString()
    assert [tuple(r)[1:] for r in n.orderBy("node_idx").collect()] == [("d", 0, "ip"), ("r", 1, "domain"), ("b", 2, "cert_peer"), ("c", 3, "asn"), ("a", 4, "ip"), ("n", 5, "asn")]
    want = [("b", "a", "resolves-to", 0.7), ("c", "d", "hosted-in", 1.0), ("b", "c", "shares-cert", 1.0), ("c", "c", "shares-cert", 1.0), ("a", "n", "hosted-in", 1.0)]
    assert [(r.src, r.dst, r.relation, r.weight) for r in e.orderBy("edge_idx").collect()] == want
    kinds = {r.node: r.type for r in G.assemble({"dns": dns, "cert": cert, "asn": asn}, roots=root)[0].collect()}
    assert kinds == {"d": "domain", "r": "domain", "b": "domain", "c": "domain", "a": "ip", "n": "asn"}
