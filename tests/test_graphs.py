import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.operators import graph as G
from gossamer.operators import links as L
from gossamer.operators import spectral as S
from gossamer.sources import fixtures as X
from gossamer.sources import signals


def matrix(g):
    return S.adjacency(*g)[1]


def test_known_spectra():
    k3, k4 = X.plain(3, [(0, 1), (1, 2), (2, 0)]), X.plain(4, [(a, b) for a in range(4) for b in range(a)])
    assert np.allclose(np.linalg.eigvalsh(S.hamiltonian(matrix(k3))), [-2, 1, 1]) and np.allclose(np.linalg.eigvalsh(S.hamiltonian(matrix(k4))), [-3, 1, 1, 1])
    h = S.hamiltonian(matrix(k4), "laplacian")
    assert np.allclose(h.sum(axis=0), 0) and np.allclose(h, h.T)
    with pytest.raises(ValueError):
        S.hamiltonian(matrix(k3), "other")
    with pytest.raises(ValueError):
        S.hamiltonian(np.zeros((0, 0)))


@pytest.mark.parametrize("t", [0.5, 3.0, 50.0])
def test_walk_against_series_and_unitarity(t):
    r = np.random.default_rng(42)
    a = r.integers(0, 2, (8, 8))
    a = np.triu(a, 1) + np.triu(a, 1).T
    values, vectors = np.linalg.eigh(-a.astype(float))
    u = S.walk(values, vectors, t)
    assert np.abs(u - S.expm(1j * a * t)).max() < 1e-9 and np.abs(u @ u.conj().T - np.eye(8)).max() < 1e-8


def test_fingerprints_do_not_depend_on_labels():
    r = np.random.default_rng(1)
    for _, a, b in X.synthetic_suite():
        for g in (a, b):
            m = matrix(g)
            for _ in range(5):
                p = r.permutation(len(m))
                assert np.abs(S.fingerprint(m) - S.fingerprint(m[np.ix_(p, p)])).max() < 1e-12


def cosine(a, b):
    return 1 - a @ b / np.sqrt(a @ a * (b @ b))


def test_golden_distances():
    want = {"rings": 0.211722, "stars": 0.104633, "campaigns": 0.0}
    for name, a, b in X.synthetic_suite():
        assert abs(cosine(S.fingerprint(matrix(a)), S.fingerprint(matrix(b))) - want[name]) < 1e-6
        if name != "campaigns":
            assert abs(cosine(S.embedding(a[0]["type"].tolist(), matrix(a), seed=1), S.embedding(b[0]["type"].tolist(), matrix(b), seed=1))) < 1e-12
    assert not S.embedding([], np.zeros((0, 0))).any() and S.embedding(["ip"], np.zeros((1, 1)), aggregation="max").shape == (16,)


def test_demo_predictions_and_recovery(spark):
    n, e = X.frames(spark, [X.demo()])
    top = L.explained(S.top_walk_links(n, e, 5)).orderBy("rank").collect()
    assert [(r.node_a, r.node_b, round(r.score, 9)) for r in top] == [
        ("phish3.xyz", "separate_cert", 0.117010162), ("phish1.xyz", "admin.phish0.xyz", 0.100655013), ("phish2.xyz", "admin.phish0.xyz", 0.100655013),
        ("phish3.xyz", "185.220.101.47", 0.058626319), ("phish4.xyz", "wildcard_cert", 0.049009602),
    ]
    assert top[0].explanation == "phish3.xyz probably shares a TLS certificate with separate_cert" and top[0].confidence == "high"
    hidden = S.hidden_links(n, e)
    assert {frozenset((r.src, r.dst)) for r in hidden.collect()} == {
        frozenset(p) for p in (("185.220.101.47", "AS44477|Stark"), ("phish2.xyz", "wildcard_cert"), ("phish2.xyz", "NameCheap"), ("phish0.xyz", "NameCheap"), ("phish1.xyz", "wildcard_cert"))
    }
    left = e.join(hidden.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
    pairs = L.candidates(n, left)
    m = L.recovery_metrics(L.ranked(S.walk_scores(n, left)), hidden).first()
    assert (round(m.mrr, 6), m.hits_3, m.hits_5, m.n_candidates) == (0.182286, 0.2, 0.4, 31)
    assert round(L.recovery_metrics(L.ranked(L.adamic_adar(n, left, pairs)), hidden).first().mrr, 6) == 0.141259
    assert round(L.recovery_metrics(L.ranked(S.random_scores(pairs)), hidden).first().mrr, 6) == 0.128403
    every = {(r.seed, r.method): r for r in S.recoveries(n, e, seeds=range(10)).collect()}
    assert [round(every[0, k].mrr, 6) for k in ("walk", "common", "random")] == [0.182286, 0.141259, 0.128403]
    assert [round(sum(every[s, k].mrr for s in range(10)) / 10, 4) for k in ("walk", "common", "random")] == [0.1933, 0.1789, 0.0920]
    assert every[0, "walk"].asDict() | m.asDict(True) == every[0, "walk"].asDict() | {k: v for k, v in m.asDict(True).items()}


def test_top_links_equal_the_relational_way(spark):
    """Ranks and bands made in a graph's task, against those of windows and percentiles over all candidates."""
    graphs = [X.demo(), X.plain(3, [(0, 1)], "tiny"), *[(n.assign(graph_id=f"{g}"), e.assign(graph_id=f"{g}")) for g, (_, _, n, e) in enumerate(X.archetypes())]]
    n, e = X.frames(spark, graphs)
    columns = ["graph_id", "rank", "node_a", "node_b", "relation", "confidence"]
    got = sorted(r[:] for r in S.top_walk_links(n, e, 7).select(columns).collect())
    assert got == sorted(r[:] for r in L.top_links(S.walk_scores(n, e), 7).select(columns).collect()) and len(got) >= 7
    common = sorted(r[:] for r in S.top_common_links(n, e, 7).select(columns).collect())
    assert common == sorted(r[:] for r in L.top_links(L.adamic_adar(n, e), 7).select(columns).collect())
    pairs = sorted(r[:] for r in L.candidates(n, e).select("graph_id", "i", "j", "relation").collect())
    assert pairs == sorted(r[:] for r in S.walk_scores(n, e).select("graph_id", "i", "j", "relation").collect())


@pytest.mark.parametrize("seed", range(4))
def test_hidden_links_as_by_trying_each(seed):
    """The spanning tree's complement is what hiding one by one, with a look at the whole graph each time, gives."""
    import pandas as pd

    r = np.random.default_rng(seed)
    links = sorted({tuple(sorted(p)) for p in r.integers(0, 14, (40, 2)).tolist() if p[0] != p[1]} | {(k, k + 1) for k in range(13)})
    n, e = X.plain(14, links)

    def whole(left):
        seen, todo = {0}, [0]
        while todo:
            x = todo.pop()
            for a, b in left:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return len(seen) == 14

    count = max(1, int(len(links) * 0.2))
    count = max(1, len(links) - 14) if count >= len(links) - 13 else count
    left, want = list(links), []
    for k in np.random.default_rng(seed).permutation(len(links)):
        if len(want) < count and whole([x for x in left if x != links[k]]):
            left.remove(links[k])
            want.append(int(k))
    assert S.hide(n, e, seed=seed) == want
    assert S.hide(n, pd.concat([e.iloc[:1]]), seed=seed) == []  # in pieces already


def test_hubs_are_scored_as_wedges_are(spark):
    n, e = X.frames(spark, [X.demo()])
    score = lambda **k: {(r.node_a, r.node_b): round(r.score, 9) for r in L.adamic_adar(n, e, **k).collect()}
    assert score(hub=0) == score(hub=2) == score()


def test_matrices_that_are_not_hermitian_are_refused(spark):
    rows = [("a", 0, 1, -1.0), ("a", 1, 0, -1.0), ("b", 0, 1, 2.0)]
    m = spark.createDataFrame(rows, "graph_id string, i int, j int, h double")
    assert S.hermitian(m.where("graph_id = 'a'")).count() == 2 and S.asymmetries(m).count() == 1
    with pytest.raises(Exception, match="not Hermitian"):
        S.hermitian(m).collect()


def test_large_graphs_are_refused(spark, monkeypatch):
    n, e = X.frames(spark, [X.demo()])
    monkeypatch.setattr(S, "MAX_NODES", 10)
    with pytest.raises(Exception, match="dense operators take 10"):
        S.spectra(n, e).collect()


def brute_campaign(egos, seed, depth, per_level, budget):
    """Expansion of one seed, a leaf at a time."""
    odd = lambda x: x.rsplit(".", 1)[-1] in {"xyz", "tk"}
    leaves = lambda g: [x for x, t in egos.get(g, []) if t == "cert_peer" and x not in done] + [x for x, t in egos.get(g, []) if t == "co_host" and odd(x) and x not in done]
    nodes, done, log = {x for x, _ in egos[seed]}, {seed}, []
    frontier = leaves(seed)
    for d in range(1, depth + 1):
        found = []
        for leaf in frontier[:per_level]:
            if leaf in done:
                continue
            if len(nodes) >= budget:
                break
            done.add(leaf)
            if not egos.get(leaf):
                log.append((seed, d, leaf, "empty", None))
                continue
            nodes |= {x for x, _ in egos[leaf]}
            found += leaves(leaf)
            log.append((seed, d, leaf, "expanded", len(egos[leaf])))
        frontier = list(dict.fromkeys(found))
    return sorted(log, key=str)


@pytest.mark.parametrize("budget", [4, 9, 14, 80])
def test_campaigns_against_expanding_leaf_by_leaf(spark, budget):
    r = np.random.default_rng(budget)
    names = [f"d{k}.{('com', 'xyz', 'tk')[k % 3]}" for k in range(24)]
    egos = {}
    for k, name in enumerate(names[:20]):  # the last have no graph of their own
        others = [x for x in r.permutation(names).tolist() if x != name][:6]
        egos[name] = [(name, "domain")] + [(x, ("cert_peer", "co_host", "ip")[j % 3]) for j, x in enumerate(others)]
    rows = [(g, x, i, t) for g, own in egos.items() for i, (x, t) in enumerate(own)]
    table = spark.createDataFrame(rows, "graph_id string, node string, node_idx int, type string")
    seeds = names[:5]
    _, log = G.expanded(spark.createDataFrame([(s,) for s in seeds], "seed string"), table, depth=3, per_level=3, budget=budget)
    got = {s: sorted([x[:] for x in log.where(F.col("seed") == s).select("seed", "depth", "domain", "status", "nodes_added").collect()], key=str) for s in seeds}
    assert got == {s: brute_campaign(egos, s, 3, 3, budget) for s in seeds}


def test_confidence_bands(spark):
    rows = [("a", 0, k, float(s)) for k, s in enumerate((10, 3, 2, 1))] + [("b", 0, k, float(s)) for k, s in enumerate((3, 2, 1))] + [("c", 0, 0, 1.0)]
    got = L.with_confidence(spark.createDataFrame(rows, "graph_id string, i int, j int, score double")).orderBy("graph_id", "j").collect()
    assert [r.confidence for r in got] == ["high", "medium", "low", "low", "high", "medium", "low", "high"]


def test_archetypes(spark):
    graphs = [(n, e) for _, _, n, e in X.archetypes()]
    got = S.missing_nodes(S.signatures(*X.frames(spark, graphs))).collect()
    assert all(r.match_distance < 1e-9 and r.confidence == "high" for r in got) and len(got) == 15
    d = {n["graph_id"].iloc[0]: S.signature(n, e) for n, e in graphs}
    assert abs(np.linalg.norm(d["shared_ip_star_4"] - d["shared_cert_star_4"]) - 0.9381) < 1e-4


def test_node_budget(spark):
    def graph(name, **kinds):
        rows = [(name, "root", 0, "domain")]
        for t, n in kinds.items():
            rows += [(name, f"{t}{k}", len(rows) + k, t) for k in range(n)]
        return rows

    rows = graph("x", co_host=40, cert_peer=20) + graph("y", cert_peer=30, subdomain=30) + graph("z", co_host=5)
    n = spark.createDataFrame(rows, X.NODE)
    e = n.where("node <> 'root'").select("graph_id", F.lit("root").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("edge_idx"), F.lit("r").alias("relation"), F.lit(1.0).alias("weight"))
    kept, links, counts = G.trimmed(n, e, F.col("node") == "root")
    assert {r.graph_id: r["count"] for r in kept.groupBy("graph_id").count().collect()} == {"x": 24, "y": 36, "z": 6}
    assert {r.graph_id: r.truncated_counts for r in counts.collect()} == {"x": {"co_host": 37}, "y": {"cert_peer": 25}, "z": {}}
    assert links.count() == 23 + 35 + 5


def test_assembly_and_expansion(spark, tmp_path):
    dns = spark.createDataFrame([("g", "a.com", "1.1.1.1", 0.5)], "graph_id string, domain string, ip string, weight double")
    shared = spark.createDataFrame([("g", "1.1.1.1", "a.com"), ("g", "1.1.1.1", "b.com")], "graph_id string, ip string, co_host string")
    n, e = G.assemble({"dns": dns, "shared": shared})
    assert {r.node: r.type for r in n.collect()} == {"a.com": "domain", "1.1.1.1": "ip", "b.com": "co_host"}
    assert {(r.src, r.dst): r.relation for r in e.collect()} == {("a.com", "1.1.1.1"): "also-hosts", ("1.1.1.1", "b.com"): "also-hosts"}
    assert {r.node: r.type for r in G.assemble({"dns": dns, "shared": shared}, protect_root=False)[0].collect()}["a.com"] == "co_host"
    signals.write_graphs(n.select("graph_id").distinct().withColumn("label", F.lit(1)), n, e, str(tmp_path / "g"))
    assert [df.count() for df in signals.read_graphs(spark, str(tmp_path / "g"))] == [1, 3, 2]
    assert G.connected(*G.composed((n, e), (n, e))).first().is_connected
