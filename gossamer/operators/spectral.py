"""Dense per-graph algebra: spectra, walks, fingerprints, embeddings, signatures, hide-and-recover.

Everything around it is relational; here each graph (some hundred nodes) is one group of an Arrow-backed
function. Nodes and edges come as a cogroup, so nodes without edges take part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import fixed as X
from gossamer.operators.graph import roots


#: Nodes of the largest graph that the dense operators take: some hundred megabytes a matrix.
MAX_NODES = 5000


def adjacency(nodes: pd.DataFrame, edges: pd.DataFrame, weighted: bool = True) -> tuple[list[str], np.ndarray]:
    nodes = nodes.sort_values("node_idx")
    order = nodes["node"].tolist()
    at = {n: k for k, n in enumerate(order)}
    a = np.zeros((len(order), len(order)))
    w = edges["weight"].to_numpy() if weighted else np.ones(len(edges))
    for s, d, x in zip(edges["src"], edges["dst"], w):
        a[at[s], at[d]] = a[at[d], at[s]] = x
    return order, a


def hamiltonian(a: np.ndarray, variant: str = "adjacency") -> np.ndarray:
    if not len(a):
        raise ValueError("the graph has no nodes")
    if variant == "adjacency":
        return -a
    if variant == "laplacian":
        return np.diag(a.sum(axis=1)) - a
    raise ValueError(f"unknown variant {variant!r}")


def walk(values: np.ndarray, vectors: np.ndarray, t: float) -> np.ndarray:
    """exp(-iHt) from the spectrum of H."""
    return (vectors * np.exp(-1j * values * t)) @ vectors.T


def histogram(values: np.ndarray, bins: int, low: float, high: float, digits: int | None = 9) -> np.ndarray:
    """Shares of the values in range; rounding first, since whole eigenvalues lie on edges of bins."""
    values = values if digits is None else np.round(values, digits) + 0.0
    n = np.histogram(values, bins=bins, range=(low, high))[0].astype(float)
    return n / n.sum() if n.sum() else n


def statistics(p: np.ndarray) -> list[float]:
    return [p.mean(), p.std(), p.min(), p.max(), np.median(p)]


def return_statistics(values: np.ndarray, vectors: np.ndarray, times) -> np.ndarray:
    out = []
    squares = vectors**2  # the diagonal of a walk needs no other entry
    for t in times:
        out += statistics(np.abs(squares @ np.exp(-1j * values * t)) ** 2)
    return np.array(out)


def fingerprint(a: np.ndarray, times=tuple(X.TIMES), method: str = "combined") -> np.ndarray:
    values, vectors = np.linalg.eigh(hamiltonian(a))
    return _phi(method, lambda: values, lambda: return_statistics(values, vectors, times))


def _phi(method: str, values, statistics) -> np.ndarray:
    if method not in ("eigenvalue_histogram", "return_probability", "combined"):
        raise ValueError(f"unknown method {method!r}")
    parts = [histogram(values(), 20, -10, 10)] if method != "return_probability" else []
    return np.concatenate(parts + [statistics()] if method != "eigenvalue_histogram" else parts)


def embedding(types: list[str], a: np.ndarray, layers: int = 2, dim: int = 16, seed: int = 0, aggregation: str = "mean") -> np.ndarray:
    """Neighbourhood aggregation with untrained weights, pooled by the mean. ``a`` says who is linked."""
    if aggregation not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if not len(types):
        return np.zeros(dim)
    return embedded(types, *np.nonzero(a), layers, dim, seed, aggregation)


def embedded(types: list[str], i: np.ndarray, j: np.ndarray, layers: int = 2, dim: int = 16, seed: int = 0, aggregation: str = "mean") -> np.ndarray:
    """The same from links: ``j`` are the neighbours of ``i``, each link both ways."""
    rng, n = np.random.default_rng(seed), len(types)
    degree = np.bincount(i, minlength=n)
    h = np.array([[float((t if t in X.EMBEDDED_TYPES else "unknown") == k) for k in X.EMBEDDED_TYPES] for t in types])
    for _ in range(layers):
        w = rng.standard_normal((dim, 2 * h.shape[1])) * 0.1
        if aggregation == "mean":
            around = np.stack([np.bincount(i, c[j], n) for c in h.T], axis=1) / np.maximum(1, degree)[:, None]
        else:
            around = np.full(h.shape, -np.inf)
            np.maximum.at(around, i, h[j])
            around[degree == 0] = 0
        h = np.maximum(0, np.concatenate([h, around], axis=1) @ w.T)
    return h.mean(axis=0)


def bucket_of(a: str, b: str) -> int:
    return next((k for k, pair in enumerate(X.BUCKETS) if {a, b} == set(pair)), len(X.BUCKETS) - 1)


def link_spectrum(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The eigenvalues of minus the adjacency of some links, piece by piece: a star's are known, others are dense."""
    at = pd.Index(sorted({x for p in pairs for x in p}))
    x, y = (at.get_indexer([p[c] for p in pairs]) for c in (0, 1))
    root = roots(len(at), x, y)
    order, by = np.argsort(root, kind="stable"), np.argsort(root[x], kind="stable")
    place = np.empty(len(at), np.int64)
    starts, sizes = np.unique(root[order], return_index=True, return_counts=True)[1:]
    for s, n in zip(starts, sizes):
        place[order[s : s + n]] = np.arange(n)
    ends = np.searchsorted(root[x][by], root[order][starts], "right")
    values, begun = [], 0
    for n, end in zip(sizes, ends):
        u, v = place[x[by[begun:end]]], place[y[by[begun:end]]]
        begun = end
        links = np.unique(np.minimum(u, v) * n + np.maximum(u, v))
        u, v = links // n, links % n
        if len(links) == n - 1 and (u != v).all() and np.bincount(np.concatenate([u, v]), minlength=n).max() == n - 1:
            values.append(np.concatenate([[-np.sqrt(n - 1)], np.zeros(n - 2), [np.sqrt(n - 1)]]))
            continue
        if n > MAX_NODES:
            raise ValueError(f"a piece has {n} nodes; dense operators take {MAX_NODES}")
        a = np.zeros((n, n))
        a[u, v] = a[v, u] = 1
        values.append(np.linalg.eigvalsh(-a))
    return np.concatenate(values)


def signature(nodes: pd.DataFrame, edges: pd.DataFrame) -> np.ndarray:
    """Per bucket of link types: the spectrum of its links (4 bins on [-4, 4]) times its share of links."""
    kind = dict(zip(nodes["node"], nodes["type"]))
    groups: dict[int, list[tuple[str, str]]] = {}
    for s, d in zip(edges["src"], edges["dst"]):
        groups.setdefault(bucket_of(kind.get(s, "other"), kind.get(d, "other")), []).append((s, d))
    out = np.zeros((len(X.BUCKETS), 4))
    for k, pairs in groups.items():
        out[k] = histogram(link_spectrum(pairs), 4, -4, 4) * len(pairs) / len(edges)
    return out.ravel()


def hide(nodes: pd.DataFrame, edges: pd.DataFrame, fraction: float = 0.2, seed: int = 0, clamp: bool = True) -> list[int]:
    """Positions of links to hide: a random order, each taken only if what is left stays connected.

    With ``clamp`` a sparse graph hides no more than its links beyond its nodes.
    """
    edges = edges.sort_values("edge_idx")
    at = {n: k for k, n in enumerate(nodes["node"])}
    return hide_pairs(len(nodes), [(at[s], at[d]) for s, d in zip(edges["src"], edges["dst"])], fraction, seed, clamp)


def hide_pairs(n_nodes: int, pairs: list[tuple[int, int]], fraction: float = 0.2, seed: int = 0, clamp: bool = True) -> list[int]:
    """The same from the places of the links' ends, in the order of edge_idx."""
    n_edges = len(pairs)
    if not n_edges:
        return []
    count = max(1, int(n_edges * fraction))
    if clamp and count >= n_edges - (n_nodes - 1):
        count = max(1, n_edges - n_nodes)
    order = np.random.default_rng(seed).permutation(n_edges).tolist()
    # An edge has to stay if it is in the spanning tree that prefers edges late in the order.
    root, left, tree = list(range(n_nodes)), n_nodes, set()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in reversed(order):
        s, d = find(pairs[k][0]), find(pairs[k][1])
        if s != d:
            root[s], left = d, left - 1
            tree.add(k)
    return [k for k in order if k not in tree][:count] if left == 1 else []


def _per_graph(nodes: DataFrame, edges: DataFrame, make, schema: str, most: float | None = None) -> DataFrame:
    """``make(graph_id, nodes, edges) -> rows`` for each graph that has nodes, of ``MAX_NODES`` or ``most`` at most."""
    names, most = [x.split()[0] for x in schema.split(", ")], MAX_NODES if most is None else most

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if len(n) > most:
            raise ValueError(f"graph {key[0]} has {len(n)} nodes; dense operators take {most}")
        return pd.DataFrame(make(key[0], n, e) if len(n) else [], columns=names)

    nodes, edges = nodes.toDF(*nodes.columns), edges.toDF(*edges.columns)  # columns of their own, even of one origin
    return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, schema)


def _key(nodes: DataFrame) -> str:
    return "graph_id " + nodes.schema["graph_id"].dataType.simpleString()


def spectra(nodes: DataFrame, edges: DataFrame, weighted: bool = True, variant: str = "adjacency") -> DataFrame:
    def make(g, n, e):
        order, a = adjacency(n, e, weighted)
        values, vectors = np.linalg.eigh(hamiltonian(a, variant))
        return [(g, len(order), order, values.tolist(), vectors.ravel().tolist())]

    return _per_graph(nodes, edges, make, f"{_key(nodes)}, n int, node_order array<string>, eigenvalues array<double>, eigenvectors array<double>")


def walks(nodes: DataFrame, edges: DataFrame, times=tuple(X.TIMES), weighted: bool = True) -> DataFrame:
    """(graph_id, t, i, j, prob): |U(t)|^2 for i <= j."""

    def make(g, n, e):
        values, vectors = np.linalg.eigh(hamiltonian(adjacency(n, e, weighted)[1]))
        rows = []
        for t in times:
            p = np.abs(walk(values, vectors, t)) ** 2
            rows += [(g, t, i, j, p[i, j]) for i in range(len(p)) for j in range(i, len(p))]
        return rows

    return _per_graph(nodes, edges, make, f"{_key(nodes)}, t double, i int, j int, prob double")


def unitarity(nodes: DataFrame, edges: DataFrame, times=tuple(X.TIMES)) -> DataFrame:
    """(graph_id, t, max_error, is_unitary), and how far U(t) is from a series for exp(-iHt)."""

    def make(g, n, e):
        h = hamiltonian(adjacency(n, e)[1])
        values, vectors = np.linalg.eigh(h)
        rows = []
        for t in times:
            u = walk(values, vectors, t)
            err = float(np.abs(u @ u.conj().T - np.eye(len(u))).max())
            rows.append((g, t, err, err < 1e-8, float(np.abs(u - expm(-1j * h * t)).max())))
        return rows

    return _per_graph(nodes, edges, make, f"{_key(nodes)}, t double, max_error double, is_unitary boolean, series_error double")


def expm(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor series."""
    k = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(m).sum(axis=1).max())))) + 1)
    m, out, term = m / 2**k, np.eye(len(m), dtype=complex), np.eye(len(m), dtype=complex)
    for j in range(1, 19):
        term = term @ m / j
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def fingerprints(nodes: DataFrame, edges: DataFrame, method: str = "combined", times=tuple(X.TIMES)) -> DataFrame:
    """``fingerprint`` of each graph, from the spectrum of its near nodes' matrix (see ``walks``)."""
    from gossamer.operators import blocks

    def make(g, n, e):
        return [(g, len(n), blocks.Walked(g, n, e).fingerprint(times, method).tolist())]

    return _per_graph(nodes, edges.select("graph_id", "src", "dst", "weight"), make, f"{_key(nodes)}, n_nodes int, phi array<double>", float("inf"))


def embeddings(nodes: DataFrame, edges: DataFrame, seed: int = 0, aggregation: str = "mean") -> DataFrame:
    def make(g, n, e):
        n = n.sort_values("node_idx")
        i, j = neighbours(n, e)
        return [(g, len(n), embedded(n["type"].tolist(), i, j, seed=seed, aggregation=aggregation).tolist())]

    return _per_graph(nodes, edges.select("graph_id", "src", "dst"), make, f"{_key(nodes)}, n_nodes int, embedding array<double>", float("inf"))


def signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _per_graph(nodes, edges.select("graph_id", "src", "dst"), lambda g, n, e: [(g, len(n), signature(n, e).tolist())], f"{_key(nodes)}, n_nodes int, signature array<double>", float("inf"))


def neighbours(nodes: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked nodes, each link both ways and once, in order; ``nodes`` are in order of node_idx."""
    at, n = pd.Index(nodes["node"]), len(nodes)
    x, y = at.get_indexer(edges["src"]).astype(np.int64), at.get_indexer(edges["dst"]).astype(np.int64)
    if len(x) and min(x.min(), y.min()) < 0:
        raise KeyError("a link to a node that the graph does not have")
    key = np.unique(np.concatenate([x * n + y, y * n + x]))
    return key // max(1, n), key % max(1, n)


def linked(nodes: pd.DataFrame, edges: pd.DataFrame) -> np.ndarray:
    """Who is linked, links of weight zero included."""
    at = {n: k for k, n in enumerate(nodes.sort_values("node_idx")["node"])}
    out = np.zeros((len(at), len(at)), bool)
    for s, d in zip(edges["src"], edges["dst"]):
        out[at[s], at[d]] = out[at[d], at[s]] = True
    return out


_RELATION = {(a, b): k for k, (x, y, _, _) in enumerate(X.LINK_TYPES) for a, b in ((x, y), (y, x))}
_TYPES = sorted({t for pair in _RELATION for t in pair})
_LINKABLE = np.array([[_RELATION.get((a, b), -1) for b in [*_TYPES, None]] for a in [*_TYPES, None]])


def open_pairs(types: list[str], link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, relation) of unlinked pairs i < j of linkable types, in that order."""
    code = np.array([_TYPES.index(t) if t in _TYPES else len(_TYPES) for t in types])
    relation = _LINKABLE[np.ix_(code, code)]
    i, j = np.nonzero(np.triu((relation >= 0) & ~link, 1))
    return i, j, relation[i, j]


def walk_matrix(a: np.ndarray, times=tuple(X.TIMES)) -> np.ndarray:
    """The walk's probability between any two nodes, averaged over times."""
    values, vectors = np.linalg.eigh(hamiltonian(a))
    out = np.zeros_like(a)
    for t in times:
        out += ((vectors * np.cos(values * t)) @ vectors.T) ** 2 + ((vectors * np.sin(values * t)) @ vectors.T) ** 2
    return out / len(times)


def common_matrix(link: np.ndarray) -> np.ndarray:
    """Adamic-Adar scores of all pairs."""
    return (link / np.maximum(np.log(np.maximum(1, link.sum(axis=0))), 1e-10)) @ link


def ordered(score: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.lexsort((j, i, -np.round(score, 12)))


_SCORED = "i int, j int, node_a string, node_b string, type_a string, type_b string, relation string, score double"


def _scored_pairs(n: pd.DataFrame, e: pd.DataFrame, matrix) -> pd.DataFrame:
    n = n.sort_values("node_idx")
    names, types, idx = n["node"].to_numpy(), n["type"].to_numpy(), n["node_idx"].to_numpy()
    i, j, relation = open_pairs(types.tolist(), linked(n, e))
    score = matrix(n, e)[i, j]
    words = np.array([x[2] for x in X.LINK_TYPES], object)
    return pd.DataFrame({"i": idx[i], "j": idx[j], "node_a": names[i], "node_b": names[j], "type_a": types[i], "type_b": types[j], "relation": words[relation], "score": score})


def walk_scores(nodes: DataFrame, edges: DataFrame, times=tuple(X.TIMES)) -> DataFrame:
    """Every candidate (unlinked, of linkable types) with the walk's probability between its nodes, averaged over times."""
    return _per_graph(nodes, edges, lambda g, n, e: _scored_pairs(n, e, lambda n, e: walk_matrix(adjacency(n, e)[1], times)).assign(graph_id=g), f"{_key(nodes)}, {_SCORED}")


def top_walk_links(nodes: DataFrame, edges: DataFrame, k: int = 10, times=tuple(X.TIMES)) -> DataFrame:
    """The ``k`` likeliest candidates of each graph by the walk. Same rows as ``links.top_links`` over ``walk_scores``."""
    from gossamer.operators import blocks

    return blocks.top_walk_links(nodes, edges, k, times)


def top_common_links(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The same by common neighbours: the rows of ``links.top_links`` over ``links.adamic_adar``, for graphs that fit a task."""
    return _top_links(nodes, edges, k, lambda n, e: common_matrix(linked(n, e)))


def _top_links(nodes: DataFrame, edges: DataFrame, k: int, matrix) -> DataFrame:
    """The ``k`` best candidates of each graph with rank and confidence; only these leave the graph's task.

    The bands are percentiles over all of a graph's candidates.
    """

    def make(g, n, e):
        all_ = _scored_pairs(n, e, matrix)
        s = np.round(all_["score"].to_numpy(), 12)
        if not len(s):
            return []
        best = ordered(s, all_["i"].to_numpy(), all_["j"].to_numpy())[:k]
        return all_.iloc[best].assign(graph_id=g, rank=np.arange(1, len(best) + 1), confidence=bands(s, s[best]))

    return _per_graph(nodes, edges, make, top_schema(nodes))


def top_schema(nodes: DataFrame) -> str:
    return f"{_key(nodes)}, rank int, {_SCORED}, confidence string"


def bands(every: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The confidence of ``some`` of the rounded scores of all candidates."""
    high = np.percentile(every, 75) if len(every) > 3 else every.max()
    middle = np.percentile(every, 50) if len(every) > 1 else 0.0
    return np.where(some >= high, "high", np.where(some >= middle, "medium", "low"))


def random_scores(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """A number of numpy's generator for each candidate in the order of (i, j)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["i", "j"])
        return df.assign(score=np.random.default_rng(seed).random(len(df)))

    from pyspark.sql import types as T

    return pairs.groupBy("graph_id").applyInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())]))


def hidden_links(nodes: DataFrame, edges: DataFrame, fraction: float = 0.2, seed: int = 0, clamp: bool = True) -> DataFrame:
    def make(g, n, e):
        e = e.sort_values("edge_idx")
        return [(g, k, e["src"].iloc[p], e["dst"].iloc[p]) for k, p in enumerate(hide(n, e, fraction, seed, clamp))]

    return _per_graph(nodes, edges, make, f"{_key(nodes)}, ord int, src string, dst string", float("inf"))


HITS = (1, 3, 5, 10)


def recoveries(nodes: DataFrame, edges: DataFrame, seeds=(0,), fraction: float = 0.2, times=tuple(X.TIMES)) -> DataFrame:
    """Hide and recover: the metrics of the walk, of common neighbours and of chance, by graph and seed."""
    from gossamer.operators import blocks

    return blocks.recoveries(nodes, edges, seeds, fraction, times)


def hamiltonian_entries(nodes: DataFrame, edges: DataFrame, variant: str = "adjacency", weighted: bool = True) -> DataFrame:
    """(graph_id, i, j, h): the entries of each graph's matrix that are not zero, whatever the graph's size.

    A pair of nodes has one edge, as ``assemble`` gives it.
    """
    if variant not in ("adjacency", "laplacian"):
        raise ValueError(f"unknown variant {variant!r}")
    at = lambda node, k: nodes.select("graph_id", F.col("node").alias(node), F.col("node_idx").cast("int").alias(k))
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = edges.select("graph_id", "src", "dst", w.alias("w")).where("w <> 0")
    e = e.join(at("src", "i"), ["graph_id", "src"]).join(at("dst", "j"), ["graph_id", "dst"])
    apart, h = F.col("i") != F.col("j"), -F.col("w")
    entry = lambda i, j, h: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), h.alias("h"))
    if variant == "adjacency":
        found = F.when(apart, F.array(entry("i", "j", h), entry("j", "i", h))).otherwise(F.array(entry("i", "j", h)))
        return e.select("graph_id", F.explode(found).alias("x")).select("graph_id", "x.*")
    # all four entries of a link; those of a node's place add up
    e = e.where(apart)
    off = e.select("graph_id", F.explode(F.array(entry("i", "j", h), entry("j", "i", h))).alias("x")).select("graph_id", "x.*")
    sums = e.select("graph_id", F.explode(F.array("i", "j")).alias("i"), "w").groupBy("graph_id", "i").agg(F.sum("w").alias("h")).where("h <> 0")
    return off.unionByName(sums.select("graph_id", "i", F.col("i").alias("j"), "h"))


def asymmetries(entries: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """The entries (graph_id, i, j, h) whose mirror is another value: none of a Hermitian matrix."""
    back = entries.select("graph_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col("h").alias("_back"))
    return entries.join(back, ["graph_id", "i", "j"], "left").where(F.abs(F.col("h") - F.coalesce("_back", F.lit(0.0))) > tolerance).drop("_back")


def hermitian(entries: DataFrame) -> DataFrame:
    """``entries``, failing where a matrix is not Hermitian. An entry meets its mirror in one pass."""
    low, high = F.least("i", "j").alias("_low"), F.greatest("i", "j").alias("_high")
    at = lambda which: F.max(F.when(which, F.col("h")))
    both = entries.groupBy("graph_id", low, high).agg(at(F.col("i") <= F.col("j")).alias("_up"), at(F.col("i") > F.col("j")).alias("_down"))
    bad = (F.col("_low") != F.col("_high")) & (F.abs(F.coalesce("_up", F.lit(0.0)) - F.coalesce("_down", F.lit(0.0))) > 1e-10)
    refused = F.raise_error(F.concat(F.lit("not Hermitian: graph "), F.col("graph_id").cast("string"))).cast("double")
    entry = lambda i, j, h: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.when(bad, refused).otherwise(F.col(h)).alias("h"))
    found = F.explode(F.array(entry("_low", "_high", "_up"), entry("_high", "_low", "_down"))).alias("x")
    return both.select("graph_id", found).select("graph_id", "x.*").where("h IS NOT NULL")


def permutation_errors(nodes: DataFrame, edges: DataFrame, tries: int = 5, seed: int = 0) -> DataFrame:
    """(graph_id, max_error): how far a fingerprint moves when a graph's nodes are put in other orders."""

    def make(g, n, e):
        a, r = adjacency(n, e)[1], np.random.default_rng(seed)
        phi = fingerprint(a)
        orders = (r.permutation(len(a)) for _ in range(tries))
        return [(g, max(float(np.abs(fingerprint(a[np.ix_(p, p)]) - phi).max()) for p in orders))]

    return _per_graph(nodes, edges, make, f"{_key(nodes)}, max_error double")


def _archetypes(signed: DataFrame, max_size: int) -> DataFrame:
    """Each signature with each of the archetypes (15 rows) and their distance."""
    from gossamer.functions.columns import distance
    from gossamer.sources.fixtures import archetypes

    rows = []
    for name, size, n, e in archetypes(max_size):
        rows.append((name, size, len(n), signature(n, e).tolist()))
    table = signed.sparkSession.createDataFrame(rows, "archetype string, size int, full int, target array<double>")
    each = signed.crossJoin(F.broadcast(table)).withColumn("d", F.round(distance(F.col("signature"), F.col("target"), "euclidean"), 12))
    order = list(dict.fromkeys(r[0] for r in rows))
    return each.withColumn("r", F.array_position(F.array(*map(F.lit, order)), F.col("archetype")))


def archetype_matches(signed: DataFrame, k: int = 5, max_size: int = 6) -> DataFrame:
    """(graph_id, rank, archetype, size, d): the ``k`` nearest archetypes of each signature."""
    found = _archetypes(signed, max_size).groupBy("graph_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "r", "size", "archetype"))), 1, k).alias("m"))  # 15 a graph
    return found.select("graph_id", F.posexplode("m").alias("p", "m")).select("graph_id", (F.col("p") + 1).alias("rank"), "m.archetype", "m.size", "m.d")


def missing_nodes(signed: DataFrame, max_size: int = 6) -> DataFrame:
    """Best of the archetypes for each signature, and what it says is missing."""
    best = _archetypes(signed, max_size).groupBy("graph_id", "n_nodes").agg(F.min(F.struct("d", "r", "size", "archetype", "full")).alias("b"))
    missing = F.greatest(F.lit(0), F.col("b.full") - F.col("n_nodes"))
    return best.select(
        "graph_id", F.when((missing > 0) | (F.col("b.d") < 0.2), F.col("b.archetype")).alias("best_archetype"), F.col("b.full").alias("best_size"), F.col("b.d").alias("match_distance"),
        missing.alias("missing"), F.when(missing > 0, "domain").alias("likely_type"), F.when(F.col("b.d") < 0.05, "high").when(F.col("b.d") < 0.15, "medium").otherwise("low").alias("confidence"),
    )


def compared(prints: DataFrame, embedded: DataFrame, threshold: float = 0.05, pairs: DataFrame | None = None, most: int = X.COMPARED) -> DataFrame:
    """Pairs of graphs (a < b) with both distances and the verdict; each graph's vectors are made once.

    ``pairs`` (graph_a, graph_b) says which; without it, all pairs of the first ``most`` graphs by name, which bounds
    what the comparison of everything with everything makes.
    """
    from gossamer.functions.columns import distance

    both = prints.select("graph_id", "phi").join(embedded.select("graph_id", "embedding"), "graph_id")
    if pairs is None:
        names = both.select("graph_id").orderBy("graph_id").limit(most)
        a, b = (names.withColumnRenamed("graph_id", f"graph_{x}") for x in "ab")
        pairs = a.join(F.broadcast(b), F.col("graph_a") < F.col("graph_b"))
    a, b = both.toDF("graph_a", "phi_a", "emb_a"), both.toDF("graph_b", "phi_b", "emb_b")
    out = pairs.select("graph_a", "graph_b").join(a, "graph_a").join(b, "graph_b")
    out = out.select("graph_a", "graph_b", distance(F.col("phi_a"), F.col("phi_b")).alias("walk_distance"), distance(F.col("emb_a"), F.col("emb_b")).alias("embedding_distance"))
    return out.withColumn("blind_spot", (F.col("walk_distance") > threshold) & ~(F.col("embedding_distance") > threshold))
