"""A graph's candidates in blocks: metrics, densities and best links of all of them, none leaving the graph's task.

A block holds the candidates (i, j) of some rows i in the order of (i, j), with their scores; the next ones are made when it
is done with. So a task takes memory by links and blocks, not by candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import fixed as X
from gossamer.operators import spectral as S
from gossamer.operators import walks as W

#: Cells and wedges of a block; a single row may have more.
CELLS = 1 << 21
#: Candidates of an Arrow batch that a graph's task hands on.
LISTED = 1 << 16
#: By codes of types: which pairs can be linked.
_FITS = S._LINKABLE >= 0

Block = tuple[np.ndarray, np.ndarray, np.ndarray]


class Graph:
    """Nodes in order and their links (both ways, each once)."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.nodes = nodes.sort_values("node_idx")
        self.n = len(nodes)
        self.i, self.j = S.neighbours(self.nodes, edges)
        self.degree = np.bincount(self.i, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.degree)])
        code = {t: k for k, t in enumerate(S._TYPES)}
        self.code = np.array([code.get(t, len(code)) for t in self.nodes["type"]], np.int64)

    @cached_property
    def by_type(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each node's neighbours by type, then in order: (them, the first ones' places, how many there are) by node and type."""
        types = len(_FITS)
        at = self.i * types + self.code[self.j]
        count = np.bincount(at, minlength=self.n * types)
        first = np.cumsum(count) - count
        return self.j[np.argsort(at, kind="stable")], first.reshape(self.n, types), count.reshape(self.n, types)

    def rows(self, cells: bool = True, wedges: bool = False) -> Iterator[tuple[int, int]]:
        """Rows of blocks, by the pairs of nodes and the wedges between linkable types that they have."""
        cost = np.full(self.n, self.n if cells else 1, np.int64)
        if wedges:
            cost += np.bincount(self.i, (self.by_type[2][self.j] * _FITS[self.code[self.i]]).sum(axis=1), self.n).astype(np.int64)
        total, a = np.cumsum(cost), 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, "right")))
            yield a, b
            a = b

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs i < j of linkable types with i in rows a to b, and which of them are linked."""
        fits = (S._LINKABLE[:, self.code] >= 0)[self.code[a:b]]
        fits &= np.arange(self.n)[None, :] > np.arange(a, b)[:, None]
        link = np.zeros(fits.shape, bool)
        at = slice(self.first[a], self.first[b])
        link[self.i[at] - a, self.j[at]] = True
        i, j = np.nonzero(fits)
        return i + a, j, link[i, j]

    @cached_property
    def linked_pairs(self) -> np.ndarray:
        """Keys i * n + j, ascending, of linked pairs i < j of linkable types."""
        some = (self.i < self.j) & _FITS[self.code[self.i], self.code[self.j]]
        return self.i[some] * self.n + self.j[some]

    @cached_property
    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """By row i, without making pairs: nodes before i of each type, and pairs i < j of linkable types in the rows before."""
        upto = np.zeros((self.n + 1, len(_FITS)), np.int64)
        upto[np.arange(1, self.n + 1), self.code] = 1
        np.cumsum(upto, axis=0, out=upto)
        own = ((upto[-1] - upto[1:]) * _FITS[self.code]).sum(axis=1)
        return upto, np.concatenate([[0], np.cumsum(own)])

    @property
    def total(self) -> int:
        """How many candidates there are."""
        return int(self.before[1][-1]) - len(self.linked_pairs)

    def place(self, key: np.ndarray) -> np.ndarray:
        """How many candidates stand before those with keys i * n + j."""
        (upto, rows), i, j = self.before, key // self.n, key % self.n
        own = ((upto[j] - upto[i + 1]) * _FITS[self.code[i]]).sum(axis=1)
        return rows[i] + own - np.searchsorted(self.linked_pairs, key)

    def candidates(self, key: np.ndarray) -> np.ndarray:
        """Those of the keys that are candidates'; they ascend."""
        i, j = key // self.n, key % self.n
        key = key[(i < j) & _FITS[self.code[i], self.code[j]]]
        return np.setdiff1d(key, self.linked_pairs, assume_unique=True)

    def open(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of rows a to b."""
        i, j, linked = self.pairs(a, b)
        return i[~linked], j[~linked]

    def weights(self, edges: pd.DataFrame) -> np.ndarray:
        """The links' weights."""
        at, out = pd.Index(self.nodes["node"]), np.zeros(len(self.i))
        x, y = at.get_indexer(edges["src"]).astype(np.int64), at.get_indexer(edges["dst"]).astype(np.int64)
        key = self.i * self.n + self.j
        w = edges["weight"].to_numpy(float)
        out[np.stack([np.searchsorted(key, x * self.n + y), np.searchsorted(key, y * self.n + x)], axis=1).ravel()] = np.repeat(w, 2)
        return out

    def relations(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return S._LINKABLE[self.code[i], self.code[j]]


def met(graph: Graph, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys i * n + j, ascending, of the candidates of rows a to b that have common neighbours, and their scores: over the middle
    nodes in order, 1 / ln(degree).

    Wedges are made only to neighbours of a type that can be linked, so a hub between nodes of one type makes none.
    """
    at = slice(graph.first[a], graph.first[b])
    row, middle = graph.i[at], graph.j[at]
    other, first, count = graph.by_type
    link, kind = np.nonzero(_FITS[graph.code[row]] & (count[middle] > 0))
    times, start = count[middle[link], kind], first[middle[link], kind]
    j = other[np.repeat(start - np.cumsum(times) + times, times) + np.arange(times.sum())]
    i, middle = np.repeat(row[link], times), np.repeat(middle[link], times)
    key, up = i * graph.n + j, j > i
    key, place = np.unique(key[up], return_inverse=True)
    score = np.bincount(place, (1 / np.maximum(np.log(np.maximum(1, graph.degree)), 1e-10))[middle[up]], len(key))
    open_ = np.ones(len(key), bool)
    open_[_found(key, row * graph.n + graph.j[at])] = False
    return key[open_], score[open_]


def common(graph: Graph) -> Iterator[Block]:
    """Scores by common neighbours (see ``met``), 0 without any."""
    for a, b in graph.rows(wedges=True):
        i, j = graph.open(a, b)
        if not len(i):
            continue
        score, (key, some) = np.zeros(len(i)), met(graph, a, b)
        score[np.searchsorted(i * graph.n + j, key)] = some
        yield i, j, score


def chance(graph: Graph, seed: int = 0) -> Iterator[Block]:
    """A number of numpy's generator for each candidate in order."""
    rng = np.random.default_rng(seed)
    for a, b in graph.rows():
        i, j = graph.open(a, b)
        yield i, j, rng.random(len(i))


def scored(graph: Graph) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``met`` of all rows, in blocks; kept if they are few."""
    return (met(graph, a, b) for a, b in graph.rows(cells=False, wedges=True))


def ranks(graph: Graph, hidden: np.ndarray) -> tuple[np.ndarray, int]:
    """The ranks by common neighbours of the candidates with keys i * n + j in ``hidden`` (descending score, then i, j), and how
    many candidates there are.

    Two passes over those that have common neighbours: the hidden ones' scores, then how many stand before each. The others
    all score 0, so they are counted, not made.
    """
    key, total = graph.candidates(np.unique(hidden)), graph.total
    if not len(key):
        return key, total
    score = np.zeros(len(key))
    for k, s in scored(graph):
        at = _found(k, key)
        score[np.searchsorted(key, k[at])] = np.round(s[at], 12)
    places, zeros = Places(graph.n, key, score), graph.place(key)
    for k, s in scored(graph):
        places.add(k // graph.n, k % graph.n, s, total)
        zeros -= np.searchsorted(k, key)
    return places.found() + np.where(score == 0, zeros, 0), total


class Places:
    """The ranks of some candidates, with their keys and rounded scores: all candidates are added, block by block."""

    def __init__(self, n: int, key: np.ndarray, score: np.ndarray):
        self.n, self.key = n, key
        self.levels, self.level, own = np.unique(score, return_inverse=True, return_counts=True)
        self.over, self.ties = np.zeros(len(self.levels), np.int64), np.zeros(len(key), np.int64)
        self.mine, self.start = np.argsort(self.level, kind="stable"), np.concatenate([[0], np.cumsum(own)])

    def add(self, i: np.ndarray, j: np.ndarray, s: np.ndarray, total: int) -> None:
        s, levels = np.round(s, 12), self.levels
        up = np.sort(s)
        low, high = np.searchsorted(up, levels, "left"), np.searchsorted(up, levels, "right")
        self.over += len(s) - high
        shared = np.flatnonzero(high > low) if len(s) < total else np.flatnonzero(high - low > 1)
        if many := len(shared) > 32:  # the equal ones by level, in order
            k = np.minimum(np.searchsorted(levels, s), len(levels) - 1)
            equal = np.flatnonzero(levels[k] == s)
            equal = equal[np.argsort(k[equal], kind="stable")]
            first = np.concatenate([[0], np.cumsum(high - low)])
        for c in shared.tolist():
            these = equal[first[c] : first[c + 1]] if many else np.flatnonzero(s == levels[c])
            at = self.mine[self.start[c] : self.start[c + 1]]
            self.ties[at] += np.searchsorted(i[these] * self.n + j[these], self.key[at], "left")

    def found(self) -> np.ndarray:
        return self.over[self.level] + self.ties + 1


def _found(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where in ``key`` those of ``some`` are; both ascend."""
    at = np.searchsorted(key, some)
    return at[key[np.minimum(at, len(key) - 1)] == some] if len(key) else at[:0]


def _marked(edges: DataFrame, hidden: DataFrame, *more: str) -> DataFrame:
    """All links with those of ``hidden`` (graph_id, src, dst) beside them, marked; a graph's task brings them together."""
    h = hidden.select("graph_id", "src", "dst", *(F.lit(None).alias(c) for c in more), F.lit(True).alias("hidden"))
    return edges.select("graph_id", "src", "dst", *more, F.lit(False).alias("hidden")).unionByName(h)


def _parts(n: pd.DataFrame, e: pd.DataFrame) -> tuple[Graph, np.ndarray, pd.DataFrame]:
    """The graph without its hidden links, their keys, and the links that are left."""
    at, size = pd.Index(n.sort_values("node_idx")["node"]), len(n)
    x, y = at.get_indexer(e["src"]).astype(np.int64), at.get_indexer(e["dst"]).astype(np.int64)
    mark, key = e["hidden"].to_numpy(bool), x * size + y
    gone = np.isin(key, key[mark])
    left, x, y = e[~gone], x[gone & ~mark], y[gone & ~mark]
    return Graph(n, left), np.minimum(x, y) * size + np.maximum(x, y), left


def recovery(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """``links.recovery_metrics`` of ``links.adamic_adar`` after ``hidden`` is taken away, made in each graph's task."""

    def make(g, n, e):
        graph, keys, _ = _parts(n, e)
        if not len(keys):
            return []
        at, total = ranks(graph, keys)
        if not total:
            return []
        inverse, found, others = float((1 / at).sum()), len(at), total - len(at)
        auc = 1 - (float(at.sum()) - found * (found + 1) / 2) / (found * others) if found and others else None
        return [(g, len(keys), found, total, inverse / found if found else 0.0, inverse / len(keys), float(at.mean()) if found else None, auc, *(float((at <= k).sum() / len(keys)) for k in S.HITS))]

    schema = f"{S._key(nodes)}, n_hidden long, n_found long, n_candidates long, mrr double, mrr_all double, mean_rank double, auc double, " + ", ".join(f"hits_{k} double" for k in S.HITS)
    return S._per_graph(nodes, _marked(edges, hidden), make, schema, float("inf"))


def density(nodes: DataFrame, edges: DataFrame, hidden: DataFrame, bins: int, walk: bool = False) -> DataFrame:
    """(graph_id, hidden, bin, density): over ``bins`` bins from 0 to 1.1 times a graph's highest score, of hidden links and of
    the others, by common neighbours or by the ``walk``."""

    def make(g, n, e):
        graph, keys, left = _parts(n, e)
        blocks = _walked(g, n, left) if walk else lambda: scored(graph)
        top = max((float(np.round(s, 12).max()) for _, s in blocks() if len(s)), default=0.0)
        width = round(top * 1.1, 12) / bins
        if width <= 0:
            return []
        key, count = graph.candidates(np.unique(keys)), np.zeros((2, bins), np.int64)
        rest = np.array([graph.total - len(key), len(key)])  # candidates without common neighbours: all score 0
        for k, s in blocks():
            at, gone = np.minimum(np.floor(np.round(np.round(s, 12) / width, 9)).astype(np.int64), bins - 1), np.zeros(len(k), bool)
            gone[_found(k, key)] = True
            count += np.stack([np.bincount(at[~gone], minlength=bins), np.bincount(at[gone], minlength=bins)])
            rest -= np.bincount(gone, minlength=2)
        count[:, 0] += rest
        total = count.sum(axis=1)
        return [(g, bool(h), int(k) + 1, float(count[h, k] / (total[h] * width))) for h, k in zip(*np.nonzero(count))]

    return S._per_graph(nodes, _marked(edges, hidden, *["weight"] * walk), make, f"{S._key(nodes)}, hidden boolean, bin int, density double", float("inf"))


def _walked(g, nodes: pd.DataFrame, edges: pd.DataFrame) -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The keys of all candidates with the walk's scores, in blocks, from the near nodes' matrix."""
    walked, none = Walked(g, nodes, edges), np.zeros(0, np.int64)
    n, table = walked.graph.n, walked.walk(walked.left(none), tuple(X.TIMES))
    return lambda: ((i * n + j, table.at(spots)[keep]) for i, j, keep, spots in walked.open(none))


def _best(blocks: Iterator[Block], k: int) -> Block:
    """The ``k`` best candidates in order."""
    best: Block = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for block in blocks:
        i, j, s = (np.concatenate(c) for c in zip(best, block))
        if len(s) > k:  # ties with the last one stay
            some = np.flatnonzero(np.round(s, 12) >= np.round(np.partition(s, len(s) - k)[len(s) - k], 12))
            i, j, s = i[some], j[some], s[some]
        order = S.ordered(s, i, j)[:k]
        best = i[order], j[order], s[order]
    return best


def top_by_chance(nodes: DataFrame, edges: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(graph_id, rank, node_a, node_b, score): the first ``k`` of ``links.ranked`` over ``spectral.random_scores``."""

    def make(g, n, e):
        graph = Graph(n, e)
        names = graph.nodes["node"].to_numpy()
        return [(g, r, names[i], names[j], float(s)) for r, (i, j, s) in enumerate(zip(*_best(chance(graph, seed), k)), 1)]

    return S._per_graph(nodes, edges.select("graph_id", "src", "dst"), make, f"{S._key(nodes)}, rank int, node_a string, node_b string, score double", float("inf"))


_WORDS = np.array([x[2] for x in X.LINK_TYPES], object)


def candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``links.candidates``."""
    return _listed(nodes, edges, False)


def adamic_adar(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``links.adamic_adar``."""
    return _listed(nodes, edges, True)


def _listed(nodes: DataFrame, edges: DataFrame, scored: bool) -> DataFrame:
    """All candidates of graphs of any size: a graph's task hands them on batch by batch as they are made, so none is shuffled."""
    schema = f"{S._key(nodes)}, i int, j int, node_a string, node_b string, type_a string, type_b string, relation string" + ", score double" * scored

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).to_pandas()
        n, e = t[t["node_idx"].notna()], t[t["node_idx"].isna()]
        if not len(n):
            return
        graph = Graph(n[["node", "node_idx", "type"]].astype({"node_idx": np.int32}), e.rename(columns={"node": "src", "type": "dst"}))
        idx, names, types = (pa.array(graph.nodes[c].to_numpy()) for c in ("node_idx", "node", "type"))
        words = pa.array(_WORDS)
        for i, j, score in common(graph) if scored else ((*graph.open(a, b), None) for a, b in graph.rows()):
            for k in range(0, len(i), LISTED):
                a, b = i[k : k + LISTED], j[k : k + LISTED]
                x, y = pa.array(a), pa.array(b)
                columns = [pa.repeat(key[0], len(a)), idx.take(x), idx.take(y), names.take(x), names.take(y), types.take(x), types.take(y), words.take(pa.array(graph.relations(a, b)))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(score[k : k + LISTED])] if scored else []), names=out)

    out = [x.split()[0] for x in schema.split(", ")]
    none = F.lit(None).cast("int")
    both = nodes.select("graph_id", "node", F.col("node_idx").cast("int").alias("node_idx"), "type").unionByName(edges.select("graph_id", F.col("src").alias("node"), none.alias("node_idx"), F.col("dst").alias("type")))
    return both.groupBy("graph_id").applyInArrow(run, schema)


class Walked:
    """A graph for walks with some links taken away: its candidates with their places in the tables, in blocks."""

    def __init__(self, g, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.graph = graph = Graph(nodes, edges)
        self.split = W.Split(graph.n, graph.i, graph.j)
        if self.split.size > S.MAX_NODES:
            raise ValueError(f"graph {g} has a matrix of {self.split.size} rows; dense operators take {S.MAX_NODES}")
        self.w, self.key = graph.weights(edges), graph.i * graph.n + graph.j
        self.kept = None

    def blocks(self) -> Iterator:
        """(i, j, which are linked, places) of the pairs of linkable types; kept if one block has them all."""
        if self.kept is not None:
            return iter(self.kept)
        made = ((*p, self.split.spots(*p[:2])) for p in (self.graph.pairs(a, b) for a, b in self.graph.rows()))
        if self.graph.n**2 <= CELLS:
            self.kept = list(made)
            return iter(self.kept)
        return made

    def open(self, hidden: np.ndarray) -> Iterator:
        """The candidates with ``hidden`` (keys that ascend) taken away: (i, j, which pairs of the block, its places)."""
        for i, j, linked, spots in self.blocks():
            keep = ~linked
            keep[_found(i * self.graph.n + j, hidden)] = True
            yield i[keep], j[keep], keep, spots

    def left(self, hidden: np.ndarray) -> np.ndarray:
        """Which links (both ways) are left without ``hidden``."""
        out, n = np.ones(len(self.key), bool), self.graph.n
        for k in (hidden, np.sort(hidden % n * n + hidden // n)):
            out[_found(self.key, k)] = False
        return out

    def walk(self, left: np.ndarray, times) -> W.Table:
        i, j, w = self.graph.i[left], self.graph.j[left], self.w[left]
        return W.probabilities(*self.split.links(i, j, w), times)

    def common(self, left: np.ndarray) -> W.Table:
        return W.common(self.split, self.graph.i[left], self.graph.j[left])

    def places(self, hidden: np.ndarray, tables: dict[str, W.Table], seed: int) -> Iterator[tuple[str, np.ndarray, int]]:
        """By each table and by chance: the ranks of the hidden candidates, and how many candidates there are.

        Two passes over the candidates for all of them: what the hidden ones score, then who stands before them.
        """
        n, rng, total = self.graph.n, np.random.default_rng(seed), 0
        kept = list(self.open(hidden)) if self.graph.n**2 <= CELLS else None
        key, score = [], {m: [] for m in (*tables, "random")}
        for i, j, _, _ in kept or self.open(hidden):
            at = _found(i * n + j, hidden)
            key.append(i[at] * n + j[at])
            spots = self.split.spots(i[at], j[at])
            for m, table in tables.items():
                score[m].append(table.at(spots))
            score["random"].append(rng.random(len(i))[at])
            total += len(i)
        if not total:
            yield from ((m, np.zeros(0, np.int64), 0) for m in score)
            return
        counted = {m: Places(n, np.concatenate(key), np.round(np.concatenate(s), 12)) for m, s in score.items()}
        rng = np.random.default_rng(seed)
        for i, j, keep, spots in kept or self.open(hidden):
            for m, table in tables.items():
                counted[m].add(i, j, table.at(spots)[keep], total)
            counted["random"].add(i, j, rng.random(len(i)), total)
        yield from ((m, c.found(), total) for m, c in counted.items())

    def fingerprint(self, times, method: str) -> np.ndarray:
        near, links = self.split.links(self.graph.i, self.graph.j, self.w)
        values, vectors = W.spectrum(near, links)
        every = lambda: np.concatenate([values, np.zeros(self.graph.n - len(values))])
        return S._phi(method, every, lambda: np.array([x for p in W.returns(values, vectors, links, times) for x in S.statistics(p)]))


def recoveries(nodes: DataFrame, edges: DataFrame, seeds=(0,), fraction: float = 0.2, times=tuple(X.TIMES)) -> DataFrame:
    """``spectral.recoveries``: each graph is one task's work; what is hidden, the three scores and the ranks never leave it."""

    def make(g, n, e):
        n, e, rows = n.sort_values("node_idx"), e.sort_values("edge_idx"), []
        walked = Walked(g, n, e)
        size, at = walked.graph.n, pd.Index(walked.graph.nodes["node"])
        x, y = at.get_indexer(e["src"]).astype(np.int64), at.get_indexer(e["dst"]).astype(np.int64)
        ends, pairs = np.minimum(x, y) * size + np.maximum(x, y), list(zip(x.tolist(), y.tolist()))
        for seed in seeds:
            hidden = S.hide_pairs(size, pairs, fraction, seed)
            if not hidden:
                continue
            keys = np.unique(ends[hidden])
            left = walked.left(keys)
            tables = {"walk": walked.walk(left, times), "common": walked.common(left)}
            for method, found, total in walked.places(keys, tables, seed):
                inverse = float((1 / np.sort(found)).sum())
                rows.append((g, seed, method, len(hidden), len(found), total, inverse / len(found) if len(found) else 0.0, inverse / len(hidden), float(found.mean()) if len(found) else None, *(float((found <= k).sum() / len(hidden)) for k in S.HITS)))
        return rows

    schema = f"{S._key(nodes)}, seed int, method string, n_hidden long, n_found long, n_candidates long, mrr double, mrr_all double, mean_rank double, " + ", ".join(f"hits_{k} double" for k in S.HITS)
    return S._per_graph(nodes, edges.select("graph_id", "src", "dst", "edge_idx", "weight"), make, schema, float("inf"))


def top_walk_links(nodes: DataFrame, edges: DataFrame, k: int = 10, times=tuple(X.TIMES)) -> DataFrame:
    """``spectral.top_walk_links``: of the candidates that are not the best, a graph's task keeps the scores only."""

    def make(g, n, e):
        walked, every = Walked(g, n, e), []
        graph, none = walked.graph, np.zeros(0, np.int64)
        table = walked.walk(walked.left(none), times)

        def scored():
            for i, j, keep, spots in walked.open(none):
                s = table.at(spots)[keep]
                every.append(np.round(s, 12))
                yield i, j, s

        i, j, s = _best(scored(), k)
        if not len(s):
            return []
        idx, names, types = (graph.nodes[c].to_numpy() for c in ("node_idx", "node", "type"))
        return {
            "graph_id": np.full(len(i), g, object), "rank": np.arange(1, len(i) + 1), "i": idx[i], "j": idx[j], "node_a": names[i], "node_b": names[j], "type_a": types[i], "type_b": types[j],
            "relation": _WORDS[graph.relations(i, j)], "score": s, "confidence": S.bands(np.concatenate(every), np.round(s, 12)),
        }

    return S._per_graph(nodes, edges.select("graph_id", "src", "dst", "weight"), make, S.top_schema(nodes), float("inf"))
