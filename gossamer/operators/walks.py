"""Walks of a graph from the spectrum of a smaller matrix: exact, whatever the weights.

Some nodes (the far ones, such as servers) meet none of their own, only the others (the near ones). With A the near nodes' links among
themselves and B those between near and far, H = -[[A, B], [B', 0]]. With B' = QR, Q orthogonal, H is -[[A, R'], [R, 0]] and zeros
beside it: at most twice as many rows as there are near nodes. If v is the near part of its vectors and U(t) = exp(-iHt),
U between near nodes is v exp(-ixt) v', between a near and a far one i J B with J(t) the integral of the former from 0 to t, and
between far ones I - B' L B with L the integral of J. So far nodes, mostly three in four, cost only their links.
"""

from __future__ import annotations

import numpy as np

#: Numbers of a block of far nodes: few enough to stay in a cache.
CELLS = 1 << 17
#: Links up to which a far node's are added one by one.
FEW = 8


class Split:
    """Near and far nodes of a graph of ``n`` nodes with links ``i``, ``j`` (both ways, each once)."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        degree = np.bincount(i, minlength=n)
        first, to = np.concatenate([[0], np.cumsum(degree)]).tolist(), j.tolist()
        taken, blocked = np.zeros(n, bool), bytearray(n)
        for x in i[i == j].tolist():
            blocked[x] = 1
        around = np.bincount(i, degree[j], n)  # of equal degree, those between hubs first
        for x in np.lexsort((-around, degree)).tolist():
            if not blocked[x]:
                taken[x] = True
                for y in to[first[x] : first[x + 1]]:
                    blocked[y] = 1
        near, far = np.flatnonzero(~taken), np.flatnonzero(taken)
        if len(near) + min(len(near), len(far)) > 0.9 * n:  # nothing to gain
            near, far, taken = np.arange(n), far[:0], np.zeros(n, bool)
        self.n, self.is_far, self.near = n, taken, near
        self.far = far[np.argsort(-degree[far], kind="stable")]
        self.place = np.empty(n, np.int32)
        self.place[self.near], self.place[self.far] = np.arange(len(self.near)), np.arange(len(self.far))

    def spots(self, i: np.ndarray, j: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray, np.ndarray]]:
        """Where pairs stand in the tables far by near, near by near and far by far: which pairs (None: all), row, column."""
        p, x, y = self.place, self.is_far[i], self.is_far[j]
        if not len(self.far):
            return [(np.zeros(0, np.int64), i[:0], j[:0]), (None, p[i], p[j]), (np.zeros(0, np.int64), i[:0], j[:0])]
        mixed, near, far = np.flatnonzero(x != y), np.flatnonzero(~(x | y)), np.flatnonzero(x & y)
        a, b = i[mixed], j[mixed]
        first = x[mixed]
        return [(mixed, p[np.where(first, a, b)], p[np.where(first, b, a)]), (near, p[i[near]], p[j[near]]), (far, p[i[far]], p[j[far]])]

    @property
    def size(self) -> int:
        """Rows of the smaller matrix."""
        return len(self.near) + min(len(self.near), len(self.far))

    def links(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, Links]:
        """The near nodes' matrix, and the links of the far ones."""
        a, p = np.zeros((len(self.near), len(self.near))), self.place
        inner = ~self.is_far[i] & ~self.is_far[j]
        a[p[i[inner]], p[j[inner]]] = w[inner]
        outer = self.is_far[i]
        return a, Links(p[i[outer]], p[j[outer]], w[outer], len(self.far), len(self.near))


class Links:
    """B: the links of far nodes (``x``) with near ones (``y``)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, far: int, near: int):
        order = np.argsort(x, kind="stable")
        self.x, self.y, self.w = x[order], y[order], w[order]
        self.far, self.near = far, near
        self.count = np.bincount(x, minlength=far)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def matrix(self) -> np.ndarray:
        """B', dense."""
        return self.rows(np.arange(self.far))

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Some rows of B', dense."""
        out, count = np.zeros((len(which), self.near)), self.count[which]
        e = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        out[np.repeat(np.arange(len(which)), count), self.y[e]] = self.w[e]
        return out

    def times(self, m: np.ndarray, a: int, b: int) -> np.ndarray:
        """Rows a to b of B'm."""
        first, count = self.first[a:b], self.count[a:b]
        out = np.zeros((b - a, m.shape[1]))
        for x in np.flatnonzero(count > FEW).tolist():
            at = slice(first[x], first[x] + count[x])
            out[x] = self.w[at] @ m[self.y[at]]
        for k in range(FEW):
            some = np.flatnonzero((count > k) & (count <= FEW))
            if not len(some):
                break
            e = first[some] + k
            part = m[self.y[e]]
            part *= self.w[e, None]
            if len(some) == b - a:
                out += part
            else:
                out[some] += part
        return out

    def blocks(self, width: int):
        step = max(1, CELLS // max(1, width))
        return ((a, min(self.far, a + step)) for a in range(0, self.far, step))


def spectrum(a: np.ndarray, links: Links) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the smaller matrix and the near rows of its vectors; H has ``far`` less its added rows more, all zero."""
    n = len(a)
    if not links.far:
        return np.linalg.eigh(-a)
    r = np.linalg.qr(links.matrix(), mode="r")
    h = np.zeros((n + len(r), n + len(r)))
    h[:n, :n], h[n:, :n], h[:n, n:] = -a, -r, -r.T
    values, vectors = np.linalg.eigh(h)
    return values, vectors[:n]


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x / np.pi)


def first_integral(values: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of the integral of exp(-ixs) over s from 0 to t."""
    x = values * t
    return t * _sinc(x), -t * x / 2 * _sinc(x / 2) ** 2


def second_integral(values: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The same of the first integral."""
    x = values * t
    small = np.abs(x) < 0.3
    y = np.where(small, 1.0, x)
    series = x / 6 * (1 - x**2 / 20 * (1 - x**2 / 42 * (1 - x**2 / 72 * (1 - x**2 / 110))))
    return t * t / 2 * _sinc(x / 2) ** 2, -t * t * np.where(small, series, (1 - _sinc(y)) / y)


def _between(vectors: np.ndarray, p: np.ndarray) -> np.ndarray:
    """v diag(p) v'."""
    if len(vectors) < 300:
        return (vectors * p) @ vectors.T
    up, down = (vectors[:, x > 0] * np.sqrt(x[x > 0]) for x in (p, -p))  # products with their own transpose take half the work
    return up @ up.T - down @ down.T


def near_far(values: np.ndarray, vectors: np.ndarray, links: Links, times) -> np.ndarray:
    """The walk's probability between far (rows) and near nodes, averaged over times."""
    n = len(vectors)
    out = np.zeros((links.far, n))
    for t in times:
        for p in first_integral(values, t):
            j = _between(vectors, p)
            for a, b in links.blocks(n):
                m = links.times(j, a, b)
                m *= m
                out[a:b] += m
    out /= len(times)
    return out


def near_near(values: np.ndarray, vectors: np.ndarray, times, which: np.ndarray) -> np.ndarray:
    """The same between some near nodes and all near ones."""
    out, v = np.zeros((len(which), len(vectors))), vectors[which]
    for t in times:
        for p in (np.cos(values * t), np.sin(values * t)):
            m = (v * p) @ vectors.T
            m *= m
            out += m
    return out / len(times)


def far_far(values: np.ndarray, vectors: np.ndarray, links: Links, times, which: np.ndarray) -> np.ndarray:
    """The same between some far nodes and all far ones."""
    out, v = np.zeros((links.far, len(which))), links.rows(which) @ vectors
    for t in times:
        for k, p in enumerate(second_integral(values, t)):
            m = links.times(np.ascontiguousarray(((v * p) @ vectors.T).T), 0, links.far)
            if k == 0:
                m[which, np.arange(len(which))] -= 1
            m *= m
            out += m
    return out.T / len(times)


def returns(values: np.ndarray, vectors: np.ndarray, links: Links, times):
    """For each time, the probabilities of being back at each node, near ones first."""
    squares = vectors**2
    near = [np.abs(squares @ np.exp(-1j * values * t)) ** 2 for t in times]
    weights = np.stack([p for t in times for p in second_integral(values, t)], axis=1)
    far = np.empty((links.far, weights.shape[1]))
    v = np.ascontiguousarray(vectors)
    for a, b in links.blocks(v.shape[1]):
        m = links.times(v, a, b)
        m *= m
        far[a:b] = m @ weights
    for k in range(len(near)):
        yield np.concatenate([near[k], (1 - far[:, 2 * k]) ** 2 + far[:, 2 * k + 1] ** 2])


class Table:
    """Values of pairs: a table of far by near nodes is made when a pair needs it, others for the rows that pairs need."""

    def __init__(self, far_near, near_near, far_far):
        self.whole, self.make, self.made = far_near, (None, near_near, far_far), None

    def at(self, spots) -> np.ndarray:
        out = np.empty(len(spots[1][1]) if spots[1][0] is None else sum(len(s[1]) for s in spots))
        for k, (which, row, column) in enumerate(spots):
            if not len(row):
                continue
            if k == 0:
                self.made = self.whole() if self.made is None else self.made
                found = self.made[row, column]
            else:
                (rows, place), (columns, across) = (np.unique(x, return_inverse=True) for x in (row, column))
                found = self.make[k](rows)[place, column] if len(rows) <= len(columns) else self.make[k](columns)[across, row]
            if which is None:
                return found
            out[which] = found
        return out


def probabilities(a: np.ndarray, links: Links, times) -> Table:
    """The walk's probabilities between nodes, averaged over times."""
    values, vectors = spectrum(a, links)
    return Table(lambda: near_far(values, vectors, links, times), lambda rows: near_near(values, vectors, times, rows), lambda rows: far_far(values, vectors, links, times, rows))


def common(split: Split, i: np.ndarray, j: np.ndarray) -> Table:
    """Adamic-Adar scores of all pairs, from links (both ways, each once)."""
    weight = 1 / np.maximum(np.log(np.maximum(1, np.bincount(i, minlength=split.n))), 1e-10)
    near, far = weight[split.near], weight[split.far]
    a, links = split.links(i, j, np.ones(len(i)))

    def near_near(rows):
        out = (a[rows] * near) @ a
        if links.far:
            b = links.matrix()
            out += (b[:, rows].T * far) @ b
        return out

    def far_far(rows):
        return links.times(np.ascontiguousarray((links.rows(rows) * near).T), 0, links.far).T

    return Table(lambda: links.times(near[:, None] * a, 0, links.far), near_near, far_far)
