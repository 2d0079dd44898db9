"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a learnt vector of its hash, one for each of its first ``PREFIXES`` characters, and the
mean of learnt vectors of all its characters (bytes). Word and prefix vectors share a table of ``BUCKETS``
rows, whose first element starts as the log odds of label 1 where it occurs. Words are read
in windows of ``WINDOW`` words that overlap by half, forwards and backwards; attention weighs the hidden
states and a linear layer gives the window's logit. A document's logit is calibrated from the largest one
of all its windows and their number.

Training takes at most ``PER_CLASS`` labelled texts of each class, longer ones by blocks from all over the
text (``EXCERPT`` bytes in all), so texts of every length are learnt from. Only some windows of a toxic text
are toxic, so each round learns from the highest window of each text and, of label 0, one other. Labels of
held-out rows are used nowhere, the share that calibrates the scores included.

Defined edge cases: a text without words (null, empty) is one window of padding and is scored like any
other; without labels of both classes every score is the share of label 1 (one half without labels);
repeated rows get equal scores, and of several texts with one id one is learnt from; an empty table gives an
empty result; clashing columns are replaced; a very long text is scored block by block of its windows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import appended
from gossamer.llm.decontaminate import _mix, lower, words_of
from gossamer.llm.labelled import sample, share

#: Labelled texts a class, bytes learnt from of each, bytes of a block of a longer one.
PER_CLASS, EXCERPT, PASSAGE = 1500, 12_000, 1_000
WINDOW, STRIDE = 32, 16
BUCKETS, WORD, CHAR, HIDDEN = 1 << 16, 4, 4, 8
PREFIXES = (4, 5, 6)
FIELDS = 1 + len(PREFIXES)
INPUT = FIELDS * WORD + CHAR
ROUNDS, BATCH, STEP = 4, 128, 0.01
#: Bytes of text and windows handled at once when scoring.
CHUNK, BLOCK = 1 << 20, 2048


def char_means(chars: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mean character vector of each word; words are apart, so every second sum is one."""
    if not len(start):
        return np.zeros((0, CHAR), np.float32)
    padded = np.concatenate([chars[low], np.zeros((1, CHAR), np.float32)])
    sums = np.add.reduceat(padded, np.stack([start, end], axis=1).ravel(), axis=0)[::2]
    return (sums / (end - start)[:, None]).astype(np.float32)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, end, buckets, bytes) of all words of joined texts, and each text's windows over them.

    A word has a bucket for itself and one for each prefix; bucket 0 is padding. Words of letters and of digits may touch: each is followed by a gap of its own
    in the sums, which ``char_means`` skips.
    """
    joined = b"\n".join(texts)
    w = words_of(joined)
    low = np.frombuffer(lower(joined), np.uint8)
    longest = np.concatenate([low, np.zeros(max(PREFIXES), np.uint8)])
    hashes, prefix = [w.literal], np.zeros(len(w.start), np.uint64)
    for k in range(max(PREFIXES)):
        prefix = np.where(w.start + k < w.end, prefix << np.uint64(8) | longest[w.start + k], prefix)
        if k + 1 in PREFIXES:
            hashes.append(_mix(prefix + np.uint64(k + 1)))
    bucket = (np.stack(hashes, axis=1) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    bound = np.concatenate([[0], np.searchsorted(w.start, np.cumsum([len(t) + 1 for t in texts]))])
    grids = [np.where((g := windows(int(b - a))) < 0, -1, g + a).astype(np.int32) for a, b in zip(bound, bound[1:])]
    return w.start, w.end, bucket, low, grids


def windows(n: int) -> np.ndarray:
    """Positions (n_windows, WINDOW) into n words; -1 is padding."""
    count = max(1, -(-(n - WINDOW) // STRIDE) + 1)
    at = np.arange(count)[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(at < n, at, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        d = INPUT
        self.p = {"word": f(BUCKETS, WORD, k=0.1), "char": f(256, CHAR, k=0.3), "att": f(2 * HIDDEN, HIDDEN, k=0.3), "att_v": f(HIDDEN, k=0.3), "out": f(2 * HIDDEN, k=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": f(d, 3 * HIDDEN, k=0.3), f"h{side}": f(HIDDEN, 3 * HIDDEN, k=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = 0
        self.cal, self.shift, self.constant = np.array([1.0, 0.0, 0.0]), 0.0, None

    def vectors(self, bucket: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Word inputs with a row of zeros for padding at the end, so that position -1 finds it."""
        v = np.zeros((len(bucket) + 1, INPUT), np.float32)
        v[:-1, :-CHAR] = self.p["word"][bucket].reshape(len(bucket), FIELDS * WORD)
        v[:-1, -CHAR:] = chars
        return v

    def _run(self, gates: np.ndarray, at: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states (WINDOW, n, HIDDEN) of one direction; gates are the words' input projections."""
        w, n, k = self.p[f"h{side}"], len(at), HIDDEN
        h, out = np.zeros((n, k), np.float32), np.empty((WINDOW, n, k), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, hw = gates[at[:, t]], h @ w
            zr = sigmoid(x[:, : 2 * k] + hw[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(x[:, 2 * k :] + r * hw[:, 2 * k :])
            if keep is not None:
                keep.append((t, h, z, r, c, hw[:, 2 * k :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def forward(self, vectors: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        hs = []
        for side in "fb":
            steps = None if keep is None else keep.setdefault(side, [])
            hs.append(self._run(vectors @ self.p[f"x{side}"] + self.p[f"c{side}"], at, side, steps))
        h = np.concatenate(hs, axis=2)
        flat = np.tanh(h.reshape(-1, 2 * HIDDEN) @ self.p["att"])
        a, s = flat.reshape(*h.shape[:2], HIDDEN), (flat @ self.p["att_v"]).reshape(h.shape[:2])
        s = np.where((at.T >= 0) | (at[:, :1].T < 0), s, np.float32(-30))
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", alpha, h)
        if keep is not None:
            keep |= {"h": h, "a": a, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, vectors: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of the mean logistic loss: by parameter, by input vector, and the loss."""
        keep: dict = {}
        logit = self.forward(vectors, at, keep)
        p = sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dl = ((p - y) / len(y)).astype(np.float32)
        g = {"out": keep["pooled"].T @ dl, "bias": np.array([dl.sum()], np.float32)}
        h, a, alpha = keep["h"], keep["a"], keep["alpha"]
        dp = dl[:, None] * self.p["out"]
        dh = alpha[:, :, None] * dp
        dalpha = (h * dp).sum(axis=2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        ds = np.where((at.T >= 0) | (at[:, :1].T < 0), ds, 0)
        da = ds[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att_v"] = np.tensordot(ds, a, axes=([0, 1], [0, 1]))
        g["att"] = np.tensordot(h, da, axes=([0, 1], [0, 1]))
        dh = dh + da @ self.p["att"].T
        dv = np.zeros_like(vectors)
        k = HIDDEN
        for s, side in enumerate("fb"):
            w, own = self.p[f"h{side}"], dh[:, :, s * k : (s + 1) * k]
            dgate, dw, back = np.zeros((len(vectors), 3 * k), np.float32), np.zeros_like(w), np.zeros((len(at), k), np.float32)
            for t, before, z, r, c, hw in reversed(keep[side]):
                d = own[t] + back
                dc = d * (1 - z) * (1 - c * c)
                dz = d * (before - c) * z * (1 - z)
                dr = dc * hw * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dhw = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(dgate, at[:, t], dx)
                dw += before.T @ dhw
                back = d * z + dhw @ w.T
            g[f"h{side}"], g[f"c{side}"], g[f"x{side}"] = dw, dgate.sum(axis=0), vectors.T @ dgate
            dv += dgate @ self.p[f"x{side}"].T
        return g, dv, loss

    def window_logits(self, start: np.ndarray, end: np.ndarray, bucket: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logits of windows; inputs are made for the words of one block of them at a time."""
        out = []
        for k in range(0, len(at), BLOCK):
            part = at[k : k + BLOCK]
            own = part[part >= 0]
            a, b = (int(own.min()), int(own.max()) + 1) if len(own) else (0, 0)
            first, last = (int(start[a]), int(end[b - 1])) if b else (0, 0)
            chars = char_means(self.p["char"], low[first:last], start[a:b] - first, end[a:b] - first)
            out.append(self.forward(self.vectors(bucket[a:b], chars), np.where(part >= 0, part - a, -1)))
        return np.concatenate(out)

    def probability(self, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(top), self.constant)
        z = np.stack([top, np.log(count), np.ones(len(top))], axis=1) @ self.cal + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        top, count = np.empty(len(texts)), np.empty(len(texts))
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) < CHUNK):
                size += len(texts[last]) + 1
                last += 1
            start, end, bucket, low, grids = laid_out(texts[first:last])
            logits = self.window_logits(start, end, bucket, low, np.concatenate(grids))
            count[first:last] = [len(g) for g in grids]
            top[first:last] = np.maximum.reduceat(logits, np.cumsum([0, *map(len, grids[:-1])]))
            first = last
        return self.probability(top, count)


def fit(texts: list[bytes], y: np.ndarray, share: float, seed: int = 0) -> Network:
    """``share`` is label 1's share among all rows that may be learnt from."""
    net = Network(seed)
    if len(np.unique(y)) < 2:
        net.constant = share
        return net
    r = np.random.default_rng(seed + 1)
    start, end, bucket, low, grids = laid_out(texts)
    lengths = (end - start).astype(np.int64)
    df = np.zeros((2, BUCKETS))
    for g, label in zip(grids, y):
        df[int(label), np.unique(bucket[np.unique(g[g >= 0])])] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
    net.p["word"][:, 0] = np.clip(odds * np.minimum(1, df.sum(axis=0) / 8), -3, 3)
    net.p["word"][0] = 0
    every = np.concatenate(grids)
    ends = np.cumsum([len(g) for g in grids])
    begins = ends - [len(g) for g in grids]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for round_ in range(ROUNDS):
        if round_:
            logits = net.window_logits(start, end, bucket, low, every)
        else:
            best = np.append(net.p["word"][bucket, 0].max(axis=1), -9)
            logits = best[every].max(axis=1)
        rows = []
        for k, (a, b) in enumerate(zip(begins, ends)):
            rows.append((k, a + int(np.argmax(logits[a:b]))))
            if not y[k] and b > a + 1:
                rows.append((k, int(r.integers(a, b))))
        order = r.permutation(len(rows))
        for s in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[s : s + BATCH]]
            at = every[[w for _, w in part]]
            own = at[at >= 0]
            local = np.where(at >= 0, np.cumsum(at >= 0).reshape(at.shape) - 1, -1)
            m = lengths[own]
            flat = low[np.repeat(start[own] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            word_of = np.repeat(np.arange(len(own)), m)
            chars = np.zeros((len(own), CHAR), np.float32)
            np.add.at(chars, word_of, net.p["char"][flat])
            chars /= np.maximum(1, m)[:, None]
            g, dv, _ = net.gradients(net.vectors(bucket[own], chars), local, y[[k for k, _ in part]].astype(np.float32))
            met, place = np.unique(bucket[own].ravel(), return_inverse=True)  # only rows that were used move
            g["word"], g["char"] = np.zeros((len(met), WORD), np.float32), np.zeros_like(net.p["char"])
            np.add.at(g["word"], place, dv[:-1, :-CHAR].reshape(-1, WORD))
            np.add.at(g["char"], flat, (dv[:-1, -CHAR:] / np.maximum(1, m)[:, None])[word_of])
            step += 1
            for name, (means, squares) in moments.items():
                at_ = met if name == "word" else slice(None)
                mean, square = means[at_], squares[at_]
                mean, square = mean + 0.1 * (g[name] - mean), square + 0.01 * (g[name] ** 2 - square)
                means[at_], squares[at_] = mean, square
                net.p[name][at_] -= (STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            net.p["word"][0] = 0
    logits = net.window_logits(start, end, bucket, low, every)
    x = np.stack([np.maximum.reduceat(logits, begins), np.log(ends - begins), np.ones(len(y))], axis=1)
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ net.cal, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        net.cal = net.cal - np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * (net.cal - [1, 0, 0]))
    own = n[1] / n.sum()
    share = min(max(share, 1e-4), 1 - 1e-4)
    net.shift = float(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return net


def excerpt(text: bytes, most: int = EXCERPT) -> bytes:
    """The text, or passages drawn from all over it by a generator that its own bytes seed."""
    if len(text) <= most:
        return text
    places = np.random.default_rng(zlib.crc32(text)).permutation(-(-len(text) // PASSAGE))[: most // PASSAGE]
    parts = [text[k * PASSAGE : (k + 1) * PASSAGE] for k in np.sort(places).tolist()]
    return b"\n".join(p[p.find(b" ") + 1 : p.rfind(b" ") if b" " in p else None] for p in parts)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most: int = EXCERPT, text: str = "text") -> Network:
    ones = share(labels, label)
    picked = sample(labels, label, per_class)  # at most 2 * per_class rows, each an id and a label
    rows = docs.select("doc_id", text).join(F.broadcast(picked), "doc_id")
    cut = appended(rows, [T.StructField("_cut", T.BinaryType())], lambda texts: [pa.array([excerpt(t, most) for t in texts], pa.binary())], text)
    got = cut.groupBy("doc_id", "label").agg(F.min("_cut").alias("cut")).toArrow().sort_by("doc_id")
    return fit(got.column("cut").to_pylist(), got.column("label").to_numpy().astype(np.float64), ones)


def scored(docs: DataFrame, model: Network, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(sent.value.score(texts), pa.float64())]

    return appended(docs, [T.StructField(column, T.DoubleType())], run, text)
