"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics are taken from each whole text. Trees are grown level by level on binned statistics with the
logistic loss; after training all trees are flattened into arrays of one shape, which a batch of documents
traverses together: one gather and one comparison per level.

Training takes at most ``PER_CLASS`` labelled rows of each class (their statistics, not their texts, come
to the driver) and weights them back to the classes' shares among all rows that may be learnt from. Labels of
held-out rows are used nowhere. Of several texts with one id, one is learnt from.

Defined edge cases: null and empty texts have statistics of zero and are scored like any other; without
labels of both classes every score is the share of label 1 (one half without labels); repeated rows get
equal scores; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import appended
from gossamer.llm.labelled import sample, share

PER_CLASS = 4000
TREES, LEVELS, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 8.0, 2.0

_MARKS = b".,;:!?|*&%$#@/\\-_<>=~^\"'()[]{}"
FEATURES = [
    "log_bytes", "log_words", "log_lines", "letters", "capitals", "digits", "spaces", "others", "non_ascii", "distinct_bytes", "entropy", "word_length", "word_spread",
    "long_words", "distinct_words", "top_word", "capital_words", "marked_words", "plain_word_starts", "line_words", "repeated_lines", "top_line", "repeated_pairs", "marks",
] + [f"mark_{c}" for c in _MARKS.decode()]


def statistics(text: bytes) -> np.ndarray:
    out = np.zeros(len(FEATURES), np.float32)
    if not text:
        return out
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    share = count[count > 0] / n
    capitals, small = count[65:91].sum(), count[97:123].sum()
    marks = count[list(_MARKS)]
    out[:11] = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (capitals + small) / n, capitals / max(1, capitals + small), count[48:58].sum() / n,
        count[32] / n, (n - count[128:].sum() - capitals - small - count[32]) / n, count[128:].sum() / n, len(share) / 64, -(share * np.log2(share)).sum(),
    ]
    if words:
        m = len(words)
        size = np.fromiter(map(len, words), np.int64, m)
        freq = Counter(words)
        pairs = Counter(zip(words, words[1:]))
        out[11:19] = [size.mean(), size.std(), (size > 20).mean(), len(freq) / m, max(freq.values()) / m, sum(w.isupper() for w in words) / m, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m, sum(97 <= w[0] <= 122 for w in words) / m]
        out[19] = m / max(1, len(lines))
        out[22] = 1 - len(pairs) / max(1, m - 1)
    if lines:
        freq = Counter(lines)
        out[20], out[21] = 1 - len(freq) / len(lines), max(freq.values()) / len(lines)
    out[23] = marks.sum() / n
    out[24:] = marks / n
    return out


class Trees:
    """Boosted trees in flat arrays: node k of a tree has children 2k + 1 and 2k + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
        base = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4))))
        inner, leaves = 2**LEVELS - 1, 2**LEVELS
        if len(np.unique(y)) < 2:
            return cls(base, np.zeros((1, inner), np.int32), np.zeros((1, inner), np.float32), np.zeros((1, leaves), np.float32))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        n_features = x.shape[1]
        flat = binned + np.arange(n_features) * BINS
        score = np.full(len(y), base)
        feature = np.zeros((TREES, inner), np.int32)
        threshold = np.full((TREES, inner), np.inf, np.float32)
        value = np.zeros((TREES, leaves), np.float32)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(LEVELS):
                width = 2**level
                at = (node[:, None] * (n_features * BINS) + flat).ravel()
                size = width * n_features * BINS
                hist = [np.bincount(at, weights=np.repeat(v, n_features), minlength=size).reshape(width, n_features, BINS) for v in (g, h, weight)]
                gl, hl, nl = (np.cumsum(v, axis=2) for v in hist)
                gt, ht, nt = (v[:, :, -1:] for v in (gl, hl, nl))
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
                best = gain.reshape(width, -1).argmax(axis=1)
                f, b = best // BINS, best % BINS
                split = gain.reshape(width, -1).max(axis=1) > 1e-6
                for k in np.flatnonzero(split):
                    if b[k] < len(edges[f[k]]):
                        feature[t, width - 1 + k], threshold[t, width - 1 + k] = f[k], edges[f[k]][b[k]]
                tree = width - 1 + node
                node = 2 * node + (x[np.arange(len(y)), feature[t, tree]] > threshold[t, tree])
            gs, hs = np.bincount(node, weights=g, minlength=leaves), np.bincount(node, weights=h, minlength=leaves)
            value[t] = -RATE * gs / (hs + RIDGE)
            score += value[t, node]
        return cls(base, feature, threshold, value)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        for level in range(LEVELS):
            at = 2**level - 1 + node
            node = 2 * node + (np.take_along_axis(x, self.feature[trees, at], axis=1) > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1, dtype=np.float64))))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, text: str = "text") -> Trees:
    """Fit on the sampled rows. A document row takes its statistics on an executor."""
    picked = sample(labels, label, per_class)
    ones = share(labels, label)
    # at most 2 * per_class rows, each an id and a label
    rows = docs.select("doc_id", text).join(F.broadcast(picked), "doc_id")

    def stats(texts: list[bytes]) -> list[pa.Array]:
        flat = np.concatenate([statistics(t) for t in texts])
        return [pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float32()))]

    got = appended(rows, [T.StructField("stats", T.ArrayType(T.FloatType()))], stats, text)
    got = got.groupBy("doc_id", "label").agg(F.min("stats").alias("stats")).toArrow().sort_by("doc_id")
    y = got.column("label").to_numpy().astype(np.float64)
    x = np.array(got.column("stats").to_pylist(), np.float32).reshape(len(y), len(FEATURES))
    weight = np.where(y == 1, ones / max(1e-9, y.mean()), (1 - ones) / max(1e-9, 1 - y.mean())) if len(y) else y
    return Trees.fit(x, y, weight)


def scored(docs: DataFrame, model: Trees, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(sent.value.score(np.stack([statistics(t) for t in texts])), pa.float64())]

    return appended(docs, [T.StructField(column, T.DoubleType())], run, text)
