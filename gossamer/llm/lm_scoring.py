"""Language-model scores by context-tree weighting over bytes.

Text is the lower-cased (A-Z) words joined by single spaces and closed by an end byte. Each byte is
decomposed into eight binary decisions; each decision has a tree of contexts, the 0 to ``depth`` bytes
before it. A node of that tree predicts with the Krichevsky-Trofimov estimate of its two counts, and the
weighting gives it the posterior share of "stop here" against "ask the longer contexts". The model's
probability of a bit mixes the estimates of all depths along the path by those shares; where a context was
never seen, the share of deeper ones stays at the deepest node that was. Probabilities of a byte sum to 1.

Counts are of all training text, and the model grows with it: one scan counts (depth + 1)-byte strings, all
shorter contexts are their sums. Strings are cut into shards by the two bytes before a byte, of ``MAX_GRAMS`` strings or
of one such context. Nodes of two bytes and more lie in one shard; those of none and one byte come from 65,536 strings
at most, are in each, and what they need of the shards below is summed up first. Shards are weighed on executors.

Scoring. Every task holds the predictions of the ``HEAD_GRAMS`` strings used most (a fixed number). A document's
other strings, seen rarely or never, are packed by shard and shuffled to the model's part that predicts them
(see ``routed``), so no process holds the whole model. The unigram base needs each word's count: see ``lookup``
for how documents get them.

Defined edge cases: null, empty and white-space texts are the end token alone; with no training rows every
estimate is one half and word counts are zero; repeated rows count as documents of their own; an empty
table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm import lookup, routed
from gossamer.llm.common import crc_bucket, extended, utf8, written

DEPTH = 4
#: Strings of a shard; strings, used most, that every executor holds (12 bytes each, twice that as a table).
MAX_GRAMS, HEAD_GRAMS = 1 << 18, 1 << 20
END = 0x0A  # never inside a word
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)  # no string is as long
#: Bytes whose strings are counted or scored at once; entries of a task's counting tables.
CHUNK, FLUSH = 1 << 21, 400_000


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, size): the strings ending at each byte of each text, as integers, and each text's part.

    A key has the byte itself in its lowest eight bits, the byte before it in the next eight, and so on.
    """
    pad = bytes([END]) * depth
    bodies = [b" ".join(t.lower().split()) + bytes([END]) for t in texts]
    raw = np.frombuffer(b"".join(pad + b for b in bodies), np.uint8)
    keys = np.zeros(len(raw), np.uint64)
    for k in range(depth + 1):
        keys[k:] |= raw[: len(raw) - k].astype(np.uint64) << np.uint64(8 * k)
    size = np.array([len(b) for b in bodies], np.int64)
    first = np.cumsum(size + depth) - size
    return keys, first, size


def chunks(texts: list[bytes]) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            out.append((start, i))
            start, size = i, 0
        size += len(t) + 1
    return [*out, (start, len(texts))] if texts else out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for a, b in chunks(texts):
        keys, first, size = stream(texts[a:b], depth)
        own = np.zeros(len(keys) + 1, np.int32)
        np.add.at(own, first, 1)
        np.add.at(own, first + size, -1)
        found.append(np.unique(keys[np.cumsum(own[:-1]) > 0], return_counts=True))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return merged(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series after moving the argument up by eight."""
    low = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


class Logs:
    """Values of strings in open addressing: one or two gathers a string."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.slot_key = np.full(1 << self.bits, _FREE)
        self.slot_log = np.zeros(1 << self.bits, np.float32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.slot_key[slot] == _FREE
            self.slot_key[slot[free]] = keys[left[free]]  # of several for one slot, the last stays
            won = self.slot_key[slot] == keys[left]
            self.slot_log[slot[won]] = logs[left[won]]
            left = left[~won]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each string, 0 where there is none, and the places of the latter."""
        slot = self._slot(keys, 0)
        hit = self.slot_key[slot] == keys
        out = np.where(hit, self.slot_log[slot], np.float32(0))
        left = np.flatnonzero(~hit)
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(keys[left], probe)
            hit = self.slot_key[slot] == keys[left]
            out[left[hit]] = self.slot_log[slot[hit]]
            left = left[~hit]
        return out, left


class Model:
    """Mixed predictions of every node seen, by depth and bit, and of every whole byte string seen."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: tuple[np.ndarray, np.ndarray] | None = None, below: list[np.ndarray] | None = None):
        """``top`` and ``below`` make a shard: (keys, counts) of all one-byte contexts, and see ``below_top``."""
        self.depth = depth
        levels = self._levels(keys, counts, depth, top)
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] = [[None] * 8 for _ in range(depth + 1)]
        for j in range(8):
            self._weigh(levels, j, below and below[j])
        self.grams = levels[depth][0]
        logs = np.zeros(len(self.grams))
        for j in range(8):
            node, bit = self._node(self.grams, j)
            at, p = self.nodes[depth][j]
            q = p[np.searchsorted(at, node)].astype(np.float64)
            logs += np.log10(np.where(bit, q, 1 - q))
        self.logs, self.counts = logs.astype(np.float32), levels[depth][1]
        self.seen: Logs | None = None

    @staticmethod
    def _levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per depth: distinct (context, byte) keys and counts."""
        own = (keys, counts)
        return [merged((x := top if top and d < 2 else own)[0] & np.uint64((1 << 8 * (d + 1)) - 1), x[1]) for d in range(depth + 1)]

    @classmethod
    def below_top(cls, keys: np.ndarray, counts: np.ndarray, depth: int, top: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """By bit: what a shard adds to the weight below each node of a one-byte context."""
        levels = cls._levels(keys, counts, depth, top)
        out = []
        for j in range(8):
            at, log_e, _ = cls._estimates(levels, j)
            out.append(cls._weights(at, log_e, cls._parents(at))[1])
        return out

    @staticmethod
    def _node(keys: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        byte = keys & np.uint64(255)
        node = (keys & ~np.uint64(255)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
        return node, (byte >> np.uint64(7 - j)) & np.uint64(1) == 1

    @classmethod
    def _estimates(cls, levels, j: int):
        at, log_e, kt = [], [], []
        for keys, n in levels:
            node, bit = cls._node(keys, j)
            k, place = np.unique(node, return_inverse=True)
            n1 = np.bincount(place, weights=n * bit, minlength=len(k))
            total = np.bincount(place, weights=n, minlength=len(k))
            at.append(k)
            log_e.append(_log_gamma(total - n1 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(total + 1) - np.log(np.pi))
            kt.append((n1 + 0.5) / (total + 1))
        return at, log_e, kt

    @staticmethod
    def _parents(at) -> list:
        """A child's parent lacks the oldest byte of its context."""
        return [None, *(np.searchsorted(at[d - 1], at[d] & np.uint64((1 << 8 * d) - 1)) for d in range(1, len(at)))]

    @staticmethod
    def _weights(at, log_e, up, below: np.ndarray | None = None) -> tuple[list, np.ndarray | None]:
        """(share of "stop here" by depth, summed weight below each node of depth one); ``below`` replaces the latter."""
        depth = len(at) - 1
        log_w, stop, found = log_e[depth], [None] * (depth + 1), None
        stop[depth] = np.ones(len(log_w))
        for d in range(depth - 1, -1, -1):
            under = np.bincount(up[d + 1], weights=log_w, minlength=len(at[d]))
            if d == 1:
                found = under = under if below is None else below
            log_w = np.logaddexp(log_e[d], under) - np.log(2)
            stop[d] = np.exp(log_e[d] - np.log(2) - log_w)
        return stop, found

    def _weigh(self, levels, j: int, below: np.ndarray | None = None) -> None:
        at, log_e, kt = self._estimates(levels, j)
        up = self._parents(at)
        stop, _ = self._weights(at, log_e, up, below)
        mixed, left = np.zeros(len(at[0])), np.ones(len(at[0]))
        for d in range(self.depth + 1):
            if d:
                mixed, left = (mixed + left * stop[d - 1] * kt[d - 1])[up[d]], (left * (1 - stop[d - 1]))[up[d]]
            p = np.clip(mixed + left * kt[d], 1e-7, 1 - 1e-7)
            self.nodes[d][j] = at[d], p.astype(np.float32)

    def _unseen(self, keys: np.ndarray) -> np.ndarray:
        logs = np.zeros(len(keys))
        for j in range(8):
            p = np.full(len(keys), 0.5)
            for d in range(self.depth + 1):
                node, bit = self._node(keys & np.uint64((1 << 8 * (d + 1)) - 1), j)
                at, value = self.nodes[d][j]
                if len(at):
                    k = np.minimum(np.searchsorted(at, node), len(at) - 1)
                    p = np.where(at[k] == node, value[k], p)  # deeper nodes come later
            logs += np.log10(np.where(bit, p, 1 - p))
        return logs.astype(np.float32)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before it."""
        if self.seen is None:
            self.seen = Logs(self.grams, self.logs)
        out, left = self.seen.find(keys)
        if len(left):
            fresh, back = np.unique(keys[left], return_inverse=True)
            out[left] = self._unseen(fresh)[back]
        return out


def score(texts: list[bytes], depth: int, strings: Logs) -> tuple[list[float], list[tuple[np.ndarray, np.ndarray]]]:
    """The sum over each text of what is known of its strings, and its other strings with their uses."""
    sums: list[float] = []
    others: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in chunks(texts):
        keys, first, size = stream(texts[a:b], depth)
        logs, left = strings.find(keys)
        logs = logs.astype(np.float64)
        bound = np.searchsorted(left, np.stack([first, first + size]))
        for f, n, i, j in zip(first, size, *bound):
            sums.append(float(logs[f : f + n].sum()))
            others.append(np.unique(keys[left[i:j]], return_counts=True))
    return sums, others


def _words(text: bytes) -> Counter[bytes]:
    out = Counter(text.lower().split())
    out[b"\n"] += 1  # the end token; no word holds a line end
    return out


def training_counts(docs: DataFrame, depth: int, folds: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(key, n) of byte strings and (k1, k2, n) of words over the rows not held out, written."""

    def scan(batches):
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(kind: bool, k1: np.ndarray, k2: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(k1)), pa.array(k1.view(np.int64)), pa.array(k2), pa.array(n.astype(np.int64))], names=["gram", "k1", "k2", "n"])

        def flush_words():
            keys = lookup.halves(map(lookup.digest, words))
            return rows(False, np.ascontiguousarray(keys[:, 0]), keys[:, 1], np.fromiter(words.values(), np.int64, len(words)))

        def flush_grams(keys: np.ndarray, n: np.ndarray):
            return rows(True, keys, np.zeros(len(keys), np.int64), n)

        for batch in batches:
            texts = [t for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) if crc_bucket(i, folds)]
            for a, b in chunks(texts):
                grams.append(count_grams(texts[a:b], depth))
                if sum(len(k) for k, _ in grams) > 2 * FLUSH:
                    grams = [merged(*(np.concatenate(c) for c in zip(*grams)))]
                    if len(grams[0][0]) > FLUSH:
                        yield flush_grams(*grams.pop())
            for t in texts:
                words.update(_words(t))
                if len(words) > FLUSH:
                    yield flush_words()
                    words.clear()
        if grams:
            yield flush_grams(*merged(*(np.concatenate(c) for c in zip(*grams))))
        if words:
            yield flush_words()

    each = docs.select(doc_id, text).mapInArrow(scan, "gram boolean, k1 long, k2 long, n long")
    all_ = written(each.groupBy("gram", "k1", "k2").agg(F.sum("n").alias("n")), "lm-counts")
    return all_.where("gram").select(F.col("k1").alias("key"), "n"), all_.where("NOT gram").select("k1", "k2", "n")


def _arrays(grams: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return grams.column("key").to_numpy().astype(np.int64).view(np.uint64), grams.column("n").to_numpy().astype(np.float64)


def shard_ends(grams: DataFrame, max_grams: int) -> np.ndarray:
    """The last two-byte context of each shard: ranges of contexts with ``max_grams`` strings, if none has more alone."""
    context = F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)
    ends, held, before = [], 0, 0
    for c, n in sorted((r.c, r["count"]) for r in grams.groupBy(context.alias("c")).count().collect()):  # 65,536 at most
        if held and held + n > max_grams:
            ends.append(before)
            held = 0
        held, before = held + n, c
    return np.array([*ends, 0xFFFF], np.int64)


def shard_of(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, ((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)).astype(np.int32)


def fitted(grams: DataFrame, depth: int, max_grams: int) -> tuple[DataFrame, np.ndarray]:
    """(shard, blob): the model of all strings, and the last context of each shard. Shards are made on executors."""
    ends = shard_ends(grams, max_grams)

    def deal(batches):
        for batch in batches:
            shard = shard_of(batch.column(0).to_numpy().view(np.uint64), ends)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", "key", "n"])

    dealt = written(grams.mapInArrow(deal, "shard int, key long, n long"), "lm-strings")
    if depth < 2:  # 65,536 strings at most
        top = below = None
    else:
        top = merged(*_arrays(grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()))

        def under(part: pa.Table) -> pa.Table:
            sums = Model.below_top(*_arrays(part), depth, top)
            node = [np.flatnonzero(x) for x in sums]
            bit, value = np.repeat(np.arange(8), list(map(len, node))), np.concatenate([x[at] for x, at in zip(sums, node)])
            return pa.table({"bit": pa.array(bit, pa.int32()), "node": pa.array(np.concatenate(node), pa.int32()), "value": value})

        rows = dealt.groupBy("shard").applyInArrow(under, "bit int, node int, value double").groupBy("bit", "node").agg(F.sum("value").alias("value")).toArrow()
        bit, node, value = (rows.column(k).to_numpy() for k in ("bit", "node", "value"))  # a node of a one-byte context each
        below = [np.bincount(node[bit == j], weights=value[bit == j], minlength=len(np.unique(Model._node(top[0], j)[0]))) for j in range(8)]

    def build(part: pa.Table) -> pa.Table:
        model = Model(*_arrays(part), depth, top, below)
        return pa.table({"shard": part.column("shard")[:1], "blob": pa.array([pickle.dumps(model)], pa.binary())})

    return written(dealt.groupBy("shard").applyInArrow(build, "shard int, blob binary"), "lm-shards"), ends


def head_of(shards: DataFrame, size: int) -> Logs:
    """The strings used most, with what the model says of them."""

    def unpack(batches):
        for batch in batches:
            for blob in batch.column(0):
                m = pickle.loads(blob.as_py())
                for k in range(0, len(m.grams), FLUSH):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + FLUSH]) for x in (m.grams.view(np.int64), m.counts.astype(np.int64), m.logs)], names=["key", "n", "log"])

    rows = shards.select("blob").mapInArrow(unpack, "key long, n long, log float").orderBy(F.desc("n"), "key").limit(size).select("key", "log").toArrow()
    return Logs(rows.column(0).to_numpy().astype(np.int64).view(np.uint64), rows.column(1).to_numpy().astype(np.float32))


#: A probe: the row, the string, how often the row has it.
PROBE = np.dtype([("row", np.int64), ("key", np.uint64), ("times", np.int32)])


def scored(docs: DataFrame, depth: int = DEPTH, folds: int = 10, max_grams: int = MAX_GRAMS, head_grams: int = HEAD_GRAMS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    spark = docs.sparkSession
    grams, words = training_counts(docs, depth, folds, text, doc_id)
    shards, ends = fitted(grams, depth, max_grams)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sent = spark.sparkContext.broadcast((lookup.Head.of(words, "n", "n"), head_of(shards, head_grams)))
    new = [T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("near_known", T.LongType()), ("near", T.DoubleType()), ("near_score", T.DoubleType()), ("n_bytes", T.LongType()))]
    schema = extended(docs.select(doc_id).schema, [*new, *lookup.TAIL_FIELDS, T.StructField("_strings", T.ArrayType(T.LongType())), T.StructField("_uses", T.ArrayType(T.IntegerType()))])
    rare = float(np.log10(0.1))  # what a word without a count adds

    def scan(batches):
        known: dict[bytes, bytes] = {}
        numbers = lookup.RowNumbers()
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            top, strings = sent.value
            logs = np.log10(top.values + 0.1)
            scores, far = score(texts, depth, strings)
            cols: list[list] = [[] for _ in range(4)]
            tails = []
            for t in texts:
                freq = _words(t)
                if len(known) > FLUSH:
                    known.clear()
                fresh = [w for w in freq if w not in known]
                known.update(zip(fresh, map(lookup.digest, fresh)))
                k = lookup.halves(map(known.__getitem__, freq))
                n = np.fromiter(freq.values(), np.int64, len(freq))
                at, there = top.find(k)
                cols[0].append(int(n.sum()))
                cols[1].append(int(n[there].sum()))
                cols[2].append(float((logs[at[there]] * n[there]).sum()))
                cols[3].append(len(b" ".join(t.split())) + 1)
                tails.append((k[~there], n[~there].astype(np.int32)))
            held = [crc_bucket(i, folds) == 0 for i in ids.to_pylist()]
            cuts = pa.array(np.cumsum([0] + [len(k) for k, _ in far]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([x[c] for x in far] or [np.zeros(0)]).astype(kind))) for c, kind in ((0, np.int64), (1, np.int32))]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(scores, pa.float64()), pa.array(cols[3], pa.int64()), numbers.take(len(held)), lookup.tail_column(tails), *lists],
                names=schema.names,
            )

    def ask(batches):
        for batch in batches:
            size = batch.column("_strings").value_lengths().to_numpy()
            flat = np.empty(int(size.sum()), PROBE)
            flat["row"] = np.repeat(batch.column("_row").to_numpy(), size)
            flat["key"], flat["times"] = batch.column("_strings").flatten().to_numpy().view(np.uint64), batch.column("_uses").flatten().to_numpy()
            if len(flat):
                yield from routed.packed(shard_of(flat["key"], ends), flat)

    def answer(model: Model, flat: np.ndarray) -> pa.RecordBatch:
        names, at = np.unique(flat["row"], return_inverse=True)
        sums = np.bincount(at, weights=model.log10(flat["key"].copy()).astype(np.float64) * flat["times"], minlength=len(names))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["_row", "far_score"])

    rows = written(docs.select(doc_id, text).mapInArrow(scan, schema), "lm-rows")
    asked = rows.where(F.size("_strings") > 0).select("_row", "_strings", "_uses").mapInArrow(ask, "shard int, data binary")
    strings = routed.answered(shards, asked, PROBE, pickle.loads, answer, "_row long, far_score double")
    # A tail word without a count adds ``rare``; those with one add the difference.
    hits = lookup.tail_hits(rows, words).select("_row", F.col("times").cast("long").alias("far_known"), (F.col("times") * (F.log10(F.col("n") + 0.1) - rare)).alias("far"), F.lit(0.0).alias("far_score"))
    hits = hits.unionByName(strings.select("_row", F.lit(0).cast("long").alias("far_known"), F.lit(0.0).alias("far"), "far_score"))
    more = hits.groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("far_known", "far", "far_score")))
    out = rows.drop("_tail", "_strings", "_uses").join(more, "_row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("far_known", "far", "far_score")})
    raw = F.col("near") + F.col("far") + (F.col("n_tokens") - F.col("near_known")) * F.lit(rare)
    under = float(np.log10(total + 0.1 * (distinct + 1)))
    log = F.col("near_score") + F.col("far_score")
    return out.select(
        doc_id, "held_out", "n_tokens", (F.col("near_known") + F.col("far_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (raw - F.col("n_tokens") * F.lit(under)).alias("base_score"), log.alias("score"), (-log / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
