"""Line deduplication through a sharded minimal perfect hash.

Plan: one scan counts in how many documents each line key occurs (per-task pre-aggregation, then one
shuffle of 128-bit hashes); the distinct hashes that reach the threshold are dealt to shards, and each shard
compiles a minimal perfect hash with two arrays behind it, a 64-bit fingerprint and a document count.
A second scan probes those arrays per document. Lines themselves are never shuffled.

Distinct lines below the threshold are counted but left out of the arrays: nearly all lines are found once, so
they would make the arrays many times larger, and the answer is the same ("keep"), since such a probe lands on
no slot or on one whose fingerprint differs.

Every answer comes from the arrays, at any size. The shard of the ``HEAD`` lines found most often (a fixed number,
about two megabytes) is sent to every task. If there are more, a document's other hashes are packed by shard and
shuffled to it (see ``routed``); the hits come back under the hash of the whole text. A line outside the head
is found in fewer documents than any in it, and a shard with many probes is copied, so none is hot.

Defined edge cases: a null or empty text is one empty line and is kept as an empty text; the key of a
line is the line without the white space at its ends, A-Z lower-cased; keys shorter than ``min_chars``
never count; repeated rows count as documents of their own; an empty table gives an empty result;
columns that clash with the ones added are replaced.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm import routed
from gossamer.llm.common import SPACE, appended, extended, rows_of, utf8, with_extra, written

#: Entries of a task's counting table before it is handed on; bounds a worker's memory.
FLUSH = 400_000
#: Keys a shard holds on average.
SHARD_KEYS = 1 << 16
#: Lines, found most often, whose arrays every task has.
HEAD = 1 << 17
#: A probe: the name of a text (the MD5 of its bytes) and the hash of one of its lines.
PROBE = np.dtype([("a", np.uint64), ("b", np.uint64), ("h1", np.uint64), ("h2", np.uint64)])

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = 0x9E3779B97F4A7C15


def line_hashes(text: bytes, min_chars: int = 1) -> list[bytes | None]:
    """A 16-byte hash for each line of the text, None where the key is too short to count."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(SPACE)
        short = len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, ranked by population count."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes = words, sizes
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)]).astype(np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys + np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)) * _MIX
        x ^= x >> np.uint64(32)
        return ((x * _MIX) >> np.uint64(16)) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], np.unique(keys)
        while len(left):
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = cls._place(left, len(levels), size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[hits[at.astype(np.int64)] > 1]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return cls(words, np.array(sizes, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it; unknown keys may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self._place(keys[open_], level, int(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.rank[word[hit]].astype(np.int64) + below
            open_ = open_[~hit]
        return out


def pack_shard(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> bytes:
    """One shard as bytes. Keys that agree in h1 alone would share a slot, so h1 is salted until none do."""
    salt = np.uint64(0)
    while len(np.unique(h1 ^ (h2 * salt))) < len(h1):
        salt += np.uint64(1)
    index = PerfectHash.build(keys := h1 ^ (h2 * salt))
    slot = index.slots(keys)
    fingerprints, stored = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32)
    fingerprints[slot], stored[slot] = h2, np.minimum(counts, 0xFFFFFFFF)
    np.savez(out := io.BytesIO(), words=index.words, sizes=index.sizes, fp=fingerprints, n=stored, salt=np.array([salt]))
    return out.getvalue()


class LineIndex:
    """Shards read back; ``counts`` gives the stored document count of each hash, 0 for unknown ones."""

    def __init__(self, shards: dict[int, bytes], n_shards: int):
        self.n_shards, self.parts = n_shards, {}
        for k, blob in shards.items():
            with np.load(io.BytesIO(blob)) as z:
                self.parts[k] = PerfectHash(z["words"], z["sizes"]), z["fp"], z["n"], z["salt"][0]

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        shard = (h1 % np.uint64(self.n_shards)).astype(np.int64)
        for k in np.unique(shard):
            if k in self.parts:
                index, fp, n, salt = self.parts[k]
                rows = np.flatnonzero(shard == k)
                slot = index.slots(h1[rows] ^ (h2[rows] * salt))
                good = slot >= 0
                good[good] = fp[slot[good]] == h2[rows[good]]
                out[rows[good]] = n[slot[good]]
        return out


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(h1, h2, n_docs) of every line key found in at least ``min_docs`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            h1, h2 = _halves(list(seen))
            n = np.fromiter(seen.values(), np.int64, len(seen))
            return rows_of(h1.view(np.int64), h2.view(np.int64), n, names=["h1", "h2", "n_docs"])

        for batch in batches:
            for doc in utf8(batch.column(0)):
                seen.update(set(line_hashes(doc, min_chars)) - {None})
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    each = docs.select(text).mapInArrow(count, "h1 long, h2 long, n_docs long")
    return each.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def build_index(frequent: DataFrame, n_shards: int) -> DataFrame:
    """(shard, blob): the minimal perfect hash and arrays of each shard, built on the executors."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        blob = pack_shard(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64), rows["n_docs"].to_numpy())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "blob": [blob]})

    # unsigned remainder, as LineIndex takes it: (high * (2^32 mod n) + low) mod n
    high, low = F.shiftrightunsigned("h1", 32), F.col("h1").bitwiseAND(0xFFFFFFFF)
    shard = ((high % n_shards) * ((1 << 32) % n_shards) + low % n_shards) % n_shards
    return frequent.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(build, "shard int, blob binary")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", head: int | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    Returns all columns of ``docs`` with the kept lines as the text, then n_lines and n_dropped. The arrays of
    the ``head`` lines found most often are sent to every task; the others are probed in their shards.
    """
    spark = docs.sparkSession
    head = HEAD if head is None else head
    frequent = written(frequent_lines(docs, min_docs, min_chars, text), "lines")
    rows = frequent.orderBy(F.desc("n_docs"), "h1", "h2").limit(head).toArrow()
    h1, h2, n = (rows.column(k).to_numpy() for k in ("h1", "h2", "n_docs"))
    sent = spark.sparkContext.broadcast(pack_shard(h1.view(np.uint64), h2.view(np.uint64), n))
    new = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    opened: list[LineIndex] = []

    def probe(hashes: list[list[bytes | None]]) -> set[bytes]:
        """The frequent ones among them, by the arrays at hand."""
        if not opened:
            opened.append(LineIndex({0: sent.value}, 1))
        all_ = list({h for own in hashes for h in own} - {None})
        return {h for h, n in zip(all_, opened[0].counts(*_halves(all_))) if n >= min_docs}

    def kept(texts: list[bytes], hashes: list[list[bytes | None]], bad: list[set[bytes]]) -> list[pa.Array]:
        out, total, gone = [], [], []
        for doc, own, drop in zip(texts, hashes, bad):
            lines = doc.split(b"\n")
            left = [x for x, h in zip(lines, own) if h is None or h not in drop]
            out.append(b"\n".join(left))
            total.append(len(lines))
            gone.append(len(lines) - len(left))
        return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]

    n_lines = frequent.count()
    if n_lines <= len(h1):  # no shard beside the one that was sent

        def whole(texts: list[bytes]) -> list[pa.Array]:
            hashes = [line_hashes(t, min_chars) for t in texts]
            return kept(texts, hashes, [probe(hashes)] * len(texts))

        return appended(docs, new, whole, text)

    rest = frequent
    if len(h1):  # those behind the last one sent
        last = rows.slice(len(h1) - 1).to_pylist()[0]
        line = lambda *c: F.struct(*(x.cast("long").alias(k) for x, k in zip(c, "abc")))
        rest = frequent.where(line(-F.col("n_docs"), F.col("h1"), F.col("h2")) > line(F.lit(-last["n_docs"]), F.lit(last["h1"]), F.lit(last["h2"])))
    n_shards = -(-(n_lines - len(h1)) // shard_keys)
    shards = written(build_index(rest, n_shards), "line-index")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts = utf8(batch.column(0))
            hashes = [line_hashes(t, min_chars) for t in texts]
            known, asked = probe(hashes), []
            for doc, own in zip(texts, hashes):
                if (name := md5(doc).digest()) not in seen:
                    if len(seen) > FLUSH:
                        seen.clear()
                    seen.add(name)
                    asked += [name + h for h in set(own) - known - {None}]
            if asked:
                flat = np.frombuffer(b"".join(asked), PROBE)
                yield from routed.packed((flat["h1"] % np.uint64(n_shards)).astype(np.int32), flat)

    def answer(index: LineIndex, flat: np.ndarray) -> pa.RecordBatch:
        good = flat[index.counts(flat["h1"], flat["h2"]) >= min_docs]
        raw = good.tobytes()
        names, lines = ([raw[k + a : k + a + 16] for k in range(0, len(raw), 32)] for a in (0, 16))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lines, pa.binary())], names=["_name", "line"])

    hits = routed.answered(shards, docs.select(text).mapInArrow(ask, "shard int, data binary"), PROBE, lambda blob: LineIndex({0: blob}, 1), answer, "_name binary, line binary")
    bad = written(hits.groupBy("_name").agg(F.collect_set("line").alias("_bad")), "line-hits")
    name = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    wide, extra = with_extra(docs, name, bad, "_name", "_bad")
    schema = extended(docs.schema, new)
    keep = [f.name for f in schema.fields[:-3]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(text))
            hashes = [line_hashes(t, min_chars) for t in texts]
            known = probe(hashes)
            columns = kept(texts, hashes, [known.union(row or ()) for row in batch.column(extra).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, names=[f.name for f in schema.fields])

    return wide.mapInArrow(apply, schema)
