"""SimHash near-duplicate groups through multi-index hashing.

A fingerprint is 64 bits: bit b is 1 if it is set in more than half of the XXH64 values (seed 42) of
the text's word shingles, repeats included. Two documents link if their fingerprints differ in at most
two bits; a component is what links reach.

Search. Only distinct fingerprints take part, so copies cost nothing. A fingerprint has two 32-bit
segments, each with a table keyed by the segment's value. If two fingerprints differ in at most two
bits, either the first segments differ in at most one bit or the second segments are equal. So a
fingerprint probes the first table with the Hamming ball of radius one around its first segment (only
upwards: of two values one bit apart, one has the bit and the other one finds it) and the second table
with its own value. Matches are fetched by a join on (segment, value) and the complete distance of each
candidate is verified.

Crowded table keys. Where more than ``crowd`` rows meet at one key, pairs would grow with the square of
the crowd. There each member is filed under every value of the *other* segment within one bit, and
each probe that arrives one bit away under its own value. Whatever shares such a file is within two
bits of each other, and any two within two bits share one, so each file is linked to its smallest
fingerprint: exact, and linear in the crowd.

Components come from alternating large-star and small-star rounds over distinct fingerprints, each
round written to the shared folder.

Defined edge cases: null, empty or white-space texts have fingerprint zero and link like any other;
texts with fewer words than a shingle count their whole word sequence; rows with a null id keep their
fingerprint and get the component's smallest non-null id (null if there is none); repeated rows are
harmless; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import dropped, released, utf8, written

SEED = 42
#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15
#: Rows at a table key beyond which the linear way is taken.
CROWD = 32
#: Links that one task contracts by itself at most before the rounds start.
LOCAL = 1 << 20


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        part = hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[doc_id, "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, fingerprint long")


def _apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) fingerprints that differ in at most two bits, enough of them to connect all that are linked.

    ``distinct`` has one column, fingerprint. A pair may come more than once.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND((1 << 32) - 1)
    flips = F.array(*(F.lit(1 << k) for k in range(32)))
    base = distinct.select(F.col("fingerprint").alias("fp"))
    own = base.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))).alias("k"), F.lit(False).alias("near"))
    ball = F.filter(F.transform(flips, lambda b: high.bitwiseOR(b)), lambda v: v != high)
    near = base.select("fp", F.explode(F.transform(ball, lambda v: F.struct(F.lit(0).alias("seg"), v.alias("val")))).alias("k"), F.lit(True).alias("near"))
    rows = own.unionByName(near).select("k.seg", "k.val", "fp", "near")

    # Keys at which a member meets anything else; the others cannot give a candidate.
    load = rows.groupBy("seg", "val").agg(F.count("*").alias("load"), F.count_if(~F.col("near")).alias("members"))
    live = load.where((F.col("load") > 1) & (F.col("members") > 0)).select("seg", "val", "load")
    met = written(rows.join(live, ["seg", "val"]), "simhash-candidates")

    few = met.where(F.col("load") <= crowd)
    table_ = few.where(~F.col("near")).select("seg", "val", F.col("fp").alias("b"))
    probes = few.select("seg", "val", F.col("fp").alias("a"), "near")
    pairs = probes.join(table_, ["seg", "val"]).where((F.col("near") | (F.col("a") < F.col("b"))) & (_apart("a", "b") <= 2)).select("a", "b")

    # Beyond that: files by the other segment.
    other = F.when(F.col("seg") == 0, low).otherwise(high)
    filed = F.when(F.col("near"), F.array(other)).otherwise(F.concat(F.array(other), F.transform(flips, lambda b: other.bitwiseXOR(b))))
    files = met.where(F.col("load") > crowd).select("seg", "val", "fp", F.explode(filed).alias("file"))
    heads = files.groupBy("seg", "val", "file").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = files.join(heads, ["seg", "val", "file"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links a task holds by stars with the same components, ``LOCAL`` links at a time."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            while not np.array_equal(up := root[root], root):
                root = up
            if np.array_equal(root[x], root[y]):
                break
        out = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) > LOCAL:
            yield stars(*(np.concatenate(c) for c in zip(*held)))
            held = []
    if held:
        yield stars(*(np.concatenate(c) for c in zip(*held)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Rounds of large-star (neighbours above a node go to its smallest neighbour) and small-star (those
    below do) until a round changes nothing; the number of rounds grows with the logarithm of the size.
    A node's smallest neighbour is joined to its links, so no node's links are ever held together.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        j = e.join(low, "a")
        if large:
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # all links point downwards here
            out = j.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        return out.where("a > b").distinct()

    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(down.mapInArrow(_contract, "a long, b long").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        before, now = now, written(star(star(now, True), False), "links")
        dropped(before)


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach from each row."""
    prints = written(fingerprints(docs, shingle, text, doc_id), "fingerprints")
    first = written(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")), "distinct")
    roots = components(links(first.select("fingerprint"), crowd))
    known = first.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    known = written(known, "roots")
    best = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(best, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select(doc_id, "fingerprint", "component_id")


# ------------------------------------------------------------------------ near copies of lesser likeness
#
# Exact: two texts link if their sets of five-word shingles (64-bit hashes) have a similarity of 0.8 or more.
# The search is a prefix filter. A set of n shingles can only reach the similarity with sets that share
# need = ceil(0.8 n) of its shingles; so of any order of all shingles, its first n - need + 1 hold the first
# one that the two share. Rare shingles go first: those of one text alone, which no candidate can meet, use
# up most prefixes or all of them, and a text with fewer than ``need`` shingles found elsewhere has none.
#
# Hashes travel packed, a row a bucket, and are counted in arrays. Every candidate is verified by the size
# of the intersection. At keys that more than ``crowd`` texts share, each meets the smallest of them first;
# where that leaves more than one component, all rows of the key are compared in blocks.

#: Similarity as a fraction.
LEAST, OF = 4, 5
#: Hashes that a task packs at once, hashes of a bucket, rows of a block.
PACKED, BUCKET, SIDE = 1 << 19, 1 << 20, 256
#: Factor of a shingle's polynomial.
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of word shingles, sorted; a shorter text is one shingle, one without words has none.

    A shingle's hash is a polynomial of its words' hashes.
    """
    words = text.lower().split()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(own) - shingle + 1) if len(own) else 0
    grams = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(own))):
        grams = grams * _FACTOR + own[k : k + n]
    return np.unique(grams)


def _node(grams: np.ndarray) -> int:
    """A set's own hash, signed: sets that are equal are one node."""
    x = xxhash.xxh3_64_intdigest(grams.tobytes(), seed=SEED)
    return x - (1 << 64) if x >> 63 else x


def _packed(by: np.ndarray, buckets: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that ``by`` falls into, with the bytes of its part of each column."""
    to = (by.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    to = to[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    ends = [*at[1:], len(to)]
    parts = [pa.array([c[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()) for c in (x[order] for x in columns)]
    return pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), *parts], names=["bucket", *(f"c{k}" for k in range(len(parts)))])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    held: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for k, h in enumerate(held):
            h += batch.column(k + 1).to_pylist()
    return [np.frombuffer(b"".join(h), kind) for h, kind in zip(held, kinds)]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return at, np.diff(np.append(at, len(x)))


def shingle_prefixes(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """(node, n, k, shared): of each distinct set that can have a near copy its size, the length of its prefix
    without the shingles of this text alone, and its shingles found elsewhere, rarest first."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (5 * BUCKET)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            size = np.array([len(s) for _, s in held])
            grams = np.concatenate([s for _, s in held])
            return _packed(grams, buckets, [grams, np.repeat(np.array([x for x, _ in held], np.int64), size), np.repeat(size.astype(np.uint32), size)])

        load = 0
        for batch in batches:
            for t in utf8(batch.column(0)):
                grams = shingle_set(t, shingle)
                node = _node(grams)
                if len(grams) and node not in seen:
                    if len(seen) > LOCAL:
                        seen.clear()
                    seen.add(node)
                    held.append((node, grams))
                    load += len(grams)
                    if load > PACKED:
                        yield flush()
                        held, load = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, node, n = _unpacked(batches, [np.uint64, np.int64, np.uint32])
        order = np.lexsort((node, grams))
        grams, node, n = grams[order], node[order], n[order]
        new = np.ones(len(grams), bool)  # tasks may have met the same set
        new[1:] = (grams[1:] != grams[:-1]) | (node[1:] != node[:-1])
        grams, node, n = grams[new], node[new], n[new]
        _, times = _runs(grams)
        found = np.repeat(times, times)
        many = found > 1
        if many.any():
            grams, node, n, found = (x[many] for x in (grams, node, n, found.astype(np.int64)))
            yield _packed(node, buckets, [grams, node, n, found])
        del grams, node, n, order, new, found, many
        released()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, node, n, found = _unpacked(batches, [np.uint64, np.int64, np.uint32, np.int64])
        order = np.lexsort((grams, found, node))
        grams, node, n = grams[order].view(np.int64), node[order], n[order].astype(np.int64)
        at, shared = _runs(node)
        need = (LEAST * n[at] + OF - 1) // OF
        able = shared >= need
        for k in range(0, int(able.sum()), 1000):
            a, m, d = (x[able][k : k + 1000] for x in (at, shared, need))
            lists = pa.array([grams[i : i + j] for i, j in zip(a, m)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(n[a]), pa.array(m - d + 1), lists], names=["node", "n", "k", "shared"])
        del grams, node, n, found, order
        released()

    dealt = docs.select(text).mapInArrow(deal, "bucket int, c0 binary, c1 binary, c2 binary").repartitionById(buckets, F.col("bucket"))
    counted = dealt.mapInArrow(count, "bucket int, c0 binary, c1 binary, c2 binary, c3 binary").repartitionById(buckets, F.col("bucket"))
    return written(counted.mapInArrow(choose, "node long, n long, k long, shared array<long>"), "similar-sets")


def _cell(table: pa.Table) -> pa.Table:
    """Links between components of the rows of a key that lie in two blocks (or one, if both are the same)."""
    node, n, root, side = (table.column(c).to_numpy() for c in ("node", "n", "root", "side"))
    lists = table.column("shared").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    first = np.cumsum(size) - size
    _, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    mark = np.zeros(len(flat) and flat.max() + 1, bool)
    two = side.min() != side.max()
    root = root.copy()
    out: list[tuple[int, int]] = []
    for i in range(len(node)):
        if not (root != root[i]).any():
            break
        own = flat[first[i] : first[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[flat].astype(np.int32), first)
        mark[own] = False
        near = (OF + LEAST) * both >= LEAST * (n + n[i])
        if two:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if root[j] != root[i]:
                out.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def similar_links(sets: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) nodes of ``sets`` (see ``shingle_prefixes``) that are near copies, enough of them to connect all
    that are."""
    members = sets.select("node", "n", F.explode(F.slice("shared", F.lit(1), F.col("k").cast("int"))).alias("key"))
    load = written(members.groupBy("key").agg(F.count("*").alias("load"), F.min("node").alias("head")).where("load > 1"), "similar-keys")
    cold = members.join(load.where(F.col("load") <= crowd).select("key"), "key")
    hot = members.join(load.where(F.col("load") > crowd), "key")
    fits = F.greatest("n", "m") * LEAST <= F.least("n", "m") * OF
    pairs = cold.withColumnRenamed("node", "a").join(cold.select("key", F.col("node").alias("b"), F.col("n").alias("m")), "key").where((F.col("a") > F.col("b")) & fits).select("a", "b")
    pairs = pairs.unionByName(hot.where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))).distinct()
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"))
    both = F.size(F.array_intersect("shared_a", "shared_b"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(both * (OF + LEAST) >= (F.col("n_a") + F.col("n_b")) * LEAST)
    links = written(met.select("a", "b"), "similar-links")
    if load.where(F.col("load") > crowd).isEmpty():
        return links

    # Keys whose rows are not all connected yet: each pair of blocks is a group of its own.
    roots = components(links).withColumnRenamed("root", "r")
    named = hot.select("node", "key", "load").join(roots, "node", "left").select("node", "key", "load", F.coalesce("r", "node").alias("root"))
    named = written(named, "similar-crowds")
    apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    blocks = F.ceil(F.col("load") / F.lit(SIDE)).cast("int")
    placed = named.join(apart, "key").select("node", "key", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("side"))
    spread = placed.select("node", "key", "root", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = spread.select("node", "key", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).join(sets.select("node", "n", "shared"), "node")
    return links.unionByName(written(cells.groupBy("key", "i", "j").applyInArrow(_cell, "a long, b long"), "similar-crowd-links"))


def similar_groups(docs: DataFrame, shingle: int = 5, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) by near copies: shingles of five words, similarity of 0.8 or more.

    Ids may be of any type that has an order. Rows without an id are left out; texts without words are copies of each
    other; repeated rows are harmless; an empty table gives an empty result; only the id and the text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([_node(shingle_set(t, shingle)) for t in utf8(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes], names=["doc_id", "node"])

    docs = docs.where(F.col(doc_id).isNotNull())
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = written(docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, node long"), "similar-rows")
    sets = shingle_prefixes(docs, shingle, text)
    roots = components(similar_links(sets, crowd))
    first = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    known = written(first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "similar-roots")
    dropped(sets)
    best = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(best, "root").select("node", "component_id")
    return rows.join(named, "node").select(F.col("doc_id").alias(doc_id), "component_id")


def near_copies(docs: DataFrame, shingle: int = 5, text: str = "text", doc_id: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups by both ways to be near copies, joined where they meet.

    Fingerprints of the text's shingles link within two bits, as everywhere here. They miss many copies of a similarity of
    0.8, whose fingerprints differ in ten bits or so; the exact check over the fingerprints' groups adds these links
    (``similar_groups``). Rows without an id are left out.
    """
    docs = docs.where(F.col(doc_id).isNotNull())
    prints = written(near_duplicate_groups(docs, shingle, text, doc_id, crowd), "near-prints")
    exact = written(similar_groups(docs, shingle, text, doc_id, crowd).withColumnRenamed("component_id", "_exact"), "near-exact")
    apart = lambda df, to: df.where(F.col(to) != F.col(doc_id)).select(F.xxhash64(doc_id).alias("a"), F.xxhash64(to).alias("b"))
    roots = components(apart(prints, "component_id").unionByName(apart(exact, "_exact")))
    rows = prints.select(doc_id, "fingerprint", F.xxhash64(doc_id).alias("own"))
    whole = written(rows.join(roots, F.col("own") == F.col("node"), "left").select(doc_id, "fingerprint", F.coalesce("root", "own").alias("root")), "near-roots")
    best = whole.groupBy("root").agg(F.min(doc_id).alias("component_id"))
    return whole.join(best, "root").select(doc_id, "fingerprint", "component_id")
