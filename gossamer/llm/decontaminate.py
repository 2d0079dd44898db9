"""Benchmark decontamination by template canonicalisation.

Words are runs of letters or of digits (points and commas inside a number belong to it). A template has
typed placeholders for numbers, names (capitalised words) and units, the rest lower-cased; a literal form
has no placeholders and no case. Each window of ``window`` words is hashed in both forms, and a
document's windows are hash-joined to the distinct windows of the benchmark items. If the items' texts measure
at most ``MAX_BYTES``, they are the build side and one scan of the documents does it. A larger benchmark
is a table of windows: documents' windows that pass a filter of fixed size are shuffled to it, and each text
is verified against its candidates; the rows are the same.

Candidates. A text that holds enough windows of an item holds one of the item's few that the fewest items share,
so only these are looked up, and phrases that many items have in common bring no candidates.

An item is in a document if at least ``similarity`` of the item's distinct windows are met around one alignment,
and, for templates, if the slots are consistent: over the matched windows, one value of the item stands
for one value of the document and the other way round, for at least ``agreement`` of the slots. So a
question with other numbers and names is caught, and text that shares only the grammar is not. Repeated words cost
no more than others: an item's window counts once, and all its places in the text are aligned by sorting.

Template windows with fewer than ``MIN_LITERAL`` plain words say too little and are left out on both
sides; an item left with fewer than three distinct ones is held against literal windows only.

Defined edge cases: null and empty texts hold nothing; items without words for one window (fewer than
``window``) never match; items of equal text are reported each; repeated rows and null ids pass through;
an empty table or benchmark gives no leaks; a column ``leaks`` that is there already is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm.common import appended, extended, utf8, with_extra, written

#: Words of a window; share of an item's windows; share of slots that must agree.
WINDOW, SIMILARITY, AGREEMENT = 5, 0.8, 0.9
MIN_LITERAL = 2
#: Words by which an alignment may drift, by insertions or longer names.
SLACK = 24
#: Bytes of a benchmark that is sent to every executor: some eight times that in its tables.
MAX_BYTES = 8 << 20
#: Bytes of text handled at once (a longer single text is handled alone); bytes hashed at once.
CHUNK, PIECE = 1 << 20, 1 << 18

# Unit words, in natural order.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs "
    "ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit kmh mph hz khz mhz ghz kb mb gb tb watt watts kw volt volts"
).split()

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NUMBER, NAME, UNIT = np.uint64(0x1111), np.uint64(0x2222), np.uint64(0x3333)

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit; bytes above 127 belong to letters
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _CLASS[128:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(p: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, p, np.uint64)]))


_UP, _DOWN = _powers(_P), _powers(_PINV)


def _word_sums(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each word's polynomial hash, from running sums over ``PIECE`` bytes at a time."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a <= PIECE:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * _UP[: b - a], out=sums[1:])
            out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * _DOWN[start[i:j] - a]
        else:  # one word longer than that
            total, scale = 0, 1
            for k in range(a, b, PIECE):
                part = low[k : min(b, k + PIECE)].astype(np.uint64) + np.uint64(1)
                total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * scale
                scale = scale * pow(_P, PIECE, 1 << 64) % (1 << 64)
            out[i] = np.uint64(total % (1 << 64))
        i = j
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    literal: np.ndarray  # hash of the lower-cased word
    template: np.ndarray  # the same, or a placeholder
    slot: np.ndarray  # whether it is a placeholder


def lower(text: bytes) -> bytes:
    """Lower case for ASCII, and for the two-byte letters whose capitals lie 32 below (U+00C0 to U+00DE)."""
    if not text.isascii() and b"\xc3" in text:
        text = re.sub(rb"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), text)
    return text.lower()


def words_of(text: bytes) -> Words:
    raw = np.frombuffer(text, np.uint8)
    low = np.frombuffer(lower(text), np.uint8)
    kind = _CLASS[raw]
    if len(raw) > 2:  # points and commas between digits
        dot = ((raw[1:-1] == ord(".")) | (raw[1:-1] == ord(","))) & (kind[:-2] == 2) & (kind[2:] == 2)
        kind[1:-1][dot] = 2
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    edge = edge[edge < len(raw)]
    start = edge[kind[edge] > 0]
    stops = np.append(edge, len(raw))
    end = stops[np.searchsorted(stops, start, side="right")]
    literal = _mix(_word_sums(low, start, end) + (end - start).astype(np.uint64))
    first = raw[start]
    name = (first >= 65) & (first <= 90) | (first == 0xC3) & (low[np.minimum(start + 1, len(raw) - 1)] != raw[np.minimum(start + 1, len(raw) - 1)])
    number = kind[start] == 2
    unit = _UNIT_HASHES[np.searchsorted(_UNIT_HASHES[:-1], literal)] == literal if len(_UNIT_HASHES) else np.zeros(len(start), bool)
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
    return Words(start, end, literal, template, number | unit | name)


_UNIT_HASHES = np.zeros(0, np.uint64)
_UNIT_HASHES = np.sort(np.array([words_of(u.encode()).literal[0] for u in UNITS], np.uint64))


def window_hashes(values: np.ndarray, window: int, salt: int) -> np.ndarray:
    n = len(values) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt), np.uint64)
    for k in range(window):
        out = (out ^ values[k : k + n]) * _M2
        out ^= out >> np.uint64(29)
    return out


def _told(words: Words, window: int) -> np.ndarray:
    """Windows with enough plain words for their template to say something."""
    n = max(0, len(words.slot) - window + 1)
    plain = np.concatenate([[0], np.cumsum(~words.slot)])
    return plain[window : window + n] - plain[:n] >= MIN_LITERAL


def item_windows(words: Words, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of an item's distinct literal windows, and of its distinct template windows."""
    out = []
    told = _told(words, window)
    for values, salt, good in ((words.literal, 1, None), (words.template, 2, told)):
        hashes = window_hashes(values, window, salt)
        at = np.arange(len(hashes)) if good is None else np.flatnonzero(good)
        once, first = np.unique(hashes[at], return_index=True)
        out.append((once, at[first]))
    if len(out[1][0]) < 3:
        out[1] = (out[1][0][:0], out[1][1][:0])
    return out


def needed(total: int, similarity: float) -> int:
    """Windows of an item that a text has to hold at least."""
    return max(1, int(np.ceil(similarity * total - 1e-9)))


class Benchmark:
    """Build side of the join: distinct windows of some items by hash."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, similarity: float):
        self.window, self.ids, self.texts = window, [i for i, _ in items], [lower(t) for _, t in items]
        self.words = [words_of(t) for _, t in items]
        self.parts = [p for w in self.words for p in item_windows(w, window)]  # of item k the forms 2 k and 2 k + 1
        self.need = [needed(len(h), similarity) for h, _ in self.parts]
        every = np.concatenate([h for h, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
        self.keys, key, shared = np.unique(every, return_inverse=True, return_counts=True)
        self.own = np.split(key, np.cumsum([len(h) for h, _ in self.parts])[:-1]) if self.parts else []
        # A text that holds ``need`` windows holds one of any total - need + 1 of them: those that fewest items share.
        first = [k[np.argsort(shared[k], kind="stable")[: len(k) - n + 1]] for k, n in zip(self.own, self.need)]
        owner = np.repeat(np.arange(len(first)), [len(f) for f in first])
        first = np.concatenate(first) if first else np.zeros(0, np.int64)
        order = np.argsort(first, kind="stable")
        self.owner, self.bound = owner[order], np.searchsorted(first[order], np.arange(len(self.keys) + 1))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def met(self, hashes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key) of every window that some item has."""
        pos = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)] & allowed)
        key = np.searchsorted(self.keys, hashes[pos])
        hit = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[pos] if len(self.keys) else np.zeros(len(pos), bool)
        return pos[hit], key[hit]


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from low to high of each pair, one after the other."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def aligned(p: np.ndarray, q: np.ndarray, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one alignment: that of the shifts p - q within ``slack`` which hold the most of the item's places.

    Each place of the item comes once, by the pair nearest to the alignment's usual shift. Linear but for sorting.
    """
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    s, n = p - q, len(p)
    by_place = np.lexsort((np.arange(n), q))
    before = np.full(n, -1)  # the pair before with the same place
    same = q[by_place][1:] == q[by_place][:-1]
    before[by_place[1:][same]] = by_place[:-1][same]
    # Pair j is a new place for the alignments that start behind the pair before it and within the slack.
    count = np.zeros(n + 1, np.int64)
    np.add.at(count, np.maximum(before + 1, np.searchsorted(s, s - slack)), 1)
    count[1:] -= 1
    best = int(np.argmax(np.cumsum(count)[:n]))
    last = int(np.searchsorted(s, s[best] + slack, side="right"))
    p, q, s = p[best:last], q[best:last], s[best:last]
    shifts, often = np.unique(s, return_counts=True)
    order = np.lexsort((p, np.abs(s - shifts[np.argmax(often)]), q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]])
    return p[order][first], q[order][first]


def _leak(text: bytes, words: Words, bench: Benchmark, own: int, p: np.ndarray, q: np.ndarray, agreement: float) -> float | None:
    """The coverage if the item is there in this form, by the positions p of its windows q."""
    item, form = divmod(own, 2)
    p, q = aligned(p, q)
    if len(q) < bench.need[own] or form and not _consistent(text, words, bench, item, dict(zip(q.tolist(), p.tolist())), agreement):
        return None
    return len(q) / len(bench.own[own])


def _consistent(text: bytes, words: Words, bench: Benchmark, item: int, pairs: dict[int, int], agreement: float) -> bool:
    own, other = bench.words[item], bench.texts[item]
    places = {q + k: p + k for q, p in pairs.items() for k in range(bench.window) if own.slot[q + k]}
    if not places:
        return True
    values = Counter()
    for q, p in places.items():
        values[other[own.start[q] : own.end[q]], lower(text[words.start[p] : words.end[p]])] += 1
    total = sum(values.values())
    for side in (0, 1):
        most: dict[bytes, int] = defaultdict(int)
        for pair, n in values.items():
            most[pair[side]] = max(most[pair[side]], n)
        if sum(most.values()) < agreement * total:
            return False
    return True


def batch_leaks(texts: list[bytes], bench: Benchmark, agreement: float) -> list[list[dict]]:
    """The items that each text holds."""
    out: list[list[dict]] = [[] for _ in texts]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < CHUNK):
            size += len(texts[last]) + 1
            last += 1
        joined = b"\n".join(texts[first:last])
        w = words_of(joined)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
        doc = np.searchsorted(starts, w.start, side="right") - 1
        n = max(0, len(doc) - bench.window + 1)
        inside = doc[:n] == doc[len(doc) - n :]
        a = bench.met(window_hashes(w.literal, bench.window, 1), inside)
        b = bench.met(window_hashes(w.template, bench.window, 2), inside & _told(w, bench.window))
        pos, key = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.lexsort((pos, key, doc[pos]))
        pos, key, of = pos[order], key[order], doc[pos[order]]
        cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(of))):
            at, k = pos[lo:hi], key[lo:hi]
            have = np.unique(k)
            found: dict[int, dict] = {}
            for own in np.unique(bench.owner[_spans(bench.bound[have], bench.bound[have + 1])]).tolist():
                item, form = divmod(own, 2)
                mine = bench.own[own]
                i, j = np.searchsorted(k, mine), np.searchsorted(k, mine, side="right")
                if item in found or np.count_nonzero(j > i) < bench.need[own]:
                    continue
                coverage = _leak(joined, w, bench, own, at[_spans(i, j)], np.repeat(bench.parts[own][1], j - i), agreement)
                if coverage is not None:
                    found[item] = {"item_id": bench.ids[item], "coverage": coverage, "kind": "template" if form else "literal"}
            out[first + int(of[lo])] = [found[x] for x in sorted(found)]
        first = last
    return out


def _leaks_type(benchmark: DataFrame) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("kind", T.StringType())]))


def marked(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, agreement: float = AGREEMENT, text: str = "text", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``docs`` with the column leaks: the benchmark items (item_id, coverage, kind) each text holds."""
    kind = _leaks_type(benchmark)
    arrow = _arrow_type(kind)
    bytes_ = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bytes_ > max_bytes:
        return _marked_by_join(docs, benchmark, window, similarity, agreement, text)
    items = benchmark.select("item_id", "text").toArrow()  # max_bytes of texts
    sent = docs.sparkSession.sparkContext.broadcast([(i, (t or "").encode()) for i, t in zip(items.column(0).to_pylist(), items.column(1).to_pylist())])
    built: list[Benchmark] = []

    def run(texts: list[bytes]) -> list[pa.Array]:
        if not built:
            built.append(Benchmark(sent.value, window, similarity))
        return [pa.array(batch_leaks(texts, built[0], agreement), arrow)]

    return appended(docs, [T.StructField("leaks", kind)], run, text)


def _marked_by_join(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float, agreement: float, text: str) -> DataFrame:
    """The same by a shuffled join of the documents' windows with a table of the items' windows."""
    spark = docs.sparkSession
    items = benchmark.where(F.octet_length("text") > 0).groupBy(F.md5(F.col("text").cast("binary")).alias("item")).agg(F.min("text").alias("item_text"), F.collect_list("item_id").alias("ids"))
    items = written(items, "items")

    def windows(batches):
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for form, (hashes, _) in enumerate(item_windows(words_of(t), window)):
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([form] * n, pa.int32()), pa.array(hashes.view(np.int64)), pa.array([n - needed(n, similarity) + 1] * n, pa.int32())], names=["item", "form", "hash", "first"])

    every = written(items.select("item", "item_text").mapInArrow(windows, "item string, form int, hash long, first int"), "item-windows")
    shared = every.groupBy("hash").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item", "form").orderBy("shared", "hash"))
    prefix = written(every.join(shared, "hash").withColumn("rank", rank).where(F.col("rank") <= F.col("first")).select("item", "hash"), "item-prefixes")

    def bits(batches):
        on = np.zeros(FILTER, bool)
        for batch in batches:
            on[_slot(batch.column(0).to_numpy().view(np.uint64))] = True
        for part in np.flatnonzero(on.reshape(-1, _PART).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(on[part * _PART : (part + 1) * _PART]).tobytes()], pa.binary())], names=["part", "bits"])

    def either(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([both.tobytes()], pa.binary())})

    parts = prefix.select("hash").mapInArrow(bits, "part int, bits binary").groupBy("part").applyInArrow(either, "part int, bits binary").toArrow()
    on = np.zeros(FILTER // 8, np.uint8)  # one bit for each hash slot, of a fixed number
    for part, got in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        on[part * _PART // 8 : (part + 1) * _PART // 8] = np.frombuffer(got, np.uint8)
    sent = spark.sparkContext.broadcast(on)

    def ask(batches):
        for batch in batches:
            names, asked = [], []
            for t in utf8(batch.column(0)):
                w = words_of(t)
                hashes = np.concatenate([window_hashes(w.literal, window, 1), window_hashes(w.template, window, 2)[_told(w, window)]])
                slot = _slot(hashes)
                hashes = np.unique(hashes[sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1])
                names += [md5(t).hexdigest()] * len(hashes)
                asked.append(hashes)
            flat = np.concatenate(asked) if asked else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(flat.view(np.int64))], names=["_name", "hash"])

    met = docs.select(text).mapInArrow(ask, "_name string, hash long").join(prefix, "hash").select("_name", "item").distinct()
    # A text holds a candidate's rarest windows, so its own length bounds how many it has.
    candidates = met.join(items, "item").groupBy("_name").agg(F.collect_list(F.struct("item", "item_text", "ids")).alias("_items"))
    name = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    wide, extra = with_extra(docs, name, written(candidates, "item-candidates"), "_name", "_items")
    kind = _leaks_type(benchmark)
    arrow = _arrow_type(kind)
    schema = extended(docs.schema, [T.StructField("leaks", kind)])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            leaks = []
            for t, held in zip(utf8(batch.column(text)), batch.column(extra).to_pylist()):
                held = sorted(held or (), key=lambda x: x["item"])
                found = batch_leaks([t], Benchmark([(x["ids"], x["item_text"].encode()) for x in held], window, similarity), agreement)[0] if held else []
                leaks.append([x | {"item_id": i} for x in found for i in x["item_id"]])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(leaks, arrow)], names=[f.name for f in schema.fields])

    return wide.mapInArrow(run, schema)


#: Bits of the filter that a document's windows pass before they are shuffled (eight megabytes), and of a part of it.
FILTER, _PART = 1 << 26, 1 << 16


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(38)).astype(np.int64)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, coverage, kind): one row for each document and benchmark item it holds."""
    found = marked(docs.select(doc_id, options.get("text", "text")), benchmark, **options)
    return found.select(doc_id, F.explode("leaks").alias("k")).select(doc_id, "k.item_id", "k.coverage", "k.kind")
