"""Byte-pair encoding through a tokenization automaton, and decoding by its arc labels.

Compilation. The automaton starts with one state and an arc for each byte back to it. Every merge
(a, b -> c), in order of rank, applies one gadget: the state reached by ``a`` loses its arc ``b`` (the pair
must not stay unmerged), a state for ``c`` is cloned from the state reached by ``b`` as it was before, and
every state that has an arc ``a`` gets an arc ``c``. A merge whose pair no text can produce when its turn comes
(no arc ``b`` is left there, or one half was never made) is dead and applies no gadget. What is left after all
merges accepts exactly the token sequences that the merges can produce, and over a given word exactly one.

Written out, 50,000 clones with thousands of arcs each would take gigabytes. So clones are kept as a
persistent structure: each gadget is three flat array entries (whose arcs it inherits, through which label
it is entered, at which step) plus one removed arc. The transition table (a row for each state: symbol to next
state, or none) is filled as states are met: an arc is resolved once, by walking up the clone chain.

Encoding. Text is split by the vocabulary's pattern (special strings are cut out first), and each distinct
word is read through the table from the start state: arcs are tried from the longest label down, and since a prefix
has only one accepted path, no position is entered twice; time is linear in the word. Texts of Latin-1 characters are
split by the same pattern with its classes spelt out for those characters, which takes a third of the time.

Decoding. The labels of all ids of a batch are gathered into one buffer, cut where each row's ids end.

Defined edge cases: null and empty texts give no ids and decode to an empty text; ids outside the
vocabulary raise; a vocabulary file with settings that are not carried out here (a normalizer, other splits,
word ends, two live merges of one result) raises; repeated rows are harmless; an empty table gives an empty result; a column ``ids``,
``n_tokens`` or ``decoded`` that is there already is replaced.
"""

from __future__ import annotations

import json
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gossamer.llm.common import appended, extended, released

#: Recently read words a worker keeps the ids of (and as many older ones); the transitions it keeps.
WORDS, ARCS = 80_000, 200_000
#: The byte-level vocabularies' pattern, white space being the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: What PATTERN's classes hold among the characters up to U+00FF.
_LETTER, _NUMBER, _SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
#: PATTERN over such characters; the alternatives that come first more often are first, as no text fits two of them.
LATIN_PATTERN = rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Recent(dict):
    """Ids of words as int32 bytes. When it is full it becomes the older half, so words in use stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


#: The start state, and what the table holds where a state has no such arc.
START, NONE = -1, -2


class Automaton:
    """A compiled vocabulary. Symbols are numbered by creation: single bytes, then live merges by rank.

    The state that a symbol leads to has its number.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int], special: dict[str, int]):
        self.special, self.ids = special, ids
        self.labels: list[bytes] = [bytes([b]) for b in range(256)]
        self.entry, self.clone = [-1] * 256, [-1] * 256
        self.removed: dict[int, int] = {}
        number = {label: k for k, label in enumerate(self.labels)}
        for a, b in merges:
            self._gadget(number, a, b)
        self.token = [ids.get(label, -1) for label in self.labels]
        self.number = number
        self.reach: dict[bytes, int] = {}  # the longest label that begins with these four bytes
        for label in self.labels:
            if len(label) > self.reach.get(label[:4], 3):
                self.reach[label[:4]] = len(label)
        self.table: dict[int, dict[int, int]] = {}
        self.entered = 0
        self.words = _Recent(self._word_ids)
        self.split_any, self.split_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        by_id = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in special.items()}
        self.by_id = pa.array([by_id.get(k) for k in range(max(by_id, default=-1) + 1)], pa.binary())

    def _gadget(self, number: dict[bytes, int], a: bytes, b: bytes) -> None:
        x, y = number.get(a), number.get(b)
        if x is None or y is None or not self._resolve(x, y):
            return  # dead
        if a + b in number:
            raise ValueError(f"two merges make {a + b!r}")
        self.removed[x << 20 | y] = len(self.labels) - 256
        number[a + b] = len(self.labels)
        self.labels.append(a + b)
        self.entry.append(x)
        self.clone.append(y)

    def _row(self, state: int) -> dict[int, int]:
        """A state's transitions met so far."""
        if self.entered > ARCS:
            self.table.clear()
            self.entered = 0
        return self.table.setdefault(state, {})

    def _enter(self, row: dict[int, int], state: int, symbol: int) -> int:
        """Fill in one transition; from the start every live symbol can be read."""
        row[symbol] = to = symbol if state == START or self._resolve(state, symbol) else NONE
        self.entered += 1
        return to

    def _resolve(self, x: int, y: int) -> bool:
        """Whether the state reached by symbol x has an arc y after the merges applied so far."""
        removed, entry, clone = self.removed, self.entry, self.clone
        until = len(self.labels)  # steps that count
        while True:
            if removed.get(x << 20 | y, until) < until:
                return False
            if x < 256 and y < 256:
                return True
            if y > x:  # arc y came with its gadget, wherever its first half had an arc after that removal
                until, y = y - 255, entry[y]
            elif x > y:  # state x was cloned before the removal of its own gadget
                until, x = x - 256, clone[x]
            else:
                until, x, y = x - 256, clone[x], entry[x]

    def encode_word(self, word: bytes) -> list[int]:
        """The symbols on the accepted path of a word."""
        n, number, reach = len(word), self.number, self.reach
        path: list[int] = []
        left: set[int] = set()  # places entered and left again: no path goes on from there
        pos, state, end = 0, START, reach.get(word[:4], 3)
        row = self._row(START)
        if end > n:
            end = n
        while pos < n:
            while end > pos:
                symbol = number.get(word[pos:end])
                if symbol is not None and end not in left:
                    to = row.get(symbol)
                    if to is None:
                        to = self._enter(row, state, symbol)
                    if to != NONE:
                        break
                end -= 1
            else:
                left.add(pos)
                end = pos - 1
                pos -= len(self.labels[path.pop()])
                state = path[-1] if path else START
                row = self._row(state)
                continue
            path.append(to)
            pos, state, row = end, to, self._row(to)
            end += reach.get(word[pos : pos + 4], 3)
            if end > n:
                end = n
        return path

    def _word_ids(self, word: str) -> bytes:
        if word in self.special:
            return struct.pack("=i", self.special[word])
        token = self.token
        found = [token[s] for s in self.encode_word(word.encode())]
        if -1 in found:
            raise ValueError(f"the vocabulary has no id for a part of {word!r}")
        return struct.pack(f"={len(found)}i", *found)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-split words; special strings come as they are."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.special else self.split(part)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        return b"".join(map(self.words.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_rows(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The texts of rows of ids; row k has the ids from ends[k] to ends[k + 1]."""
        labels = self.by_id.take(ids)
        if labels.null_count:
            raise ValueError("an id that the vocabulary does not have")
        at = np.frombuffer(labels.buffers()[1], np.int32)[labels.offset :][ends] if len(labels) else np.zeros(len(ends), np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), labels.buffers()[2]])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:  # ids may cut a character
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())

    def decode(self, ids) -> bytes:
        return b"".join(self.by_id.take(pa.array(ids, pa.int32())).to_pylist())


def read_vocabulary(path: str) -> dict:
    """Merges, ids and special strings of a byte-level BPE file in the tokenizers library's format.

    A file that asks for anything else raises.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, part = data["model"], data.get("pre_tokenizer") or {}
    other = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    other += [f"model {model.get('type')}"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * bool(data.get("normalizer"))
    if part.get("type") != "ByteLevel" or part.get("add_prefix_space") or not part.get("use_regex", True):
        other.append("pre_tokenizer")
    other += [f"added token {t['content']!r}" for t in data["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if other:
        raise ValueError(f"{path} has settings that are not supported: {', '.join(other)}")
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"merges": [(raw(a), raw(b)) for a, b in merges], "ids": {raw(t): k for t, k in model["vocab"].items() if t not in special}, "special": special}


_COMPILED: dict[str, Automaton] = {}


def compiled(sent) -> Automaton:
    """This worker's automaton of a broadcast vocabulary."""
    key, parts = sent.value
    if key not in _COMPILED:
        _COMPILED.clear()
        released()
        _COMPILED[key] = Automaton(**parts)
    return _COMPILED[key]


class Vocabulary:
    """A vocabulary on the driver, sent to the executors once (its size is the file's, not the data's)."""

    def __init__(self, spark, path: str):
        self.sent = spark.sparkContext.broadcast((uuid.uuid4().hex, read_vocabulary(path)))


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with the columns ids and n_tokens, and with ``decode`` also decoded, from the ids.

    Decoding in the same pass takes one Python worker a task where two operators in a row take two.
    """
    sent = vocabulary.sent
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("decoded", T.StringType())] * decode

    def run(texts: list[bytes]) -> list[pa.Array]:
        a = compiled(sent)
        rows = [a.encode_bytes(t.decode("utf-8", "replace")) for t in texts]
        n = np.array([len(r) // 4 for r in rows], np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
        out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(n)]
        return [*out, a.decode_rows(flat, ends)] if decode else out

    return appended(docs, new, run, text)


def decoded(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``docs`` with the column decoded: the text its ids stand for."""
    sent = vocabulary.sent
    schema = extended(docs.schema, [T.StructField("decoded", T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            rows = batch.column(ids)
            ends = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy())])
            texts = compiled(sent).decode_rows(rows.flatten(), ends)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [texts], names=[*keep, "decoded"])

    return docs.mapInArrow(run, schema)
