"""Sums over a document's distinct keys of values that a table holds by key.

Keys are 128-bit hashes in two longs, so that distinct strings keep distinct keys at any corpus size. They are
split by how often the whole corpus uses them. The ``HEAD`` most used ones (a fixed number, so their broadcast
has a fixed size) are added up where the document is read. The rest are shuffled to the table: no such key can be
hot, because ``HEAD`` keys are used more often than it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose values every executor holds: 24 bytes each.
HEAD = 1 << 17

_TAIL = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("times", pa.int32())])

#: What a document scan adds for ``tail_hits``: the row's number, and the keys the head doesn't have.
TAIL_FIELDS = [
    T.StructField("_row", T.LongType()),
    T.StructField("_tail", T.ArrayType(T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("times", T.IntegerType())]))),
]


def digest(word: bytes | str) -> bytes:
    return xxhash.xxh3_128_digest(word)


def halves(digests: Iterable[bytes]) -> np.ndarray:
    """(n, 2) longs of 16-byte digests."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


class Head:
    """The most used keys with their values. Of keys that share a first half, none is taken."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, values: np.ndarray):
        order = np.argsort(k1, kind="stable")
        k1, k2, values = k1[order], k2[order], values[order]
        once = np.ones(len(k1), bool)
        once[1:] &= k1[1:] != k1[:-1]
        once[:-1] &= k1[:-1] != k1[1:]
        self.k1, self.k2, self.values = k1[once], k2[once], values[once]

    @classmethod
    def of(cls, table: DataFrame, value: str, used: str, size: int | None = None) -> Head:
        rows = table.orderBy(F.desc(used), "k1", "k2").limit(size or HEAD).select("k1", "k2", value).toArrow()
        return cls(*(rows.column(k).to_numpy() for k in range(3)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key its place, and whether it is there."""
        if not len(self.k1):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.k1, keys[:, 0]), len(self.k1) - 1)
        return at, (self.k1[at] == keys[:, 0]) & (self.k2[at] == keys[:, 1])


class RowNumbers:
    """Numbers that no other row of a table has: the task's partition, then a count. For tables that are written,
    since only one attempt of a task is kept then."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 40

    def take(self, n: int) -> pa.Array:
        self.next += n
        return pa.array(np.arange(self.next - n, self.next))


def tail_column(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """The second of TAIL_FIELDS from each row's keys and how often it has them."""
    ends = np.cumsum([0] + [len(k) for k, _ in rows])
    keys = np.concatenate([k for k, _ in rows]) if rows else np.zeros((0, 2), np.int64)
    times = np.concatenate([t for _, t in rows]) if rows else np.zeros(0, np.int32)
    parts = [pa.array(keys[:, 0], pa.int64()), pa.array(keys[:, 1], pa.int64()), pa.array(times, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_TAIL)))


def tail_hits(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(_row, times, the table's other columns) of each tail key of ``rows`` (written, with TAIL_FIELDS) in the table."""
    flat = rows.select("_row", F.explode("_tail").alias("t")).select("_row", "t.k1", "t.k2", "t.times")
    return flat.join(table, ["k1", "k2"]).drop("k1", "k2")
