"""Probing shards of a structure that is too large to broadcast.

A shard is a blob that holds a part of the structure; a probe is a packed record of rows meant for one shard.
Both are shuffled to the shard's partition, where the blob comes first: one shard is open at a time and its probes
stream past it, so memory is bounded by a shard and a batch. A shard that is asked for more than ``SHARE`` bytes of
probes is copied to as many partitions as that takes, so no shard is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import written

#: Probes that one partition answers, bytes; rows of a packed record.
SHARE, RECORD = 64 << 20, 1 << 13


def packed(shard: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, data): the rows of a structured array, by the shard each is meant for."""
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1]]))
    ends = np.append(cuts[1:], len(shard))
    spans = [(k, min(k + RECORD, b)) for a, b in zip(cuts.tolist(), ends.tolist()) for k in range(a, b, RECORD)]
    for k in range(0, len(spans), 256):
        part = spans[k : k + 256]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in part], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in part], pa.binary())], names=["shard", "data"])


def answered(shards: DataFrame, probes: DataFrame, kind: np.dtype, open_: Callable, answer: Callable, schema: str) -> DataFrame:
    """What ``answer(open_(blob), rows of a record)`` gives (a record batch of ``schema``) for every record.

    ``shards`` has (shard int, blob), ``probes`` (shard int, data) as ``packed`` makes them. A record whose shard
    has no blob gets no answer.
    """
    probes = written(probes, "probes")
    load = probes.groupBy("shard").agg(F.ceil(F.sum(F.length("data")) / F.lit(SHARE)).cast("int").alias("copies"))
    load = written(load, "probe-loads")
    parts = max(1, load.agg(F.sum("copies")).first()[0] or 0)
    none = F.lit(None).cast("binary")
    blobs = shards.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "blob", none.alias("data"))
    asked = probes.join(load, "shard").select("shard", F.pmod(F.xxhash64("data"), F.col("copies")).cast("int").alias("copy"), none.alias("blob"), "data")
    both = blobs.unionByName(asked).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, -1
        for batch in batches:
            blobs, records = batch.column("blob"), batch.column("data")
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                if (blob := blobs[k].as_py()) is not None:
                    held, of = open_(blob), shard
                elif shard == of:
                    yield answer(held, np.frombuffer(records[k].as_py(), kind))

    return both.select("shard", "blob", "data").mapInArrow(run, schema)
