"""Token counts without token ids.

The corpus's distinct pre-tokens are counted once with their frequency (one scan, one shuffle), and the
pieces of each distinct pre-token are counted once. A second scan takes each document's pre-token
frequencies and joins them to those counts (see ``lookup``); a document's count is the sum of frequency
times pieces.

Defined edge cases: null and empty texts have no tokens; special strings inside a text count as one token
each; repeated rows are counted one by one; an empty table gives an empty result; only the id and the
text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.llm import lookup
from gossamer.llm.bpe import Vocabulary, compiled
from gossamer.llm.common import extended, utf8, written

#: Entries of a task's counting table before it is handed on.
FLUSH = 400_000


def pre_token_pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(k1, k2, used, pieces) of every distinct pre-token: a hash of it, its uses, its token count."""
    sent = vocabulary.sent

    def count(batches):
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "used"])

        for batch in batches:
            pieces = compiled(sent).pieces
            for t in utf8(batch.column(0)):
                seen.update(pieces(t.decode("utf-8", "replace")))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    def cost(batches):
        for batch in batches:
            a = compiled(sent)
            words = batch.column(0).to_pylist()
            n = [1 if w in a.special else len(a.encode_word(w.encode())) for w in words]
            keys = lookup.halves(map(lookup.digest, words))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(1), pa.array(n, pa.int64())], names=["k1", "k2", "used", "pieces"])

    words = docs.select(text).mapInArrow(count, "word string, used long").groupBy("word").agg(F.sum("used").alias("used"))
    return words.mapInArrow(cost, "k1 long, k2 long, used long, pieces long")


def token_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    sent = vocabulary.sent
    table = written(pre_token_pieces(docs, vocabulary, text), "pieces")
    head = docs.sparkSession.sparkContext.broadcast(lookup.Head.of(table, "pieces", "used"))
    schema = extended(docs.select(doc_id).schema, [T.StructField("n_bytes", T.LongType()), T.StructField("near", T.LongType()), *lookup.TAIL_FIELDS])

    def scan(batches):
        known: dict[str, bytes] = {}
        numbers = lookup.RowNumbers()
        for batch in batches:
            pieces, top = compiled(sent).pieces, head.value
            size, near, tails = [], [], []
            for t in utf8(batch.column(1)):
                freq = Counter(pieces(t.decode("utf-8", "replace")))
                fresh = [w for w in freq if w not in known]
                if len(known) > FLUSH:
                    known.clear()
                    fresh = list(freq)
                known.update(zip(fresh, map(lookup.digest, fresh)))
                k = lookup.halves(map(known.__getitem__, freq))
                n = np.fromiter(freq.values(), np.int64, len(freq))
                at, there = top.find(k)
                size.append(len(t))
                near.append(int((top.values[at[there]] * n[there]).sum()) if there.any() else 0)
                tails.append((k[~there], n[~there].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(near, pa.int64()), numbers.take(len(size)), lookup.tail_column(tails)], names=schema.names)

    rows = written(docs.select(doc_id, text).mapInArrow(scan, schema), "frequencies")
    far = lookup.tail_hits(rows, table.select("k1", "k2", "pieces")).groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("far"))
    out = rows.drop("_tail").join(far, "_row", "left")
    return out.select(doc_id, "n_bytes", (F.col("near") + F.coalesce("far", F.lit(0))).alias("n_tokens"))
