import numpy as np
import pytest

from gossamer.llm import line_dedup as L
from gossamer.llm import routed

EDGE = [None, "", "a\nA \nb", "\x0ba\r\nrare", "a", "x" * 300_000 + "\na", "B\n\n\nc", "a", "ab", "ÀB\n"]


def brute(texts, min_docs, min_chars):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(strip).translate(low) for x in doc] for doc in lines]
    often = {}
    for doc in keys:
        for k in set(doc):
            often[k] = often.get(k, 0) + 1
    bad = {k for k, n in often.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(doc), sum(k in bad for k in ks), "\n".join(x for x, k in zip(doc, ks) if k not in bad)) for doc, ks in zip(lines, keys)]


@pytest.mark.parametrize("head", [L.HEAD, 1, 0])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (4, 1), (2, 2)])
def test_matches_brute_force(docs, min_docs, min_chars, head, monkeypatch):
    monkeypatch.setattr(routed, "SHARE", 40)  # shards are copied
    monkeypatch.setattr(routed, "RECORD", 2)
    out = L.drop_frequent_lines(docs(EDGE), min_docs, min_chars, head=head, shard_keys=1).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in out] == brute(EDGE, min_docs, min_chars)
    assert out[0].lang == "en"


def test_empty_table_and_clashing_columns(docs, spark):
    assert L.drop_frequent_lines(docs([]), 2).count() == 0
    d = spark.createDataFrame([(1, "a", "x"), (1, "a", "y")], "doc_id long, text string, n_lines string")
    rows = L.drop_frequent_lines(d, 2).collect()
    assert [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows] == [(1, "", 1, 1)] * 2
    more = d.selectExpr("*", "1 AS _name", "2 AS _BAD")
    assert sorted(r[:4] for r in L.drop_frequent_lines(more, 2, head=0).drop("_name", "_BAD").collect()) == sorted(r[:] for r in rows)


def test_whole_documents_through_the_shards(spark):
    """All of sf0.01 gives the same rows whether the arrays are sent or probed in their shards."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a, b = ({r.doc_id: r[1:] for r in L.drop_frequent_lines(d, 10, head=h, shard_keys=50).collect()} for h in (L.HEAD, 20))
    assert a == b and sum(x[2] for x in a.values()) > 100


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert sorted(L.PerfectHash.build(keys).slots(keys)) == list(range(5000))


def test_index_tells_members_from_strangers():
    r = np.random.default_rng(2)
    h1, h2 = (r.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(2))
    h1[1] = h1[0]
    parts = {k: L.pack_shard(h1[m], h2[m], np.arange(3000)[m] + 1) for k in range(4) if (m := h1 % np.uint64(4) == k).any()}
    index = L.LineIndex(parts, 4)
    assert (index.counts(h1, h2) == np.arange(3000) + 1).all()
    assert (index.counts(h1, h2 + np.uint64(1)) == 0).all()
