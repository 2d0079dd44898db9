import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import quality as Q
from gossamer.llm import queries as R
from gossamer.llm import toxicity as X
from gossamer.llm.common import crc_bucket
from gossamer.llm.labelled import held_out


def test_gradients_match_differences():
    net = X.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    at = np.where(np.arange(X.WINDOW) < np.array([[40], [9], [0]]), np.arange(X.WINDOW) + np.array([[0], [5], [0]]), -1)
    v = np.concatenate([r.standard_normal((45, X.INPUT)), np.zeros((1, X.INPUT))])
    y = np.array([1.0, 0.0, 1.0])
    net.forward = X.Network.forward.__get__(net)
    g, dv, _ = net.gradients(v, at, y)
    loss = lambda: net.gradients(v, at, y)[2]
    for name in ("hf", "hb", "xf", "xb", "cf", "cb", "att", "att_v", "out", "bias"):
        for k in (0, net.p[name].size - 1):
            at_k = np.unravel_index(k, net.p[name].shape)
            old = net.p[name][at_k]
            net.p[name][at_k] = old + 1e-2
            up = loss()
            net.p[name][at_k] = old - 1e-2
            down = loss()
            net.p[name][at_k] = old
            assert abs((up - down) / 2e-2 - g[name][at_k]) < 2e-3, name


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        w = X.windows(n)
        assert set(w.ravel()) - {-1} == set(range(n)) and (len(w) == 1 or (w >= 0).any(axis=1).all())


def test_scores_do_not_depend_on_the_batch():
    net = X.Network(1)
    texts = [b"", b"one", b"a 1b2 c" * 50, b"word " * 3000, b"x", "é ß 東京".encode()]
    together = net.score(texts)
    alone = np.concatenate([net.score([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()


def test_learns_marked_words():
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    make = lambda bad: " ".join([*r.choice(words, 60), *["nasty" + str(r.integers(99))] * bad, *r.choice(words, 60)]).encode()
    texts = [make(k % 2) for k in range(400)]
    net = X.fit(texts[:300], np.array([k % 2 for k in range(300)], float), 0.5)
    got = net.score(texts[300:]) >= 0.5
    assert (got == np.array([k % 2 == 1 for k in range(100)])).mean() > 0.95


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.random((2000, len(Q.FEATURES))).astype(np.float32)
    y = ((x[:, 3] > 0.6) ^ (x[:, 7] > 0.5)).astype(float)
    m = Q.Trees.fit(x[:1500], y[:1500], np.ones(1500))
    s = m.score(x[1500:])
    assert ((s >= 0.5) == y[1500:]).mean() > 0.95
    one = m.base
    for t in range(len(m.feature)):
        k = 0
        for _ in range(Q.LEVELS):
            k = 2 * k + 1 + int(x[1500, m.feature[t, k]] > m.threshold[t, k])
        one += m.value[t, k - (2**Q.LEVELS - 1)]
    assert abs(1 / (1 + np.exp(-one)) - s[0]) < 1e-6
    assert Q.Trees.fit(x[:0], y[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_statistics_of_odd_texts():
    for t in (b"", b" ", b"\n\n", b"a", b"\xff" * 9, b"x" * 500_000):
        assert np.isfinite(Q.statistics(t)).all()


@pytest.mark.parametrize("name,label,threshold,least", [("op6_quality", "quality", 0.3, 0.9), ("op4_toxicity", "toxic", 0.5, 0.85)])
def test_queries_on_held_out_rows(spark, name, label, threshold, least):
    d = "/root/testdata/sf0.01"
    rows = R.QUERIES[name](spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas()
    assert len(rows) == len(docs) and rows.score.between(0, 1).all()
    assert (rows.held_out == [crc_bucket(i, 5) == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= threshold)).all()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    got = rows[rows.held_out].merge(labels, on="doc_id")
    assert (got.predicted == got[label]).mean() >= least


def test_without_labels_and_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs([None, "", "some text"])
    assert {r.score for r in Q.scored(d, Q.train(d, none)).collect()} == {0.5}
    assert {r.score for r in X.scored(d, X.train(d, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert X.scored(docs([]), X.train(d, one)).count() == 0 == Q.scored(docs([]), Q.train(d, one)).count()


def _tables(spark, docs, n=120):
    """Documents with marked bad ones, and labels of both kinds for them."""
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*r.choice(words, 40), *["nasty"] * (k % 3 == 0), "!!!" * (k % 2)]) for k in range(n)]
    return docs(texts), spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(Q, "quality"), (X, "toxic")])
def test_held_out_labels_are_not_used(spark, docs, module, label):
    d, labels = _tables(spark, docs)
    other = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    assert labels.exceptAll(other).count() > 10
    one, two = ({r.doc_id: r.score for r in module.scored(d, module.train(d, x)).collect()} for x in (labels, other))
    assert one == two


@pytest.mark.parametrize("module", [Q, X])
def test_repeated_rows_and_clashing_columns(spark, docs, module):
    d, labels = _tables(spark, docs, 40)
    d = d.union(d.limit(7)).union(docs(["other text of the same id"], [1])).withColumn("Score", F.lit("x"))
    out = module.scored(d, module.train(d, labels)).collect()
    assert len(out) == 48 and len({(r.doc_id, r.score) for r in out}) == 41
    assert module.scored(d, module.train(d, labels)).schema["score"].dataType.simpleString() == "double"


def test_excerpts_come_from_all_over():
    text = b" ".join(b"w%d" % k for k in range(30_000))
    cut = X.excerpt(text)
    assert len(cut) <= X.EXCERPT and X.excerpt(text) == cut and X.excerpt(text[:99]) == text[:99]
    places = [int(w[1:]) for w in cut.split()]
    assert min(places) < 6000 and max(places) > 24_000 and set(cut.split()) <= set(text.split())
    assert len(X.excerpt(b"x" * 10**6)) <= X.EXCERPT + 12


def test_very_long_text_scores_like_its_windows():
    net = X.Network(2)
    text = b" ".join(b"%d" % (k % 977) for k in range(200_000)).translate(bytes.maketrans(b"0123456789", b"abcdefghij"))
    start, end, bucket, low, grids = X.laid_out([text])
    logits = net.window_logits(start, end, bucket, low, grids[0])
    few = X.laid_out([b" ".join(text.split()[32_000:32_032])])
    assert abs(logits[2000] - net.window_logits(*few[:4], few[4][0])[0]) < 1e-4
    assert len(logits) == len(X.windows(200_000)) and np.isfinite(net.score([text])).all()
