import pytest

import corpus_pipeline as P
from gossamer.llm import decontaminate as D
from gossamer.llm import quality as Q
from gossamer.llm import queries as R
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_similar


def test_rows_match_brute_force(spark, sf):
    """Each stage against a plain version of its rule, the classifier's model being the stage's own."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    left = [(i, t) for i, t in left if model.score(Q.statistics((t or "").encode())[None])[0] >= P.QUALITY_FLOOR]
    left = [(i, kept) for (i, _), (_, _, kept) in zip(left, brute_lines([t for _, t in left], 10, 1))]
    first = brute_similar([t for _, t in left])
    left = [row for k, row in enumerate(left) if first[k] == k]
    items = [b" ".join(D.lower(r.text.encode()).split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not any(x in b" ".join(D.lower(t.encode()).split()) for x in items)]
    library = Tokenizer.from_file(R.VOCABULARY)
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in left]
    assert sorted((r.doc_id, r.ids) for r in P.run(spark, sf).collect()) == want
    assert 100 < len(want) < docs.count()


def run_on(spark, tmp_path, docs, labels=(), bench=()):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return P.run(spark, str(tmp_path))


def test_odd_documents(spark, docs, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and other columns pass every stage."""
    item = "one question that a benchmark asks in some ten words or more"
    long = " ".join(f"w{k}" for k in range(200_000))
    d = docs([None, "", " ", long, "a b c", "a b c", f"before {item} after", "x\nline\ny"], [0, 1, 2, 3, 4, 4, 6, 7])
    d = d.selectExpr("*", "7 AS n_tokens", "'q' AS ids", "1.0 AS _score", "'k' AS leaks", "9 AS component_id").union(d.selectExpr("NULL", "'no id'", "lang", "source", "n_chars", "7", "'q'", "1.0", "'k'", "9").limit(1))
    rows = sorted((r.doc_id is not None, r.doc_id, r.n_tokens) for r in run_on(spark, tmp_path, d, bench=[(1, item), (2, None)]).collect())
    # 0 stands for the texts without words; the repeated row 4 has one id and stays as it is
    assert [(i, n > 0) for _, i, n in rows] == [(None, True), (0, False), (3, True), (4, True), (4, True), (7, True)]


def test_empty_tables(spark, docs, tmp_path):
    assert run_on(spark, tmp_path, docs([])).count() == 0


def test_stages_keep_the_columns_and_leave_one_table(spark, docs, tmp_path):
    from gossamer.llm.common import n_written

    d = docs(["some text of its own"]).drop("n_chars")
    for name, stage in P.STAGES[:-1]:
        if name != "benchmark decontamination":
            d2 = stage(spark, d, "/root/testdata/sf0.001")
            assert d2.columns == d.columns, name
    before = n_written()
    run_on(spark, tmp_path, docs(["one", "two"]))
    assert n_written() == before + 1


def test_ids_that_decode_to_another_text_stop_the_run(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    whole = P.bpe.encoded
    monkeypatch.setattr(P.bpe, "encoded", lambda *a, **k: whole(*a, **k).withColumn("decoded", F.lit("else")))
    with pytest.raises(Exception, match="decode to another text"):
        P.encode(spark, docs(["a"]), "").collect()
