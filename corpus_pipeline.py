"""The corpus pipeline: from raw documents to encoded training text.

Each stage takes the documents that its predecessor kept and returns those it keeps, with the columns of
``documents`` (n_chars follows the text); the last adds the token ids. Stages are written as Parquet in
the shared folder and read again, so a lost executor costs at most a stage. What a stage wrote in between is
deleted once its result is written.

In every stage a null text counts as an empty one, texts of any length are taken whole, other columns of any name
pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import bpe, decontaminate, line_dedup, quality, simhash
from gossamer.llm.common import dropped_since, fresh, n_written, table, written
from gossamer.llm.queries import VOCABULARY

#: Scores under this are rejected.
QUALITY_FLOOR = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Equal texts fare alike, repeated rows and rows without an id included; an empty text is scored like any other;
    without labels nothing is rejected.
    """
    score = fresh(docs, "_score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, column=score).where(F.col(score) >= QUALITY_FLOOR).select(docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines found in ten documents or more; no document goes.

    A null text comes back empty, a text of such lines alone too; repeated rows count as documents of their own.
    n_chars is set anew where there is such a column.
    """
    out = line_dedup.drop_frequent_lines(docs, min_docs=10)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keep the document with the smallest id.

    Near duplicates have SimHash fingerprints within two bits, or a similarity of 0.8 or more in the exact check that
    follows. Texts without words are alike by both, so one of them stays. Rows that repeat an id stay or go together,
    and rows without an id stay.
    """
    groups = simhash.near_copies(docs, shingle=5)
    copies = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, literally or with other numbers, names and units.

    Items without text or of fewer than five words drop nothing, an empty text stays, repeated rows fare alike.
    """
    plain = docs.withColumnRenamed("leaks", kept := fresh(docs, "_kept")) if "leaks" in docs.columns else docs
    out = decontaminate.marked(plain, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0)
    return (out.drop("leaks").withColumnRenamed(kept, "leaks") if "leaks" in docs.columns else out).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document, empty ones and repeated rows included.

    Ids that do not decode to the text they came from stop the run.
    """
    out = bpe.encoded(docs, bpe.Vocabulary(spark, VOCABULARY), decode=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    checked = F.when(same, F.col("n_tokens")).otherwise(F.raise_error(F.lit("token ids that decode to another text")).cast("long"))
    return out.select("doc_id", "lang", "source", checked.alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_common_lines),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express trained trees, fingerprints or merges; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = n_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        dropped_since(spark, first, keep=docs)
    return docs
