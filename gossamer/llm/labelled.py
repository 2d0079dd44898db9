"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) that is held out, and its modulus.
HELD_OUT, FOLDS = 0, 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): the rows that may be learnt from.

    Rows held out or without an id or label are left out; a row labelled twice counts once, with the larger label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg((F.max(label) >= 1).cast("int").alias("label"))


def share(labels: DataFrame, label: str) -> float:
    """Label 1's share of the rows that may be learnt from; one half without any."""
    ones, rows = learnable(labels, label).agg(F.sum("label"), F.count("*")).first()
    return ones / rows if rows else 0.5


def sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label): of each class up to ``per_class`` rows that may be learnt from, by a hash of the id."""
    usable = learnable(labels, label)
    pick = lambda k: usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return pick(0).unionByName(pick(1))
