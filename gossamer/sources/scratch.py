"""Intermediate tables of the graph engine, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
#: With this, the shuffles of a query are deleted when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; unset, a folder in the warehouse (a local session: of its own)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "/tmp/checkpoints/gossamer" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_gossamer"
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graphs-{_RUN}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: its lineage is cut, lost executors cost nothing, and its shuffles are deleted."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def still_there(*tables: DataFrame) -> bool:
    """Whether tables that ``written`` returned have not been deleted since."""
    spark = tables[0].sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(t._written_to + "/_SUCCESS") for t in tables]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
