"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters the contracts count as white space: U+0020 and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"

_RUN = uuid.uuid4().hex
_WRITTEN: list[str] = []
#: With this, the shuffles of a query are deleted when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes handed to a Python worker at once; a single larger row comes alone.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch to these; smaller settings stay.

    Spark has no setting for one query, and plans read it when they run, so it is not put back.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def released() -> None:
    """Hand memory that this worker has freed back to the system: one worker serves all stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster's own ``spark.checkpoint.dir`` is read first. Where it is unset, a local
    session gets a folder of its own and any other one a folder inside the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local")
        base = "/tmp/checkpoints/gossamer" if local else spark.conf.get("spark.sql.warehouse.dir") + "/_gossamer"
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, deletes its shuffles."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/gossamer-{_RUN}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once all that was made of them is written too."""
    for df in tables:
        if df._written_to in _WRITTEN:
            _WRITTEN.remove(df._written_to)
            _delete(df.sparkSession, df._written_to)


def n_written() -> int:
    """How many intermediate tables there are; see ``dropped_since``."""
    return len(_WRITTEN)


def dropped_since(spark: SparkSession, first: int, keep: DataFrame) -> None:
    """Delete the intermediate tables after the first ``first`` ones, but for ``keep``."""
    for path in _WRITTEN[first:]:
        if path != keep._written_to:
            _delete(spark, path)
    _WRITTEN[first:] = [keep._written_to]


def clear_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process once their results have been consumed."""
    _WRITTEN.clear()
    _delete(spark, f"{shared_dir(spark)}/gossamer-{_RUN}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def extended(schema: T.StructType, new: list[T.StructField], dropped: tuple[str, ...] = ()) -> T.StructType:
    """``schema`` with the fields of ``new`` at its end; columns of those names make way for them."""
    gone = {f.name.lower() for f in new} | {x.lower() for x in dropped}
    return T.StructType([f for f in schema.fields if f.name.lower() not in gone] + new)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def with_extra(df: DataFrame, key: Column, found: DataFrame, on: str, column: str) -> tuple[DataFrame, str]:
    """``df`` left joined by its ``key`` to ``found``'s ``on``, with its ``column`` under a name that clashes with none."""
    key_name, name = fresh(df, on), fresh(df, column)
    found = found.select(F.col(on).alias(key_name), F.col(column).alias(name))
    return df.withColumn(key_name, key).join(found, key_name, "left").drop(key_name), name


def appended(df: DataFrame, new: list[T.StructField], make, text: str = "text", dropped: tuple[str, ...] = ()) -> DataFrame:
    """Append columns that ``make(list of UTF-8 texts) -> list of arrow arrays`` computes batch by batch."""
    small_batches(df.sparkSession)
    schema = extended(df.schema, new, dropped)
    keep = [f.name for f in schema.fields[: len(schema.fields) - len(new)]]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = make(utf8(batch.column(text)))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, names=names)
                del batch, columns
        released()

    return df.mapInArrow(run, schema)


def crc_bucket(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def rows_of(*arrays: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)
