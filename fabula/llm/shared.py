"""Tables written between jobs of one operator, in the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Rows with whole texts that a task and its Python worker hand each other at once; Spark's own 10,000 are tens of megabytes.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where none is named, a local session (tests) has a
    folder of its own; on a cluster that is an error, as its machines share no temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="fabula-")
        named = _own[context.applicationId]
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor
    costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as keep them apart from ``columns``."""
    have = {c.lower() for c in columns}
    lead = "_"
    while any(lead + n.lower() in have for n in names):
        lead += "_"
    return [lead + n for n in names]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within it hand rows to Python in batches of ``BATCH_ROWS`` at most; the session's setting is put back."""
    was = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, min(BATCH_ROWS, int(was)) if int(was) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, was)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of ``BATCH_ROWS`` rows at most."""
    for at in range(0, len(batch), BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)
