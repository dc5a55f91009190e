"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker, about; one row at least.
BATCH = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that the session names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a folder of its own; any other has
    executors that would not see it, so that is a ``ValueError``.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orelode-checkpoint-")
    sc.setCheckpointDir(named)
    return named


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def planned_as_dealt(spark: SparkSession) -> AbstractContextManager[None]:
    """Plans made within keep their hash partitioning known: an adaptive plan's result counts as dealt anyhow."""
    return _setting(spark, "spark.sql.adaptive.enabled", "false")


def bounded_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs run within send batches of about BATCH bytes to Python workers.

    Spark's own bounds, 10,000 rows and 64 MB, let a batch of texts take tens of
    MB, which each task holds both in the executor's direct memory and in its
    worker.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """The rows of ``df``, computed once and read back from the shared folder.

    With ``dealt`` their partitioning is kept, so joins on the same key need no
    new shuffle.
    """
    shared_folder(df.sparkSession)
    with bounded_batches(df.sparkSession), planned_as_dealt(df.sparkSession) if dealt else nullcontext():
        return df.checkpoint(eager=True)
