"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import bounded_batches, cut, shared_folder
from ..functions.shipping import ship

__all__ = ["cut", "forget", "frugal", "give_back", "id_text", "left_behind", "pooled", "read_table", "set_aside", "ship", "slices", "strings", "text_buffer", "written"]


#: What the operators' tasks leave in a Python worker for later ones, which saves them time only.
_left: list[tuple[str, dict]] = []

#: Hands freed pages back to the system; glibc has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def left_behind(cache: dict, owner: str = "") -> dict:
    """``cache``, which ``forget`` empties, but for tasks of its owner."""
    _left.append((owner, cache))
    return cache


def forget(but: str | None = None) -> None:
    """Frees what tasks of other operators left in this Python worker, all but the caches of owner ``but``."""
    had = False
    for owner, cache in _left:
        if owner != but and cache:
            cache.clear()
            had = True
    if had:
        give_back()


def give_back() -> None:
    """Returns memory that is free to the system, which the allocators of C and of Arrow would keep in this process."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a Python worker, which outlives it: nothing of other operators stays in it before, no free memory after.

    Idle workers count towards an executor's memory as busy ones do.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from run(batches)
        give_back()

    return task


def pooled(df: DataFrame) -> DataFrame:
    """``df`` of short rows, in no more partitions than tasks run at once.

    Every file that an executor writes to a local folder costs it two processes
    (``chmod`` for the file and its checksum), so tables of ids are not cut into
    a file for each shuffle partition.
    """
    return df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, null text as empty.

    Every other column of the input is ignored, so extra columns with
    clashing names can't reach an operator.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``own`` under names that clash with none of an operator's, and what brings the old names back."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in own}
    return docs.toDF(*[names.get(c, c) for c in docs.columns]), {new: old for old, new in names.items()}


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet: smaller than a checkpoint for wide or many rows.

    The folder lies in the shared checkpoint folder under a fresh name, and
    goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"orelode-{uuid.uuid4().hex}")
    with bounded_batches(spark):
        df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about ``most`` text bytes, one row at least, to bound the memory of vector work."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
