"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of working columns, so that columns of the input can have any other name.
OWN = "__fm_"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else, whatever the locale."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="fieldmill-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def working_partitions(df: DataFrame) -> int:
    """As many partitions as the session gives a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count_of(spans: str, field: str, kind: str) -> Column:
    """How many of an array of structs have ``kind`` in ``field``, as n_<kind>."""
    return F.size(F.filter(spans, lambda s: s[field] == kind)).cast("long").alias(f"n_{kind}")


def text_offsets(col: pa.Array) -> np.ndarray:
    """Where each text begins in the data of an Arrow column, and the end of the last one; of either width."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]


def release_memory() -> None:
    """Gives freed memory back to the system. Arrow's pool and the C library keep it otherwise, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have no such call
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, that gives freed memory back after each batch and at its end: workers wait beside the executor's next stages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            release_memory()

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            release_memory()

    return run_and_release


def blocks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column``, where nulls are empty; a row is never cut."""
    at = batch.schema.get_field_index(column)
    col = batch.column(at)
    offsets = text_offsets(col)
    start = 0
    while start < len(col):
        stop = int(np.searchsorted(offsets, int(offsets[start]) + limit, side="right"))
        stop = min(max(stop - 1, start + 1), len(col))
        block = batch.slice(start, stop - start)
        yield block.set_column(at, column, block.column(at).fill_null("")) if block.column(at).null_count else block
        start = stop
