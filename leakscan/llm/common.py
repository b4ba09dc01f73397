"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is the empty text."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each, and one row at least."""
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    for row, length in enumerate(lengths):
        if row > start and size + length > limit:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length
    if batch.num_rows > start:
        yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


Batches = Iterator[pa.RecordBatch]


_settled: list[bool] = []


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; at its end the worker, which is kept for later tasks, returns memory that it has freed to the system."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        if not _settled:  # what modules hold stays; later collections need not look at it again
            gc.freeze()
            _settled.append(True)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return wrapped
