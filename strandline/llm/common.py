"""What the training-data operators share: folds, samples, numbering of rows; and the written tables of the engine."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.staging import scratch_path, written

__all__ = ["blocks", "byte_texts", "fold", "least_hashed", "scratch_path", "task_numbers", "texts_of", "written"]

#: The word separators of every contract here: space and the ASCII controls from tab to carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that others can't clash. A null text is an empty one."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), *more)


def least_hashed(rows: DataFrame, group: str, most: int) -> DataFrame:
    """doc_id, text_hash, group of a sample of the rows' distinct keys: of each group those with the least hash of id and text, `most` at
    most, whatever the ids.

    A group may hold most rows and an id may be on all of them, so equal keys go first, and then of each of 64 salts the least few, some
    five times their share."""
    keys = rows.select("doc_id", "text_hash", group).distinct().withColumn("at", F.xxhash64("doc_id", "text_hash")).withColumn("salt", F.pmod("at", F.lit(64)))
    for part, n in (([group, "salt"], min(most, most // 12 + 16)), ([group], most)):
        keys = keys.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("at", "doc_id", "text_hash"))).where(F.col("rank") <= n)
    return keys.select("doc_id", "text_hash", group)


def task_numbers() -> Iterator[int]:
    """Numbers that no other task gives: the partition's index, then a counter. A task that is run again over the same split gives the same ones."""
    ctx = TaskContext.get()
    base = (ctx.partitionId() if ctx else 0) << 36
    while True:
        yield base
        base += 1


def blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the named column has about max_bytes in each, but one row at least: memory doesn't follow the length of the
    longest batch. After the last, memory is given back."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(batch.schema.get_field_index(column))
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())).to_pylist()
            start, base = 0, 0
            for i, end in enumerate(ends):
                if end - base >= max_bytes:
                    yield batch.slice(start, i + 1 - start)
                    start, base = i + 1, end
            if start < batch.num_rows:
                yield batch.slice(start)
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between tasks, beside an executor that needs it for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.binary()).to_pylist()
