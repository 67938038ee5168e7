"""Small helpers that the corpus operators share; intermediate tables are those of ``gridloom.sources.tables``."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop_table, materialize, new_path, shared_dir  # noqa: F401

#: Of the C locale's white space: a space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Freed memory goes back to the system; the allocators would keep it as long as the process lives."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function after which its worker gives freed memory back: workers outlive their tasks, and stand idle beside stages without Python."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; the slow character map runs only over texts with other signs than ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever signs their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def packed(docs: DataFrame) -> Column:
    """All columns of a row in one struct, in which no name can clash with an operator's own."""
    return F.struct(*own_columns(docs))


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row, but for columns that have no order (maps, variants)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])
