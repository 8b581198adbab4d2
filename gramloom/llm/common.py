"""What several operators share: tables, tables written to the shared folder, word expressions."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.sources.shared import file_system, new_path, shared_folder, written

__all__ = [
    "SPACE", "SPACES", "crc32_of_id", "documents", "file_system", "give_back", "gives_back", "keeps_names", "new_path", "shared_folder",
    "words", "written",
]

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keeps_names(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the other columns of their input: those named like the operator's own columns, with a
    leading underscore, have other names while it runs, so neither takes the other's place."""

    @functools.wraps(run)
    def renamed(docs: DataFrame, *args, **options) -> DataFrame:
        names = {c: uuid.uuid4().hex for c in docs.columns if c.startswith("_")}
        out = run(docs.withColumnsRenamed(names), *args, **options)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return renamed


def give_back() -> None:
    """Free memory that this process's allocators keep goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions of ``mapInArrow``. Spark's workers outlive their tasks and more of them wait than work, so what a task needed
    for a batch is given back after the batch, and the rest at the task's end."""

    @functools.wraps(run)
    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                batch = None
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return lean


def words(text: Column) -> Column:
    """The words of a text, unchanged and in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
