"""What several of the operators share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 64 << 20  # largest vocabulary file that is sent to every executor
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file's bytes; the file's size is checked first."""
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than the {MAX_VOCABULARY_BYTES} that may be broadcast")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; whatever else the table has, names that clash included, stays behind."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def whole_rows(docs: DataFrame) -> F.Column:
    """All columns of a row as one column, so that no name can clash while it travels; `row.*` brings them back."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


def by_bytes(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has about `limit` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def giving_back(run: Callable) -> Callable:
    """A task function that hands freed memory back to the system when it ends: Python workers live on, and what one operator
    has freed but kept would count beside what the next one needs."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """While it holds, Spark hands tasks Arrow batches of about `limit` bytes, or one row, not of up to 64 MB: such a batch stands twice
    outside the heap and again in the Python worker. It holds for what runs meanwhile, not for frames that are only made."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{limit}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hash_unit(*cols) -> F.Column:
    """A number in [0, 1) that depends on the columns only, so that reruns and retries agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def safe_units(text: str) -> list[str]:
    """Cut a text before each space that follows something other than white space.

    No match of the tokenizers' splitting patterns spans such a place: white space opens a match or stands in a run of
    white space, and never follows other characters inside one. Parts can therefore be encoded on their own.
    """
    if "\x00" in text or "  " in text or text[:1] == " ":
        return _careful_units(text)
    units = text.replace(" ", "\x00 ").split("\x00")
    if any(unit[-1].isspace() for unit in units[:-1]):
        return _careful_units(text)
    return units


def _careful_units(text: str) -> list[str]:
    units: list[str] = []
    for part in text.split(" "):
        if units and not (units[-1] and not units[-1][-1].isspace()):
            units[-1] += " " + part
        elif units:
            units.append(" " + part)
        else:
            units.append(part)
    return [unit for unit in units if unit]
