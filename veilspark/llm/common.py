"""Helpers shared by the corpus operators: reading, shared storage, caches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmap import gathered
from ..plans.storage import as_files, ensure_importable, materialize, read

__all__ = ["BoundedCache", "as_files", "crc_bucket", "ensure_importable", "materialize", "only", "read", "row_filter", "slices", "trim", "unused", "with_row_id", "without"]


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """``df`` with a number that is the same for a row each time it is read, however its files are split.

    It hashes file and place, so pair it with doc_id where two rows must not meet.  Where
    numbers of two readings are compared, pass what ``as_files`` returns to both.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    return as_files(df.drop(name)).select("*", place)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``rows`` (doc_id, rid of ``with_row_id``) names."""
    mine, gone, key = (unused(docs, n) for n in ("__rid", "__gone", "__doc"))
    named = rows.select(F.col("rid").alias(gone), F.col("doc_id").alias(key))
    kept = with_row_id(docs, mine)
    return kept.join(named, (F.col(mine) == F.col(gone)) & F.col("doc_id").eqNullSafe(F.col(key)), "left_anti").drop(mine)


def crc_bucket(column: str | Column, n: int) -> Column:
    """``crc32(text of the id) mod n``; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column) % n


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that a caller's extra columns never clash with working ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_filter(df: DataFrame, named: Callable[[bytes], np.ndarray], rows: int) -> Broadcast:
    """A broadcast bitmap of the row numbers that ``named`` reads from the blobs of ``df``: 16 bits a row, 16 MB at most.

    It surely has them and few others, so it decides which rows travel, never a result.
    """

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        found = [named(b).astype(np.int64) for b in batch.column("blob").to_pylist()]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    return df.sparkSession.sparkContext.broadcast(gathered(df.select("blob"), numbers, rows, most=1 << 27))


class BoundedCache(dict):
    """A dict that computes missing values and forgets all but ``base`` when it is full."""

    def __init__(self, compute: Callable, limit: int, base: dict | None = None):
        super().__init__(base or {})
        self.compute, self.limit, self.base = compute, limit + len(base or {}), base or {}

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:  # a rare long token never pushes out frequent short ones
            if len(self) >= self.limit:
                self.clear()
                self.update(self.base)
            self[key] = value
        return value


_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back to the system: a worker serves many stages, and what one has freed the next can't always use."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece has at most ``rows`` rows and, if it has several, about ``size`` bytes of ``column``."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        trim()
