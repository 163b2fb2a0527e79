"""A bitmap of hashes, sized by what it holds and bounded: it keeps most of what can't match out of a join, never a match."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64


class Bitmap:
    """``bits`` is a power of two: ``per_entry`` for each entry, ``most`` at most (128 MB).

    probes: bits that an entry sets.  With 32 bits an entry and 4 probes one string in 5000 passes that should not.
    """

    CHUNK = 1 << 15

    def __init__(self, entries: int, per_entry: int = 16, most: int = 1 << 30, probes: int = 1):
        self.bits = min(most, max(self.CHUNK * 8, 1 << (per_entry * max(1, entries) - 1).bit_length()))
        self.probes = probes
        self.data = np.zeros(self.bits // 8, np.uint8)

    def places(self, hashes: np.ndarray, probe: int = 0) -> np.ndarray:
        h = hashes.view(U) * U(0x9E3779B97F4A7C15)
        at = h ^ (h >> U(32))
        if probe:
            at += U(probe) * (h >> U(17) | U(1))
        return (at & U(self.bits - 1)).astype(np.int64)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self._set(self.places(hashes))
        for probe in range(1, self.probes):
            left = np.flatnonzero(out)
            out[left] = self._set(self.places(hashes[left], probe))
        return out

    def mark(self, hashes: np.ndarray) -> None:
        for probe in range(self.probes):
            at = self.places(hashes, probe)
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))


def gathered(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], entries: int, **size: int) -> Bitmap:
    """The bitmap of what ``hashes`` reads from ``df``: tasks mark their own, and chunks are united before the driver gets them."""
    out = Bitmap(entries, **size)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap(entries, **size)
        for batch in batches:
            own.mark(hashes(batch))
        chunks = own.data.reshape(-1, Bitmap.CHUNK)
        used = np.flatnonzero(chunks.any(axis=1)).tolist()
        for start in range(0, len(used), 64):
            some = used[start : start + 64]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([chunks[i].tobytes() for i in some], pa.binary())], ["chunk", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        whole = np.zeros(Bitmap.CHUNK, np.uint8)
        for bits in table["bits"].to_pylist():
            whole |= np.frombuffer(bits, np.uint8)
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    parts = df.mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInArrow(unite, "chunk long, bits binary")
    for row in parts.toLocalIterator():
        out.data[row.chunk * Bitmap.CHUNK : (row.chunk + 1) * Bitmap.CHUNK] = np.frombuffer(bytes(row.bits), np.uint8)
    return out
