"""Operator 9: token counts by a two-tier lookup on the map side.

Tier one is a table of frequent pre-tokens and their numbers of tokens, fitted on a
bounded sample and broadcast; tier two is each worker's own cache of the misses, which
the library's model encodes once.  No pre-token is ever shuffled, and the sample decides
only how fast the counts come, never what they are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, only, slices
from .tokens import PLAIN, WORD_LEVEL, chunks, library, mapped, parts

COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def word_length(path: str):
    model = library(path).model
    return lambda word: len(model.tokenize(mapped(word)))


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int = 1000, max_bytes: int = 1 << 16, entries: int = 1 << 16) -> tuple[bytes, bytes]:
    """The table to broadcast: at most ``entries`` words, and a byte each for their lengths.

    Fitted on about ``sample_rows`` texts of at most ``max_bytes``, chosen by a hash of the id.
    """
    rows = max(1, docs.count())
    share = min(1.0, sample_rows / rows)
    chosen = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.octet_length("text") <= max_bytes))
    counts: Counter[str] = Counter()
    for row in chosen.select("text").limit(2 * sample_rows).toLocalIterator():
        if PLAIN.fullmatch(row.text):
            counts.update(WORD_LEVEL.findall(row.text.lower()))
    length = word_length(path)
    words = [w for w, n in counts.most_common(entries) if n > 1 and len(w) <= 64]
    found = {w: min(255, length(w)) for w in words}
    found = {w: n for w, n in found.items() if n < 255}
    return zlib.compress("\n".join(found).encode()), bytes(found.values())


class Counter9:
    """Counts the tokens of whole texts on a worker."""

    def __init__(self, path: str, table: tuple[bytes, bytes], cached: int = 400_000):
        self.path = path
        words = zlib.decompress(table[0]).decode().split("\n") if table[1] else []
        self.lengths = BoundedCache(word_length(path), cached, dict(zip(words, table[1], strict=True)))

    def count(self, text: str) -> int:
        total = 0
        for i, part in enumerate(parts(text, self.path)):
            if i % 2:
                total += 1
                continue
            for chunk in chunks(part):
                if PLAIN.fullmatch(chunk):
                    total += sum(map(self.lengths.__getitem__, WORD_LEVEL.findall(chunk.lower())))
                else:
                    total += len(library(self.path).encode(chunk, add_special_tokens=False).ids)
        return total


_COUNTERS: dict[str, tuple[int, Counter9]] = {}


def counter(path: str, table: tuple[bytes, bytes]) -> Counter9:
    """One counter a worker, kept between tasks."""
    key = zlib.crc32(table[0])
    if path not in _COUNTERS or _COUNTERS[path][0] != key:
        _COUNTERS[path] = (key, Counter9(path, table))
    return _COUNTERS[path][1]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, **sample) -> DataFrame:
    """Tokens of every whole text, and whether they exceed ``limit``.

    A null text counts as empty: no bytes, no tokens.  Very long texts are cut where
    pre-tokens always end, so their counts are the same.  Each row gives a row, also repeated
    rows and rows without a doc_id; an empty table gives an empty one; other columns are ignored.
    """
    docs = only(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, **sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, table.value)
        for batch in slices(batches, "text", 4000, 8 << 20):
            texts = batch.column("text")
            n = np.fromiter((own.count(t) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))
            size = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, COUNTED)
