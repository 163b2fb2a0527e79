"""Operator 8: mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens that earns its share of each window.  What a queue has
earned less what it was served is its deficit; the token (or, of a small share, the turn of
a few tokens) whose queue has waited longest is served next.  A window is what is served
before 2048 tokens are full, so deficits go over from window to window as they are.

What has been served of each queue before any window follows from the shares alone, so a
partition needs nothing from the ones before but how many tokens of each queue they hold:
every partition goes on exactly where the others have left the deficits, all run in
parallel, and only the last sequence of all is not full.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BoundedCache, materialize, only, slices, trim, with_row_id
from .tokens import byte_pretokens, chunks, library, parts, specials, unmapped

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class IdEncoder:
    """Ids of whole texts as little-endian unsigned integers of one width; keeps pre-tokens, and short texts that come again, seen lately."""

    def __init__(self, path: str, cached: int = 400_000, texts: int = 4096, short: int = 1 << 13):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.path, self.ids = path, specials(path)[1]
        self.dtype = dtype = np.dtype("<u2" if max(*vocab.values(), *self.ids.values(), 1) < 1 << 16 else "<u4")
        ranks = {unmapped(t): i for t, i in vocab.items() if t not in self.ids}
        encode = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # a pre-token is one piece
        self.cache = BoundedCache(lambda piece: np.array(encode(piece), dtype).tobytes(), cached)
        self.again, self.short = lru_cache(maxsize=texts)(self._encode), short

    def encode(self, text: str) -> bytes:
        return self.again(text) if len(text) < self.short else self._encode(text)

    def _encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(parts(text, self.path)):
            if i % 2:
                out.append(np.array([self.ids[part]], self.dtype).tobytes())
            elif part:
                for chunk in chunks(part):
                    out.append(b"".join(map(self.cache.__getitem__, byte_pretokens(chunk, self.path))))
        return b"".join(out)


@lru_cache(maxsize=2)
def id_encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


def id_dtype(path: str) -> np.dtype:
    return np.dtype("<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4")


def encode_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Per row: a row number, its source, its tokens and its compressed ids, ``end_id`` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = id_encoder(path), zstandard.ZstdCompressor(1)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in slices(batches, "text", 4000, 8 << 20):
            ids = [(own.encode(t) if t else b"") + end for t in batch.column("text").to_pylist()]
            n = [len(i) // own.dtype.itemsize for i in ids]
            packed = pa.array(list(map(press.compress, ids)), pa.binary())
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(n, pa.int64()), packed], ["rid", "doc_id", "source", "n", "ids"])

    rows = with_row_id(only(docs, "doc_id", "source", "text"))
    return rows.mapInArrow(run, "rid long, doc_id long, source string, n long, ids binary")


class Mixture:
    """The order in which queues are served, from their shares and their tokens.

    Turn c of queue q is served when the queue has earned c + 1/2 turns; of two that are due
    at once the lower queue goes first.  A queue that is empty earns nothing, so the others
    keep their proportions to each other.
    """

    def __init__(self, share: np.ndarray, tokens: np.ndarray, window: int, turn: int):
        self.share = np.maximum(np.asarray(share, np.float64), 1e-12)
        self.tokens = np.asarray(tokens, np.int64)
        self.window, self.total = window, int(self.tokens.sum())
        #: Tokens a turn: one where a window holds many turns of the queue anyway.
        self.turn = np.where(self.share * window >= turn, 1, turn).astype(np.int64)
        end = self.tokens / self.share
        order = np.argsort(end, kind="stable")
        left = self.share.sum() - np.cumsum(self.share[order])
        self.times = np.concatenate(([0.0], end[order]))
        self.served = np.concatenate(([0.0], np.cumsum(self.tokens[order]) + end[order] * np.maximum(left, 0.0)))

    def time(self, turns: np.ndarray, queue=slice(None)) -> np.ndarray:
        """When these turns of the queues are due."""
        return (turns + 0.5) * self.turn[queue] / self.share[queue]

    def size(self, turns: np.ndarray, queue=slice(None)) -> np.ndarray:
        """Tokens of so many turns."""
        return np.minimum(self.tokens[queue], turns * self.turn[queue])

    def before(self, place: np.ndarray) -> np.ndarray:
        """For each place of the packed stream, the tokens of each queue that stand before it."""
        place = np.minimum(np.asarray(place, np.int64), self.total)
        at = np.interp(place, self.served, self.times)[:, None]
        most = -(-self.tokens // self.turn)
        x = np.minimum(most, np.floor(self.share * at / self.turn + 0.5).astype(np.int64))
        rows = np.arange(len(place))
        while True:  # take back the last turns, or add the next, until the turns that fit as a whole are a head of the order
            last = np.where(x > 0, self.time(x - 1), -np.inf)
            following = np.where(x < most, self.time(x), np.inf)
            drop = x.shape[1] - 1 - last[:, ::-1].argmax(axis=1)
            add = following.argmin(axis=1)
            gap = place - self.size(x).sum(axis=1)
            late, soon = last[rows, drop], following[rows, add]
            wrong = (late > soon) | (late == soon) & (drop > add)
            room = np.take_along_axis(self.size(x + 1) - self.size(x), add[:, None], axis=1)[:, 0]
            back = (gap < 0) | wrong
            more = ~back & np.isfinite(soon) & (gap >= room)
            if not (back | more).any():
                break
            x[rows[back], drop[back]] -= 1
            x[rows[more], add[more]] += 1
        out = self.size(x)
        part = np.isfinite(soon) & (gap > 0)
        out[rows[part], add[part]] += gap[part]
        return out

    def place(self, queue: int, turns: np.ndarray) -> np.ndarray:
        """Where turns of a queue stand in the packed stream."""
        due = self.time(turns, queue)[:, None]
        first = np.arange(len(self.share)) < queue  # those go first at the same time
        x = np.maximum(0, np.floor(due * self.share / self.turn - 0.5).astype(np.int64))
        while (low := (self.time(x) < due) | (self.time(x) == due) & first).any():
            x = x + low
        while (high := (x > 0) & ((self.time(x - 1) > due) | (self.time(x - 1) == due) & ~first)).any():
            x = x - high
        x[:, queue] = turns
        return self.size(x).sum(axis=1)

    def windows(self, queue: int, start: int, end: int) -> np.ndarray:
        """The windows that may hold tokens ``start`` to ``end`` of a queue."""
        turns = np.arange(start // self.turn[queue], (end - 1) // self.turn[queue] + 1)
        edge = self.place(queue, turns[[0, -1]]) // self.window
        wide = -(-int(self.turn[queue]) // self.window) + 1  # windows that one turn may reach into
        if edge[1] - edge[0] <= 4 * len(turns):
            return np.arange(edge[0], edge[1] + wide)
        first = self.place(queue, turns) // self.window
        return np.unique(np.concatenate([first + i for i in range(wide)]))

    def spans(self, queue: int, start: int, end: int) -> tuple[np.ndarray, ...]:
        """Tokens ``start`` to ``end`` of a queue as they fall into windows: first token, tokens, window, offset there."""
        w = self.windows(queue, start, end)
        known = np.unique(np.concatenate((w, w + 1)))
        every = self.before(known * self.window)
        x, y = every[np.searchsorted(known, w)], every[np.searchsorted(known, w + 1)]
        low, high = np.maximum(x[:, queue], start), np.minimum(y[:, queue], end)
        held = np.flatnonzero(low < high)
        x, y, w, low, high = x[held], y[held], w[held], low[held], high[held]
        return low, high - low, w, (y - x)[:, :queue].sum(axis=1) + low - x[:, queue]


def pieces(mixture: Mixture, queue: int, base: int, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Documents of ``sizes`` tokens, which stand in the queue from token ``base`` on, cut by windows: document, start, length, window, offset."""
    ends = base + np.cumsum(sizes)
    low, length, window, offset = mixture.spans(queue, base, int(ends[-1]))
    cuts = np.unique(np.concatenate((low, ends - sizes, ends)))
    start, size = cuts[:-1], np.diff(cuts)
    doc, span = np.searchsorted(ends, start, "right"), np.searchsorted(low, start, "right") - 1
    return doc, start - (ends - sizes)[doc], size, window[span], offset[span] + start - low[span]


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, mixture: dict[str, float] | None = None, turn: int = 32, lane_tokens: int = 1 << 21, queues: int = 256) -> DataFrame:
    """Pack every token of ``docs`` into sequences of ``window`` tokens; all but the last are full.

    mixture: target proportions by source, relative to each other; by default those of the
    corpus in tokens, and sources that it doesn't name get their corpus proportion.  While
    all queues have tokens, each window holds of each queue its share to within a token, or
    to within ``turn`` tokens where its share of a window is less than that.  queues: the
    largest sources, half of so many, and those of ``mixture`` have queues of their own; all others share the
    rest by a hash.  lane_tokens: about so many tokens are one task's.

    Null and empty texts pack as ``end_id`` alone, very long ones like any other; a null source
    is a source of its own; repeated rows and rows without a doc_id are packed as documents of
    their own; documents of a queue stand in a fixed order that their rows give, so there are
    no ties.  An empty table gives no piece.  Other columns are ignored.
    """
    rows = materialize(encode_rows(docs, path, end_id))
    by_source = materialize(rows.groupBy("source").agg(F.sum("n").alias("n")))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    half = max(1, queues // 2)
    own = {r.source for r in by_source.orderBy(F.desc("n"), "source").limit(half).collect()} | set(mixture or {})
    names = sorted(own, key=lambda s: (s is None, s or ""))
    spark = docs.sparkSession
    listed = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(names)], "named string, own int"))

    def queued(df: DataFrame) -> DataFrame:
        found = df.join(listed, F.col("source").eqNullSafe(F.col("named")), "left")
        return found.withColumn("queue", F.coalesce("own", F.lit(len(names)) + F.pmod(F.xxhash64("source"), F.lit(half)).cast("int"))).drop("named", "own")

    lanes = max(1, -(-total // lane_tokens))
    rows = queued(rows).withColumn("lane", F.pmod("rid", F.lit(lanes)))
    tokens = {r.queue: r.n for r in queued(by_source).groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    wished = {names.index(source): share for source, share in (mixture or {}).items()}
    used = sorted(tokens)  # queues that hold anything
    share = np.array([wished.get(q, tokens[q] / max(1, total)) for q in used])
    plan = Mixture(share / max(share.sum(), 1e-12), np.array([tokens[q] for q in used], np.int64), window, turn)
    # Tokens of each queue before each lane: within blocks of lanes first, so that no task sorts all of them.
    cells = materialize(rows.groupBy("lane", "queue").agg(F.sum("n").alias("n")).withColumn("block", F.expr("lane div 4096")))
    earlier = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("block", "queue").agg(F.sum("n").alias("n")).select("block", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("had"))
    inside = Window.partitionBy("block", "queue").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["block", "queue"])
    bases = bases.select("lane", "queue", (F.col("in") + F.col("had")).alias("base"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], f) for f in _TYPES], names=_NAMES)
        base = dict(zip(right["queue"].to_pylist(), right["base"].to_pylist(), strict=True))
        n, rid, queue = (left[c].to_numpy() for c in ("n", "rid", "queue"))
        order = np.lexsort((n, left["doc_id"].fill_null(0).to_numpy(), rid, queue))
        cut = []
        for mine in np.split(order, np.flatnonzero(np.diff(queue[order])) + 1):
            q = int(queue[mine[0]])
            doc, *rest = pieces(plan, used.index(q), base[q], n[mine])
            cut.append((mine[doc], *rest))
        doc, start, size, number, offset = (np.concatenate(c) for c in zip(*cut, strict=True))
        dtype, plain, packed, sums, last = id_dtype(path), zstandard.ZstdDecompressor(), left["ids"], [], -1
        for i, low, high in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist(), strict=True):
            if i != last:
                ids, last = memoryview(np.frombuffer(plain.decompress(packed[i].as_py()), dtype).astype("<u4").tobytes()), i
            sums.append(zlib.crc32(ids[low:high]))
        at = pa.array(doc)
        columns = [left["doc_id"].combine_chunks().take(at), start, size, sums, n[doc], number, offset, left["source"].combine_chunks().take(at)]
        trim()
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f) for c, f in zip(columns, _TYPES, strict=True)], names=_NAMES)

    return rows.groupBy("lane").cogroup(bases.groupBy("lane")).applyInArrow(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in PIECES.split(", ")]
