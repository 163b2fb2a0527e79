"""Operator 2: document quality by Bradley-Terry pairwise ranking.

The chance that one document is preferred to another is the logistic function of the
difference of their scores, which are linear in features of the text.  Preference pairs
are all of a good and a bad labelled document; the weights minimise the logistic loss over
differences of features, which hangs on the pairs by the counts of scores alone.  Scores become acceptance by a threshold
at a score quantile of the labelled documents: the share of those that labels call bad.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmap import gathered
from .common import crc_bucket, materialize, only, slices

#: Coarse byte classes: lower, upper, digit, blank, newline, stop, quote or bracket, other sign, not ASCII.
KINDS = 9


def _kinds() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 8
    table[list(b" \t\x0b\x0c\r")] = 3
    table[10] = 4
    table[list(b".,;:!?")] = 5
    table[list(b"'\"()[]{}-")] = 6
    return table


KIND = _kinds()
SIGNS = b"#*$%&|<>!?.,;:-_=+/\\@~^'\"()[]{}"


def features(text: str | None) -> np.ndarray:
    """Shares of byte kinds and of pairs of them, of single signs, and of repetition; over the whole text."""
    data = (text or "").encode()
    n = len(data)
    if not n:
        return np.zeros(WIDTH)
    kind = KIND[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
    signs = np.fromiter((data.count(bytes([s])) for s in SIGNS), np.float64, len(SIGNS))
    words = data.split()
    many = max(1, len(words))
    lines = data.split(b"\n")
    follow = len(set(zip(words, words[1:], strict=False))) / max(1, many - 1)
    shape = [
        np.log1p(n) / 10, n / many / 20, len(set(words)) / many, follow, len(lines) / many,
        1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / many, sum(map(bytes.isalpha, words)) / many,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, sum(len(w) == 1 for w in words) / many, 1.0 if many < 20 else 0.0,
    ]
    return np.concatenate((np.sqrt(np.bincount(kind, minlength=KINDS) / n), np.sqrt(pairs / n), np.sqrt(signs / n), shape))


SHAPES = 11
WIDTH = KINDS + KINDS * KINDS + len(SIGNS) + SHAPES


@dataclass
class Ranker:
    """Linear scores, and the place and scale of the threshold."""

    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    accept: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.center) / self.spread @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1, of which the threshold gets ``accept``."""
        shift = np.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.threshold) / self.scale + shift, -30, 30)))


#: Scores are counted in cells of this part of 1; within one the logistic function is taken as straight.
FINE = 64
Cells = tuple[np.ndarray, np.ndarray]


def cells(s: np.ndarray) -> Cells:
    """Cells of scores, and how many are in each."""
    return np.unique(np.floor(s * FINE).astype(np.int64), return_counts=True)


def beaten(at: np.ndarray, by: Cells) -> np.ndarray:
    """The mean logistic function of the difference from the scores in cells ``at`` to all those of ``by``."""
    out = np.zeros(len(at))
    for low in range(0, len(at), 256):
        off = (by[0][None, :] - at[low : low + 256, None]) / FINE
        out[low : low + 256] = (1 / (1 + np.exp(np.clip(-off, -30, 30)))) @ by[1]
    return out / by[1].sum()


def loss(up: Cells, down: Cells) -> float:
    """The mean logistic loss over all pairs of a good and a bad row."""
    total = 0.0
    for low in range(0, len(up[0]), 256):
        off = (down[0][None, :] - up[0][low : low + 256, None]) / FINE
        total += up[1][low : low + 256] @ np.logaddexp(0, off) @ down[1]
    return float(total / up[1].sum() / down[1].sum())


def pulled(z: np.ndarray, s: np.ndarray, at: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """The sum of rows, each by the pull on the cell of its score, or the next one that has any."""
    return pull[np.minimum(np.searchsorted(at, np.floor(s * FINE).astype(np.int64)), len(at) - 1)] @ z


def descend(count: Callable, slope: Callable, rounds: int = 40, kept: int = 12, shrink: float = 1e-4) -> np.ndarray:
    """Weights of the least loss over all pairs, by L-BFGS.

    count: from weights to the cells of good and of bad rows.  slope: from weights, and for good and for bad
    rows the cells and the pull on each, to the sum of the pulled rows.
    """

    def value(w: np.ndarray) -> tuple[float, tuple[Cells, Cells]]:
        up, down = count(w)
        return loss(up, down) + shrink / 2 * float(w @ w), (up, down)

    def gradient(w: np.ndarray, up: Cells, down: Cells) -> np.ndarray:
        pulls = beaten(up[0], down) / up[1].sum(), -(1 - beaten(down[0], up)) / down[1].sum()
        return shrink * w - slope(w, (up[0], pulls[0]), (down[0], pulls[1]))

    w = np.zeros(WIDTH)
    f, seen = value(w)
    g = gradient(w, *seen)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = g.copy(), []
        for d, y in reversed(steps):
            a = (d @ q) / (d @ y)
            q -= a * y
            used.append(a)
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(g).sum()))
        for (d, y), a in zip(steps, reversed(used), strict=True):
            q += (a - (y @ q) / (d @ y)) * d
        by = 1.0
        while True:
            to = w - by * q
            new, seen = value(to)
            if new <= f - 1e-4 * by * float(g @ q) or by < 1e-3:
                break
            by /= 2
        if new >= f * (1 - 1e-4):
            return to if new < f else w
        h = gradient(to, *seen)
        if (to - w) @ (h - g) > 1e-12:
            steps = [*steps, (to - w, h - g)][-kept:]
        w, f, g = to, new, h
    return w


def fit(rows: np.ndarray, good: np.ndarray, accept: float = 0.7, rounds: int = 40) -> Ranker:
    """Learn from all pairs of a good and a bad row, of rows that are at hand."""
    rows = rows.reshape(-1, WIDTH)
    center, spread = (rows.mean(axis=0), rows.std(axis=0) + 1e-3) if len(rows) else (np.zeros(WIDTH), np.ones(WIDTH))
    if not good.any() or good.all():
        return Ranker(center, spread, np.zeros(WIDTH), 0.0, 1.0, accept)
    z = (rows - center) / spread
    up, down = z[good], z[~good]
    weights = descend(lambda w: (cells(up @ w), cells(down @ w)), lambda w, a, b: pulled(up, up @ w, *a) + pulled(down, down @ w, *b), rounds)
    s = Ranker(center, spread, weights, 0.0, 1.0, accept).raw(rows)
    scale = max(1e-6, float(np.median(s[good]) - np.median(s[~good])) / 6)
    return Ranker(center, spread, weights, float(np.quantile(s, np.mean(~good))), scale, accept)


def added(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Counts (kind, cell, how many) of several parts as one."""
    kind, at, many = np.concatenate([x.reshape(-1, 3) for x in parts]).T
    keys, back = np.unique(np.stack((kind, at)), axis=1, return_inverse=True)
    return np.concatenate((keys, np.bincount(back.ravel(), many).astype(np.int64)[None])).T.ravel()


def passed(found: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray], kind: type = np.float64) -> np.ndarray | None:
    """What ``run`` makes of the features and labels of all batches, joined in each task and then in an order that does not hang on the tasks' times."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column("row").to_pylist()), np.float32).reshape(-1, WIDTH)
                new = run(rows.astype(np.float64), batch.column("good").to_numpy(zero_copy_only=False))
                own = new if own is None else join([own, new])
        if own is not None:
            yield pa.record_batch([pa.array([own.tobytes()], pa.binary())], ["blob"])

    blobs = sorted(bytes(r.blob) for r in found.mapInArrow(each, "blob binary").collect())
    return join([np.frombuffer(b, kind) for b in blobs]) if blobs else None


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of ``scores (s)``, as numpy interpolates it: cells are counted, and only values of the cells that hold it are looked at."""
    low, high, n = scores.agg(F.min("s"), F.max("s"), F.count("*")).first()
    wide = (high - low) / 4096 or 1.0
    each = scores.select("s", F.floor((F.col("s") - low) / wide).alias("cell"))
    sizes = sorted(tuple(r) for r in each.groupBy("cell").count().collect())
    before = np.cumsum([0, *[k for _, k in sizes]])
    at = share * (n - 1)
    ends = [int(at), min(int(at) + 1, n - 1)]
    held = [int(np.searchsorted(before, k, "right")) - 1 for k in ends]
    values = each.where(F.col("cell").isin([sizes[h][0] for h in held])).groupBy("s").count().orderBy("s").collect()
    upto = before[held[0]] + np.cumsum([r["count"] for r in values])
    a, b = (values[int(np.searchsorted(upto, k, "right"))].s for k in ends)
    return float(a + (b - a) * (at - int(at)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, accept: float = 0.7, rounds: int = 40) -> Ranker:
    """Fit on all labelled documents outside the held-out fold, as ``fit`` does.

    Their features are written once; each round reads them, and tasks send counts and sums to the
    driver, so nothing there grows with the documents.  Labels other than 0 and 1 are left out; a
    document labelled more than once takes part once with its highest label.
    """
    known = only(labels, "doc_id", "quality").where((crc_bucket("doc_id", folds) != fold) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 8 << 20):
            batch = batch.filter(pa.array(wanted.value.has(batch.column("doc_id").cast(pa.int64()).to_numpy())))
            rows = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "row"])

    known = materialize(known)
    wanted = docs.sparkSession.sparkContext.broadcast(gathered(known.select(F.col("doc_id").cast("long")), lambda b: b.column("doc_id").to_numpy(), known.count(), most=1 << 27))
    found = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, row binary")  # features, not texts, are shuffled
    found = materialize(found.join(known, "doc_id").select("good", "row"))
    sums = passed(found, lambda rows, good: np.concatenate(([len(rows), good.sum()], rows.sum(axis=0))), added)
    n, up = (int(x) for x in sums[:2]) if sums is not None else (0, 0)
    if not 0 < up < n:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 1.0, accept)
    center = sums[2:] / n
    spread = np.sqrt(passed(found, lambda rows, good: ((rows - center) ** 2).sum(axis=0), added) / n) + 1e-3
    plain = lambda w: Ranker(center, spread, w, 0.0, 1.0, accept)

    def count(w: np.ndarray) -> tuple[Cells, Cells]:
        own = plain(w)

        def told(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
            s = own.raw(rows)
            return np.concatenate([np.stack((np.full(len(at), kind), at, many)).T for kind, part in enumerate((s[good], s[~good])) for at, many in [cells(part)]]).ravel()

        kind, at, many = passed(found, told, merged, np.int64).reshape(-1, 3).T
        return (at[kind == 0], many[kind == 0]), (at[kind == 1], many[kind == 1])

    def slope(w: np.ndarray, above: Cells, below: Cells) -> np.ndarray:
        own = plain(w)

        def told(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
            z, s = (rows - center) / spread, own.raw(rows)
            return sum(pulled(z[at], s[at], *pull) for at, pull in ((good, above), (~good, below)))

        return passed(found, told, added)

    weights = descend(count, slope, rounds)
    own = plain(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("row").to_pylist()), np.float32).reshape(-1, WIDTH)
            yield pa.record_batch([batch.column("good"), pa.array(own.raw(rows.astype(np.float64)))], ["good", "s"])

    scores = materialize(found.mapInArrow(scored, "good boolean, s double"))
    scale = max(1e-6, (quantile(scores.where("good"), 0.5) - quantile(scores.where("not good"), 0.5)) / 6)
    return Ranker(center, spread, weights, quantile(scores, (n - up) / n), scale, accept)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def rank(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, accept: float = 0.7) -> DataFrame:
    """One row per row: score of the whole text from 0 to 1, and 1 where it reaches ``accept``.

    Null and empty texts are scored by features of zero, very long texts whole; without both
    labels to learn from every score is ``accept``; a row without a doc_id counts as held out.
    Equal texts have equal scores and repeated rows a row each; a document labelled more than
    once counts as its highest label.  An empty table gives an empty one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold, accept=accept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", 2000, 8 << 20):
            score = own.score(np.stack([features(t) for t in batch.column("text").to_pylist()]))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= own.accept).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = only(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(crc_bucket("doc_id", folds) == fold, F.lit(True)).alias("held_out"))
    return rows.mapInArrow(run, SCORED)
