"""Operator 1: language identification of words by a linear-chain conditional random field.

A word's features are its hashed byte n-grams between boundary marks (those that hold a
mark are its affixes) and its place in a lexicon learned with the model; transitions
between the labels of neighbouring words are learned too.  Forward-backward gives each
word's label probabilities, and their mean over a text gives the text's language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, only, slices

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def lower(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngram_table(words: list[str], bits: int, orders: tuple[int, ...] = (2, 3, 4)) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of ``^word$``, word after word: their buckets, and where each word starts."""
    data = np.frombuffer(b"".join(b"^%b$" % w.encode() for w in words), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter((len(w.encode()) + 2 for w in words), np.int64, len(words)))
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    found, owners = [], []
    for k in orders:
        n = len(data) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : n + i]
            h ^= h >> np.uint64(31)
        inside = owner[:n] == owner[k - 1 :]
        found.append((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits))
        owners.append(owner[:n][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return np.concatenate(found)[order].astype(np.int64), starts


@dataclass
class Chain:
    """Texts laid out by time: all first words, then all second words, longest text first."""

    place: np.ndarray
    active: np.ndarray
    order: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> Chain:
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
        starts = np.concatenate(([0], np.cumsum(active)))
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        total = int(sizes.sum())
        first = np.cumsum(sizes) - sizes
        time = np.arange(total) - np.repeat(first, sizes)
        return cls(starts[time] + np.repeat(rank, sizes), active, order, starts)


def forward_backward(emission: np.ndarray, chain: Chain, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word's label, and expected transitions; ``emission`` is by time, not logarithmic."""
    K = emission.shape[1]
    alpha, S, A = np.empty_like(emission), chain.starts, chain.active.tolist()
    before = None
    for t, n in enumerate(A):
        now = emission[S[t] : S[t] + n] * (start if t == 0 else before[:n] @ step)
        now /= now.sum(axis=1, keepdims=True)
        alpha[S[t] : S[t] + n] = before = now
    moves = np.zeros((K, K))
    posterior = np.empty_like(emission)
    beta, pending = np.ones((0, K), emission.dtype), None
    for t in range(len(A) - 1, -1, -1):
        n = A[t]
        here = np.ones((n, K), emission.dtype)
        if len(beta):
            ahead = pending * beta
            m = len(ahead)
            here[:m] = ahead @ step.T
            scale = (alpha[S[t] : S[t] + m] * here[:m]).sum(axis=1, keepdims=True)
            moves += ((alpha[S[t] : S[t] + m] / scale).T @ ahead) * step
            here[:m] /= here[:m].sum(axis=1, keepdims=True)
        both = alpha[S[t] : S[t] + n] * here
        posterior[S[t] : S[t] + n] = both / both.sum(axis=1, keepdims=True)
        beta, pending = here, emission[S[t] : S[t] + n]
    return posterior, moves


@dataclass
class Tagger:
    """The learned model and, on a worker, the emissions of words seen lately."""

    labels: list[str]
    bits: int
    weights: np.ndarray
    bias: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    start: np.ndarray
    step: np.ndarray
    limit: int = 300_000
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        grams, starts = ngram_table(words, self.bits)
        scores = np.add.reduceat(self.weights[grams], starts, axis=0) + self.bias
        scores += self.lexical[np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))]
        return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Emissions of a sequence of words; only unseen ones are computed."""
        if self.table is None or len(self.known) > self.limit:
            self.known, self.table = {}, np.empty((0, len(self.labels)), np.float32)
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            if len(known) > len(self.table):
                grown = np.empty((2 * len(known), len(self.labels)), np.float32)
                grown[:at] = self.table[:at]
                self.table = grown
            for i in range(0, len(new), 10_000):
                part = new[i : i + 10_000]
                self.table[at + i : at + i + len(part)] = self.emissions(part)
        return self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text, each word's label probabilities; also the general interface for code-switched text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        chain = Chain.of(sizes)
        emission = np.empty((int(sizes.sum()), len(self.labels)), np.float32)
        emission[chain.place] = self.lookup([w for t in texts for w in t])
        posterior, _ = forward_backward(emission, chain, self.start, self.step)
        return np.split(posterior[chain.place], np.cumsum(sizes)[:-1])

    def read(self, raw: list[str | None], size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text, its number of words and whether none has a letter; and the emissions of all words, text after text.

        Words are held for about ``size`` characters at a time: as objects they take many times their text, and
        those of them that stay known would keep the memory between them from being given back.
        """
        sizes, blank, parts, words, held = [], [], [], [], 0
        for text in raw:
            found = lower(text) if text else []
            sizes.append(len(found))
            blank.append(not any(c.isalpha() for w in found for c in w))
            words += found
            held += len(text or "")
            if held >= size:
                parts.append(self.lookup(words))
                words, held = [], 0
        parts.append(self.lookup(words))
        return np.array(sizes, np.int64), np.array(blank, bool), np.concatenate(parts)

    def means(self, sizes: np.ndarray, emission: np.ndarray) -> np.ndarray:
        """Per text, the mean of its words' label probabilities; zeros for a text without words."""
        total = np.zeros((len(sizes), len(self.labels)))
        if sizes.sum():
            chain = Chain.of(sizes)
            timed = np.empty_like(emission)
            timed[chain.place] = emission
            posterior, _ = forward_backward(timed, chain, self.start, self.step)
            for t, n in enumerate(chain.active.tolist()):
                total[chain.order[:n]] += posterior[chain.starts[t] : chain.starts[t] + n]
        return total / np.maximum(sizes, 1)[:, None]


def fit(texts: list[str], langs: list[str], bits: int = 16, rounds: int = 60, sequences: int = 3000, words: int = 60, seed: int = 7) -> Tagger:
    """Maximum likelihood with a quadratic penalty, on code-switched sequences of stretches of the texts.

    Every stretch of 3 to 30 words comes from one text and carries its language.
    """
    labels = sorted(set(langs))
    K, rng = len(labels), np.random.default_rng(seed)
    split = [lower(t) for t in texts]
    by_label = [[w for w, g in zip(split, langs, strict=True) if g == name and w] for name in labels]
    seen = [Counter(w for t in group for w in set(t)) for group in by_label]
    lexicon = {}
    for k, counts in enumerate(seen):
        for w, n in counts.most_common(5000):
            share = [c[w] / max(1, len(g)) for c, g in zip(seen, by_label, strict=True)]
            if n >= 3 and share[k] >= 0.8 * sum(share):
                lexicon[w] = k
    usable = [k for k in range(K) if by_label[k]]
    chains, tags = [], []
    for _ in range(sequences if usable else 0):
        seq, tag, k = [], [], int(rng.choice(usable))
        while len(seq) < words:
            text = by_label[k][rng.integers(len(by_label[k]))]
            size = int(rng.integers(3, 31))
            at = int(rng.integers(max(1, len(text) - size)))
            seq += (part := text[at : at + size])
            tag += [k] * len(part)
            k = int(rng.choice(usable))
        chains.append(seq)
        tags.append(tag)
    tagger = Tagger(labels, bits, np.zeros((1 << bits, K)), np.zeros(K), lexicon, np.zeros((K + 1, K)), np.full(K, 1 / max(1, K), np.float32), np.full((K, K), 1 / max(1, K), np.float32))
    if not chains:
        return tagger
    types = {w: i for i, w in enumerate(dict.fromkeys(w for s in chains for w in s))}
    grams, starts = ngram_table(list(types), bits)
    counts = np.diff(starts, append=len(grams))
    lex = np.fromiter((lexicon.get(w, -1) for w in types), np.int64, len(types))
    sizes = np.fromiter(map(len, chains), np.int64, len(chains))
    chain = Chain.of(sizes)
    kind, gold = np.empty(len(chain.place), np.int64), np.empty(len(chain.place), np.int64)
    kind[chain.place] = [types[w] for s in chains for w in s]
    gold[chain.place] = [k for t in tags for k in t]
    observed = np.zeros((len(types), K))
    np.add.at(observed, (kind, gold), 1)
    moves = np.zeros((K, K))
    flat = gold[chain.place]
    within = np.ones(len(flat) - 1, bool)
    within[np.cumsum(sizes)[:-1] - 1] = False
    np.add.at(moves, (flat[:-1][within], flat[1:][within]), 1)
    first = np.bincount(gold[: len(chains)], minlength=K)
    total = len(flat)
    free = {"weights": tagger.weights, "bias": tagger.bias, "lexical": tagger.lexical[:K], "start": np.zeros(K), "step": np.zeros((K, K))}
    grown = {n: np.full_like(v, 1e-8) for n, v in free.items()}
    for turn in range(rounds):
        scores = np.add.reduceat(free["weights"][grams], starts, axis=0) + free["bias"]
        scores += tagger.lexical[lex]
        emission = np.exp(scores - scores.max(axis=1, keepdims=True))[kind]
        posterior, expected = forward_backward(emission, chain, np.exp(free["start"]), np.exp(free["step"]))
        wanted = np.zeros((len(types), K))
        for k in range(K):
            wanted[:, k] = np.bincount(kind, posterior[:, k], minlength=len(types))
        gap = (observed - wanted) / total
        spread = np.repeat(gap, counts, axis=0)
        slope = {
            "weights": np.stack([np.bincount(grams, spread[:, k], minlength=1 << bits) for k in range(K)], axis=1) - 1e-7 * free["weights"],
            "bias": gap.sum(axis=0),
            "lexical": np.stack([np.bincount(lex[lex >= 0], gap[lex >= 0, k], minlength=K)[:K] for k in range(K)], axis=1) - 1e-5 * free["lexical"],
            "start": (first - posterior[: len(chains)].sum(axis=0)) / total,
            "step": (moves - expected) / total - 1e-5 * free["step"],
        }
        for n, g in slope.items():
            grown[n] += g * g
            free[n] += 0.5 * g / np.sqrt(grown[n])
    tagger.start = np.exp(free["start"] - free["start"].max()).astype(np.float32)
    tagger.step = np.exp(free["step"] - free["step"].max()).astype(np.float32)
    tagger.weights = free["weights"].astype(np.float32)
    return tagger


def train(docs: DataFrame, per_label: int = 400, sample_rows: int = 20_000, least: int = 20, max_chars: int = 20_000, folds: int = 5, fold: int = 0) -> Tagger:
    """Fit on a bounded sample of labelled texts, never from the held-out fold.

    Every language takes part, with about ``per_label`` texts, or so many that all together
    are about ``sample_rows``, but ``least`` at any rate; of a longer text it is a stretch of
    ``max_chars`` from a place that its id chooses.
    """
    usable = docs.where((crc_bucket("doc_id", folds) != fold) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    each = max(least, min(per_label, sample_rows // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 24)) / (1 << 24)
    room = F.greatest(F.length("text") - max_chars, F.lit(0)) + 1
    stretch = F.substring("text", 1 + F.pmod(F.xxhash64(F.lit("stretch"), "doc_id"), room).cast("int"), F.lit(max_chars))
    sample = usable.where(chance < F.try_element_at(share, "lang")).select("doc_id", stretch.alias("text"), "lang").limit(2 * each * len(sizes))
    rows = sorted((r.doc_id, r.text, r.lang) for r in sample.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


TAGGED = "doc_id long, held_out boolean, lang_pred string, score double, n_words long"


def predict(own: Tagger, raw: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of words, language and score of each text."""
    if not own.labels:
        sizes = np.fromiter((len(lower(t)) if t else 0 for t in raw), np.int64, len(raw))
        return sizes, [UNKNOWN] * len(raw), np.zeros(len(raw))
    sizes, blank, emission = own.read(raw)
    means = own.means(sizes, emission)
    best = means.argmax(axis=1)
    names = [UNKNOWN if b else own.labels[k] for b, k in zip(blank, best, strict=True)]
    return sizes, names, np.where(blank, 0.0, np.clip(means[np.arange(len(best)), best], 0, 1))


def filtered(own: Tagger, batches: Iterator[pa.RecordBatch], wanted: set[str] | None, least: float) -> Iterator[pa.RecordBatch]:
    """The rows that ``keep_languages`` keeps."""
    for batch in slices(batches, "text", 2000, 2 << 20):
        _, names, score = predict(own, batch.column("text").to_pylist())
        keep = [n != UNKNOWN and s >= least and (wanted is None or n in wanted) for n, s in zip(names, score, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_languages(docs: DataFrame, wanted: set[str] | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` without texts that are in no language for sure: ``und``, a score under ``least``, or not ``wanted``.

    Null, empty and letterless texts go, and everything where no labelled text can be learned
    from; all columns and equal rows that stay are as they came.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return filtered(sent.value, batches, wanted, least)

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, tagger: Tagger | None = None, folds: int = 5, fold: int = 0) -> DataFrame:
    """One row per row: the language of each whole text, and its mean probability over the words.

    Null, empty and other texts without a letter are ``und`` with score 0, and so is
    everything where no labelled text could be learned from; ties go to the first label in
    order; very long texts are read whole.  A row without a doc_id counts as held out.
    Repeated rows give a row each, an empty table an empty one; other columns are ignored.
    """
    tagger = tagger or train(docs, folds=folds, fold=fold)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, 4 << 20):
            sizes, names, score = predict(sent.value, batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(sizes)], [c.split()[0] for c in TAGGED.split(", ")])

    rows = only(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(crc_bucket("doc_id", folds) == fold, F.lit(True)).alias("held_out"))
    return rows.mapInArrow(run, TAGGED)
