"""Operator 5: quality rules by n-gram perplexity.

Each language has a modified Kneser-Ney model of order 4 over its own letters: the commonest
code points of its texts are a sign each, any other is spelled by several, so no two code
points are the same, however many a script has.  Spark
counts letters and n-grams of every document; a model is kept as sorted arrays of hashes, of
n-grams with their log-probabilities and of contexts with their weights, in which scoring
looks every n-gram up, falling back to shorter ones.  With 64 signs a model has at most
64**4 n-grams, which bounds what is broadcast; where the models of all languages together
are larger than a limit, they go out in groups of languages, each to its own documents.  A
document is rejected where its cross-entropy leaves the band of its language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_files, materialize, only, slices, trim, with_row_id, without

ORDER, BITS = 4, 6
SIGNS = 1 << BITS
#: White space, digits, what a letter and another sign that are not among the commonest begin with, and the first of those.
SPACE, DIGIT, LETTER, OTHER, FIRST = range(5)
BLANK = b" \t\n\x0b\x0c\r"
U32 = np.uint32


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """What each code point counts as: its lower case, one for all white space, one for all digits."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(1 << 17):  # beyond there is neither case nor space, nor a digit
        text = chr(c)
        if text.isspace():
            table[c] = 32
        elif text.isdecimal():
            table[c] = 48
        elif len(low := text.lower()) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)), bool, 1 << 16)


def points(texts: list[str]) -> np.ndarray:
    """Folded code points of texts, end to end."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return folded()[raw]


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, list[int], list[str]]]:
    """The rows of a batch and their non-empty texts, language by language."""
    found: dict[str | None, tuple[list[int], list[str]]] = {}
    for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)):
        if text:
            rows, texts = found.setdefault(lang, ([], []))
            rows.append(i)
            texts.append(text)
    for lang, (rows, texts) in found.items():
        yield lang, rows, texts


def alphabets(docs: DataFrame) -> dict[str | None, np.ndarray]:
    """The sign that each folded code point of 16 bits begins with, by language: the commonest of all its texts have signs of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}
        for batch in slices(batches, "text", 4000, 2 << 20):
            for lang, _, texts in by_language(batch):
                total[lang] = total.get(lang, 0) + np.bincount(np.minimum(points(texts), 0xFFFF), minlength=1 << 16)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "point", "n"])

    counts = docs.mapInArrow(run, "lang string, point int, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "point"))
    common = counts.where(~F.col("point").isin(32, 48, 0xFFFF)).withColumn("rank", rank).where(F.col("rank") <= SIGNS - FIRST)
    base = np.where(letters(), LETTER, OTHER).astype(np.uint8)
    base[32], base[48] = SPACE, DIGIT
    out: dict[str | None, np.ndarray] = {r.lang: base.copy() for r in counts.select("lang").distinct().collect()}
    for r in common.toLocalIterator():
        out[r.lang][r.point] = FIRST + r["rank"] - 1
    return out


def codes(texts: list[str], signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each sign, texts end to end, with where texts start and end, and their code points.

    Each text starts after white space, so no n-gram reaches over from another.  A code point without a
    sign of its own is spelled: what it begins with, then its bits from the highest, 18 of a letter, or 24.
    """
    pad = " " * (ORDER - 1)
    point = points([pad + t for t in texts])
    data = signs[np.minimum(point, 0xFFFF)].astype(U32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    after = np.cumsum(sizes + ORDER - 1)
    end, start = after, after - sizes
    if len(rare := np.flatnonzero((data == LETTER) | (data == OTHER))):
        more = np.zeros(len(data) + 1, np.int64)
        more[1:][rare] = np.where(data[rare] == LETTER, 3, 4)
        place = np.arange(len(more)) + np.cumsum(more)
        spelled = np.zeros(place[-1], U32)
        spelled[place[:-1]] = data
        for i in range(4):
            long = rare[more[1:][rare] > i]
            spelled[place[1:][long] - 1 - i] = point[long] >> U32(BITS * i) & U32(SIGNS - 1)
        data, start, end = spelled, place[start], place[end]
    code = np.zeros(len(data), U32)
    for i in range(ORDER):
        code[i:] |= data[: len(data) - i] << U32(BITS * i)
    return code, start, end, sizes


def count_ngrams(docs: DataFrame, signs: dict[str | None, np.ndarray]) -> DataFrame:
    """``(lang, code, n)`` over all texts; each task sends its sums, at most one row a code and language."""
    sent = docs.sparkSession.sparkContext.broadcast(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text", 4000, 2 << 20):
            for lang, _, texts in by_language(batch):
                code, start, end, _ = codes(texts, sent.value[lang])
                inside = np.zeros(len(code) + 1, np.int8)
                inside[start] += 1
                inside[end] -= 1
                new, n = np.unique(code[np.cumsum(inside[:-1]) > 0], return_counts=True)
                if lang in total:
                    keys, back = np.unique(np.concatenate((total[lang][0], new)), return_inverse=True)
                    new, n = keys, np.bincount(back, np.concatenate((total[lang][1], n))).astype(np.int64)
                total[lang] = new, n
        for lang, (code, n) in total.items():
            for at in range(0, len(code), 100_000):
                part = slice(at, at + 100_000)
                yield pa.record_batch([pa.array([lang] * len(code[part]), pa.string()), pa.array(code[part].astype(np.int32)), pa.array(n[part])], ["lang", "code", "n"])
        total.clear()
        trim()

    return docs.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def hashed(code: np.ndarray) -> np.ndarray:
    """32-bit hashes of codes, without collisions: odd multipliers and shifts are invertible."""
    h = code.astype(U32) * U32(0x9E3779B1)
    h ^= h >> U32(15)
    h *= U32(0x85EBCA77)
    return h ^ (h >> U32(13))


class Table:
    """Sorted hashes of codes, each with a value."""

    def __init__(self, code: np.ndarray, value: np.ndarray):
        h = hashed(code)
        order = np.argsort(h)
        self.keys, self.values = h[order], value[order].astype(np.float32)

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes it has, and the values of those."""
        if not len(self.keys):
            return np.zeros(len(code), bool), np.zeros(0, np.float32)
        h = hashed(code)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        found = self.keys[at] == h
        return found, self.values[at[found]]


class Model:
    """Modified Kneser-Ney of one language: for each order a table of log-probabilities and one of weights by context."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        gram, counts = np.asarray(code, np.int64), np.asarray(n, np.float64)
        levels = []
        for k in range(ORDER, 0, -1):
            order = np.argsort(gram)
            levels.append((gram[order], counts[order]))
            if k > 1:  # below the top: the number of different left neighbours
                gram, left = np.unique(gram & ((1 << BITS * (k - 1)) - 1), return_counts=True)
                counts = left.astype(np.float64)
        self.grams: list[Table] = []
        self.contexts: list[Table] = []
        shorter, below = np.zeros(1, np.int64), np.full(1, 1 / SIGNS)
        for k, (gram, counts) in enumerate(reversed(levels)):
            lower = below[np.searchsorted(shorter, gram & ((1 << BITS * k) - 1))] if k else np.full(len(gram), 1 / SIGNS)
            prob, context, weight = self._level(gram, counts, lower)
            self.grams.append(Table(gram, np.log(prob)))
            self.contexts.append(Table(context, np.log(weight)))
            shorter, below = gram, prob

    @staticmethod
    def _level(gram: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interpolated probabilities of the seen n-grams, their contexts, and the weights of those."""
        times = [float((counts == i).sum()) for i in range(1, 5)]
        y = times[0] / (times[0] + 2 * times[1]) if times[0] else 0.5
        cut = [0.0] + [min(max(i - (i + 1) * y * times[i] / times[i - 1], 0.05), i - 0.05) if times[i - 1] and times[i] else 0.5 * i for i in (1, 2, 3)]
        cut = np.array(cut)[np.minimum(counts, 3).astype(np.int64)]
        context, group = np.unique(gram >> BITS, return_inverse=True)
        whole = np.bincount(group, counts)
        weight = np.bincount(group, cut) / whole
        return (counts - cut) / whole[group] + weight[group] * lower, context, weight

    def score(self, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams: from the longest that was seen, behind the weights of the contexts that were."""
        out = np.zeros(len(code), np.float32)
        open_, left = np.arange(len(code)), code
        for k in range(ORDER - 1, -1, -1):
            found, value = self.grams[k].find(left)
            out[open_[found]] += value
            open_, left = open_[~found], left[~found]
            if not len(open_):
                return out
            known, weight = self.contexts[k].find(left >> U32(BITS))
            out[open_[known]] += weight
            left = left & U32((1 << BITS * k) - 1)
        out[open_] -= np.log(SIGNS)
        return out


def repeated_words(words: list[list[bytes]], width: int = 8) -> np.ndarray:
    """Per text: words in windows of ``width`` words that the text has twice or more."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    h = np.fromiter((hash(w) for t in words for w in t), np.int64, int(sizes.sum())).view(np.uint64)
    n = len(h) - width + 1
    if n < 2:
        return out
    text = np.repeat(np.arange(len(words)), sizes)
    mixed = h * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    window = np.zeros(n, np.uint64)
    for i in range(width):
        window = window * np.uint64(0xD6E8FEB86659FD93) + mixed[i : n + i]
    starts = np.flatnonzero(text[:n] == text[width - 1 :])
    if len(starts) < 2:
        return out
    key = window[starts] ^ (text[starts].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + width, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def base_counts(texts: list[bytes]) -> list[tuple[int, ...]]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = [t.split() for t in texts]
    again = repeated_words(words)
    out = []
    for t, w, r in zip(texts, words, again.tolist(), strict=True):
        chars = len(t.decode()) - sum(t.count(bytes([b])) for b in BLANK)
        symbols = sum(t.count(bytes([b])) for b in b"#*$%&|<>")
        lines = [x for x in t.split(b"\n") if x.strip(BLANK)] if b"\n" in t else []
        out.append((len(w), chars, symbols, len(lines) - len(set(lines)), r))
    return out


SCORED = "rid long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, n_points long, entropy double"


def groups_of_languages(counts: DataFrame, most: int) -> list[list[str | None]]:
    """Languages in groups whose models have about ``most`` n-grams together; each in one group."""
    sizes = [(r.lang, r.n) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").toLocalIterator()]
    groups: list[list[str | None]] = []
    held = most
    for lang, n in sizes:
        if held + n > most:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += n
    return groups


def train(counts: DataFrame, langs: list[str | None]) -> dict[str | None, Model]:
    """The models of some languages."""
    named = F.col("lang").isin(*[x for x in langs if x is not None])
    found = counts.where(named | F.col("lang").isNull() if None in langs else named).toArrow()
    lang = np.array([x if x is not None else "" for x in found["lang"].to_pylist()], object)
    null = found["lang"].is_null().to_numpy()
    code, n = found["code"].to_numpy(), found["n"].to_numpy()
    pick = {x: np.flatnonzero(null if x is None else (lang == x) & ~null) for x in langs}
    return {x: Model(code[at], n[at]) for x, at in pick.items()}


def score(docs: DataFrame, signs: dict[str | None, np.ndarray], models: dict[str | None, Model]) -> DataFrame:
    """Base counts and cross-entropy (nats a code point; null for an empty text) of each whole text."""
    spark = docs.sparkSession.sparkContext
    sent = spark.broadcast(({x: signs[x] for x in models}, models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, known = sent.value
        for batch in slices(batches, "text", 2000, 1 << 20):
            raw = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            entropy, size = np.full(len(raw), np.nan), np.zeros(len(raw), np.int64)
            for lang, rows, texts in by_language(batch):
                code, start, end, many = codes(texts, alphabet[lang])
                gains = np.concatenate(([0.0], np.cumsum(known[lang].score(code), dtype=np.float64)))
                size[rows] = many
                entropy[rows] = (gains[start] - gains[end]) / many
            counts = [pa.array(c, pa.int64()) for c in zip(*base_counts(raw), strict=True)]
            n_bytes = pa.array(list(map(len, raw)), pa.int64())
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), batch.column("lang"), *counts, n_bytes, pa.array(size), pa.array(entropy, from_pandas=True)], [c.split()[0] for c in SCORED.split(", ")])

    return docs.mapInArrow(run, SCORED)


def failed() -> Column:
    """The rules on counts: too short, or mostly repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bands(scored: DataFrame, like: float = 30.0) -> DataFrame:
    """``(lang, mid, dev)``: median and robust standard deviation of the entropy, by language.

    From exact counts in steps of 0.001 over all documents that pass the rules on counts.  A
    language's deviation is drawn towards that of all documents from the medians of their
    languages, as if ``like`` documents had shown it, and is wider by its median's own error.
    """
    cells = scored.where(~failed() & F.col("entropy").isNotNull()).groupBy("lang", F.round("entropy", 3).alias("e")).agg(F.count("*").alias("n"))

    def middle(df: DataFrame) -> DataFrame:
        mid = df.groupBy("lang").agg(F.percentile("e", 0.5, F.col("n")).alias("mid"), F.sum("n").alias("seen"))
        both = df.alias("a").join(mid.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")))
        both = both.select("a.lang", F.abs(F.col("a.e") - F.col("b.mid")).alias("off"), "a.n", "b.mid", "b.seen")
        return both.groupBy("lang", "mid", "seen").agg((1.4826 * F.percentile("off", 0.5, F.col("n"))).alias("dev"))

    own = materialize(middle(cells))
    off = cells.alias("c").join(own.alias("o"), F.col("c.lang").eqNullSafe(F.col("o.lang"))).select((F.col("c.e") - F.col("o.mid")).alias("e"), "c.n")
    usual = middle(off.groupBy("e").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("all"))).first()
    all_dev = F.lit(1.0 if usual is None else max(usual["dev"], 0.01))
    drawn = F.sqrt((F.col("seen") * F.col("dev") ** 2 + like * all_dev**2) / (F.col("seen") + like))
    return own.select("lang", "mid", (F.greatest(drawn, F.lit(0.005)) * F.sqrt(1 + np.pi / 2 / F.col("seen"))).alias("dev"))


def judge(docs: DataFrame, below: float = 4.0, above: float = 4.0, steady: float = 1500.0, grams: int = 1 << 23) -> DataFrame:
    """One row per row: base counts, entropy, perplexity, base_failed and kept.

    below, above: width of the bands in robust deviations, which for a text of n code points
    are wider by the root of 1 + ``steady`` / n, as a mean over fewer of them varies more.
    grams: about so many n-grams (8 bytes each) are broadcast at a time; a single language has
    64**4 at most.

    Null, empty and white-space texts have no words, so they fail the rules on counts; very
    long texts are scored whole; a language without any passing document rejects none by its
    band; a null language, or a table without a column lang, is a language of its own.  Repeated
    rows and rows without a doc_id give a row each, an empty table an empty one; other columns
    are ignored.  Of letters as common as each other those of lower code points get signs of their own.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    rows = with_row_id(only(docs, "doc_id", "text", "lang"))
    signs = alphabets(rows)
    counts = materialize(count_ngrams(rows, signs))
    scored = None
    for langs in groups_of_languages(counts, grams) or [[]]:
        own = F.lit(False)
        for lang in langs:
            own = own | F.col("lang").eqNullSafe(F.lit(lang))
        mine = score(rows.where(own & (F.octet_length("text") > 0)), signs, train(counts, langs))
        scored = mine if scored is None else scored.unionByName(mine)
    scored = materialize(scored.unionByName(score(rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) == 0), signs, {})))
    band = bands(scored)
    out = scored.alias("s").join(band.alias("b"), F.col("s.lang").eqNullSafe(F.col("b.lang")), "left").select("s.*", "b.mid", "b.dev")
    off = (F.col("entropy") - F.col("mid")) / F.col("dev") / F.sqrt(1 + steady / F.nullif(F.col("n_points"), F.lit(0)))
    inside = F.coalesce(off.between(-below, above), F.lit(True))
    return out.select("rid", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & inside).alias("kept"), "entropy", F.exp("entropy").alias("perplexity"), "lang")


def keep_passing(docs: DataFrame, **bounds) -> DataFrame:
    """``docs`` without the rows that the rules or the bands reject."""
    docs = as_files(docs)
    return without(docs, judge(docs, **bounds).where("not kept"))
