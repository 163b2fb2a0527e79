"""Operator 10: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a common variant within half of it, so each
distinct fingerprint emits its whole ball of half the radius and equal variants meet in a
shuffle.  A ball holds a fixed number of fingerprints, which bounds every group whatever
the corpus; copies collapse to one fingerprint before any variant is made.

``near_duplicates`` links fingerprints of 64 bits.  ``near_copies`` finds texts of a given
similarity, which differ in more bits than one ball can reach: texts with a MinHash band in
common meet, and pairs whose fingerprints are not too far apart are verified on their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmap import gathered
from .common import as_files, materialize, only, slices, trim, with_row_id, without


def fingerprint(text: str | None, words: int = 3, step: int = 1 << 18) -> int:
    """Majority vote, bit by bit, of the XXH64 (seed 42) of all word shingles of a text."""
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    size = min(words, len(found))
    n = len(found) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        part = found[at : at + step + size - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(size)], strict=False))
        hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, min(step, n - at))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Per row: row number, doc_id and fingerprint (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4000, 8 << 20):
            marks = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), pa.array(marks.view(np.int64))], ["rid", "doc_id", "fp"])

    rows = with_row_id(only(docs, "doc_id", "text"))
    return rows.mapInArrow(run, "rid long, doc_id long, fp long")


def masks(bits: int) -> list[int]:
    """All changes of at most ``bits`` of 64 bits, as signed longs."""
    found = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a > b, of distinct fingerprints that connect all within ``radius`` bits.

    The radius is even.  Members of a variant's group are then all within reach of each other,
    so pairing neighbours in numeric order loses no connection.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    spread = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius // 2)]))
    balls = marks.select("fp", spread.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    pairs = balls.select(F.col("fp").alias("a"), F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("b")).where("b is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(pairs: DataFrame, most: int = 60) -> DataFrame:
    """``(node, root)`` for every node in ``pairs (a, b)`` but the roots; root: the smallest reachable.

    Alternating large and small stars; each round is written to the shared folder.
    """
    edges = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(edges)
    for _ in range(most):
        if not seen[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        edges = materialize(small)
        if (now := mark(edges)) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, fingerprint, component_id and the rid of its keeper.

    Null, empty and white-space texts have fingerprint zero and link like any other; very
    long texts are read whole.  Ties and repeated rows: the smallest doc_id keeps the
    component, then the first row; rows without a doc_id come last, and a component of such
    rows alone has a null id.  An empty table gives an empty one; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    marks = rows.groupBy("fp").agg(first.alias("first"))
    roots = components(links(marks.select("fp"), radius))
    marks = marks.join(roots, marks["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    marks = materialize(marks)
    heads = marks.groupBy("root").agg(F.min("first").alias("head"))
    marks = marks.join(heads, "root").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("keeper"))
    return rows.join(marks, "fp").select("rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keeper")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, one without words has none."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    size = min(words, len(found))
    shingles = map(b" ".join, zip(*[found[i:] for i in range(size)], strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(found) - size + 1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two texts without words are equal."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - same
    return same / every if every else 1.0


def spread_bits(hashes: np.ndarray, longs: int, step: int = 255 * 16) -> np.ndarray:
    """Majority vote of ``longs`` independent 64-bit hashes of each shingle, as signed longs."""
    ones = np.zeros(longs * 64, np.int64)
    salts = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step, None] ^ salts
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of bytes that fit into a byte
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def differing(similar: float) -> float:
    """The share of bits in which two texts of some Jaccard similarity differ: the angle between their sets of shingles."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def plan(similar: float, recall: float = 0.97, size: int = 8) -> int:
    """The number of bands of ``size`` minima, of which texts that are just so similar have one or more in common with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**size))


def bands_of(hashes: np.ndarray, bands: int, size: int = 8, step: int = 256) -> np.ndarray:
    """MinHash bands of a set of shingles: for each a hash of the least of its shingles in ``size`` orders, as signed longs.

    Two sets have the same least shingle in an order with the probability of their Jaccard similarity.
    """
    salts = np.arange(1, bands * size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    least = np.full(bands * size, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), step):
        h = hashes[at : at + step, None] ^ salts
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, h.min(axis=0), out=least)
    least = least.reshape(bands, size)
    out = np.zeros(bands, np.uint64)
    for i in range(size):
        out = (out ^ least[:, i]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def candidates(marks: DataFrame, longs: list[str], bands: int, far: float, some: range) -> DataFrame:
    """Distinct pairs ``(a, b)``, a > b, of ``marks (id, root, longs..., bands)`` of different roots that have one of ``some`` bands in common.

    Those with an equal band meet the least root of it, and the least root of those that are equal
    in the next band as well, unless they have it already; so a text has two pairs a band at most, however many
    are like it.  Pairs whose fingerprints differ in more than ``far`` bits are left out: they are unlike.
    """
    rows = [F.struct(F.lit(t).alias("t"), F.element_at("bands", t + 1).alias("v"), F.element_at("bands", (t + 1) % bands + 1).alias("w")) for t in some]
    each = marks.select("id", "root", *longs, F.inline(F.array(*rows)))
    first, mixed = F.min(F.struct("root", "id", *longs)).alias("head"), (F.min("root") < F.max("root")).alias("mixed")
    crowd = materialize(each.join(each.groupBy("t", "v").agg(first, mixed).where("mixed").drop("mixed"), ["t", "v"]))
    nearer = crowd.groupBy("t", "v", "w").agg(first, mixed).where("mixed").drop("mixed")
    off = reduce(Column.__add__, [F.bit_count(F.col(f).bitwiseXOR(F.col(f"head.{f}"))) for f in longs])
    both = crowd.unionByName(crowd.drop("head").join(nearer, ["t", "v", "w"]))
    found = both.where((F.col("root") != F.col("head.root")) & (off <= far))
    return found.select(F.greatest("id", "head.id").alias("a"), F.least("id", "head.id").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """The ``pairs (a, b)`` whose ``texts (id, text)`` are as similar as that, shingle by shingle."""
    left = pairs.join(texts.withColumnRenamed("id", "a").withColumnRenamed("text", "x"), "a")
    both = left.join(texts.withColumnRenamed("id", "b").withColumnRenamed("text", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        sets = lru_cache(maxsize=64)(lambda z: shingle_hashes(plain.decompress(z).decode(), words))  # the next pairs often share a text
        for batch in batches:
            keep = [similarity(sets(x), sets(y)) >= similar for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            trim()

    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, similar: float = 0.8, recall: float = 0.97, lead: int = 4) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, component_id and the rid of its keeper, for texts of a Jaccard similarity of ``similar`` or more.

    MinHash bands and a fingerprint of 128 bits stand for each distinct sequence of words.
    Texts with a band in common meet; of the pairs, those whose fingerprints are too far apart
    for the similarity go, and the others are verified on their shingles.  Unlike texts hardly ever have a band in common,
    so pairs grow with the texts alone.  The first ``lead`` bands come before the others, and what they have joined is not
    paired again, so a large group has few pairs for each of its texts.  Two texts of just that similarity meet with probability
    ``recall`` or more, of a higher one almost surely; a pair that is reported is one.

    Null, empty and white-space texts have no shingles and are equal to each other; a text
    of fewer words is one shingle; very long texts are read whole.  Ties and repeated rows: the
    smallest doc_id keeps the component, then the first row; rows without a doc_id come
    last, and a component of such rows alone has a null id.  An empty table gives an empty one.
    """
    docs = as_files(only(docs, "doc_id", "text"))
    rows = with_row_id(docs)
    bands = plan(similar, recall)
    longs = ["f0", "f1"]
    fields = ["rid", "doc_id", "k0", "k1", *longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text", 2000, 4 << 20):
            keys, marks, found = [], [], []
            for text in batch.column("text").to_pylist():
                whole = xxhash.xxh3_128_digest(b" ".join((text or "").encode().lower().split()))
                keys.append(np.frombuffer(whole, "<i8"))
                shingles = shingle_hashes(text, words)
                marks.append(spread_bits(shingles, len(longs)))
                found.append(bands_of(shingles, bands))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * bands, pa.int32()), pa.array(np.concatenate(found)))
            columns = np.concatenate((np.array(keys), np.array(marks)), axis=1).T
            yield pa.record_batch([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), *map(pa.array, map(np.ascontiguousarray, columns)), values], [*fields, "bands"])

    marks = materialize(rows.mapInArrow(run, ", ".join(f"{f} long" for f in fields) + ", bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    classes = marks.groupBy("k0", "k1").agg(first, *[F.min(f).alias(f) for f in (*longs, "bands")])
    classes = materialize(classes.withColumn("id", F.col("k0")))  # from the words alone, so another place of the files changes nothing
    p = differing(similar)
    far = 64 * len(longs) * p + 5 * math.sqrt(64 * len(longs) * p * (1 - p))
    rows_of = classes.select("id", F.col("first.rid").alias("rid"))
    many = classes.count()

    def texts_of(pairs: DataFrame) -> DataFrame:
        """``(id, text)`` of all that stand in pairs."""
        ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        ends = materialize(rows_of.join(ends, "id", "left_semi"))
        wanted = docs.sparkSession.sparkContext.broadcast(gathered(ends, lambda b: b.column("rid").to_numpy(), many, most=1 << 27))

        def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = zstandard.ZstdCompressor(3)
            for batch in slices(batches, "text", 2000, 8 << 20):
                batch = batch.filter(pa.array(wanted.value.has(batch.column("rid").to_numpy())))
                texts = [own.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
                yield pa.record_batch([batch.column("rid"), pa.array(texts, pa.binary())], ["rid", "text"])

        return materialize(rows.select("rid", "text").mapInArrow(press, "rid long, text binary").join(ends, "rid").select("id", "text"))

    links = roots = None
    for some in filter(None, (range(min(lead, bands)), range(min(lead, bands), bands))):
        known = classes.select("id", *longs, "bands")
        if roots is None:
            known = known.withColumn("root", F.col("id"))
        else:
            known = known.join(roots, known["id"] == roots["node"], "left").select("id", *longs, "bands", F.coalesce("root", "id").alias("root"))
        pairs = materialize(candidates(known, longs, bands, far, some))
        near = verified(pairs, texts_of(pairs), words, similar)
        links = materialize(near if links is None else links.unionByName(near))
        roots = components(links)
    classes = classes.join(roots, classes["id"] == roots["node"], "left").select("k0", "k1", "first", F.coalesce("root", "id").alias("root"))
    classes = materialize(classes)
    heads = classes.groupBy("root").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "root").select("k0", "k1", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("keeper"))
    return marks.select("rid", "doc_id", "k0", "k1").join(classes, ["k0", "k1"]).select("rid", "doc_id", "component_id", "keeper")


def keep_one(docs: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """``docs`` without the rows that another row of their component stands for; see ``near_copies``."""
    docs = as_files(docs)
    found = near_copies(docs, words, similar)
    return without(docs, found.where("rid <> keeper or not doc_id <=> component_id"))
