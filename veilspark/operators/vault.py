"""The vault: stable, reversible numbering of values, per vault key.

A vault is a table ``(vault_key, real, token, entity_type, n)``, unique in (vault_key, real);
rows without a key, or with an empty one, belong to the vault of no session.
A value's type is that of its first occurrence; its number counts the values of that type.
Occurrences are ordered by message, and within a message from right to left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmap import gathered
from ..functions.text import make_token, safe_type, session, vault_file_key
from ..plans.storage import materialize

#: Values per vault and type up to which one task numbers them.
ONE_TASK = 2_000_000
#: Leading bytes on which texts are searched first.
ANCHOR = 7


def first_seen(mentions: DataFrame) -> DataFrame:
    """One row per value of ``(vault_key, seq, start, entity_type, real)``: where it came first, and its type then.

    A null seq comes before all; of several types at one place the least counts.
    """
    place = F.struct("seq", (-F.col("start")).alias("back"), "entity_type")
    firsts = mentions.groupBy(session(F.col("vault_key")).alias("vault_key"), "real").agg(F.min(place).alias("at"))
    return firsts.withColumn("entity_type", F.col("at.entity_type"))


def ranked(firsts: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``firsts`` with ``n``, the rank among the values of a vault and type.

    Types that read alike in a placeholder are numbered together, so no two values share one.
    Where one group is large, ranks are counted within ranges and summed over ranges.
    """
    firsts = firsts.withColumn("kind", safe_type(F.col("entity_type")))
    keys = ["vault_key", "kind"]
    order = Window.partitionBy(*keys).orderBy("at", "real")
    largest = firsts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= one_task:
        return firsts.withColumn("n", F.row_number().over(order))
    parts = firsts.repartitionByRange(*keys, "at", "real").withColumn("part", F.spark_partition_id())
    parts = materialize(parts)  # the ranges must not be drawn twice
    sizes = parts.groupBy(*keys, "part").agg(F.count("*").alias("size"))
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("at", "real"))
    return parts.withColumn("r", inside).join(before, [*keys, "part"]).withColumn("n", (F.col("before") + F.col("r")).cast("int")).drop("part", "before", "r")


def assign(mentions: DataFrame, vault: DataFrame | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Vault rows for the values of ``mentions`` that ``vault`` does not have; numbers go on from it."""
    fresh = first_seen(mentions)
    if vault is not None:
        vault = vault.withColumn("vault_key", session(F.col("vault_key")))
        fresh = fresh.join(vault.select("vault_key", "real"), ["vault_key", "real"], "left_anti")
    new = ranked(fresh, one_task)
    if vault is not None:
        last = vault.groupBy("vault_key", safe_type(F.col("entity_type")).alias("kind")).agg(F.max("n").alias("last"))
        new = new.join(last, ["vault_key", "kind"], "left").withColumn("n", F.col("n") + F.coalesce("last", F.lit(0)))
    return new.select("vault_key", "real", make_token(F.col("entity_type"), F.col("n")).alias("token"), "entity_type", F.col("n").cast("int").alias("n"))


def extend(mentions: DataFrame, vault: DataFrame) -> DataFrame:
    """The vault with the new values of ``mentions``."""
    return vault.withColumn("vault_key", session(F.col("vault_key"))).unionByName(assign(mentions, vault))


def registered(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(vault_key, fresh)``: every session of ``messages`` once, and whether ``known`` has no vault of it yet."""
    every = messages.select(session(F.col("vault_key")).alias("vault_key")).distinct()
    if known is None:
        return every.withColumn("fresh", F.lit(True))
    have = sessions(known).withColumn("__have", F.lit(True))
    return every.join(have, "vault_key", "left").select("vault_key", F.col("__have").isNull().alias("fresh"))


def summary(vault: DataFrame) -> DataFrame:
    """Values per vault and type."""
    return vault.groupBy("vault_key", "entity_type").agg(F.max("n").cast("long").alias("n"))


def sessions(vault: DataFrame) -> DataFrame:
    return vault.select(session(F.col("vault_key")).alias("vault_key")).distinct()


def merged(vaults: DataFrame) -> DataFrame:
    """One token map of ``(path, token, real)`` rows: the first path in order wins."""
    return vaults.groupBy("token").agg(F.min_by("real", F.struct("path", "real")).alias("real"))


U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=U)
#: Bytes of a text that are searched at a time.
PIECE = 1 << 18
#: Strings that a task of ``candidates`` holds before it hands them on.
HELD = 10_000


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size + 1, b, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


def _hashes(data: np.ndarray, at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Hashes of the runs of ``length`` bytes at some places of at most ``size`` bytes, from running sums ``data``."""
    return (data[at + length] - data[at]) * _powers(size)[1][at] + U(length)


def _hashed(values: pa.Array, size: int, most: int | None = None) -> np.ndarray:
    """Hashes of whole values, or of their leading ``most`` bytes; none is longer than ``size``."""
    values = values.cast(pa.binary())
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data, out, i = np.frombuffer(values.buffers()[2] or b"", np.uint8), np.empty(len(values), U), 0
    while i < len(values):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        at, length = ends[i:j] - ends[i], np.diff(ends[i : j + 1])
        out[i:j] = _hashes(_sums(data[ends[i] : ends[j]], size), at, length if most is None else np.minimum(length, most), size)
        i = j
    return out


def _sums(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * _powers(size)[0][: len(data)], out=out[1:])
    return out


def _of_key(key: str) -> np.ndarray:
    return U(zlib.crc32(key.encode("utf-8", "surrogatepass")) * 0xD6E8FEB8 % (1 << 64))


def candidates(texts: DataFrame, values: DataFrame) -> DataFrame:
    """Strings of ``texts (vault_key, text)`` that may be ``values (vault_key, value)``, ``(vault_key, value)``: all that are, and few others.

    Texts are read where they are.  Two bitmaps, of leading bytes of values and of whole
    values by key, let one in 5000 strings pass each, up to 33 million values.  A task holds
    one text and ``HELD`` strings.
    """
    count = values.count()
    lengths = sorted(r[0] for r in values.select(F.length("value")).distinct().collect())
    longest = max(lengths, default=0)
    size = PIECE + longest

    def leading(batch: pa.RecordBatch) -> np.ndarray:
        return _hashed(batch.column("value"), size, ANCHOR)

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        return _hashed(batch.column("value"), size) ^ np.array([_of_key(k) for k in batch.column("vault_key").to_pylist()], U)

    spark = values.sparkSession
    heads = spark.sparkContext.broadcast(gathered(values, leading, count, per_entry=32, probes=4))
    bodies = spark.sparkContext.broadcast(gathered(values, whole, count, per_entry=32, probes=4))

    def packed(found: set[tuple[str, bytes]]) -> pa.RecordBatch:
        keys, strings = zip(*found, strict=True) if found else ((), ())
        return pa.record_batch([pa.array(keys, pa.string()), pa.array(strings, pa.binary())], ["vault_key", "value"])

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str, bytes]] = set()
            for key, text in zip(batch.column("vault_key"), batch.column("text").cast(pa.binary()), strict=True):
                key, text = key.as_py(), np.frombuffer(text.as_buffer(), np.uint8)
                own = _of_key(key)
                for start in range(0, len(text), PIECE):
                    data = text[start : start + PIECE + longest - 1]
                    sums, lead = _sums(data, size), {}
                    for n in lengths:
                        k = min(ANCHOR, n)
                        if k not in lead:
                            every = np.arange(max(0, len(data) - k + 1))
                            lead[k] = every[heads.value.has(_hashes(sums, every, k, size))] if len(every) else every
                        if not len(lead[k]):
                            continue
                        at = lead[k][lead[k] + n <= len(data)]
                        if len(at):
                            at = at[bodies.value.has(_hashes(sums, at, n, size) ^ own)]
                            for i in at.tolist():
                                out.add((key, data[i : i + n].tobytes()))
                                if len(out) >= HELD:
                                    yield packed(out)
                                    out.clear()
            yield packed(out)

    rows = texts.select(session(F.col("vault_key")).alias("vault_key"), "text").where("text is not null")
    return rows.mapInArrow(spot, "vault_key string, value binary")


def present(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """Per vault key, how many of its non-empty values stand in its texts ``(vault_key, text)``: the leak count.

    The ``candidates`` meet the values in a join on (key, string), so no text is shuffled and
    nothing rests on a hash.
    """
    values = vault.where("real <> ''").select(session(F.col("vault_key")).alias("vault_key"), F.encode("real", "UTF-8").alias("value")).distinct()
    values = materialize(values)
    found = candidates(texts, values).distinct().join(values, ["vault_key", "value"])
    counts = found.groupBy("vault_key").agg(F.count("*").alias("n_present"))
    return sessions(vault).join(counts, "vault_key", "left").select("vault_key", F.coalesce("n_present", F.lit(0)).cast("long").alias("n_present"))


def expired(vault_files: DataFrame, now: float, ttl: float) -> DataFrame:
    """Rows of ``(path, updated_at)`` that are past their time, counted from the last write."""
    return vault_files.where(F.lit(now) - F.col("updated_at") > ttl)


def file_name(session_id):
    return F.concat(vault_file_key(session_id), F.lit(".json"))
