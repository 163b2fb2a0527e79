"""Operator 3: placement by a permutation-filled lookup table, in DataFrame functions alone.

Every shard orders the slots of a prime-sized table by its own permutation; shards take
turns and each claims the first slot in its order that is still free.  The table has a
fixed size, so its broadcast is bounded, and placing a row costs one lookup.  When a shard
joins or leaves, few slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: str) -> int:
    """The leading 60 bits of the MD5 of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int, weights: list[int] | None = None) -> list[int]:
    """The shard's place in ``shards`` for each slot; a shard of weight w takes w turns a round."""
    if not is_prime(size) or not shards or len(shards) > size or len(set(shards)) < len(shards):
        raise ValueError("the size must be a prime of at least the number of distinct shards")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("each shard needs a weight of 0 or more, and one of them more than 0")
    place = [number(f"{s}/offset") % size for s in shards]
    skip = [number(f"{s}/skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    turns = [i for i, w in enumerate(weights) for _ in range(w)]
    table, free = [-1] * size, size
    while free:
        for i in turns:
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % size
            table[place[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """A key's slot; a null key hashes as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, shards: list[str], table: list[int]) -> DataFrame:
    """(slot, shard) for each slot, from one literal."""
    literal = F.split(F.lit(",".join(map(str, table))), ",")
    names = F.array(*map(F.lit, shards))
    slots = spark.range(1).select(F.posexplode(literal).alias("slot", "place"))
    return slots.select("slot", F.get(names, F.col("place").cast("int")).alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], size: int = 65537, weights: list[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard``: a broadcast join with the table, no shuffle.

    Equal keys share a shard, null keys that of the empty text; an empty frame stays empty.
    Columns of those names that ``df`` has already are replaced.
    """
    table = table_frame(df.sparkSession, shards, lookup_table(shards, size, weights))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(key, size))
    return rows.join(F.broadcast(table), "slot")
