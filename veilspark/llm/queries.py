"""The corpus operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, images, packing, perplexity, ranking, sharding, simhash, stages, suffixes, token_counts
from .common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(read(spark, sf_dir, "documents"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: A prime of about 100 slots a shard keeps shares within a hundredth of each other.
SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(64)], 6421


def op3_sharding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.place(docs, F.col("doc_id"), SHARDS, SLOTS).select("doc_id", "slot", "shard", "n_bytes")


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each row of embeddings is drawn as one, and every tenth edited too."""
    return images.find_copies(images.pictures(read(spark, sf_dir, "embeddings")))


def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(read(spark, sf_dir, "documents")).drop("rid")


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.strip_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_crf, op2_quality_ranking, op3_sharding_lookup, op4_image_copies, op5_quality_perplexity, op6_suffix_merge, op7_bpe_prefix_dp, op8_mixture_packing, op9_token_counts, op10_simhash_ball)}
QUERIES["pipeline"] = stages.run

#: The lookup table, claimed slot by slot: each step keeps the table, the places and the turn.
ORACLE_SQL: dict[str, str] = {
    "op3_sharding_lookup": f"""
WITH RECURSIVE shards AS (
    SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS shard FROM range({len(SHARDS)}) AS r(i)
), hashed AS (
    SELECT i, shard,
        CAST('0x' || substr(md5(shard || '/offset'), 1, 15) AS BIGINT) % {SLOTS} AS start,
        CAST('0x' || substr(md5(shard || '/skip'), 1, 15) AS BIGINT) % {SLOTS - 1} + 1 AS skip
    FROM shards
), orders AS (
    SELECT list(start ORDER BY i) AS starts, list(skip ORDER BY i) AS skips FROM hashed
), claims AS (
    SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, list_transform(range({len(SHARDS)}), lambda x: CAST(0 AS BIGINT)) AS tries, list_transform(range({SLOTS}), lambda x: false) AS taken
    UNION ALL
    SELECT turn + 1, claimed, list_concat(list_concat(tries[1:k - 1], [j + 1]), tries[k + 1:]), list_concat(list_concat(taken[1:claimed], [true]), taken[claimed + 2:])
    FROM (
        SELECT turn, tries, taken, k, j, (starts[k] + j * skips[k]) % {SLOTS} AS claimed
        FROM (
            SELECT turn, tries, taken, starts, skips, turn % {len(SHARDS)} + 1 AS k,
                list_filter(range(tries[turn % {len(SHARDS)} + 1], {SLOTS}), lambda y: NOT taken[(starts[turn % {len(SHARDS)} + 1] + y * skips[turn % {len(SHARDS)} + 1]) % {SLOTS} + 1])[1] AS j
            FROM claims, orders WHERE turn < {SLOTS}
        )
    )
), slots AS (
    SELECT slot, (turn - 1) % {len(SHARDS)} AS i FROM claims WHERE turn > 0
)
SELECT d.doc_id, CAST(s.slot AS INTEGER) AS slot, h.shard, coalesce(strlen(d.text), 0) AS n_bytes
FROM documents d
JOIN slots s ON s.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS}
JOIN hashed h ON h.i = s.i
""",
}
