"""Durable vaults: JSON files, one per session or agent, and tables of many."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import NO_SESSION, VAULT_TTL_SECONDS
from ..functions.text import safe_type, session
from ..operators import vault as V
from ..plans.storage import filesystem, private, remove

FILE = "ts double, real_to_token map<string,string>, token_to_real map<string,string>, counters map<string,int>, _corrupt string"
DAY = float(VAULT_TTL_SECONDS)


def read_files(spark: SparkSession, paths: str, ttl: float | None = DAY, now: float | None = None) -> DataFrame:
    """``(path, updated_at, token, real)`` of all readable files; broken ones are empty, old ones left out."""
    rows = spark.read.schema(FILE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths, multiLine=True)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("ms"))
    rows = rows.select("path", (F.col("ms") / 1000).alias("updated_at"), F.explode("token_to_real").alias("token", "real"))
    return rows if ttl is None else rows.where(F.lit(time.time() if now is None else now) - F.col("updated_at") <= ttl)


def token_map(spark: SparkSession, paths: str) -> DataFrame:
    """One map from all files, whatever their age: the first path in order wins."""
    return V.merged(read_files(spark, paths, ttl=None))


def as_documents(book: DataFrame, most: int = 100_000) -> DataFrame:
    """JSON documents ``(name, value)`` of vaults, under names that do not tell the id.

    A vault of more than ``most`` values is dealt by value into several documents, each with
    all counters, so no row holds a whole large vault.
    """
    book = book.withColumn("vault_key", session(F.col("vault_key")))
    sizes = book.groupBy("vault_key").agg(F.ceil(F.count("*") / most).alias("of"))
    dealt = book.join(sizes, "vault_key").withColumn("shard", F.pmod(F.xxhash64("real"), F.col("of")))
    by_type = book.groupBy("vault_key", safe_type(F.col("entity_type")).alias("k")).agg(F.max("n").alias("n"))
    counters = by_type.groupBy("vault_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counters"))
    maps = dealt.groupBy("vault_key", "shard").agg(F.map_from_entries(F.collect_list(F.struct("real", "token"))).alias("real_to_token"), F.map_from_entries(F.collect_list(F.struct("token", "real"))).alias("token_to_real"))
    rows = maps.join(counters, "vault_key").withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6)
    name = F.when(F.col("shard") == 0, V.file_name(F.col("vault_key"))).otherwise(F.concat(V.vault_file_key(F.col("vault_key")), F.lit("-"), "shard", F.lit(".json")))
    return rows.select(name.alias("name"), F.to_json(F.struct("ts", "real_to_token", "token_to_real", "counters")).alias("value"))


def put(documents: DataFrame, path: str) -> None:
    """Each of ``documents (name, value)`` as a file under ``path/name=<name>/``.

    A file costs much more than its bytes, so all cores share the files, however small; by
    their bytes alone few tasks would write all of them.
    """
    tasks = 4 * documents.sparkSession.sparkContext.defaultParallelism
    documents.repartition(tasks, "name").write.mode("append").partitionBy("name").text(path)


def write_files(book: DataFrame, path: str) -> None:
    """One JSON document per vault under ``path/name=<key>.json/``, for the owner alone; ``read_files(path/*)`` reads them.

    They are written beside and renamed into place, so what was there stays until all are written.
    """
    spark = book.sparkSession
    beside = private(spark, f"{path.rstrip('/')}_{uuid.uuid4().hex}")
    put(as_documents(book), beside)
    remove(spark, path)
    fs, place = filesystem(spark, path)
    if not fs.rename(filesystem(spark, beside)[1], place):
        raise OSError(f"{path}: another writer has put files in place")


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs, place = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("version=")) if fs.exists(place) else []


def save(book: DataFrame, path: str, known: DataFrame | None = None) -> bool:
    """Write vaults as a new version of a table; whether there was anything to write.

    known: the vault as it was loaded; where ``book`` has no value beyond it, nothing is
    written.  A version is written beside the others and then renamed into place, so readers
    see the old or the new one, never half; the one before stays for those that still read it.  Rows
    lie in buckets of the hashed key, so no folder tells an id, and only the owner can enter the table.
    """
    spark = book.sparkSession
    if known is not None and book.select("vault_key", "real").join(known.select("vault_key", "real"), ["vault_key", "real"], "left_anti").isEmpty():
        return False
    fs, _ = filesystem(spark, private(spark, path))
    beside = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    rows = book.withColumns({"updated_at": F.unix_micros(F.current_timestamp()) / 1e6, "bucket": F.substring(V.vault_file_key(F.col("vault_key")), 1, 2)})
    rows.write.partitionBy("bucket").parquet(beside)
    before = _versions(spark, path)
    number = int(before[-1].split("=")[1]) + 1 if before else 0
    if not fs.rename(filesystem(spark, beside)[1], filesystem(spark, f"{path.rstrip('/')}/version={number:09d}")[1]):
        raise OSError(f"{path}: another writer has put version {number} in place; load again and save")
    remove(spark, *[f"{path.rstrip('/')}/{v}" for v in before[:-1]])
    return True


def load(spark: SparkSession, path: str, ttl: float = DAY, now: float | None = None) -> DataFrame | None:
    """The rows of vaults of the latest version that were written within ``ttl`` seconds; none where nothing was saved."""
    versions = _versions(spark, path)
    if not versions:
        return None
    rows = spark.read.parquet(f"{path.rstrip('/')}/{versions[-1]}").drop("bucket")
    live = rows.groupBy("vault_key").agg(F.max("updated_at").alias("t")).where(F.lit(time.time() if now is None else now) - F.col("t") <= ttl)
    return rows.join(live.select("vault_key"), "vault_key", "left_semi").drop("updated_at")


def sweep(rows: DataFrame, ttl: float = DAY, now: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows ``(vault_key, updated_at, ...)`` that stay, and the keys of the vaults that have run out."""
    last = rows.groupBy("vault_key").agg(F.max("updated_at").alias("updated_at"))
    gone = V.expired(last, time.time() if now is None else now, ttl).select("vault_key")
    return rows.join(gone, "vault_key", "left_anti"), gone


def clear(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of all other vaults; an empty or missing key stands for the vault of no session."""
    named = [k or NO_SESSION for k in keys]
    return rows.where(~session(F.col("vault_key")).isin(*named)) if named else rows
