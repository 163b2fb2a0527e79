"""Shared storage for results that are used more than once, and numbers of rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: What this process has written, until it is removed.
_WRITTEN: list[str] = []


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a folder under its warehouse; on a
    cluster, whose executors would each write to a disk of their own, this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def private(spark: SparkSession, path: str) -> str:
    """``path`` as a folder that only its owner can enter; what is written into it needs no rights of its own."""
    fs, place = filesystem(spark, path)
    if not fs.exists(place):
        fs.mkdirs(place, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, place = filesystem(spark, path)
        fs.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, everything that was written to the shared folder meanwhile.

    Results are lazy: write or collect them before the end.
    """
    before = len(_WRITTEN)
    try:
        yield
    finally:
        mine = _WRITTEN[before:]
        del _WRITTEN[before:]
        remove(spark, *mine)


def clear(spark: SparkSession) -> None:
    """Remove everything that this process has written to the shared folder."""
    remove(spark, *_WRITTEN)
    _WRITTEN.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Only the owner may read it; ``scratch`` and ``clear`` remove it.
    """
    spark = df.sparkSession
    path = private(spark, shared_dir(spark))
    _WRITTEN.append(path)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only filters and selects from files, so that a row's file and place are its own."""
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = [line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()]
    if not nodes or set(nodes) - {"Project", "Filter", "SubqueryAlias", "Relation"}:
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def as_files(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder unless it is read from files as it is: reading it again gives the same rows."""
    return df if is_scan(df) else materialize(df)


def numbered(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with a struct that tells its rows apart, equal rows too, and is the same each time ``df`` is read.

    It is a hash of the file and the place there, so lost executors and other splits of files change nothing.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    return as_files(df.drop(name)).select("*", place.alias(name))
