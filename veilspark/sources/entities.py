"""Sources of names: ``(surface, entity_type, ord)`` tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CLIENT

SCHEMA = "surface string, entity_type string, ord long"


def from_file(spark: SparkSession, path: str, default: str = CLIENT) -> DataFrame:
    """Lines ``surface<TAB>type``; blank lines and lines with # are left out, a missing type is the default.

    The last of equal names wins, by file and then by place in the file.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    lines = lines.select(F.trim("value", F.lit(" \t\r\n\f\x0b")).alias("line"), "at")
    lines = lines.where(~F.startswith("line", F.lit("#")) & (F.col("line") != ""))
    parts = F.split("line", "\t", 2)
    strip = lambda c: F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")
    return lines.select(strip(parts[0]).alias("surface"), F.coalesce(strip(F.get(parts, F.lit(1))), F.lit(default)).alias("entity_type"), F.col("at").alias("ord"))


def from_callable(spark: SparkSession, fn: Callable[[], Iterable[tuple[str, str]]]) -> DataFrame:
    return spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(fn())], SCHEMA)


def from_table(rows: DataFrame, default: str = CLIENT) -> DataFrame:
    """The first two columns of any query; empty surfaces go, an empty or missing type is the default."""
    surface = F.col(f"`{rows.columns[0]}`").cast("string")  # a query has no order: of equal names the last by type wins
    kind = F.nullif(F.col(f"`{rows.columns[1]}`").cast("string"), F.lit("")) if len(rows.columns) > 1 else F.lit(None).cast("string")
    out = rows.select(surface.alias("surface"), F.coalesce(kind, F.lit(default)).alias("entity_type"), F.lit(0).cast("long").alias("ord"))
    return out.where("surface <> ''")


def from_sql(spark: SparkSession, query: str, default: str = CLIENT, **frames: DataFrame) -> DataFrame:
    return from_table(spark.sql(query, **frames), default)


def from_jdbc(spark: SparkSession, url: str, query: str, default: str = CLIENT, **options: str) -> DataFrame:
    return from_table(spark.read.format("jdbc").options(url=url, query=query, **options).load(), default)


def parties(spark: SparkSession, query: str | None = None, **frames: DataFrame) -> DataFrame:
    """The customary query of a practice's database."""
    return from_sql(spark, query or f"select name, '{CLIENT}' as kind from {{parties}}", **frames)
