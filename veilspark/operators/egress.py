"""Last-mile restoration of outgoing content: texts, files and HTTP bodies."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARK, leftovers, substitute
from ..plans.storage import materialize
from . import restore
from .restore import lookup

BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def marked(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(MARK)), F.lit(False))


def restore_content(text: Column, tokens: Column) -> Column:
    """``struct<text, leftover>``: texts without a mark pass as they are, and leftovers keep repeats."""
    real = lookup(tokens)
    done = substitute(text, real)
    left = F.when(marked(text), leftovers(done, real)).otherwise(F.array().cast("array<string>"))
    return F.struct(done.alias("text"), left.alias("leftover"))


def restore_base64(body: Column, tokens: Column) -> Column:
    """Base64 of a text with a mark, restored inside; null for any other body."""
    plain = F.when(body.rlike(BASE64), F.try_to_binary(body, F.lit("base64"))).cast("string")
    text = F.try_validate_utf8(plain)
    packed = F.regexp_replace(F.base64(F.encode(substitute(text, lookup(tokens)), "UTF-8")), "[\r\n]", "")
    return F.when(marked(text), packed)


def restore_blob(body: Column, tokens: Column) -> Column:
    """``struct<body, changed>`` of a text body: marks in it, else base64 of a text with marks, else as it is."""
    inner = restore_base64(body, tokens)
    literal = marked(body)
    done = F.when(literal, substitute(body, lookup(tokens))).otherwise(F.coalesce(inner, body))
    return F.struct(done.alias("body"), (literal | inner.isNotNull()).alias("changed"))


def restore_bytes(body: Column, tokens: Column) -> Column:
    """``restore_blob`` of a binary body; bytes that are no UTF-8 stay."""
    text = F.try_validate_utf8(body.cast("string"))
    done = restore_blob(text, tokens)
    return F.struct(F.when(done["changed"], F.encode(done["body"], "UTF-8")).otherwise(body).alias("body"), F.coalesce(done["changed"], F.lit(False)).alias("changed"))


def restore_requests(requests: DataFrame, enabled: bool = True) -> DataFrame:
    """``requests (url, json, data, form, tokens, ...)`` with bodies restored and ``changed``.

    JSON is restored as text, keys included; where that breaks it (a value with a quotation
    mark), the whole request goes out as it was.  Of forms, the top values are restored.
    """
    if not enabled:
        return requests.withColumn("changed", F.lit(False))
    tokens = F.col("tokens")
    has_json = marked(F.col("json"))
    json = F.when(has_json, substitute(F.col("json"), lookup(tokens))).otherwise(F.col("json"))
    rows = requests.withColumn("__json", json).withColumn("__ok", ~has_json | F.try_parse_json(F.col("__json")).isNotNull())
    rows = rows.withColumn("__data", restore_blob(F.col("data"), tokens))
    form = F.transform_values("form", lambda k, v: substitute(v, lookup(tokens)))
    has_form = F.coalesce(F.exists(F.map_values("form"), marked), F.lit(False))
    changed = F.col("__ok") & (has_json | F.coalesce(F.col("__data.changed"), F.lit(False)) | has_form)
    pick = lambda new, old: F.when(F.col("__ok"), new).otherwise(F.col(old)).alias(old)
    others = [c for c in requests.columns if c not in ("json", "data", "form")]
    return rows.select(*others, pick(F.col("__json"), "json"), pick(F.col("__data.body"), "data"), pick(form, "form"), changed.alias("changed"))


def host(url: Column) -> Column:
    """The host of a URL as it stands there, with port and user: all that an audit line keeps of it."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def restored_audit(requests: DataFrame) -> DataFrame:
    """One line per request that was changed; the host alone, no values."""
    return requests.where("changed").select(F.lit("egress_http_restored").alias("kind"), host(F.col("url")).alias("host"))


def leftover_audit(rows: DataFrame, where: Column) -> DataFrame:
    """One line per row of ``(leftover, ...)`` with any."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return rows.where(F.size("leftover") > 0).select(F.lit("egress_leftover").alias("kind"), stamp.alias("ts"), where.alias("where"), F.col("leftover").alias("tokens"))


ALL = "all"


def with_map(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``tokens`` for the placeholders of ``text``, from one map ``known (token, real)`` of all vaults."""
    book = known.select(F.lit(ALL).alias("vault_key"), "token", "real")
    return restore.with_tokens(rows.withColumn("vault_key", F.lit(ALL)), book, text).drop("vault_key")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write files whole: beside the target first, then moved over it, so that readers never see half."""
    from pyarrow import fs

    for batch in batches:
        for target, text in zip(batch.column("target").to_pylist(), batch.column("text").to_pylist(), strict=True):
            store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", target))
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            beside = f"{place}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(beside) as f:
                f.write(text.encode())
            store.move(beside, place)
            sums = "{}/.{}.crc".format(*place.rsplit("/", 1))  # Hadoop's local files keep sums beside them, which hold no longer
            if store.get_file_info(sums).type == fs.FileType.File:
                store.delete_file(sums)
        yield pa.record_batch([batch.column("path")], ["path"])


def restore_files(spark: SparkSession, paths: str, known: DataFrame, out: str | None = None, audit: str | None = None) -> DataFrame:
    """Restore text files: those that change are written, in place or under the folder ``out``; returns ``(path, changed, leftover)``.

    known: ``(token, real)`` of all vaults.  Placeholders meet it in a join, however large it
    is.  audit: a folder that gets a line for every file with placeholders left over.  With
    ``out``, files that don't change are copied as well.  Files that are no UTF-8 stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
    files = with_map(files.where("value is not null"), known, "value")
    done = files.withColumn("r", restore_content(F.col("value"), F.col("tokens")))
    name = F.element_at(F.split("path", "/"), -1)
    target = F.col("path") if out is None else F.concat(F.lit(out.rstrip("/") + "/"), name)
    done = materialize(done.select("path", target.alias("target"), F.col("r.text").alias("text"), (F.col("r.text") != F.col("value")).alias("changed"), F.col("r.leftover").alias("leftover")))
    (done if out else done.where("changed")).select("path", "target", "text").mapInArrow(_written, "path string").count()
    told = done.select("path", "changed", "leftover")
    if audit:
        leftover_audit(done, F.concat(F.lit("file:"), name)).write.mode("append").json(audit)
    return told


def restore_for_send(rows: DataFrame, where: str = "send") -> tuple[DataFrame, DataFrame]:
    """``rows (text, tokens)`` with ``sent``, and audit lines for what could not be restored."""
    done = rows.withColumn("__r", restore_content(F.col("text"), F.col("tokens")))
    lines = leftover_audit(done.select(F.col("__r.leftover").alias("leftover")), F.lit(where))
    return done.withColumn("sent", F.col("__r.text")).drop("__r"), lines
