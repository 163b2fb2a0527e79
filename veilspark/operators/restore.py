"""Inbound: placeholders back to values in texts, JSON and tool calls, and what could not be restored."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MARK, find_tokens, leftovers, session, substitute
from ..plans.storage import materialize

MAP = "map<string,string>"
#: A JSON string, with the colon that makes it a key.
LITERAL = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def lookup(tokens: Column) -> Callable[[Column], Column]:
    """The value of a placeholder in a map column; null where there is none."""
    return lambda t: F.try_element_at(tokens, t)


def with_tokens(rows: DataFrame, book: DataFrame, *texts: str | Column) -> DataFrame:
    """``rows (vault_key, ...)`` with ``tokens``, a map of the known placeholders that stand in ``texts``.

    Rows with the same placeholders need the same map, so it is the distinct lists of
    placeholders that meet the vault, in a join on (vault_key, token); a row never carries
    more of a vault than it needs, and equal rows or null keys are rows like any other.  Rows
    without a mark take no part in any join.  The maps are written first: few go to all
    executors, many are joined.
    """
    every = F.concat_ws(" ", *texts)
    rows = rows.withColumn("__key", session(F.col("vault_key"))).withColumn("__list", F.array_distinct(find_tokens(every)))
    marked = F.contains(every, F.lit(MARK))
    lists = rows.where(marked).select("__key", "__list").distinct()
    known = book.select(session(F.col("vault_key")).alias("__key"), "token", "real").groupBy("__key", "token").agg(F.min("real").alias("real"))
    found = lists.select("__key", "__list", F.explode("__list").alias("token")).join(known, ["__key", "token"])
    maps = materialize(found.groupBy("__key", "__list").agg(F.map_from_entries(F.collect_list(F.struct("token", "real"))).alias("tokens")))
    none = F.create_map().cast(MAP)
    done = rows.where(marked).join(maps, ["__key", "__list"], "left").withColumn("tokens", F.coalesce("tokens", none))
    return done.unionByName(rows.where(~marked).withColumn("tokens", none)).drop("__key", "__list")


def restore_by_join(rows: DataFrame, book: DataFrame, text: str = "text") -> DataFrame:
    """``rows (vault_key, text, ...)`` with ``restored``."""
    return with_tokens(rows, book, text).withColumn("restored", substitute(F.col(text), lookup(F.col("tokens")))).drop("tokens")


def restore_values(node, real: dict):
    """JSON with the placeholders in its texts restored; keys stay."""
    from ..streaming.deltas import restore_text

    if isinstance(node, str):
        return restore_text(node, real)
    if isinstance(node, list):
        return [restore_values(x, real) for x in node]
    if isinstance(node, dict):
        return {k: restore_values(v, real) for k, v in node.items()}
    return node


def json_restored(text: str | None, real: dict[str, str]) -> str | None:
    """JSON text with values restored, written anew; text that is no JSON is restored as it is."""
    if text is None or MARK not in text and "\\u27e6" not in text.lower():
        return text
    try:
        node = json.loads(text)
    except ValueError:
        return restore_values(text, real)
    return json.dumps(restore_values(node, real), ensure_ascii=False)


TRIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def attempted(fn: Callable[[str | None, dict[str, str]], str | None]) -> Callable[[Column, Column], Column]:
    """A function of a text and its map as a column function: ``struct<text, error>``; where it fails the text is what came in.

    One row at a time is Python objects, and no filter on the result makes Spark run it again (see ``detect.attempted``).
    """

    @F.arrow_udf(TRIED)
    def run(texts: pa.Array, maps: pa.Array) -> pa.Array:
        out, errors = [], []
        for text, real in zip(texts, maps, strict=True):
            text, error = text.as_py(), None
            try:
                text = fn(text, dict(real.as_py() or ()))
            except Exception as e:  # told to the caller; the other rows go on
                error = repr(e)
            out.append(text)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return run.asNondeterministic()


_json = attempted(json_restored)


def restore_json(text: Column, tokens: Column) -> Column:
    """``json_restored`` by column; a text that can't be handled (nested too deeply) stays as it is."""
    return _json(text, tokens)["text"]


def report(rows: DataFrame, book: DataFrame, restorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``rows (vault_key, content, arguments array<string>, ...)`` restored, with what is left over.

    leftover: placeholders that no value is known for, each once, as they come in content
    and then arguments.  restored_any: whether the vault holds anything at all.  restorer: for
    content that column functions don't fit, ``attempted`` of any function; where it
    fails, ``error`` tells so and the row goes on as it came.
    """
    names = [c for c in rows.columns if c not in ("leftover", "restored_any", "error")]
    rows = with_tokens(rows.select(*names), book, "content", "arguments").withColumn("__key", session(F.col("vault_key")))
    holds = book.select(session(F.col("vault_key")).alias("__key")).distinct().withColumn("__any", F.lit(True))
    rows = rows.join(holds, "__key", "left")
    real = lookup(F.col("tokens"))
    content, error = substitute(F.col("content"), real), F.lit(None).cast("string")
    if restorer is not None:
        rows = rows.withColumn("__tried", restorer(F.col("content"), F.col("tokens")))
        content, error = F.col("__tried.text"), F.col("__tried.error")
    arguments = F.transform(F.coalesce("arguments", F.array().cast("array<string>")), lambda a: substitute_json(a, F.col("tokens")))
    out = rows.withColumns({"error": error, "__content": content, "__arguments": arguments})
    failed = F.col("error").isNotNull()
    out = out.withColumn("content", F.when(failed, F.col("content")).otherwise(F.col("__content")))
    out = out.withColumn("arguments", F.when(failed, F.col("arguments")).otherwise(F.col("__arguments")))
    left = F.concat(leftovers(F.col("content"), real), F.flatten(F.transform(F.coalesce("arguments", F.array().cast("array<string>")), lambda a: leftovers(a, real))))
    left = F.when(failed, F.array().cast("array<string>")).otherwise(F.array_distinct(left))
    return out.select(*names, left.alias("leftover"), F.coalesce("__any", F.lit(False)).alias("restored_any"), "error")


def substitute_json(text: Column, tokens: Column) -> Column:
    """Restoration inside JSON text without parsing: values are escaped, and keys stay.

    A text in JSON is a key if a colon follows it, so the text is cut at its string literals.
    """
    pieces = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))
    gaps = F.split(text, LITERAL, -1)
    escaped = lambda t: F.regexp_replace(F.to_json(F.struct(F.try_element_at(tokens, t).alias("v"))), '^\\{"v":"|"\\}$|^\\{\\}$', "")
    real = lambda t: F.when(F.map_contains_key(tokens, t), escaped(t))
    values = F.transform(pieces, lambda p: F.when(F.endswith(p, F.lit(":")), p).otherwise(substitute(p, real)))
    joined = F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    is_json = F.try_parse_json(text).isNotNull()
    return F.when(~F.contains(text, F.lit(MARK)), text).when(is_json, joined).otherwise(substitute(text, lookup(tokens)))
