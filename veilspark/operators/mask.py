"""Outbound: detection, numbering, replacement, instruction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPANS, replace_spans, session
from ..plans.storage import materialize, numbered
from . import detect, gazetteer, resolve, vault

INSTRUCTION = (
    "Marks like ⟦TYPE_NUMBER⟧ (such as ⟦לקוח_1⟧) stand for protected values. Keep every mark exactly as it is, "
    "in tables, lists and tool arguments alike; never translate, drop, explain or invent what it stands for."
)


def findings(rows: DataFrame, names: DataFrame | None = None, never: list[str] | None = None, secondary: Callable[[Column], Column] | None = None, primary: Callable[[Column], Column] | None = None, once: bool = False, types: tuple[str, ...] | None = None) -> DataFrame:
    """``(__row, vault_key, seq, spans, error, missed)`` of numbered messages with any; spans resolved, in order.

    names: a gazetteer.  never: texts that stay.  primary: what finds identifiers, by default
    ``detect.attempt``.  secondary: a recognizer of further spans, which give way to all
    others.  Both give ``struct<spans, error>``; error: nothing was found because the primary
    failed, missed: the secondary failed.  once: look at each distinct content once, which
    pays where the secondary is slow and contents come again.  types: without a primary of
    one's own, the entity types to look for; all by default.
    """
    texts = rows.select("__row", session(F.col("vault_key")).alias("vault_key"), "seq", "text").where("text is not null")
    if names is None and secondary is None and primary is None:
        texts = texts.where(detect.possible(F.col("text")))
    if types is not None and primary is None:
        primary = detect.only(*types)
    if once:
        digest = F.sha2(F.col("text"), 256).alias("__digest")
        contents = texts.groupBy(digest).agg(F.first("text").alias("text"))
        seen = materialize(_seen(contents.withColumnRenamed("__digest", "__row"), names, never, secondary, primary))
        found = texts.select("__row", "vault_key", "seq", digest).join(seen.withColumnRenamed("__row", "__digest"), "__digest").drop("__digest")
    else:
        found = _seen(texts, names, never, secondary, primary)
    return found.select("__row", "vault_key", "seq", "spans", "error", "missed")


def _seen(texts: DataFrame, names, never, secondary, primary) -> DataFrame:
    """Spans and errors of ``texts (__row, text, ...)``, without the texts."""
    asked = {"__p": (primary or detect.attempt)(F.col("text"))}
    if secondary is not None:
        asked["__s"] = secondary(F.col("text"))
    out = texts.withColumns(asked)  # in one step: a text goes to one Python worker
    found = F.coalesce("__p.spans", F.array().cast(SPANS))
    if names is not None:
        listed = materialize(gazetteer.names(names))
        if (match := gazetteer.matcher(listed)) is not None:
            out = out.withColumn("__named", match(F.col("text")))
        else:
            hits = gazetteer.find_names(texts.select("__row", "text"), names, key="__row").withColumnRenamed("spans", "__named")
            out = out.join(hits, "__row", "left")
        found = F.concat(found, F.coalesce("__named", F.array().cast(SPANS)))
    kept, missed = resolve.drop_never(found, never or []), F.lit(None).cast("string")
    if secondary is None:
        kept = resolve.resolve(kept)
    else:
        kept, missed = resolve.merge(kept, resolve.drop_never(F.coalesce("__s.spans", F.array().cast(SPANS)), never or [])), F.col("__s.error")
    others = [c for c in texts.columns if c != "text"]
    out = out.select(*others, kept.alias("spans"), F.col("__p.error").alias("error"), missed.alias("missed"))
    return out.where((F.size("spans") > 0) | F.col("error").isNotNull() | F.col("missed").isNotNull())


def spans(messages: DataFrame, **finding) -> DataFrame:
    """``(vault_key, seq, spans)`` of each of ``messages (vault_key, seq, text)`` that has any."""
    return findings(numbered(messages), **finding).where(F.size("spans") > 0).select("vault_key", "seq", "spans")


def mentions(found: DataFrame) -> DataFrame:
    """``(vault_key, seq, start, entity_type, real)`` of ``spans()`` or ``findings()``."""
    rows = found.select("vault_key", "seq", F.explode("spans").alias("s"))
    return rows.select("vault_key", "seq", F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("real"))


def mask(messages: DataFrame, known: DataFrame | None = None, closed: bool = False, **finding) -> tuple[DataFrame, DataFrame]:
    """``messages (vault_key, seq, text, ...)`` with ``masked``, ``error`` and ``missed``, and the vault that undoes it.

    A row is told apart by its place in the files, so equal rows, and rows without a key or a
    seq, are masked like any other; rows without a key share the vault of no session.  Values
    meet their tokens in a join on (vault_key, real), and only places and tokens go back to
    the texts; texts that cannot hold a value take no part in any join.

    A null text stays null.  A row on which detection fails, or of which a value has no
    token, carries an ``error``; its text goes out as it was, or not at all where ``closed``.
    Columns of those three names that come in are replaced.
    """
    kept = [c for c in messages.columns if c not in ("masked", "error", "missed", "__row")]
    rows = numbered(messages.select(*kept))
    found = materialize(findings(rows, **finding))
    seen = mentions(found)
    book = materialize(vault.extend(seen, known) if known is not None else vault.assign(seen))
    marks = found.select("__row", "vault_key", F.explode("spans").alias("s")).withColumn("real", F.col("s.text"))
    marks = marks.join(book.select("vault_key", "real", "token"), ["vault_key", "real"], "left")
    per = marks.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end", "token"))).alias("__marks"))
    told = found.where("error is not null or missed is not null").select("__row", "error", "missed")
    per = materialize(per.join(told, "__row", "full"))
    lacking = F.when(F.exists("__marks", lambda m: m["token"].isNull()), F.lit("a value has no token"))
    per = per.withColumn("error", F.coalesce("error", lacking))
    maybe = F.lit(True)
    if all(finding.get(k) is None for k in ("names", "secondary", "primary")):
        maybe = F.coalesce(detect.possible(F.col("text")), F.lit(False))
    done = rows.where(maybe).join(per, "__row", "left")
    instead = F.lit(None).cast("string") if closed else F.col("text")
    text = F.when(F.col("error").isNotNull(), instead).when(F.col("__marks").isNull(), F.col("text")).otherwise(replace_spans(F.col("text"), F.col("__marks")))
    out = done.withColumn("masked", text).select(*kept, "masked", "error", "missed")
    none = F.lit(None).cast("string")
    rest = rows.where(~maybe).select(*kept, F.col("text").alias("masked"), none.alias("error"), none.alias("missed"))
    return out.unionByName(rest), book


def instruct(messages: DataFrame, book: DataFrame, instruction: str = INSTRUCTION, text: str = "masked") -> DataFrame:
    """Sessions with a vault get the instruction: before the first system text, or as a message of its own in front.

    Only rows of the role ``system`` meet anything; all others pass as they are.  The first is
    that of the least seq, then of the first place.  Other columns of an added message are null.
    """
    keyed = messages.withColumn("__key", session(F.col("vault_key")))
    active = book.select(session(F.col("vault_key")).alias("__key")).distinct()
    system = F.coalesce((F.col("role") == "system") & F.col(text).isNotNull(), F.lit(False))
    lead = numbered(keyed.where(system))
    heads = lead.groupBy("__key").agg(F.min(F.struct("seq", "__row")).alias("__head"))
    lead = lead.join(active.join(heads, "__key"), "__key", "left")
    first = F.coalesce(F.col("__row") == F.col("__head.__row"), F.lit(False))
    lead = lead.withColumn(text, F.when(first, F.concat(F.lit(instruction + "\n\n"), text)).otherwise(F.col(text)))
    lacking = active.join(heads, "__key", "left_anti")
    origin = keyed.groupBy("__key").agg(F.max("vault_key").alias("vault_key"))
    kinds = dict(messages.dtypes)
    given = {"vault_key": F.col("vault_key"), "seq": F.lit(-1).cast(kinds["seq"]), "role": F.lit("system"), text: F.lit(instruction)}
    added = origin.join(lacking, "__key").select(*[given.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in messages.columns])
    return lead.select(*messages.columns).unionByName(keyed.where(~system).select(*messages.columns)).unionByName(added)
