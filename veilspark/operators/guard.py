"""Modes, rows that fail, and alerts as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import MODES
from ..functions.text import session
from . import mask as M
from . import restore as R
from . import vault as V

ALERT = "kind string, session_id string, detail string"


def mode_of(text: str | None) -> str:
    """The mode that a control text names; anything else is off."""
    found = (text or "").strip().lower()
    return found if found in MODES else "off"


def alerts(rows: DataFrame, failed_kind: str = "restore_error", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Events of ``rows (session_id, error, leftover)``: an error, or else placeholders left over.

    wanted: the kinds that a deployment wants to hear of; all by default.
    """
    kind = F.when(F.col("error").isNotNull(), failed_kind).when(F.size("leftover") > 0, "leftover_token")
    detail = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.array_join("leftover", ","))
    events = rows.select(kind.alias("kind"), "session_id", detail.alias("detail")).where("kind is not null")
    return events if wanted is None else events.where(F.col("kind").isin(*wanted))


def outbound_alerts(sent: DataFrame) -> DataFrame:
    """Events of masked messages: ``unfiltered_sent`` for rows that went out as they came (``withheld`` for those that
    did not go out), ``recognizer_error`` for rows on which the secondary recognizer failed."""
    key = session(F.col("vault_key")).alias("session_id")
    failed = F.when(F.col("sent").isNull(), "withheld").otherwise("unfiltered_sent")
    first = sent.where("error is not null").select(failed.alias("kind"), key, F.col("error").alias("detail"))
    return first.unionByName(sent.where("missed is not null").select(F.lit("recognizer_error").alias("kind"), key, F.col("missed").alias("detail")))


def message(product: str = "veilspark") -> Column:
    """An alert as a line for people."""
    return F.format_string(f"[{product}] %s (session %s): %s", "kind", "session_id", "detail")


def flush(events: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Hand the events of a batch to every sink; also fit for ``foreachBatch``."""
    for sink in sinks:
        sink(events)


def file_sink(path: str) -> Callable[[DataFrame], None]:
    """Appends a JSON line per event."""
    return lambda events: events.write.mode("append").json(path)


def callback_sink(fn: Callable[[str], None]) -> Callable[[DataFrame], None]:
    """Calls ``fn`` with a line per event, one event at a time."""
    return lambda events: [fn(r.line) for r in events.select(message().alias("line")).toLocalIterator()] and None


def collecting_sink(into: list) -> Callable[[DataFrame], None]:
    return lambda events: into.extend(events.toLocalIterator())


def outbound(messages: DataFrame, mode: str, known: DataFrame | None = None, instruction: str | None = M.INSTRUCTION, closed: bool = False, audited: bool = True, **finding) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Messages to send, the vault, and an audit line per vault key, by mode.

    off: all as it came.  shadow: values are found and numbered, and the original is sent.
    enforce: the masked text is sent, with proof of how many real values are still in it;
    messages with a ``role`` also get the instruction that explains the marks.  ``sent``
    comes with ``error`` and ``missed`` (see ``mask``), which ``outbound_alerts`` reads.
    audited: whether the audit lines are wanted; the proof reads all that is sent once more.
    """
    if mode_of(mode) == "off":
        none = F.lit(None).cast("string")
        return messages.withColumns({"sent": F.col("text"), "error": none, "missed": none}), None, None
    masked, book = M.mask(messages, known=known, closed=closed, **finding)
    audit = None
    counts = V.summary(book).groupBy("vault_key").agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "n"))).alias("entities"))
    if mode_of(mode) == "shadow":
        audit = counts.select(F.lit("shadow_detect").alias("kind"), "vault_key", "entities", F.lit(None).cast("long").alias("real_values_in_outbound"))
        return masked.withColumn("sent", F.col("text")).drop("masked"), book, audit
    if audited:
        leaks = V.present(masked.select("vault_key", F.col("masked").alias("text")), book)
        audit = counts.join(leaks, "vault_key").select(F.lit("enforce_send").alias("kind"), "vault_key", "entities", F.col("n_present").alias("real_values_in_outbound"))
    sent = masked.withColumnRenamed("masked", "sent")
    if instruction and "role" in messages.columns:
        sent = M.instruct(sent, book, instruction, text="sent")
    return sent, book, audit


def inbound(rows: DataFrame, book: DataFrame, mode: str, restorer: Callable[[Column, Column], Column] | None = None, wanted: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Replies ``(vault_key, content, arguments, ...)`` restored, an audit line for each, and alerts.

    Only enforce restores: in the other modes nothing was masked on the way out.  A reply on
    which the restorer fails goes on as it came, with an alert.
    """
    if mode_of(mode) != "enforce":
        return rows, None, None
    told = R.report(rows, book, restorer)
    key = session(F.col("vault_key"))
    audit = told.where("error is null").select(F.lit("enforce_restore").alias("kind"), key.alias("vault_key"), *[c for c in ("seq",) if c in rows.columns], F.col("restored_any").alias("restored"), F.size("leftover").alias("leftover"))
    events = alerts(told.select(key.alias("session_id"), "error", "leftover"), wanted=wanted)
    return told.drop("leftover", "restored_any", "error"), audit, events


def outgoing_text(rows: DataFrame, book: DataFrame, mode: str) -> DataFrame:
    """``rows (vault_key, text)`` with ``restored``, which is the text itself unless the mode is enforce."""
    return R.restore_by_join(rows, book) if mode_of(mode) == "enforce" else rows.withColumn("restored", F.col("text"))


def outbound_hook(mode: Callable[[], str], **finding) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform`` and ``foreachBatch``: reads the mode each time and masks accordingly."""
    return lambda messages: outbound(messages, mode(), audited=False, **finding)[0]


def inbound_hook(book: Callable[[], DataFrame], mode: Callable[[], str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: inbound(rows, book(), mode())[0]
