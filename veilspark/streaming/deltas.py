"""Placeholders in streamed replies: a token may be split over deltas, so an open one is held back.

Holding back is the only stateful part; what is sent is whole tokens and plain text, which
``operators.restore`` restores like any other text, batch by batch in the streaming form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CLOSE, HOLD, OPEN
from ..functions.text import PLACEHOLDER
from ..operators.restore import restore_by_join
from ..plans.storage import as_files, scratch

_TOKEN = re.compile(PLACEHOLDER)
OUT = "session_id string, turn long, delta_idx int, text string"
KEYS = ("session_id", "turn")


def restore_text(text: str, real: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: real.get(m[0], m[0]), text)


def advance(held: str, text: str | None, hold: int = HOLD) -> tuple[str, str]:
    """What to send now, and what to hold until the next delta: a mark that is open for at most ``hold`` characters."""
    whole = held + (text or "")
    head, mark, tail = whole.rpartition(OPEN)
    if mark and CLOSE not in tail and 1 + len(tail) <= hold:
        return head, mark + tail
    return whole, ""


def hold_back(deltas: DataFrame, hold: int = HOLD, flush: bool = False) -> DataFrame:
    """Batch form over ``deltas (session_id, turn, delta_idx, text)``: a row per delta, in order within its turn.

    Turns stand one after the other in sorted partitions, so no turn is ever held in memory.
    flush: also send what is still held at the end of a turn, with its last delta.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, kept = "", None, None  # kept: the last row so far, which may still get what is held
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, sent = batch.select([*KEYS, "delta_idx"]), []
            for text, first in zip(batch.column("text").to_pylist(), _firsts(rows, last), strict=True):
                if first:
                    if flush and held:
                        if sent:
                            sent[-1] += held
                        elif kept is not None:
                            kept = (kept[0], kept[1] + held)
                    held = ""
                if held or text and OPEN in text:
                    text, held = advance(held, text, hold)
                sent.append(text or "")
            if kept is not None:
                yield _rows(kept[0], [kept[1]])
            last = rows.slice(rows.num_rows - 1)
            kept = (last, sent.pop())
            if sent:
                yield _rows(rows.slice(0, len(sent)), sent)
        if kept is not None:
            yield _rows(kept[0], [kept[1] + held if flush else kept[1]])

    rows = deltas.select(*KEYS, "delta_idx", "text").repartition(*KEYS).sortWithinPartitions(*KEYS, "delta_idx")
    return rows.mapInArrow(run, OUT)


def _firsts(rows: pa.RecordBatch, last: pa.RecordBatch | None) -> list[bool]:
    """Whether each row begins a turn; ``last`` is the row before them.  Null keys are keys like any other."""
    out = np.zeros(rows.num_rows, bool)
    out[0] = last is None or any(last.column(k)[0].as_py() != rows.column(k)[0].as_py() for k in KEYS)
    for k in KEYS:
        now, before = rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)
        lone = pc.xor(pc.is_null(now), pc.is_null(before))
        out[1:] |= pc.fill_null(pc.or_(pc.not_equal(now, before), lone), lone).to_numpy(zero_copy_only=False)
    return out.tolist()


def _rows(rows: pa.RecordBatch, sent: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32()]
    return pa.record_batch([*(c.cast(k) for c, k in zip(rows.columns, kinds, strict=True)), pa.array(sent, pa.string())], [*KEYS, "delta_idx", "text"])


def hold_back_stream(deltas: DataFrame, hold: int = HOLD, ttl_ms: int = 24 * 3600 * 1000, flush: bool = False) -> DataFrame:
    """Streaming form: the held text is keyed state, which goes ``ttl_ms`` after its last change.

    flush: what is still held then is sent as a last delta; else it is dropped.  Sessions and
    turns that are null are keys like any other.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held, last = state.get
            state.remove()
            if flush and held:
                yield pd.DataFrame([(*key, last + 1, held)], columns=[*KEYS, "delta_idx", "text"])
            return
        held, last = state.get if state.exists else ("", -1)
        rows = pd.concat(list(frames)).sort_values("delta_idx", kind="stable")
        out = []
        for text in rows["text"]:
            sent, held = advance(held, text, hold)
            out.append(sent)
        state.update((held, max(last, int(rows["delta_idx"].max()))))
        state.setTimeoutDuration(ttl_ms)
        yield rows.assign(text=out)[[*KEYS, "delta_idx", "text"]]

    return deltas.groupBy(*KEYS).applyInPandasWithState(run, OUT, "held string, last int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def restored_deltas(rows: DataFrame, book: DataFrame) -> DataFrame:
    """``(session_id, turn, delta_idx, text)`` of whole tokens with values put back.

    The rows are read several times, so they are written first: holding back, in Python, is done once.
    """
    back = restore_by_join(as_files(rows).withColumn("vault_key", F.col("session_id")), book)
    return back.select(*KEYS, "delta_idx", F.col("restored").alias("text"))


def restore_stream(deltas: DataFrame, book: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, mode: Callable[[], str] = lambda: "enforce", **holding):
    """Start a query from deltas to restored deltas: state holds open tokens back, and each micro-batch meets the vault as it is then.

    sink: gets each restored batch and its number, which tells a batch that comes again after
    a failure.  mode: read anew for each batch; in any mode but enforce deltas pass unrestored.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            sink(restored_deltas(batch, book()) if mode() == "enforce" else batch, number)

    return hold_back_stream(deltas, **holding).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def joined_replies(deltas: DataFrame) -> DataFrame:
    """The whole text of each turn."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("delta_idx", "text"))))
    return deltas.groupBy(*KEYS).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
