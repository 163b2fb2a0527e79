"""Filters and interval resolution over arrays of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import PROCLITICS
from ..functions.text import SPANS, variants


def never_set(entries: list[str]) -> list[str]:
    """Texts that are never masked, with and without a glued letter."""
    return sorted({v for e in entries for v in ([e, e[1:]] if len(e) >= 3 and e[0] in PROCLITICS else [e])})


def drop_never(spans: Column, entries: list[str]) -> Column:
    """Spans whose whole text, in any variant, is not to be masked go; before any resolution."""
    names = never_set(entries)
    if not names:
        return spans
    allowed = F.array(*map(F.lit, names))
    return F.filter(spans, lambda s: ~F.arrays_overlap(variants(s["text"]), allowed))


def resolve(spans: Column) -> Column:
    """Leftmost, then longest, then first given: a span stays if it starts where the last kept one has ended."""
    ordered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s.alias("span")))
    kept = F.aggregate(
        F.array_sort(ordered), F.struct(F.lit(-1).alias("last"), F.array().cast(SPANS).alias("kept")),
        lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["span"]["end"].alias("last"), F.concat(acc["kept"], F.array(s["span"])).alias("kept"))).otherwise(acc),
    )
    return kept["kept"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merge(primary: Column, secondary: Column) -> Column:
    """Resolved secondary spans join where they touch no resolved primary span; in order of start."""
    first = resolve(primary)
    rest = F.filter(resolve(secondary), lambda s: ~F.exists(first, lambda k: overlaps(s, k)))
    return F.array_sort(F.concat(first, rest))
