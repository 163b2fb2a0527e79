"""Check digits as column functions (and for single texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EVERY_DIGIT = "(?U)[^\\d]"
_ZEROS = [chr(c) for c in range(0x660, 0x1E960) if chr(c).isdecimal() and int(chr(c)) == 0]
_FROM = "".join(chr(ord(z) + d) for z in _ZEROS for d in range(10))
_TO = "0123456789" * len(_ZEROS)


def digits(text: Column) -> Column:
    """The decimal digits of a text, as ASCII."""
    kept = F.regexp_replace(text, _EVERY_DIGIT, "")
    return F.when(kept.rlike("[^0-9]"), F.translate(kept, _FROM, _TO)).otherwise(kept)


def _weighted(number: Column, doubled) -> Column:
    """Whether the digit sums of products with 1 and 2 add up to a multiple of ten."""
    parts = F.transform(F.split(number, ""), lambda c, i: F.when(doubled(i), c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(parts, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def valid_id(number: Column) -> Column:
    """Nine digits with the national check digit; the argument holds digits alone."""
    return F.when(F.length(number) == 9, _weighted(number, lambda i: i % 2 == 1)).otherwise(False)


def luhn(number: Column) -> Column:
    """13 to 19 digits with the card check digit; the argument holds digits alone."""
    n = F.length(number)
    return F.when(n.between(13, 19), _weighted(number, lambda i: i % 2 == n % 2)).otherwise(False)


def is_valid_id(number: str) -> bool:
    return len(number) == 9 and number.isdigit() and not sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(number)) % 10


def is_luhn(text: str) -> bool:
    number = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(number) <= 19 and not sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(number)) % 10
