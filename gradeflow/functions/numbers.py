"""Rounding and labels that give the same digits on every engine.

Values are scaled first and rounded to whole numbers, ties away from zero; labels are
built from the whole numbers, never by a formatter's own rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.round(c * scale) / scale


def _fixed(scaled: Column, digits: int) -> Column:
    """Absolute whole number ``scaled`` written with ``digits`` decimals."""
    base = 10**digits
    size = F.abs(scaled)
    return F.concat(
        (size - size % base).__truediv__(base).cast("long").cast("string"), F.lit("."),
        F.lpad((size % base).cast("string"), digits, "0"),
    )


def _tenths_of_percent(basis_points: Column) -> Column:
    size = F.abs(basis_points) + 5
    return ((size - size % 10) / 10).cast("long")


def percent_label(fraction: Column) -> Column:
    """A fraction known to 4 places as text with one decimal, such as ``-2.1%``."""
    points = F.round(fraction * 10000.0).cast("long")
    return F.concat(F.when(points < 0, "-").otherwise(""), _fixed(_tenths_of_percent(points), 1), F.lit("%"))


def signed_label(value: Column, digits: int) -> Column:
    scaled = F.round(value * float(10**digits)).cast("long")
    return F.concat(F.when(scaled < 0, "-").otherwise("+"), _fixed(scaled, digits))


def signed_percent_label(fraction: Column) -> Column:
    points = F.round(fraction * 10000.0).cast("long")
    return F.concat(F.when(points < 0, "-").otherwise("+"), _fixed(_tenths_of_percent(points), 1), F.lit("%"))
