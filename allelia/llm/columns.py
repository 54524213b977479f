"""Column helpers for operators that stay in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import let, sums_before  # noqa: F401
from ..functions.arrays import scan as running  # noqa: F401
from .common import SPACE_CHARS


def whole_text(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    spaced = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def log_tail(z: Column) -> Column:
    """Upper tail of the standard normal at z, by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    # Fixed values of the published approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)
