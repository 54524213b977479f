"""Column helpers over arrays that stay linear in an array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that one step of a scan copies at most; two levels of it hold arrays of millions.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, first: Column, step: Callable[[Column, Column], Column], kind: str = "long") -> Column:
    """What ``step`` has gathered before each item: an array as long as ``items``, which begins with ``first``.

    ``step`` must be associative, and ``first`` neutral to it (sums from 0, maxima from a least value). Appending to
    an array copies it, so the items are scanned in blocks and the blocks' totals before them."""

    def one(xs: Column, start: Column) -> Column:
        def grow(s: Column, x: Column) -> Column:
            return F.struct(step(s["now"], x).alias("now"), F.array_append(s["out"], s["now"]).alias("out"))

        return F.aggregate(xs, F.struct(start.alias("now"), F.array().cast(f"array<{kind}>").alias("out")), grow, lambda s: s["out"])

    def whole(xs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))

        def joined(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.aggregate(b, first, lambda a, x: step(a, x)))
            return F.flatten(F.zip_with(bs, one(totals, first), one))

        return F.when(F.size(xs) > BLOCK, let(blocks, joined)).otherwise(one(xs, first))

    return let(items, whole)


def sums_before(sizes: Column) -> Column:
    """The sum of all items before each one, of an array of longs."""
    return scan(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
