"""Ordered work over rows of any number: by ranges of the order, with what is carried from each range to the next.

Rows are dealt out by range, sorted and stored with their place; windows then cover one range, and a table of one row
for each range carries the last row, or the sum, over to the ranges behind it. No task holds more than a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialize

_PLACE = 33  # monotonically increasing ids: range << 33 | place in it


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_range`` and ``_at`` (their place over all ranges), stored; rows that agree in ``order`` in any order."""
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    placed = materialize(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return placed.withColumn("_range", F.shiftright("_at", _PLACE))


def with_previous(placed: DataFrame, columns: list[str], prefix: str = "_last_") -> DataFrame:
    """``ranged`` rows with ``columns`` of the row before, over the ends of ranges too; nulls for the first of all."""
    own = Window.partitionBy("_range").orderBy("_at")
    inside = placed.withColumn("_before", F.lag(F.struct(*columns)).over(own))
    ends = placed.groupBy("_range").agg(F.max_by(F.struct(*columns), "_at").alias("_end"))  # one row for each range
    carried = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_carried"))
    both = inside.join(F.broadcast(carried), "_range").withColumn("_before", F.coalesce("_before", "_carried"))
    return both.select(*placed.columns, *(F.col("_before")[c].alias(prefix + c) for c in columns))


def running_sum(placed: DataFrame, column: str, name: str) -> DataFrame:
    """``ranged`` rows with ``name``: the sum of ``column`` up to and with each row."""
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_range").agg(F.sum(column).alias("_sum"))  # one row for each range
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, F.sum(column).over(own)).join(F.broadcast(sums.select("_range", before.alias("_sum_before"))), "_range").withColumn(name, F.col(name) + F.col("_sum_before")).drop("_sum_before")


def order_proof(rows: DataFrame, place: str, order: list[str]) -> DataFrame:
    """One row ``(n, breaks)``: rows, and those whose ``order`` is less than that of the row before by ``place``.

    Each range of places is looked at by itself; first and last keys of the ranges are then held against each other."""
    seen = with_previous(ranged(rows.select(F.col(place).alias("_place"), F.struct(*order).alias("_key")), ["_place"]), ["_key"])
    return seen.agg(F.count("*").alias("n"), F.count_if(F.col("_last__key") > F.col("_key")).alias("breaks"))
