"""Global row numbers without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import written

_PLACES = 33  # bits that monotonically_increasing_id() leaves for the place in a partition


def numbered(rows: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """The rows with a gapless number from 0 in `name`, in the given order.

    Rows are sorted by ranges and written once, so that later jobs, and tasks that
    run again, see the same partitions. Only one count per range partition is put
    together; it is the one thing that is broadcast, bounded by the number of
    partitions. Equal rows are numbered in any order. Pass narrow rows."""
    spread = F.monotonically_increasing_id()  # splits ranges of equal rows
    placed = written(
        rows.withColumn("_tie", spread).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        .drop("_tie").withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("_place", _PLACES)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + (F.col("_place") - F.shiftleft("_part", _PLACES))
    return (
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, number).drop("_part", "_place", "_start")
    )
