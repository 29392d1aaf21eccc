"""Insert-or-replace by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. The row-number limit is applied before the
    shuffle as well, so copies of a hot key are dropped where they are read."""
    newest = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return batch.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def keyed_upsert(
    target: DataFrame, batch: DataFrame, key: str, *, order: str, small_batch: bool = False
) -> DataFrame:
    """`target` with the rows of `batch` in place of those with the same key. Rows
    missing from the batch stay. With `small_batch`, for a batch whose size has
    been checked, the keys are broadcast and the target is not shuffled."""
    rows = last_per_key(batch, key, order).select(*target.columns)
    keys = rows.select(key)
    kept = target.join(F.broadcast(keys) if small_batch else keys, key, "left_anti")
    return kept.select(*target.columns).unionByName(rows)
