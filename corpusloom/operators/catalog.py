"""The catalogue of site items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROJECT = "PROJECT"  # fixed value


def indexed(items: DataFrame) -> DataFrame:
    """Items the sparse index shows: those with both of its keys."""
    return items.where(F.col("GSI1PK").isNotNull() & F.col("GSI1SK").isNotNull())


def partition_newest_first(items: DataFrame, partition: str = PROJECT) -> DataFrame:
    return indexed(items).where(F.col("GSI1PK") == partition).orderBy(F.col("GSI1SK").desc(), "SK")


def projects(items: DataFrame) -> DataFrame:
    """Projects with defaults in place of missing values."""
    return partition_newest_first(items).select(
        F.col("SK").alias("id"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.col("GSI1SK").alias("publishedAt"),
    )


def listing(rows: DataFrame) -> DataFrame:
    """Text columns of the project list: joined tags and a short date."""
    return rows.select(
        "id",
        F.when(F.size("tags") > 0, F.array_join("tags", " · ")).alias("tag_line"),
        "summary",
        F.date_format(F.try_to_timestamp("publishedAt"), "M/d/yyyy").alias("published"),
    )
