"""Chunk records as JSON lines: a directory of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.schemas import CHUNK


def write_chunks(chunks: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One object per line; nulls are written, non-ASCII text is not escaped."""
    chunks.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped; a bad line fails the job."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)
