"""Raw documents: files under a root, and their text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. A PDF needs a per-row parser and is left out.
EXTENSIONS = ("md", "markdown", "html", "htm", "txt")


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """All documents below `root`, as `path, content`. The name filter works on
    the file listing; its brackets make it ignore case."""
    any_case = ",".join(
        "".join(f"[{c}{c.upper()}]" for c in extension) for extension in EXTENSIONS
    )
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{any_case}}}")
        .load(root)
    )
    return files.select("path", "content")


@F.arrow_udf(T.StringType())
def _decode_valid_parts(contents: pa.Array) -> pa.Array:
    return pa.array(
        [None if c is None else c.decode("utf-8", "ignore") for c in contents.to_pylist()],
        pa.string(),
    )


def decode_utf8(content: Column) -> Column:
    """Bytes to text without the invalid ones. Valid bytes, the usual case, are
    taken as they are; only the others go to Python."""
    text = content.cast("string")
    repaired = _decode_valid_parts(F.when(~F.is_valid_utf8(text), content))
    return F.coalesce(repaired, text)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents below `root` as `key, text`; a key is the path below the root."""
    files = scan_raw(spark, root)
    relative = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return files.select(
        F.replace(relative, F.lit(base), F.lit("")).alias("key"),
        decode_utf8(F.col("content")).alias("text"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than cores, dealt out to all of them.
    An input of cluster size has more splits, and is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
