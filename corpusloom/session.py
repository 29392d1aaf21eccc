"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key on one side of a join is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where an aggregation on the join key follows and needs a shuffle then.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when their job has ended, not when the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Long texts cross to Python in batches of moderate size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Keyed stream state lives on local disk with changelogs in the checkpoint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "corpusloom", **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that is already running."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from `spark.checkpoint.dir`.

    On one machine only, where it is unset, a temporary folder takes its place. On
    a cluster such a folder would be another one on each machine, so that rows
    written there could not be read back: that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    local = tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. Nothing is created or deleted here."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: a costly step runs once,
    an executor lost later does not bring it back, and each reader takes only the
    columns it needs. It stays until that folder's clean-up, so it is packed tightly."""
    path = new_dir(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unsized(rows: DataFrame) -> DataFrame:
    """A side of a join that Spark would take for smaller than it is, after an explode or as
    a compressed file: neither side of that join is broadcast, whatever the threshold."""
    return rows.hint("merge")
