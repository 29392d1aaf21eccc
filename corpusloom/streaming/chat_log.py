"""Message stream to chat log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.chat_log import log_items


def log_stream(requests: DataFrame, path: str, checkpoint: str, *, unique=None) -> StreamingQuery:
    """Append each valid request once; runs until the input at hand is used up."""
    return (
        log_items(requests, unique=unique)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
