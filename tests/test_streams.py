from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cache
from corpusloom.streaming.cache import replay_stream
from workload import chat

START = datetime(2024, 1, 1)
TURNS = [(1, 0, "user", "Where is the tea?"), (1, 1, "assistant", "In the pot."), (2, 0, "user", "hi"), (2, 1, "user", None)]


@pytest.fixture(params=[False, True], ids=["file", "folder"])
def tables(request, spark, tmp_path):
    """Tables as a file each, or as folders of several files."""
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    documents = spark.createDataFrame(
        [(0, "I like tea.", "en"), (1, "A compiler for tiny machines.", "en")], "doc_id long, text string, lang string")
    for name, rows in (("conversations", turns), ("documents", documents)):
        path = tmp_path / f"{name}.parquet"
        if request.param:
            rows.repartition(3, F.col(rows.columns[0])).write.parquet(str(path))
        else:
            rows.toPandas().to_parquet(path)
    (tmp_path / "conversations.parquet2").mkdir()  # another table, by its name
    turns.write.mode("append").parquet(str(tmp_path / "conversations.parquet2"))
    return str(tmp_path)


def test_log_of_a_streamed_table(spark, tables):
    found = chat.chat_log_stream(spark, tables).collect()
    assert sorted((r.PK, r.message) for r in found) == [("CHAT#1", "Where is the tea?"), ("CHAT#2", "hi")]


def test_retrieval_for_a_streamed_table(spark, tables):
    found = chat.retrieve_stream_rows(spark, tables).where("id = 'S1' or id is null").collect()
    ids = {r.q_id: r.text for r in found}
    assert set(ids) == {"1-0", "1-0-blank", "2-0", "2-0-blank", "2-1", "2-1-blank"}
    assert ids["1-0"] == "I like tea." and ids["2-1"] is None and ids["1-0-blank"] is None


@pytest.mark.parametrize("kind", ["string", "long", "binary"])
def test_keys_share_a_group_of_the_stream(spark, tmp_path, kind):
    """Few groups, each with many keys: also a null key, and keys of later batches only."""
    rows = [(None if key == 9 else key, hour, hour * 100 + key) for key in range(60) for hour in {key % 5, 5, 30, 47, 50, 60, 99}]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, "key long, hour long, request_id long").select(
        F.col("key").cast("string").cast(kind).alias("key"), F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "request_id")
    for early in (True, False):
        frame.where((F.col("request_id") < 4900) == early).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = replay_stream(stream, buckets=4)
    (found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
     .trigger(availableNow=True).start(path).awaitTermination())
    groups = found._jdf.queryExecution().analyzed().toString()
    assert "bucket" in groups
    key = F.coalesce(F.hex("key"), F.lit("none"))
    expected = cache.replay(frame.withColumn("key", key)).select("key", "request_id", "hit")
    found = spark.read.parquet(path).withColumn("key", key).select("key", "request_id", "hit")
    assert sorted(found.collect()) == sorted(expected.collect())
    assert {r.hit for r in found.collect()} == {True, False}


def test_a_request_without_time_ends_the_stream(spark, tmp_path):
    """With an error, not with an endless search for the next miss."""
    rows = spark.createDataFrame([("k", START, 1), ("k", None, 2)], "key string, ts timestamp, request_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = replay_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), buckets=1)
    started = (found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
               .trigger(availableNow=True).start(str(tmp_path / "out")))
    with pytest.raises(Exception, match="no time"):
        started.awaitTermination()
