from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import cache
from corpusloom.sources.upsert import keyed_upsert

START = datetime(2024, 1, 1)


def walk(requests, ttl):
    expires, hits = {}, {}
    for key, ts, request_id in sorted(requests, key=lambda r: (r[1], r[2])):
        hits[request_id] = key in expires and ts < expires[key]
        if not hits[request_id]:
            expires[key] = ts + ttl
    return hits


def replay(spark, requests, **options):
    rows = spark.createDataFrame(requests, "key string, ts timestamp, request_id long")
    return {r.request_id: r.hit for r in cache.replay(rows, **options).collect()}


def test_expiry(spark):
    requests = [("k", START + timedelta(hours=h), h) for h in (0, 47, 49, 96, 97)]
    assert replay(spark, requests) == {0: False, 47: True, 49: False, 96: True, 97: False}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 900)), min_size=1, max_size=150),
       st.sampled_from([7, 24, 90]), st.sampled_from([1, 4, 4096]))
def test_replay_equals_walk(spark, drawn, ttl_seconds, phases):
    requests = [(k, START + timedelta(seconds=s), i) for i, (k, s) in enumerate(drawn)]
    found = replay(spark, requests, ttl_hours=ttl_seconds / 3600, phases=phases)
    assert found == walk(requests, timedelta(seconds=ttl_seconds))


def test_put_and_lookup(spark):
    entries = spark.createDataFrame(
        [("a", "old", 10, 1), ("a", "new", 20, 2), ("b", "b", 5, 1)], "pk string, value string, ttl long, createdAt int"
    )
    stored = cache.put(entries.where("false"), entries)
    assert {r.pk: r.value for r in stored.collect()} == {"a": "new", "b": "b"}
    requests = spark.createDataFrame([("a", 19), ("a", 20), ("b", 4), ("c", 0)], "pk string, s long")
    found = cache.lookup(requests.withColumn("ts", F.timestamp_seconds("s")), stored).collect()
    assert {(r.pk, r.s): (r.cached, r.value) for r in found} == {
        ("a", 19): (True, "new"), ("a", 20): (False, None), ("b", 4): (True, "b"), ("c", 0): (False, None)}


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, n int")
    once = keyed_upsert(target, batch, "k", order="n")
    twice = keyed_upsert(once, batch, "k", order="n")
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", 1), ("b", 4), ("c", 5)]


def test_hot_key_is_cut_before_the_shuffle(spark):
    batch = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = keyed_upsert(batch, batch, "k", order="v")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_an_entry_without_value_is_no_hit(spark):
    requests = spark.createDataFrame([("k", START), ("n", START)], "pk string, ts timestamp")
    entries = spark.createDataFrame([("k", "v", 2**40), ("n", None, 2**40)], "pk string, value string, ttl long")
    assert {r.pk: (r.cached, r.value) for r in cache.lookup(requests, entries).collect()} == {"k": (True, "v"), "n": (False, None)}


def test_covered(spark):
    hour = timedelta(hours=1)
    misses = spark.createDataFrame([("k", START, 5), ("k", START + 50 * hour, 6), ("o", START, 7)], "key string, ts timestamp, request_id long")
    asked = [("k", START, 4), ("k", START, 6), ("k", START + 47 * hour, 8), ("k", START + 48 * hour, 9), ("k", START + 97 * hour, 10),
             ("k", START - hour, 11), ("x", START, 12), ("o", START + hour, 13)]
    rows = spark.createDataFrame(asked, "key string, ts timestamp, request_id long")
    found = {r.request_id: r.hit for r in cache.covered(rows, misses).collect()}
    assert found == {4: False, 6: True, 8: True, 9: False, 10: True, 11: False, 12: False, 13: True}
