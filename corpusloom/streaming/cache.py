"""The answer cache as keyed stream state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.cache import TTL_HOURS


BUCKETS = 1024  # fixed value: groups that share the keys. It belongs to a stream's checkpoint.


class _Expiry(StatefulProcessor):
    """When the answers of a bucket's keys expire (microseconds), by the keys' names. A call
    costs far more than a request, so many keys share one."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([
            T.StructField("names", T.ArrayType(T.StringType())), T.StructField("expires_at", T.ArrayType(T.LongType())),
        ])
        self.expiry = handle.getValueState("expiry", schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch may bring a key's rows out of order. Its size, and so that
        # of a group, is what the source is told to hand on per trigger.
        batch = pd.concat(list(rows), ignore_index=True)
        if batch["t"].isna().any():
            raise ValueError("a request has no time")
        codes, names = pd.factorize(batch["name"], use_na_sentinel=False)
        batch = batch.assign(code=codes).sort_values(["code", "t", "request_id"], kind="stable", ignore_index=True)
        bounds = batch["code"].searchsorted(range(len(names) + 1)).tolist()
        times, hit = batch["t"].tolist(), np.ones(len(batch), dtype=bool)
        found = self.expiry.get() if self.expiry.exists() else None
        expiry = dict(zip(*found)) if found else {}
        for name, at, end in zip(names, bounds, bounds[1:]):
            name = None if pd.isna(name) else name
            if name in expiry:
                at = bisect_left(times, expiry[name], at, end)
            while at < end:
                hit[at] = False
                expiry[name] = times[at] + self.ttl
                at = bisect_left(times, expiry[name], at, end)
        self.expiry.update((list(expiry), list(expiry.values())))
        yield batch[["key", "request_id", "t"]].assign(hit=hit)

    def close(self) -> None:
        pass


def _name(key: str, kind: T.DataType) -> Column:
    """The key as text, different for different keys."""
    if isinstance(kind, T.AtomicType) and not isinstance(kind, T.BinaryType):
        return F.col(key).cast("string")
    return F.to_json(F.struct(key))


def replay_stream(requests: DataFrame, *, ttl_hours: float = TTL_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """Stream `key, ts, request_id` to `key, request_id, ts, hit`. Requests of a
    later micro-batch meet the state the earlier ones left. The keys are dealt out to
    `buckets` groups, each with a state that is read and written as a whole: its size is
    the number of keys over theirs."""
    request_id = requests.schema["request_id"].dataType
    key = requests.schema["key"].dataType
    out = T.StructType([
        T.StructField("key", key),
        T.StructField("request_id", request_id),
        T.StructField("t", T.LongType()),
        T.StructField("hit", T.BooleanType()),
    ])
    # Null keys have a bucket of their own, so that no other column of keys has gaps.
    bucket = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64(_name("key", key)), F.lit(buckets)))
    timed = requests.select(
        "key", "request_id", F.unix_micros("ts").alias("t"), _name("key", key).alias("name"), bucket.cast("int").alias("bucket")
    )
    found = timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Expiry(round(ttl_hours * 3_600_000_000)),
        outputStructType=out,
        outputMode="Append",
        timeMode="None",
    )
    return found.select("key", "request_id", F.timestamp_micros("t").alias("ts"), "hit")
