"""Exact duplicates against SQL and direct grouping; filters against sets."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import binary_fuse, queries
from corpusloom.llm.exact_dedup import exact_dedup, one_of_each, survivors
from tests.llm.brute import connection, same_as_sql


@pytest.mark.parametrize("count", [0, 1, 2, 3, 10, 100, 5000, 120_000])
def test_filter(count):
    rng = np.random.default_rng(count)
    keys = rng.integers(0, 2**63, count, dtype=np.uint64)
    made = binary_fuse.build(np.concatenate([keys, keys]))
    assert binary_fuse.contains(made, keys).all()
    others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert binary_fuse.contains(made, others).mean() < 0.01
    assert len(made.tags) < 1.3 * count + 700


ROWS = [
    (1, "a b\tc", 9), (2, "abc", 8), (3, " a b c ", 7), (4, "a b c  ", 7), (5, "ABC", 1), (6, None, 2), (7, "", 3),
    (8, " \n", 4), (None, "abc", 5), (9, "x y", 6), (9, "x y", 6), (9, "z", 6), (10, "a bc", 1), (11, "w" * 300_000, 1),
    (12, "w " * 300_000, 1),
]


def expected(rows):
    by = defaultdict(list)
    for i, (doc_id, text, _) in enumerate(rows):
        by[re.sub("[\x20\x09-\x0d]", "", text or "")].append((doc_id, len(text or ""), i))
    out = []
    for normal, group in by.items():
        best = min(group, key=lambda g: (-g[1], g[0] is None, g[0] or 0))
        for doc_id, _, _ in group:
            out.append((doc_id, best[0], len(group), hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arrivals", [1, 2, 4])
def test_edges(spark, arrivals):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest int").repartition(3)
    found = exact_dedup(docs, arrivals).cache()
    rows = found.select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted((tuple(r) for r in rows), key=repr) == expected(ROWS)
    kept = found.where("kept").collect()
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({e[3] for e in expected(ROWS)})
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = survivors(docs, one_of_each(docs, arrivals)).collect()
    assert sorted(r.doc_id for r in stay) == sorted(r.doc_id for r in kept)
    assert {len(r) for r in stay} == {3}
    assert exact_dedup(docs.limit(0), arrivals).collect() == []


def test_a_large_group(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"),
    )
    found = exact_dedup(docs)
    assert found.where("kept").count() == 20_000 - (6667 - 1)
    assert found.where("keep_id = 0").agg(F.min("group_size"), F.count("*")).first()[:] == (6667, 6667)


def test_query(spark, sf_dir):
    same_as_sql(queries.op7_exact_dedup(spark, sf_dir), connection(sf_dir), queries.SQL["op7_exact_dedup"])
