"""Sharding against direct computation: a permutation, balanced, reproducible, invertible."""

import zlib

import numpy as np
import pytest

from corpusloom.llm import queries
from corpusloom.llm.sharding import document_shards, permute, place, row_at


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(total):
    found = permute(np.arange(total), total, 7)
    assert sorted(found) == list(range(total))
    assert (permute(found, total, 7, inverse=True) == np.arange(total)).all()


def test_seed_and_spread():
    one, other = permute(np.arange(10_000), 10_000, 1), permute(np.arange(10_000), 10_000, 2)
    assert (one == other).mean() < 0.01
    assert abs(np.corrcoef(np.arange(10_000), one)[0, 1]) < 0.05


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_edges(spark):
    rows = [(1, "a", 5), (2, None, 6), (None, "é", None), (3, "", 7), (3, "", 7), (4, "x" * 100_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    found = document_shards(docs, 4).collect()
    assert sorted(r.row_number for r in found) == list(range(6))
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in found}
    assert sizes == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    for r in found:
        assert (r.shard, r.slot) == place(r.row_number, 6, 4, 0)
        assert row_at(r.shard, r.slot, 6, 4, 0) == r.row_number
    assert document_shards(docs.limit(0), 4).collect() == []
    assert rows_of(document_shards(docs.repartition(3), 4)) == rows_of(document_shards(docs.coalesce(1), 4))


def test_query(spark, sf_dir):
    found = queries.op10_sharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    found = found.sort_values("doc_id")
    assert (found.doc_id.values == docs.doc_id.values).all()
    assert [zlib.crc32(t.encode()) for t in docs.text] == found.text_crc32.tolist()
    assert [len(t.encode()) + 1 for t in docs.text] == found["size"].tolist()
    at = permute(np.arange(len(docs)), len(docs), 2024)
    assert (found.shard.values == at % 8).all() and (found.slot.values == at // 8).all()
    counts = found.groupby("shard").slot.agg(["count", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] == counts["count"] - 1).all()
    assert found.grown_shard.isna().all() and set(found.law) == {"rows"}
