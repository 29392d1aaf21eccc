"""Ordinal regression: gradients, order of cuts, held-out accuracy, edge rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import quality, queries


def test_sums():
    weights = np.random.default_rng(1).normal(size=quality.FEATURES)
    texts = ["", None, "One two ONE", "x " * 3000, "Ab1## é"]
    found = quality.Bags.of(pa.array(texts, pa.string())).sums(weights)
    for text, value in zip(texts, found):
        words = (text or "").split()
        each = [weights[zlib.crc32(w.lower().encode(), 1) % quality.FEATURES] + weights[zlib.crc32(s.encode(), 2) % quality.FEATURES]
                for w, s in zip(words, quality._shapes(pa.array(words, pa.string())).to_pylist())]
        assert value == pytest.approx(sum(each) / max(1, len(words)) ** 0.5)
    assert quality._shapes(pa.array(["AbcÉé12-x", "##"])).to_pylist() == ["AaAa0-a", "##"]


def made(count, seed):
    rng = np.random.default_rng(seed)
    texts, grades = [], []
    for _ in range(count):
        grade = rng.integers(4)
        words = [f"w{n}" for n in rng.zipf(1.4, 60) % 500]
        for at in rng.choice(60, 30, replace=False)[: int(10 * grade)]:
            words[at] = f"fine{rng.integers(20)}"
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, np.array(grades)


def test_ordinal():
    texts, grades = made(900, 2)
    model = quality.fit(texts, grades, 4)
    assert (np.diff(model.cuts) > 0).all()
    fresh, truth = made(300, 3)
    tails = model.tails(quality.Bags.of(pa.array(fresh)))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(tails.sum(axis=1), truth)[0, 1] > 0.95
    assert np.abs(np.rint(tails.sum(axis=1)) - truth).mean() < 0.15


ROWS = [(1, "a b", 1.0), (2, None, 1.0), (3, "", 1.0), (None, "x", 1.0), (4, "w " * 100_000, 1.0), (1, "a b", 1.0)]


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept double")
    ratings = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (None, 1), (3, None), (4, 3), (99, 2)], "doc_id long, grade int")
    model = quality.train(docs, ratings, 4)
    found = quality.graded(docs, model, 2).collect()
    assert len(found) == len(ROWS)
    scores = {(r.doc_id, r.text): (r.expected_grade, r.tail_probability) for r in found}
    assert len(scores) == len(ROWS) - 1 and scores[2, None] == scores[3, ""]
    assert all(0 <= r.expected_grade <= 3 and r.kept == (r.tail_probability >= 0.5) for r in found)
    assert quality.graded(docs.limit(0), model, 2).collect() == []
    assert quality.graded(docs, quality.train(docs, ratings.limit(0), 4), 2).count() == len(ROWS)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    found = queries.op4_quality(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    both = found[found.held_out].merge(labels, on="doc_id")
    assert (both.kept == (both.quality == 1)).mean() > 0.93
    assert both[both.quality == 1].kept.mean() > 0.97
