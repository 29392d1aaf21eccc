"""Mixing against SQL, and its targets, limits, order and edge rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing, queries
from tests.llm.brute import connection, same_as_sql, words


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        out = {s: left * weight[s] / total for s in free}
        above = {s for s in free if out[s] > 2 * sizes[s]}
        if not above:
            return out | {s: 2 * sizes[s] for s in full}
        full |= above
        left -= sum(2 * sizes[s] for s in above)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_positions(spark, knots):
    """The inverse of the integral, against summing the schedule up."""
    shares = np.linspace(0, 1, 101)
    rows = spark.createDataFrame([(float(s),) for s in shares], "share double")
    found = [r[0] for r in rows.select(mixing.position(F.col("share"), F.lit(0), [knots])).collect()]
    time = np.linspace(0, 1, 200_001)
    weight = np.interp(time, [t for t, _ in knots], [w for _, w in knots])
    summed = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    assert np.allclose(found, np.interp(shares, summed / summed[-1], time), atol=1e-6)


def rows_for(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), rng.choice(["a", "b", "B", "é", "big"], p=[0.02, 0.2, 0.1, 0.1, 0.58]), 1) for i in range(3000)]
    rows += [(3000, None, "a", 1), (3001, "x y", None, 1), (3001, "x y", None, 1), (None, "one", "a", 1), (3002, "", "empty", 1),
             (3003, "v " * 50_000, "long", 1)]
    return spark.createDataFrame([(i, t, s if s is None else str(s), n) for i, t, s, n in rows], "doc_id long, text string, source string, size int")


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    docs = rows_for(spark).repartition(5)
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    plain = plain_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(plain[s])
        assert abs(taken[s] - targets[s]) <= (0.02 * sizes[s] if s == "big" else 25_000 if s == "long" else 30)
    assert {(r.doc_id, r.size) for r in found} == {(r.doc_id, len(words(r.text))) for r in docs.collect()}
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs.where("source = 'empty'")).first()[2:6] == (0, 0, 0.0, 0)


@pytest.mark.parametrize("seed", ["mix", "a", "b", "c", "d"])
def test_long_documents_are_passed(spark, monkeypatch, seed):
    """Short documents make up what a long one cannot, wherever it stands."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    docs = spark.createDataFrame([(i, "w " * 10, "s") for i in range(300)] + [(300, "w " * 1800, "s")], "doc_id long, text string, source string")
    assert sum(r.taken for r in mixing.mix(docs, seed).collect()) == 7200


def test_the_last_round(spark, monkeypatch):
    """Against taking documents one by one."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in np.exp(rng.normal(4, 1.5, 700))]
    docs = spark.createDataFrame(
        [(i, f"{'w ' * n}", str(rng.choice(["a", "b", "c", "d"], p=[0.55, 0.25, 0.15, 0.05]))) for i, n in enumerate(sizes)],
        "doc_id long, text string, source string",
    )
    found = defaultdict(list)
    for r in mixing.mix(docs).collect():
        text = "w " * r.size
        name = f"{r.doc_id}/mix/{hashlib.md5(text.encode()).hexdigest()}"
        found[r.source].append((hashlib.md5(name.encode()).hexdigest(), r.size, r.copies, r.target, r.source_size))
    for rows in found.values():
        rows.sort()
        target, words_of = rows[0][3:]
        rest = target - target // words_of * words_of
        once = []
        for _, size, *_ in rows:
            once.append(size <= rest and size > 0)
            rest -= size if once[-1] else 0
        others = [(abs(size - rest), key) for (key, size, *_), o in zip(rows, once) if not o and abs(size - rest) < rest]
        extra = min(others)[1] if others else None
        for (key, size, copies, *_), o in zip(rows, once):
            assert copies == target // words_of + (o or key == extra) or size == 0


def test_curriculum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 500)
    docs = rows_for(spark)
    order = mixing.curriculum(docs)
    assert order.columns == docs.columns
    rows = order.collect()
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in rows) == +copies
    at = defaultdict(list)  # the schedule of a source shows in where its words stand
    for i, r in enumerate(rows):
        at[r.source].append(i / len(rows))
    assert np.mean(at["a"]) > np.mean(at["B"])
    assert mixing.curriculum(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    frame = queries.op3_mixing(spark, sf_dir)
    same_as_sql(frame, connection(sf_dir), queries.SQL["op3_mixing"])
