"""Whitening against exact covariances of products."""

import math
import random

import numpy as np
import pytest

from corpusloom.llm import queries, vectors, whitening


def plain(vectors_in):
    """n, exact deviations, covariance as numpy from exact products."""
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors_in]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    z = [[n * x[i] - sums[i] for i in range(d)] for x in xs]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    return n, [sum(c * c for c in r) for r in z], np.array([[c / n for c in r] for r in z]), cov


def check(rows, ids, vecs, components=8):
    n, deviation, centred, cov = plain(vecs)
    values = np.linalg.eigvalsh(cov)[::-1]
    shown = min(components, len(values))
    assert len(rows) == len(vecs) * shown
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.deviation), []).append(r)
    order = {}
    for i, dev, c in zip(ids, deviation, centred):
        order.setdefault((i, dev), []).append(c)
    assert set(found) == set(order)
    axes = {}
    for k in range(shown):
        got = np.array([sorted(r.whitened for r in found[key] if r.component == k + 1)[0] for key in order])
        points = np.array([order[key][0] for key in order])
        axis, *_ = np.linalg.lstsq(points, got * math.sqrt(values[k]), rcond=None)
        assert np.allclose(points @ axis, got * math.sqrt(values[k]), atol=1e-6)
        assert np.allclose(cov @ axis, values[k] * axis, rtol=1e-7, atol=1e-6 * values[0])
        assert abs(np.linalg.norm(axis) - 1) < 1e-7
        axes[k] = axis
    for r in rows:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, whitened int, number int")


def test_small(spark):
    rng = random.Random(1)
    vecs = [[rng.gauss(0, 1) * (k + 1) / 8 + 50 for k in range(11)] for _ in range(60)]
    vecs = [list(map(float, np.array(v, dtype=np.float32))) for v in vecs]
    rows = [(i, v, 1, "clash", 2, 3) for i, v in enumerate(vecs)]
    odd = [(100, None, 1, "", 0, 0), (101, [1.0] * 10 + [None], 1, "", 0, 0), (102, [float("nan")] * 11, 1, "", 0, 0),
           (103, [float("inf")] * 11, 1, "", 0, 0), (104, [], 1, "", 0, 0), (105, [1.0], 1, "", 0, 0)]
    whole = [*rows, rows[3], rows[3], (None, vecs[5], None, None, None, None)]
    frame = table(spark, whole + odd).repartition(5)
    found = whitening.report(frame).collect()
    check(found, [r[0] for r in whole], [r[1] for r in whole])


def test_degenerate(spark):
    assert whitening.report(table(spark, [])).collect() == []
    assert whitening.report(table(spark, [(1, None, 1, "", 0, 0)])).collect() == []
    one = whitening.report(table(spark, [(1, [0.5, 0.25], 1, "", 0, 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    line = whitening.report(table(spark, [(i, [float(i), 2.0], 1, "", 0, 0) for i in range(4)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert all(r.identity_error < 1e-12 for r in line)


def test_exact_far_from_zero(spark):
    """Sums of squares beyond a long and beyond doubles."""
    vecs = [[900_000.0 * (-1) ** i, 0.5 * i, 1000.0 + i] for i in range(40)]
    rows = [(i, v, 1, "", 0, 0) for i, v in enumerate(vecs)]
    model = whitening.fit(*vectors.integers(table(spark, rows), "vec_id", shift=whitening.SHIFT))
    n, deviation, _, cov = plain(vecs)
    assert np.allclose(model.values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12, atol=1e-6)
    found = whitening.report(table(spark, rows)).collect()
    assert {(r.vec_id, int(r.deviation)) for r in found} == set(enumerate(deviation))


def test_too_large(spark):
    with pytest.raises(Exception, match="component of"):
        whitening.report(table(spark, [(1, [2.0**21], 1, "", 0, 0)])).collect()


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(queries.op11_whitening(spark, sf_dir).collect(), [r.vec_id for r in docs], [r.embedding for r in docs])
