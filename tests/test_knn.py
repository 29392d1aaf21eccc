import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import knn


def brute_force(questions, chunks, k):
    out = {}
    for q_id, q in questions.items():
        def order(item):
            name, v = item
            if v is None:
                return (2, 0, name)
            size = np.linalg.norm(v) * np.linalg.norm(q)
            return (0, -round(float(np.dot(v, q) / size), 12), name) if size else (1, 0, name)
        out[q_id] = [name for name, _ in sorted(chunks.items(), key=order)[:k]]
    return out


def search(spark, questions, chunks, k, **options):
    qs = spark.createDataFrame(list(questions.items()), "q_id int, qvec array<float>")
    cs = spark.createDataFrame(list(chunks.items()), "chunk_id string, embedding array<float>").repartition(3)
    rows = knn.top_k(qs, cs, k, **options).orderBy("q_id", "rank").collect()
    out = {q: [] for q in questions}
    for r in rows:
        assert r["rank"] == len(out[r.q_id]) + 1
        out[r.q_id].append(r.chunk_id)
    return out, rows


SMALL = st.lists(st.sampled_from([-1.0, 0.0, 1.0, 2.0]), min_size=3, max_size=3)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(qs=st.lists(SMALL.filter(any), min_size=1, max_size=6),
       cs=st.lists(st.one_of(st.none(), SMALL), min_size=1, max_size=30), k=st.integers(1, 8))
def test_equals_brute_force(spark, options, qs, cs, k):
    """Few different vectors: many ties, zero and missing vectors."""
    questions = dict(enumerate(qs))
    chunks = {f"c{i:03d}": v for i, v in enumerate(cs)}
    found, _ = search(spark, questions, chunks, k, **options)
    assert found == brute_force(questions, chunks, k)


def test_tiles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_QUESTIONS", 4)
    monkeypatch.setattr(knn, "TILE_CHUNKS", 16)
    rng = np.random.default_rng(1)
    questions = {i: rng.normal(size=5).tolist() for i in range(11)}
    chunks = {f"c{i:03d}": rng.normal(size=5).tolist() for i in range(90)}
    chunks |= {f"copy{i:03d}": chunks["c007"] for i in range(60)}
    found, _ = search(spark, questions, chunks, 7, broadcast_bytes=0)
    assert found == brute_force(questions, chunks, 7)


def test_a_scan_holds_one_block_and_one_tile(spark, monkeypatch):
    monkeypatch.setattr(knn, "SCAN_QUESTIONS", 4)
    monkeypatch.setattr(knn, "TILE_CHUNKS", 16)
    rng = np.random.default_rng(3)
    questions = {i: rng.normal(size=5).tolist() for i in range(11)}
    chunks = {f"c{i:03d}": rng.normal(size=5).tolist() for i in range(60)}
    chunks |= {f"copy{i:03d}": chunks["c007"] for i in range(30)}
    found, _ = search(spark, questions, chunks, 7)
    assert found == brute_force(questions, chunks, 7)
    qs = spark.createDataFrame(list(questions.items()), "q_id int, qvec array<float>")
    cs = spark.createDataFrame(list(chunks.items()), "chunk_id string, embedding array<float>").coalesce(1)
    handed_on = knn._scan(qs, cs, 7, knn._candidates_schema(qs.schema["q_id"].dataType))
    assert handed_on.count() >= 11 * 7 * 5  # what is best in each tile, not in the task


def test_parts_shuffle_no_vectors(spark, monkeypatch):
    """Many questions: a part of them is broadcast at a time, and a task hands on what is best in
    all its tiles, copies, zero and missing vectors among them."""
    monkeypatch.setattr(knn, "SCAN_QUESTIONS", 3)
    monkeypatch.setattr(knn, "TILE_CHUNKS", 16)
    handed_on = []
    ranked = knn._ranked

    def counted(found, k):
        handed_on.append(found.count())
        return ranked(found, k)

    monkeypatch.setattr(knn, "_ranked", counted)
    monkeypatch.setattr(knn, "_tiles", None)
    rng = np.random.default_rng(5)
    questions = {i: rng.normal(size=5).tolist() for i in range(23)}
    chunks = {f"c{i:03d}": rng.normal(size=5).tolist() for i in range(150)}
    chunks |= {f"copy{i:03d}": chunks["c007"] for i in range(60)} | {"none": None, "zero": [0.0] * 5}
    found, _ = search(spark, questions, chunks, 7, broadcast_bytes=700)
    assert found == brute_force(questions, chunks, 7)
    assert len(handed_on) == 3 and sum(handed_on) == 23 * 7 * 3  # of three partitions, whatever their tiles
    few = dict(list(questions.items())[:2])
    assert search(spark, few, {"zero": [0.0] * 5, "none": None, "b": [1.0] * 5}, 7, broadcast_bytes=50)[0] == {q: ["b", "zero", "none"] for q in few}


def test_close_scores_are_told_apart(spark):
    """Differences that single precision does not show."""
    base = np.array([1.0, 2.0, 3.0, 4.0])
    chunks = {f"c{(i * 7) % 40:02d}": (base + [0, 0, 0, i * 1e-6]).astype(np.float32).tolist() for i in range(40)}
    questions = {0: [1.0, 2.0, 3.0, 4.0], 1: [-1.0, 0.5, 0.0, 1.0]}
    for options in ({}, {"broadcast_bytes": 0}):
        assert search(spark, questions, chunks, 5, **options)[0] == brute_force(questions, chunks, 5)


def test_scores_and_prefix(spark):
    rng = np.random.default_rng(2)
    questions = {i: rng.normal(size=4).tolist() for i in range(3)}
    chunks = {f"c{i}": rng.normal(size=4).tolist() for i in range(20)} | {"zero": [0.0] * 4, "none": None}
    six, _ = search(spark, questions, chunks, 6)
    seven, _ = search(spark, questions, chunks, 7)
    assert all(seven[q][:6] == six[q] for q in questions)
    every, rows = search(spark, questions, chunks, 50)
    assert every[0][-2:] == ["zero", "none"]
    assert rows[-1].similarity is None and np.isnan(rows[-2].similarity)
    pairs = spark.createDataFrame([(questions[0], chunks["c3"])], "a array<float>, b array<float>")
    expected = pairs.select(V.cosine_similarity(F.col("a"), F.col("b"))).first()[0]
    assert [r for r in rows if r.q_id == 0 and r.chunk_id == "c3"][0].similarity == pytest.approx(expected)


def test_width_is_checked(spark):
    with pytest.raises(Exception, match="different widths"):
        search(spark, {0: [1.0, 2.0]}, {"a": [1.0, 2.0], "b": [1.0]}, 1)


def test_unit_length(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    found = [r[0] for r in rows.select(V.l2_normalize(F.col("v"))).collect()]
    assert found[0] == pytest.approx([0.6, 0.8]) and found[1:] == [[0.0, 0.0], None]
