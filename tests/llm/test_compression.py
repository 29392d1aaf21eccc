"""Codes and codebooks against plain rounds and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import compression, queries
from tests.llm.brute import connection, same_as_sql


def nearest(part, book):
    best = min(range(len(book)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(part, book[k])), k))
    return best, sum((a - b) ** 2 for a, b in zip(part, book[best]))


def plain(rows, parts=4, entries=256, rounds=4):
    fit = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows
           if v and all(c is not None and math.isfinite(c) for c in v)]
    width = len(fit[0][1]) // parts
    cut = lambda x: [x[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in fit:
                groups.setdefault(nearest(cut(x)[p], books[p])[0], []).append(cut(x)[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    name = hashlib.sha256(",".join(str(v) for book in books for w in book for v in w).encode()).hexdigest()
    out = []
    for i, x, label in fit:
        found = [nearest(part, book) for part, book in zip(cut(x), books)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(e for _, e in found), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], name) for i, code, error, label in out), key=repr)


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int, x int",
    )


def found(frame):
    return sorted(map(tuple, frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_small(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[9][1], None), rows[3], rows[3]]
    odd = [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] * 8, 1), (503, [], 1), (504, [float("-inf")] * 8, 1)]
    made = compression.compressed(table(spark, rows + odd).repartition(4), entries=40)
    assert found(made) == plain(rows + odd, entries=40)


def test_few_and_none(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None), (2, [-5.0, 0.0, 0.001, 100.0], 4)]
    assert found(compression.compressed(table(spark, rows))) == plain(rows)
    assert compression.compressed(table(spark, [])).collect() == []
    assert compression.compressed(table(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        compression.compressed(table(spark, [(1, [1.0, 2.0], 1)]))


@pytest.mark.parametrize("spread", [3, 100, 5000, 1 << 26])
def test_nearest(spread):
    """Cells leave out no nearest entry, also with ties, few cached cells and wide values."""
    rng = np.random.default_rng(spread)
    book = rng.integers(-spread, spread, (50, 3))
    parts = rng.integers(-spread, spread, (300, 3))
    expected = [nearest(p, book.tolist()) for p in parts.tolist()]
    for width in (1, 7, 64, 1 << 20):
        tool = compression.Nearest(book, width, cached=30)
        for _ in range(2):
            index, error = tool(parts)
            assert list(zip(index.tolist(), error.tolist())) == expected


def test_memory_of_cells():
    """Of clustered parts, most entries of a book are never evaluated, and cells are met again."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 8))
    parts = centres[rng.integers(0, 40, 2000)] + rng.integers(-3, 4, (2000, 8))
    tool = compression.Nearest(centres, 64)
    tool(parts[:1000])
    missed = tool.missed
    tool(parts[1000:])
    assert tool.evaluated < 2000 * 40 / 8
    assert tool.missed - missed < missed


def test_decoded():
    books = [np.array([[1, 2], [3, 4]]), np.array([[5], [6]])]
    assert compression.decoded("0100", books) == [3, 4, 5]
    assert compression.digest(books) == hashlib.sha256(b"1,2,3,4,5,6").hexdigest()


def test_query(spark, sf_dir):
    same_as_sql(queries.op13_compression(spark, sf_dir), connection(sf_dir), queries.SQL["op13_compression"])
