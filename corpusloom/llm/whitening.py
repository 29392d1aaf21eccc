"""Whitening by a covariance matrix from variances alone.

For any two dimensions the variance of their sum is the sum of their variances and
twice their covariance. So squares of centred values are summed for every dimension
and for the sum of every two, as whole numbers and without rounding, and the
differences give all covariances. Each task hands on one partial sum per dimension
pair, the driver holds one number per pair: neither grows with the rows. Eigenvectors
of the assembled matrix project the rows in a last pass over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.vectors import integers, matrix
from corpusloom.session import written

SHIFT = 100_000
COMPONENTS = 8
FLAT = 1e-12   # of the largest eigenvalue: below it a component has no spread
_SMALL = 20    # bits of a centred value up to which a batch's sums of squares fit in a long
_EXACT = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Model:
    n: int
    sums: tuple[int, ...]  # per dimension
    values: np.ndarray     # of the covariance matrix, falling
    vectors: np.ndarray    # one per column
    trace: float


def _centre(n: int, sums: list[int]) -> tuple[list[int], list[int]]:
    """The whole number next to each mean, and n times what is left: x - mean = ((x - q) * n - r) / n."""
    q = [(2 * s + n) // (2 * n) for s in sums]
    return q, [s - n * c for s, c in zip(sums, q)]


def _added(partials: DataFrame) -> dict[tuple[int, int], int]:
    """Sums per `number` and place of arrays `sums`; as many as a dimension pair's at most."""
    each = partials.select("number", F.posexplode("sums"))
    found = each.groupBy("number", "pos").agg(F.sum("col").alias("sum")).collect()
    return {(r.number, r.pos): int(r.sum) for r in found}


_PARTIAL = "number int, sums array<decimal(38,0)>"


def _partial_rows(sums: list[list[int]]) -> pa.RecordBatch:
    lists = pa.array([[int(v) for v in row] for row in sums], pa.list_(_EXACT))
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), lists], names=["number", "sums"])


def _totals(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(length, dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), length)
            count += len(x)
            sums = sums + x.sum(axis=0).astype(object)
        if count:
            yield _partial_rows([[count, *sums]])

    found = _added(rows.select("x").mapInArrow(run, _PARTIAL))
    return found.get((0, 0), 0), [found.get((0, i + 1), 0) for i in range(length)]


def _squares(rows: DataFrame, q: list[int]) -> dict[tuple[int, int], int]:
    """Sums of squares of y = x - q, at (i, 0), and of y_i + y_j, at (i, j - i)."""
    length, near = len(q), np.array(q, dtype=np.int64)

    def pairs(y: np.ndarray) -> list[np.ndarray]:
        out = []
        for i in range(length):
            both = y[:, i:] + y[:, i : i + 1]
            both[:, 0] = y[:, i]
            out.append((both * both).sum(axis=0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = [np.zeros(length - i, dtype=object) for i in range(length)], False
        for batch in batches:
            y = matrix(batch.column(0), length) - near
            wide = (np.abs(y) >> _SMALL).any(axis=1)
            for part in (y[~wide], y[wide].astype(object)):
                if len(part):
                    some = True
                    sums = [s + p.astype(object) for s, p in zip(sums, pairs(part))]
        if some:
            yield _partial_rows([list(s) for s in sums])

    return _added(rows.select("x").mapInArrow(run, _PARTIAL))


def fit(rows: DataFrame, length: int) -> Model:
    """The model of a table with `x`, vectors of longs of one length. Every sum is exact; the
    first rounding is that of each covariance to the nearest double."""
    n, sums = _totals(rows, length)
    if not n:
        return Model(0, (), np.empty(0), np.empty((0, 0)), 0.0)
    q, r = _centre(n, sums)
    squares = _squares(rows, q)
    # n^3 times the variances of the dimensions and of the sums of two.
    own = [n * squares[i, 0] - r[i] ** 2 for i in range(length)]
    covariance = np.empty((length, length))
    for i in range(length):
        for j in range(i, length):
            cross = 2 * own[i] if i == j else n * squares[i, j - i] - (r[i] + r[j]) ** 2 - own[i] - own[j]
            covariance[i, j] = covariance[j, i] = cross / (2 * n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(length)] < 0, -1.0, 1.0)
    return Model(n, tuple(sums), values, vectors, sum(own) / (n * n))


def whitened(rows: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """The rows' other columns with `deviation`, the exact sum of (n * x - S)^2 as decimal(38,0), and
    `whitened`, the coordinates on the first components over the roots of their
    eigenvalues; null on a component without spread."""
    carried = [c for c in rows.columns if c != "x"]
    length, (q, r) = len(model.sums), _centre(model.n, list(model.sums))
    near, rest = np.array(q, dtype=np.int64), np.array(r, dtype=object)
    shown = min(components, length)
    spread = model.values[:shown] > FLAT * max(model.values[0], 0.0)
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, model.values[:shown], 1.0)), np.nan)
    axes = model.vectors[:, :shown] * scale
    n = model.n
    rest_sum = int((rest * rest).sum())
    flat = [k for k in range(shown) if not spread[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch.column(batch.num_columns - 1), length) - near
            wide = y.astype(object)
            # The sum of (n * y - r)^2 over the dimensions.
            deviation = n * n * (wide * wide).sum(axis=1) - 2 * n * (wide * rest).sum(axis=1) + rest_sum
            centred = ((n * wide - rest) / n).astype(np.float64)
            found = centred @ axes
            lists = [[None if k in flat else v for k, v in enumerate(row)] for row in found.tolist()] if flat else found.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([int(v) for v in deviation], _EXACT), pa.array(lists, pa.list_(pa.float64()))],
                names=[*carried, "deviation", "whitened"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
    schema = ", ".join(filter(None, [kinds, "deviation decimal(38,0)", "whitened array<double>"]))
    return rows.select(*carried, "x").mapInArrow(run, schema)


def identity_error(rows: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of `whitened`, over the components that have
    spread, minus the identity; NaN if none has."""
    at = [F.get("whitened", F.lit(k)) for k in range(components)]
    means = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(at)]).first()
    live = [k for k in range(components) if means[k] is not None]
    if not live:
        return float("nan")
    centred = {k: at[k] - F.lit(means[k]) for k in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    found = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`, a row for each vector and
    component (from 1), of a table `vec_id, embedding` (others ignored).

    Which vectors count, and as what integers, is said at `vectors.integers`; repeated rows
    count one by one, and null ids stay. Vectors of fewer dimensions than `components`
    have as many components as dimensions. A component without spread (one row, equal
    rows) has a null `whitened` and no part in `identity_error`. Equal eigenvalues leave the
    choice of axes to the solver; all rows share it. An empty table, or one without
    such vectors, gives an empty result."""
    rows, length = integers(embeddings, "vec_id", shift=SHIFT)
    model = fit(rows, length)
    if not model.n:
        # The columns, and no rows.
        return rows.select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        ).limit(0)
    made = written(whitened(rows, model, components), "whitened")
    shown = min(components, length)
    error = identity_error(made, shown)
    share = [float(v) / model.trace if model.trace else None for v in model.values[:shown]]
    shares = F.array(*[F.lit(s).cast("double") for s in share])
    each = made.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
