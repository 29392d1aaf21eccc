"""Vector arithmetic as column expressions; sums are kept in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12  # fixed value, keeps a zero vector at zero
DECIMALS = 6     # fixed value, precision of stored and of query vectors


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    total = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(total)


def cosine_similarity(a: Column, b: Column) -> Column:
    """`1 - cosine distance`; NaN when a side has length zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0.0, F.lit(float("nan"))).otherwise(dot(a, b) / lengths)


def l2_normalize(v: Column) -> Column:
    # array_repeat carries the length into the lambda, so it is computed once per
    # row and not once per element.
    size = F.size(v)
    lengths = F.array_repeat(norm(v) + F.lit(EPSILON), size)
    unit = F.zip_with(v, lengths, lambda x, n: (x.cast("double") / n).cast("float"))
    return F.when(v.isNotNull(), unit)


def quantize(v: Column) -> Column:
    """Six decimals. Scaled and rounded to even: `round` would go through the
    decimal text of every element."""
    scale = float(10**DECIMALS)
    return F.transform(v, lambda x: (F.rint(x.cast("double") * scale) / scale).cast("float"))
