"""Vectors of integers: what whitening and compression read from a table of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written

SCALE = 1024
LIMIT = 1 << 30  # of a scaled component; beyond it the job ends with an error


def _whole(vector: Column) -> Column:
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _integer(component: Column, shift: int) -> Column:
    scaled = F.floor(component.cast("double") * SCALE)
    too_large = F.raise_error(F.lit(f"a component of {LIMIT // SCALE} or more")).cast("long")
    return F.when(F.abs(component.cast("double")) * SCALE < LIMIT, scaled + shift).otherwise(too_large)


def integers(embeddings: DataFrame, *carried: str, shift: int = 0) -> tuple[DataFrame, int]:
    """A table of the carried columns and `x`, floor(1024 * component) + `shift` as longs, of the
    rows whose `embedding` is a vector of finite numbers; and the length of these.

    Null vectors, empty ones and such as hold nulls, NaN or infinities are left out. The
    length is that of most vectors (the longer of equally many); vectors of other
    lengths are left out as well. Other columns are ignored, repeated rows all kept. An
    empty table gives an empty one and length 0."""
    fit = embeddings.where(_whole(F.col("embedding"))).where(F.size("embedding") > 0)
    lengths = fit.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    length = most.length if most else 0
    x = F.transform("embedding", lambda c: _integer(c, shift))
    return written(fit.where(F.size("embedding") == length).select(*carried, x.alias("x")), "vectors"), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch's vectors as the rows of a matrix."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, length)
