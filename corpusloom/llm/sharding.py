"""A reproducible shuffle into shards: a keyed Feistel permutation of row numbers.

Rows get global numbers in the order of their ids; a Feistel network permutes the
numbers, and numbers that leave the range walk on along their cycle until they are
back inside. The permuted number gives shard and slot by division, so the place of
any row can be computed from its number alone, and the row of any place by the
inverse. Shards differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ordering import numbered

ROUNDS = 6
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _round_keys(seed: int) -> np.ndarray:
    return _mixed(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed & (2**64 - 1)))


def _half_bits(total: int) -> int:
    """Half the width of the network: its domain holds `total`, and less than four times that."""
    return max(1, (max(1, total - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: np.ndarray, inverse: bool) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for key in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (_mixed(left ^ key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right ^ key) & mask)
    return (left << _U(half)) | right


def permute(numbers: np.ndarray, total: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..total-1, or its inverse, at the given numbers."""
    half, keys = _half_bits(total), _round_keys(seed)
    with np.errstate(over="ignore"):
        out = _network(numbers.astype(_U), half, keys, inverse)
        while (outside := out >= _U(total)).any():
            out[outside] = _network(out[outside], half, keys, inverse)
    return out.astype(np.int64)


def place(number: int, total: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = int(permute(np.array([number]), total, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int) -> int:
    """The number of the row in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), total, seed, inverse=True)[0])


def shard(rows: DataFrame, *order: Column, shards: int, seed: int = 0) -> DataFrame:
    """The rows with `row_number`, `shard` (0 to shards-1) and `slot` (gapless from 0).

    `order` are the columns that number the rows; the same rows give the same
    result in any run and on any cluster. Nulls come first in the order; repeated
    rows take neighbouring numbers and are spread like any others; an empty table
    gives an empty result. Other columns, whatever their names but these three and
    those beginning with an underscore, are carried along; pass narrow rows and
    keep the texts where they are."""
    total = rows.count()

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, seed))

    at = numbered(rows, *order).withColumn("_at", permuted("row_number"))
    return at.select(
        *rows.columns, "row_number",
        F.pmod("_at", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_at div {shards}").alias("slot"),
    )


def document_shards(documents: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """`doc_id, size, text_crc32, row_number, shard, slot` of a table `doc_id, text`.

    Size is the UTF-8 length plus 1; a null text counts as empty, a null id comes
    first. The texts are only read, never shuffled."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(narrow, F.col("doc_id"), F.col("text_crc32"), F.col("size"), shards=shards, seed=seed)
