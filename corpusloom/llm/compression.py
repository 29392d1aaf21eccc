"""Compression of vectors to codes, with memoised grid cells.

A vector is cut into equal parts, and each part becomes the index of the nearest entry
of its position's codebook. A part lies in a cell of a coarse grid; the cell's box
has a least and a greatest distance to each entry, and an entry whose least distance
is above another's greatest is nowhere in the box the nearest. The entries that are left
are remembered by the cell's hash, and only to these a part's distance is worked out,
exactly. Codebooks are learnt in rounds over all rows: assignment and sums in the
tasks, a codebook's worth of sums to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import _bounded
from corpusloom.llm.vectors import integers, matrix
from corpusloom.session import written

PARTS, ENTRIES, ROUNDS = 4, 256, 4
CELL = 32             # width of a grid cell
CACHED_CELLS = 20_000 # per part position; beyond it the memory of cells begins anew
_SMALL = 1 << 24      # components up to which squared distances fit in a long
_BLOCK = 128          # cells, or 32 times as many candidates, at a time

Books = list[np.ndarray]  # by part position: entries as rows


def _exactly(values: np.ndarray) -> np.ndarray:
    return values.astype(object) if values.size and np.abs(values).max() > _SMALL else values


class Nearest:
    """The nearest entry of one part position's codebook, ties to the lower index."""

    def __init__(self, book: np.ndarray, width: int = CELL, cached: int = CACHED_CELLS):
        self.book, self.width, self.cached = book, width, cached
        self.cells: dict[bytes, np.ndarray] = {}
        self.evaluated = self.missed = 0  # distances and cells worked out

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries of each cell that may be the nearest somewhere in it. All lengths are
        doubled, so that the middle of a box is a whole number."""
        half, middles, book = self.width - 1, 2 * cells * self.width + self.width - 1, 2 * self.book
        largest = max((int(np.abs(v).max()) for v in (middles, book) if v.size), default=0)
        square = book.shape[1] * (2 * largest + half) ** 2
        kind = np.int32 if square < 1 << 31 else np.int64 if square < 1 << 63 else object
        middles, book = middles.astype(kind), book.astype(kind)
        out: list[np.ndarray] = []
        for first in range(0, len(cells), _BLOCK):
            some = middles[first : first + _BLOCK]
            least = np.zeros((len(some), len(book)), dtype=kind)
            greatest = least.copy()
            for middle, entry in zip(some.T, book.T):
                apart = np.abs(np.subtract.outer(middle, entry))
                across = apart + half
                greatest += across * across
                inside = np.maximum(apart - half, 0)
                least += inside * inside
            out += [np.nonzero(row)[0] for row in least <= greatest.min(axis=1, keepdims=True)]
        return out

    def _candidates(self, parts: np.ndarray) -> list[np.ndarray]:
        cells, which = np.unique(parts // self.width, axis=0, return_inverse=True)
        keys = [row.tobytes() for row in cells]
        if len(self.cells) + len(keys) > self.cached:
            self.cells = {}
        new = [k for k, key in enumerate(keys) if key not in self.cells]
        self.missed += len(new)
        self.cells.update(zip([keys[k] for k in new], self._undominated(cells[new])))
        return [self.cells[keys[k]] for k in which.ravel()]

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each row of `parts`."""
        index = np.empty(len(parts), dtype=np.int64)
        error: list[int] = []
        candidates = self._candidates(parts) if len(parts) else []
        sizes = np.array([len(c) for c in candidates], dtype=np.int64)
        block = np.cumsum(sizes) // (_BLOCK * 32)
        bounds = [0, *(np.nonzero(np.diff(block))[0] + 1), len(parts)]
        for first, end in zip(bounds, bounds[1:]):
            if first == end:
                continue
            flat = np.concatenate(candidates[first:end])
            some = sizes[first:end]
            starts = np.concatenate([[0], np.cumsum(some)[:-1]])
            apart = _exactly(np.repeat(parts[first:end], some, axis=0) - self.book[flat])
            far = (apart * apart).sum(axis=1)
            least = np.minimum.reduceat(far, starts)
            ties = np.where(far == np.repeat(least, some), flat, len(self.book))
            index[first:end] = np.minimum.reduceat(ties, starts)
            error += least.tolist()
            self.evaluated += len(flat)
        return index, np.array(error, dtype=object)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def first_books(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """The parts of the vectors with the smallest ids (a null id last, rows of one id by vector)."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("x"))
    first = rows.orderBy(*order).limit(entries).collect()
    return _cut(np.array([r.x for r in first], dtype=np.int64).reshape(-1, length), parts)


def updated(rows: DataFrame, length: int, books: Books) -> Books:
    """The books after a round: entries become the floors of the means of the parts next to them."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Nearest(book) for book in books]
        sums = [np.zeros((len(book), book.shape[1] + 1), dtype=np.int64) for book in books]
        for batch in batches:
            for finder, part, total in zip(finders, _cut(matrix(batch.column(0), length), parts), sums):
                index, _ = finder(part)
                np.add.at(total, index, np.hstack([np.ones((len(part), 1), dtype=np.int64), part]))
        for number, total in enumerate(sums):
            used = np.nonzero(total[:, 0])[0]
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), number), pa.int32()), pa.array(used, pa.int32()),
                     pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"],
                )

    partials = rows.select("x").mapInArrow(run, "part int, entry int, sums array<long>")
    each = partials.select("part", "entry", F.posexplode("sums"))
    found = each.groupBy("part", "entry", "pos").agg(F.sum("col").alias("sum")).collect()
    sums = {(r.part, r.entry, r.pos): r.sum for r in found}
    out = [book.copy() for book in books]
    for (part, entry, pos), total in sums.items():
        if pos:
            out[part][entry, pos - 1] = total // sums[part, entry, 0]
    return out


def trained(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of a table `vec_id, x` of vectors of `length` longs."""
    books = first_books(rows, length, parts, entries)
    for _ in range(rounds):
        books = updated(rows, length, books)
    return books


def encoded(rows: DataFrame, length: int, books: Books) -> DataFrame:
    """The rows' other columns with `code` (two hex digits a part) and `error`, the squared distances
    to the entries, summed."""
    carried = [c for c in rows.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Nearest(book) for book in books]
        for batch in batches:
            cut = _cut(matrix(batch.column(batch.num_columns - 1), length), len(books))
            found = [finder(part) for finder, part in zip(finders, cut)]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*[index.tolist() for index, _ in found])]
            errors = [int(e) for e in sum(error for _, error in found)] if codes else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*carried, "code", "error"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")
    return rows.select(*carried, "x").mapInArrow(run, ", ".join(filter(None, [kinds, "code string, error long"])))


def decoded(code: str, books: Books) -> list[int]:
    """The vector that a code stands for."""
    return [int(v) for k, book in enumerate(books) for v in book[int(code[2 * k : 2 * k + 2], 16)]]


def digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """`vec_id, code, error, label_error, codebooks_sha256`, a row per vector of a table
    `vec_id, embedding, label` (others ignored).

    Which vectors count, and as what integers, is said at `vectors.integers`; their length has to
    be a multiple of `parts`. Codebooks start with the smallest ids, null last, rows of
    one id by vector; with fewer rows they have fewer entries. Repeated rows count one by
    one. Null labels are a group of their own. An empty table, or one without such
    vectors, gives an empty result."""
    rows, length = integers(embeddings, "vec_id", "label")
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    if not length:
        books: Books = []
        made = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    else:
        books = trained(rows.select("vec_id", "x"), length, parts, entries, rounds)
        made = written(encoded(rows, length, books), "codes")
    sums = made.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    met = made.join(_bounded(written(sums, "label_errors")), F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
