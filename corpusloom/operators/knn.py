"""Exact cosine top-k of a question table over a chunk table.

Every question is compared with every chunk by matrix products inside the tasks;
no row pairs are ever made. Blocks of questions meet tiles of chunks, and of each such
meeting at most k rows per question go on, so a task holds no more than one block and
one tile at work. Content stays out of this job: it is joined to the few winners
afterwards (`with_chunks`).

Few questions are broadcast, behind a check of their size, and the chunk table
is then scanned in place. Many are broadcast part by part, a scan for each, whose
tasks hand on what is best in all of their chunks: no vector is shuffled, and what is grows
with the questions alone. Where nothing may be broadcast, both meet in groups.

Products are made in single precision first; what could be among the best k by them,
given a bound of their error, is computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import new_dir, written

BROADCAST_BYTES = 64 << 20   # question vectors sent to every worker, at most
ASSUMED_WIDTH = 4096         # where the first question has no vector
HIT_BYTES = 128              # a row of the result, about
BLOCK_QUESTIONS = 16_384     # questions that meet a tile, about
SCAN_QUESTIONS = 4_096       # the same where nothing is shuffled for them
TILE_CHUNKS = 65_536         # chunks of a tile, about
_CELLS = 2 << 20             # scores held at a time
_STEPS = (1024, 8192)        # chunks compared at a time: the first few set a floor for the rest

# Scores are whole multiples of this, so that equal vectors tie whatever the
# shape of the product they came from, and the chunk id decides.
_SCALE = 1e12
_NAN, _NULL, _NONE = -2 * _SCALE, -3 * _SCALE, -4 * _SCALE  # order: scores, NaN, null, unused


def _matrix(vectors: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, width) unit rows in double, and masks of the null and of the zero rows,
    which stay zero."""
    missing = np.asarray(vectors.is_null())
    present = vectors.drop_null()
    lengths = np.asarray(pc.list_value_length(present))
    if width is None:
        width = int(lengths[0]) if len(lengths) else 0
    if len(lengths) and not (lengths == width).all():
        raise ValueError(f"vectors of different widths; expected {width}")
    rows = np.asarray(present.flatten(), dtype=np.float64).reshape(-1, width)
    sizes = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows = rows / np.where(sizes == 0, 1, sizes)[:, None]
    if not missing.any():
        return rows, missing, sizes == 0
    out, zero = np.zeros((len(vectors), width)), np.zeros(len(vectors), dtype=bool)
    out[~missing], zero[~missing] = rows, sizes == 0
    return out, missing, zero


class _Best:
    """The best k chunks of a tile for each question of a block."""

    def __init__(self, q_ids: pa.Array, vectors: pa.Array, k: int):
        present = vectors.is_valid()
        q_ids, vectors = q_ids.filter(present), vectors.filter(present)
        self.q_ids, self.k = q_ids, k
        self.questions, _, self.zero = _matrix(vectors, None)
        # Of a product of unit vectors in single precision, whatever the order of its sum.
        self.error = (self.questions.shape[1] + 16) * 2.0**-23
        self.keys = np.full((len(q_ids), k), _NONE)
        self.columns = np.zeros((len(q_ids), k), dtype=np.int64)  # places among the tile's ids, in order

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        """The tile's chunks by id, in steps: what came first wins among equals."""
        order = pc.sort_indices(ids)
        self.ids = ids.take(order)
        done, step = 0, min(_STEPS)
        while done < len(order) and len(self.q_ids):
            self._add(vectors.take(order.slice(done, step)), done)
            done, step = done + step, max(_STEPS)

    def _add(self, vectors: pa.Array, done: int) -> None:
        chunks, missing, zero = _matrix(vectors, self.questions.shape[1])
        short, fixed = chunks.astype(np.float32).T, np.zeros(len(chunks))
        fixed[zero], fixed[missing] = _NAN, _NULL
        step = max(1, _CELLS // len(chunks))
        for first in range(0, len(self.questions), step):
            rows = slice(first, first + step)
            scores = self.questions[rows].astype(np.float32) @ short
            scores[:, zero] = _NAN / _SCALE
            scores[self.zero[rows]] = _NAN / _SCALE
            scores[:, missing] = _NULL / _SCALE
            # Most rows of most batches hold nothing better, and are left here.
            worst = self.keys[rows, -1]
            hit = np.nonzero(scores.max(axis=1) >= (worst - 1) / _SCALE - self.error)[0]
            if len(hit):
                keys, columns = self._select(scores[hit], worst[hit], hit + first, chunks, fixed)
                self._merge(hit + first, keys, columns + done)

    def _exact(self, rows: np.ndarray, columns: np.ndarray, chunks: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Keys of pairs. Each is computed by itself, so equal vectors have equal keys."""
        keys, step = np.empty(len(rows)), max(1, _CELLS // (8 * max(1, chunks.shape[1])))
        for first in range(0, len(rows), step):
            part = slice(first, first + step)
            keys[part] = np.einsum("ij,ij->i", self.questions[rows[part]], chunks[columns[part]])
        keys = np.rint(keys * _SCALE)
        keys[self.zero[rows]] = _NAN
        return np.where(fixed[columns] == _NULL, _NULL, np.where(fixed[columns] == _NAN, _NAN, keys))

    def _select(
        self, scores: np.ndarray, worst: np.ndarray, rows: np.ndarray, chunks: np.ndarray, fixed: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(n, k) keys and columns of the best scores per row, in order, that are no
        worse than the worst one kept; what is left over is filled with _NONE."""
        n, k = scores.shape[1], self.k
        floor = (worst - 1) / _SCALE - self.error
        empty = worst <= _NONE
        if empty.any() and n > k:
            floor[empty] = np.partition(scores[empty], n - k, axis=1)[:, n - k] - 2 * self.error
        mask = scores >= floor[:, None]
        keys = np.full((len(scores), k), _NONE)
        columns = np.zeros((len(scores), k), dtype=np.int64)
        # Rows with very many ties are cut one by one, without sorting them all.
        for r in np.nonzero(mask.sum(axis=1) > 8 * k)[0]:
            near = np.nonzero(mask[r])[0]
            mask[r] = False
            row = self._exact(np.full(len(near), rows[r]), near, chunks, fixed)
            edge = np.partition(row, len(near) - k)[len(near) - k]
            above = np.nonzero(row > edge)[0]
            chosen = np.concatenate([above, np.nonzero(row == edge)[0][: k - len(above)]])
            chosen = chosen[np.argsort(-row[chosen], kind="stable")]
            keys[r], columns[r] = row[chosen], near[chosen]
        r, c = np.nonzero(mask)
        values = self._exact(rows[r], c, chunks, fixed)
        order = np.lexsort((c, -values, r))
        r, c, values = r[order], c[order], values[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < k
        keys[r[kept], place[kept]] = values[kept]
        columns[r[kept], place[kept]] = c[kept]
        return keys, columns

    def _merge(self, rows: np.ndarray, new_keys: np.ndarray, new_columns: np.ndarray) -> None:
        all_keys = np.concatenate([self.keys[rows], new_keys], axis=1)
        all_columns = np.concatenate([self.columns[rows], new_columns], axis=1)
        order = np.argsort(-all_keys, axis=1, kind="stable")[:, : self.k]
        self.keys[rows] = np.take_along_axis(all_keys, order, axis=1)
        self.columns[rows] = np.take_along_axis(all_columns, order, axis=1)

    def result(self) -> pa.Table:
        row, col = np.nonzero(self.keys > _NONE)
        keys = self.keys[row, col]
        scores = np.where(keys == _NAN, np.nan, keys / _SCALE)
        return pa.table({
            "q_id": self.q_ids.take(pa.array(row)),
            "chunk_id": self.ids.take(pa.array(self.columns[row, col])),
            "similarity": pa.array(scores, pa.float64(), mask=keys == _NULL),
        })


def _candidates_schema(q_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("q_id", q_type),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ])


def _tiles_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most `size`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            if held and sum(b.num_rows for b in held) + part.num_rows > size:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _shared(questions: DataFrame) -> Broadcast:
    """The ids and vectors of questions, broadcast."""
    table = questions.toArrow().combine_chunks()
    return questions.sparkSession.sparkContext.broadcast(
        (table.column("q_id").combine_chunks(), table.column("qvec").combine_chunks())
    )


def _scan(questions: DataFrame, chunks: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Questions broadcast; one pass over the chunk table where it lies. A task works on
    a tile and a block at a time and hands on what it found, whatever their numbers."""
    shared = _shared(questions)
    block, size = SCAN_QUESTIONS, TILE_CHUNKS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, vectors = shared.value
        for tile in _tiles_of(batches, size):
            ids, embeddings = tile.column("chunk_id").combine_chunks(), tile.column("embedding").combine_chunks()
            for first in range(0, len(q_ids), block):
                best = _Best(q_ids.slice(first, block), vectors.slice(first, block), k)
                best.add(ids, embeddings)
                yield from best.result().to_batches()

    return chunks.mapInArrow(search, schema)


def _first_k(found: pa.Table, k: int) -> pa.Table:
    """The best k rows of each question, in the order of `top_k`."""
    scores = np.asarray(found.column("similarity").combine_chunks())
    missing = np.asarray(found.column("similarity").combine_chunks().is_null())
    keys = np.where(missing, _NULL, np.where(np.isnan(scores), _NAN, scores))
    order = [("q_id", "ascending"), ("_key", "descending"), ("chunk_id", "ascending")]
    found = found.take(pc.sort_indices(found.append_column("_key", pa.array(keys)), sort_keys=order))
    places = np.asarray(found.column("q_id").combine_chunks())
    return found.filter(pa.array(np.arange(len(places)) - np.searchsorted(places, places) < k)).combine_chunks()


def _passes(questions: DataFrame, chunks: DataFrame, k: int, schema: T.StructType, parts: int) -> DataFrame:
    """The best k of each question, as a table: parts of the questions are broadcast one after
    the other, and the chunk table is scanned in place for each. A task goes through its
    tiles with all blocks of the part, and holds no more than k rows per question of it.
    There are as many tasks as run at once, for each hands on k rows per question."""
    spark, path = questions.sparkSession, new_dir(questions.sparkSession, "nearest")
    questions = written(questions, "vectors").withColumn("_part", F.pmod(F.xxhash64("q_id"), F.lit(parts)))
    narrow = chunks.select("chunk_id", "embedding").coalesce(max(1, spark.sparkContext.defaultParallelism))
    block, size = SCAN_QUESTIONS, TILE_CHUNKS

    for part in range(parts):
        shared = _shared(questions.where(F.col("_part") == part).drop("_part"))

        def search(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            q_ids, vectors = shared.value
            places, best = pa.array(np.arange(len(q_ids))), {}
            for tile in _tiles_of(batches, size):
                ids, embeddings = tile.column("chunk_id").combine_chunks(), tile.column("embedding").combine_chunks()
                for first in range(0, len(q_ids), block):
                    found = _Best(places.slice(first, block), vectors.slice(first, block), k)
                    found.add(ids, embeddings)
                    more = found.result()
                    best[first] = _first_k(pa.concat_tables([best[first], more]), k) if first in best else more
            for found in best.values():
                yield from found.set_column(0, "q_id", q_ids.take(found.column("q_id").combine_chunks())).to_batches()

        _ranked(narrow.mapInArrow(search, schema), k).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.parquet(path)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("q_id").orderBy(
        (1.0 - F.col("similarity")).asc_nulls_last(), F.col("chunk_id")
    )
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("q_id", "rank", "chunk_id", "similarity")


def _tiles(
    questions: DataFrame, chunks: DataFrame, k: int, schema: T.StructType,
    n_questions: int, n_chunks: int,
) -> DataFrame:
    """Each question block meets each chunk tile in one group. Blocks and tiles
    are cut by the hash of unique ids, so their sizes keep close to the mean."""
    n_blocks = -(-n_questions // BLOCK_QUESTIONS)
    n_tiles = -(-n_chunks // TILE_CHUNKS)

    def part(column: str, n: int):
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = questions.select("q_id", "qvec", part("q_id", n_blocks).alias("block"), every(n_tiles).alias("tile"))
    right = chunks.select("chunk_id", "embedding", part("chunk_id", n_tiles).alias("tile"), every(n_blocks).alias("block"))

    def search(qs: pa.Table, cs: pa.Table) -> pa.Table:
        q_ids = qs.column("q_id").combine_chunks()
        if not len(q_ids) or not cs.num_rows:
            return pa.table({
                "q_id": q_ids.slice(0, 0),
                "chunk_id": pa.array([], pa.string()),
                "similarity": pa.array([], pa.float64()),
            })
        best = _Best(q_ids, qs.column("qvec").combine_chunks(), k)
        best.add(cs.column("chunk_id").combine_chunks(), cs.column("embedding").combine_chunks())
        return best.result()

    return (
        left.groupBy("block", "tile")
        .cogroup(right.groupBy("block", "tile"))
        .applyInArrow(search, schema)
    )


def top_k(
    questions: DataFrame, chunks: DataFrame, k: int, *, broadcast_bytes: int = BROADCAST_BYTES,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Questions `q_id, qvec` against chunks `chunk_id, embedding`: rows
    `q_id, rank, chunk_id, similarity`, by ascending distance.

    Both ids must be unique. NaN ranks behind all numbers and a missing vector
    behind NaN; ties go by chunk id. Rows without `qvec` have no result. The
    questions are counted when this is called: their number decides the form.
    `then` may choose among these rows, before columns of the chunks are joined: it must
    return no more rows than it gets, and none that are much wider.
    """
    # Counted without the vectors, and measured on one of them: neither makes the
    # vectors of all questions. Questions without one are dropped where they are
    # read; a filter here would be pushed below the embedding and repeat it.
    id_bytes = F.octet_length(F.col("q_id").cast("string"))
    n, id_bytes = questions.agg(F.count(F.lit(1)), F.coalesce(F.max(id_bytes), F.lit(0))).first()
    questions = questions.select("q_id", "qvec")
    first = questions.select(F.size("qvec")).first()
    width = first[0] if first and (first[0] or 0) > 0 else ASSUMED_WIDTH
    chunks = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "embedding")
    schema = _candidates_schema(questions.schema["q_id"].dataType)
    question_bytes = n * (4 * width + 64 + id_bytes)
    if question_bytes <= broadcast_bytes:
        ranked = _ranked(_scan(questions, chunks, k, schema), k)
    elif broadcast_bytes:
        ranked = _passes(questions, chunks, k, schema, -(-question_bytes // broadcast_bytes))
    else:
        ranked = _ranked(_tiles(questions, chunks, k, schema, n, chunks.count()), k)
    # At most k rows per question: where these are few enough, the joins to come
    # scan the other side in place; else they shuffle.
    few = n * k * (HIT_BYTES + id_bytes) <= broadcast_bytes
    for step in [lambda rows: rows, then] if then else [lambda rows: rows]:
        ranked = step(ranked)
        ranked = F.broadcast(ranked) if few else ranked
    return ranked


def with_chunks(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Join chunk columns to the winners."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")
