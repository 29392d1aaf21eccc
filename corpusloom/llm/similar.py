"""Near duplicates by exact similarity: the Jaccard measure of two texts' sets of shingles.

All shingles have one order, the same for every text. Two sets that share four fifths
of their union share a shingle among the first fifth of each (and one more), so texts
that never meet in a cell, which is such a shingle, need no comparison: nothing is
missed. The order puts shingles that a sample of the texts has often last, which keeps
cells small; the result does not depend on it. In the first cell that two sets share,
whatever stands before its shingle in either is not in the other, so members that
have it late do not meet.

Texts of a small cell are compared in pairs. In a crowded one each is compared with a few
members, the same in all cells that have them; what is linked by then needs no further
comparison. Members of a crowded cell meet, then and later, only if the parities of
their shingles differ in few enough bits, which the join itself decides: its rows are
pairs that are similar but for chance. A set has the more parities the larger it is, since
too few of them say nothing about many shingles.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.exact_dedup import BROADCAST_ROWS, _bounded, text_key
from corpusloom.llm.simhash import SEED, components
from corpusloom.session import unsized, written

PART, WHOLE = 4, 5     # similar from 4 / 5 on
CROWD = 16             # texts in a cell that are still paired at once
CENTRES = 16           # of a crowded cell, that each of its texts is compared with
SAMPLE_TEXTS = 20_000  # about, whose shingles are counted for the order
OFTEN = 2              # of them have a shingle that goes last
MOST_OFTEN = 50_000    # such shingles; the driver holds them
BITS = 2048            # of the parities of a set of up to so many shingles, a power of two; of a larger one, as many times 2
FOLDED = 8             # words of the parities that a join compares first
_BATCH = 1 << 16       # shingles in a batch, about


def _hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; words are those of `simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(gram), SEED) for gram in grams), dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(_hashes(text, width))


def _key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), dtype=np.uint64).view(np.int64))


def _parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles has each value of some bits, in words of 64. Half of
    twice as many is the bitwise difference of the halves."""
    size = BITS << (max(len(found) - 1, 0) // BITS).bit_length()
    odd = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _first(found: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles that come first where the shingles `often` go last, by `times`: as many as
    two similar sets need to share one."""
    rank = np.zeros(len(found), dtype=np.int64)
    if len(often) and len(found):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, times[at], 0)
    count = len(found) - -(-len(found) * PART // WHOLE) + 1
    return found[np.lexsort((found, rank))[:count]]


def _sets(documents: DataFrame, width: int, often: np.ndarray, times: np.ndarray) -> DataFrame:
    """`doc_id, text_key, fp, set_key, n, bits, folded, first` of every row: its fingerprint, a name of
    its set of shingles, its size, its parities, those of fewer, larger classes, and its first
    shingles. Two sets differ in as many shingles at least as in parities."""
    names = ["doc_id", "text_key", "fp", "set_key", "n", "bits", "folded", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
            *numbers, bits, folded, first = zip(*rows)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, of)]), pa.int32()), pa.array(np.concatenate(of), pa.int64()))
                for of in (bits, folded, first)
            ]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in numbers], *lists], names=names,
            )

        for batch in batches:
            rows, start, size = [], 0, 0
            for number, text in enumerate(batch.column(2)):
                hashes = _hashes(text.as_py(), width)
                found, fp = np.unique(hashes), np.array(simhash.majority(hashes), dtype=np.uint64).view(np.int64)
                bits = _parities(found)
                folded = np.bitwise_xor.reduce(bits.reshape(-1, FOLDED), axis=0)
                rows.append((int(fp), _key(found), len(found), bits, folded, _first(found, often, times).view(np.int64)))
                size += len(rows[-1][-1])
                if size >= _BATCH or number + 1 == batch.num_rows:
                    yield batch_of(batch.slice(start, len(rows)), rows)
                    rows, start, size = [], number + 1, 0

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long, set_key long, n long, bits array<long>, folded array<long>, first array<long>")


def _often(documents: DataFrame, width: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, in order, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["token"])

    share = max(1, number // SAMPLE_TEXTS)
    sample = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    counts = sample.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    rows = counts.where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "token").limit(MOST_OFTEN).toArrow()
    tokens = np.asarray(rows.column("token"), dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.asarray(rows.column("times"), dtype=np.int64)[order]


def _members(documents: DataFrame, rows: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """`set_key, shingles` of the sets named in `keys`, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingles(batch.column(1)[i].as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))],
                    names=["set_key", "shingles"],
                )

    each = rows.join(keys, "set_key").groupBy("set_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    one = each.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "times")).alias("one"))
    wanted = one.select("set_key", F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_key"), F.col("one.times").alias("times"))
    texts = documents.select("doc_id", text_key().alias("text_key"), "text")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    met = texts.join(_bounded(written(wanted, "wanted")), match)
    once = met.where("times = 1").select("set_key", "text")
    again = met.where("times > 1").select("set_key", "text").dropDuplicates(["set_key"])
    return written(once.unionByName(again).mapInArrow(run, "set_key long, shingles array<long>"), "shingles")


def _sized(rows: DataFrame) -> DataFrame:
    """A written table, whose join is left to Spark if its counted rows are few, and only then."""
    return rows if rows.count() <= BROADCAST_ROWS else unsized(rows)


def _keys(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key")))
    return _sized(written(both.distinct(), "keys"))


def _with_both(pairs: DataFrame, each: DataFrame, **columns: str) -> DataFrame:
    """Pairs `a, b`, a written table, with columns of `each` for both, as `name_a, name_b`."""
    few = pairs.count() <= BROADCAST_ROWS
    for side in "ab":
        of = each.select(F.col("set_key").alias(side), *[F.col(c).alias(f"{name}_{side}") for name, c in columns.items()])
        pairs = (pairs if few else unsized(pairs)).join(of, side)
    return pairs


def _similar(pairs: DataFrame, documents: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The pairs `a, b` whose sets are similar, as a table. Pairs whose parities differ too often go
    first; the sets of the others are compared."""
    pairs = written(pairs.distinct(), "pairs")
    known = rows.join(_keys(pairs), "set_key").select("set_key", "n", "bits").dropDuplicates(["set_key"])
    known = written(known, "parities")
    few = _few(_differ(F.col("bits_a"), F.col("bits_b")), F.col("n_a") + F.col("n_b"))
    near = written(_with_both(pairs, known, n="n", bits="bits").where(few).select("a", "b"), "near")
    members = _members(documents, rows, _keys(near), width)
    enough = (PART + WHOLE) * F.size(F.array_intersect("in_a", "in_b")) >= PART * (F.size("in_a") + F.size("in_b"))
    return written(_with_both(near, members, **{"in": "shingles"}).where(enough).select("a", "b"), "similar")


def _fits(left: str, right: str) -> Column:
    """Whether two members of a cell can be similar by their sizes and by the places of its shingle."""
    n, m, i, j = (F.col(side + c) for c in ("n", "at") for side in (left, right))
    sized = (WHOLE * n >= PART * m) & (WHOLE * m >= PART * n)
    return sized & ((PART + WHOLE) * (i + j) <= (WHOLE - PART) * (n + m))


def _differ(a: Column, b: Column) -> Column:
    """In how many parities two sets differ that fit by their sizes, so that one has twice as many at most."""

    def halved(bits: Column) -> Column:
        half = (F.size(bits) / 2).cast("int")
        return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    x = F.when(F.size(a) > F.size(b), halved(a)).otherwise(a)
    y = F.when(F.size(b) > F.size(a), halved(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def _few(differ: Column, n: Column) -> Column:
    """Whether parities differ as little as those of similar sets of `n` shingles together."""
    return (PART + WHOLE) * differ <= (WHOLE - PART) * n


def _folded() -> list[Column]:
    """The parities of fewer, larger classes, `p0, p1, ...`: what fits into a fast condition of a join."""
    return [F.get("folded", F.lit(i)).alias(f"p{i}") for i in range(FOLDED)]


def _apart(left: str, right: str) -> Column:
    """Whether two members of a cell may be similar and are not in one component yet."""
    differ = functools.reduce(operator.add, [F.bit_count(F.col(f"{left}p{i}").bitwiseXOR(F.col(f"{right}p{i}"))) for i in range(FOLDED)])
    near = _fits(left, right) & _few(differ, F.col(f"{left}n") + F.col(f"{right}n"))
    return (F.col(f"{left}root") != F.col(f"{right}root")) & near


def _sides(cells: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(
        of.select("token", *[F.col(c).alias(side + c) for c in of.columns if c != "token"]) for side, of in (("a_", cells), ("b_", others))
    )


def _paired(cells: DataFrame, fits: Column) -> DataFrame:
    """Pairs of members of a cell that fit."""
    left, right = _sides(cells, cells)
    met = unsized(left).join(right, "token").where((F.col("a_set_key") < F.col("b_set_key")) & fits)
    return met.select(F.col("a_set_key").alias("a"), F.col("b_set_key").alias("b"))


def _starred(cells: DataFrame) -> DataFrame:
    """Each member of a cell with a few of them that it may be similar to. These do not depend on
    the cell, so members that meet in many cells meet the same."""
    order = Window.partitionBy("token").orderBy(F.xxhash64("set_key"), "set_key")
    chosen = cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTRES).drop("place")
    left, right = _sides(cells, chosen)
    met = unsized(left).join(right, "token").where((F.col("a_set_key") != F.col("b_set_key")) & _apart("a_", "b_"))
    return met.select(F.least("a_set_key", "b_set_key").alias("a"), F.greatest("a_set_key", "b_set_key").alias("b"))


def _open(crowded: DataFrame, edges: DataFrame) -> DataFrame:
    """The crowded cells with members in several components, and these, as a table."""
    found = components(edges)
    named = crowded.drop("root").join(found, crowded.set_key == found.node, "left")
    named = written(named.withColumn("root", F.coalesce("root", "set_key")).drop("node"), "crowded")
    several = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return written(named.join(several.select("token"), "token"), "open")


def links(rows: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """`a, b`: links between similar sets such that two are connected by links if and
    only if they are connected by steps between similar sets. `rows` is `_sets`, written."""
    tokens = rows.select("set_key", "n", F.posexplode("first").alias("at", "token"))
    first = tokens.repartition("token").dropDuplicates(["token", "set_key"])
    counted = first.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("token")))
    cells = written(counted.where("members > 1"), "cells")
    few = cells.where(F.col("members") <= CROWD).select("token", "set_key", "n", "at")
    parities = rows.select("set_key", *_folded()).dropDuplicates(["set_key"])
    many = cells.where(F.col("members") > CROWD).drop("members").withColumn("root", F.col("set_key"))
    crowded = written(many.join(parities, "set_key"), "crowded")
    edges = _similar(_paired(few, _fits("a_", "b_")).unionByName(_starred(crowded)), documents, rows, width)
    left = _open(crowded, edges)
    whole = rows.join(left.select("set_key").distinct(), "set_key").select("set_key", "bits").dropDuplicates(["set_key"])
    few = _few(_differ(F.col("a_bits"), F.col("b_bits")), F.col("a_n") + F.col("b_n"))
    pairs = _paired(left.join(whole, "set_key"), _apart("a_", "b_") & few)
    return edges.unionByName(_similar(pairs, documents, rows, width))


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """`a, b`: links that connect the sets of texts whose fingerprints are connected. The least set of
    a fingerprint stands for it."""
    each = written(rows.select("fp", "set_key").distinct(), "fingerprints")
    least = written(each.groupBy("fp").agg(F.min("set_key").alias("least")), "least")
    equal = each.join(least, "fp").select(F.col("least").alias("a"), F.col("set_key").alias("b"))
    left, right = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    near = simhash.links(least.select("fp")).join(left, "a").join(right, "b")
    return equal.unionByName(near.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))).where("a <> b")


def one_of_each(documents: DataFrame, width: int = 5) -> DataFrame:
    """`doc_id, text_key, rows, stay` for `exact_dedup.survivors`: of each group of texts that are connected
    by similarity, or by SimHash fingerprints of the same shingles (`simhash.links`), the row
    with the smallest id stays (a null id last); of several rows of that id, the one with the
    least text key, once. `documents` has `doc_id` and `text`, others are ignored.

    A null text counts as empty; texts without words have equal, empty sets. Repeated rows are
    in one group. An empty table gives an empty result."""
    documents = documents.select("doc_id", "text")
    often, times = _often(documents, width, documents.count())
    rows = written(_sets(documents, width, often, times), "sets")
    edges = links(rows, documents, width).unionByName(_by_fingerprint(rows))
    found = components(written(edges, "links"))
    each = rows.groupBy("doc_id", "text_key", "set_key").agg(F.count(F.lit(1)).alias("rows"))
    named = each.join(found, each.set_key == found.node, "left").withColumn("root", F.coalesce("root", "set_key"))
    named = written(named.select("doc_id", "text_key", "rows", "root"), "named")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    best = named.groupBy("root").agg(F.min(name).alias("best"))
    return named.join(best, "root").select("doc_id", "text_key", "rows", (name == F.col("best")).cast("long").alias("stay"))
