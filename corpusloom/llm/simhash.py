"""Near duplicates by SimHash: links between fingerprints that differ in few bits.

A 64-bit fingerprint is cut into 16 segments of four bits, and their bit counts are
a point in a 16-dimensional grid. Flipping a bit moves one coordinate by one, so the
Manhattan distance of two points is at most the Hamming distance of the two
fingerprints. Points within distance 2 have a grid cell within distance 1 of both:
each fingerprint is put in its own cell and the (at most 32) cells around it, and
only fingerprints that meet in a cell are compared bit by bit.

Only distinct fingerprints take part, so exact copies cost nothing. A cell with many
fingerprints is not paired: its members meet again one level down, at segments of
one bit, where those that share a cell differ in at most two bits for certain, and
one link to the least of them stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import BROADCAST_ROWS, text_key
from corpusloom.session import unsized, written

BITS = 64
SEED = 42
DISTANCE = 2
CROWD = 64            # fingerprints in a cell that are still paired
ROUND_EDGES = 200_000 # in a file of the rounds
_BLOCK = 1 << 16      # shingles hashed at a time
_SEGMENTS = range(0, BITS, 4)


def fingerprint(text: str | None, width: int) -> int:
    """The SimHash of a text's shingles of `width` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for first in range(0, count, _BLOCK):
        part = words[first : min(first + _BLOCK, count) + width - 1]
        grams = zip(*(part[i:] for i in range(width))) if len(words) >= width else [words]
        ones += _ones([xxhash.xxh64_intdigest(b" ".join(gram), SEED) for gram in grams])
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _ones(hashes: Sequence[int]) -> np.ndarray:
    """How many hashes have each bit set."""
    bits = np.unpackbits(np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes, repeats included."""
    ones = sum((_ones(hashes[i : i + _BLOCK]) for i in range(0, len(hashes), _BLOCK)), np.zeros(BITS, dtype=np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int) -> DataFrame:
    """`doc_id, text_key, fp` (fp as a signed long) of every row, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = np.array([fingerprint(texts[i].as_py(), width) for i in range(len(texts))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_key", "fp"],
            )

    rows = documents.select("doc_id", text_key().alias("text_key"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _bit_counts(fp: Column) -> Column:
    """The bit counts of the 16 segments, each in four bits of a long."""
    ones = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(0x1111111111111111)) for i in range(4)]
    return ones[0] + ones[1] + ones[2] + ones[3]


def _cells(point: Column) -> Column:
    """The cells within Manhattan distance 1 of a point."""
    around = [point]
    for shift in _SEGMENTS:
        count = F.shiftrightunsigned(point, shift).bitwiseAND(F.lit(15))
        step = F.lit(1 << shift)
        around += [F.when(count < 4, point + step), F.when(count > 0, point - step)]
    return F.array(*around)


def _bit_flips(fp: Column) -> Column:
    flips = [F.lit((1 << i) if i < 63 else -(1 << 63)) for i in range(BITS)]
    return F.array(fp, *[fp.bitwiseXOR(flip) for flip in flips])


def links(fps: DataFrame) -> DataFrame:
    """`a, b`: links between distinct fingerprints `fp` such that two are connected by
    links if and only if they are connected by steps of at most two bits."""
    point = _bit_counts(F.col("fp"))
    grid = fps.select("fp", F.explode(_cells(point)).alias("cell")).where("cell IS NOT NULL")
    counts = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(unsized(grid).join(counts, "cell"), "cells")

    paired = shared.where(F.col("members") <= CROWD)
    left, right = paired.select("cell", F.col("fp").alias("a")), paired.select("cell", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = unsized(left).join(right, "cell").where((F.col("a") < F.col("b")) & near).select("a", "b")

    crowded = shared.where(F.col("members") > CROWD).select("fp").distinct()
    flips = crowded.select("fp", F.explode(_bit_flips(F.col("fp"))).alias("cell"))
    least = flips.groupBy("cell").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = unsized(flips).join(least, "cell").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of the edges `a, b`: the least node reachable.

    Large and small stars in turn: each node hands its neighbours to the least of
    them until nothing changes, in a number of rounds that grows with the logarithm
    of the nodes. Each round is a written table; only counts reach the driver."""
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, was = written(edges.select(big, small).distinct(), "stars"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        was = mark
        parts = -(-mark[0] // ROUND_EDGES)  # stars never have more edges than before
        sized = unsized if mark[0] > BROADCAST_ROWS else lambda rows: rows
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = sized(both).join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.coalesce(parts), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = sized(large).join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts), "stars")


def _named(documents: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Tables `doc_id, text_key, fp` of all rows and `fp, least, root` of distinct fingerprints: the
    smallest id with it, and the fingerprint that names its component."""
    rows = written(fingerprints(documents, width), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct))
    named = distinct.join(found, distinct.fp == found.node, "left")
    return rows, written(named.select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")


def near_dedup(documents: DataFrame, width: int = 5) -> DataFrame:
    """`doc_id, fingerprint, component_id`, one row per row of `documents` (`doc_id`, `text`,
    others ignored).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text of
    fewer words than `width` is one shingle, and one without words, or null, has
    fingerprint zero and is linked like any other. The component is named by its
    smallest id; null ids count only where there is no other. Repeated rows are
    in one component. An empty table gives an empty result."""
    rows, named = _named(documents, width)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, width: int = 5) -> DataFrame:
    """`doc_id, text_key, rows, stay` for `exact_dedup.survivors`: of each component the row with the
    smallest id stays (a null id last); of several rows of that id, the one with the
    least text key, once."""
    rows, named = _named(documents, width)
    each = rows.groupBy("doc_id", "text_key", "fp").agg(F.count(F.lit(1)).alias("rows")).join(named, "fp")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    best = each.groupBy("root").agg(F.min(name).alias("best"))
    return each.join(best, "root").select("doc_id", "text_key", "rows", (name == F.col("best")).cast("long").alias("stay"))
