"""Sketches: cells against direct computation, differences exactly recovered, edge rows."""

import functools
import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import queries, sketches


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(key, *numbers):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for n in numbers:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", n), seed)
    return signed(seed)


def keys_of(text):
    pieces = []
    for line in re.split("[\n\r]", text or ""):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        piece = []
        for i, word in enumerate(words):
            piece.append(word)
            if i + 1 == len(words) or signed(xxhash.xxh64_intdigest(word, 42)) % sketches.PIECE_WORDS == 0:
                pieces.append(piece)
                piece = []
    digest = lambda piece: functools.reduce(lambda seed, word: xxhash.xxh64_intdigest(word, seed), piece, 42)
    return {signed(digest(p)) for p in pieces}


def plain_fingerprint(text):
    cells = {}
    for key in keys_of(text):
        for t in range(3):
            i = spark_hash(key, t, 0) % sketches.CELLS + t * sketches.CELLS
            c, k, h = cells.get(i, (0, 0, 0))
            cells[i] = c + 1, k ^ key, h ^ ((spark_hash(key, -1) & (2**64 - 1)) >> 32)
    return ".".join(f"{i:x}:{c:x}:{k & (2**64 - 1):x}:{h:x}" for i, (c, k, h) in sorted(cells.items()))


def plain_likeness(one, other):
    a, b = keys_of(one), keys_of(other)
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def check(found, docs):
    docs = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    expected = []
    for i, r in enumerate(docs):
        text, after = r.text or "", docs[(i + 1) % len(docs)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((
            r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_fingerprint(text), plain_fingerprint(edited),
            round(plain_likeness(text, edited), 12), round(plain_likeness(text, after), 12),
        ))
    rows = [(*r[:5], round(r.near_edited, 12), round(r.near_next, 12)) for r in found]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("sizes", [(0, 0, 0), (0, 1, 0), (3, 0, 5), (50, 40, 0), (2000, 5, 7), (10, 300, 200), (0, 1500, 1)])
def test_difference(spark, sizes):
    """(shared, only left, only right) digests: peeling gives exactly the others."""
    shared, left, right = sizes
    key = lambda n: signed(xxhash.xxh64_intdigest(str(n)))
    common, one, two = [key(i) for i in range(shared)], [key(10**6 + i) for i in range(left)], [key(-1 - i) for i in range(right)]
    rows = spark.createDataFrame([(common + one, two + common)], "a array<bigint>, b array<bigint>")
    found = rows.select(sketches.difference(F.col("a"), F.col("b")).alias("d")).first().d
    assert sorted(found.plus) == sorted(one) and sorted(found.minus) == sorted(two)


def test_retries(spark):
    """A small difference comes from the fingerprints' cells, however large the sets; a larger one from larger sketches."""
    key = lambda n: signed(xxhash.xxh64_intdigest(str(n)))
    sets = [([key(i) for i in range(n)], [key(i) for i in range(d, n)]) for n, d in [(3000, 3), (3000, 0), (3000, 900), (60, 60)]]
    sets.append(([key(i) for i in range(500)], [key(-1 - i) for i in range(500)]))
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(sets)], "n int, a array<bigint>, b array<bigint>")
    found = [r.d for r in rows.select("n", sketches.difference(F.col("a"), F.col("b")).alias("d")).orderBy("n").collect()]
    assert [len(d.plus) + len(d.minus) for d in found] == [3, 0, 900, 60, 1000]
    assert [d.level > 0 for d in found] == [False, False, True, True, True]


def test_an_inserted_word(spark):
    line = [f"w{i}" for i in range(400)]
    rows = spark.createDataFrame([(" ".join(line), " ".join([*line[:at], "new", *line[at:]])) for at in (0, 1, 200, 399)], "a string, b string")
    near = rows.select(sketches.likeness(sketches.digests(F.col("a")), sketches.digests(F.col("b"))).alias("near"))
    assert all(0.8 < r.near < 1 for r in near.collect())


def test_failure_is_seen_and_retried(spark):
    keys = [signed(xxhash.xxh64_intdigest(str(n))) for n in range(100)]
    rows = spark.createDataFrame([(keys, [])], "a array<bigint>, b array<bigint>")
    at = lambda level: sketches.peeled(sketches.subtracted(F.col("a"), F.col("b"), F.lit(level)), F.lit(level))
    small, large = rows.select(at(0).alias("s"), at(4).alias("l")).first()
    assert small is None and sorted(large.plus) == sorted(keys)


LINES = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
ROWS = [
    (5, "\n".join(LINES)), (6, "\n".join(LINES[:6] + LINES[7:])), (7, None), (8, ""), (9, "one"), (10, "é👍é"), (11, "a b\r\n\nc \t d\x0be"),
    (12, "word " * 20_000), (None, "nothing"), (None, None), (13, "same"), (13, "same"), (13, "other"), (2**40, "\n".join(LINES)),
]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_edges(spark, monkeypatch, block):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", block)
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, block string").repartition(4)
    check(sketches.fingerprints(docs).collect(), docs.collect())
    some = docs.where("doc_id < 9")
    check(sketches.fingerprints(some).collect(), some.collect())
    single = docs.where("doc_id = 5")
    assert sketches.fingerprints(single).first().near_next == 1
    assert sketches.fingerprints(docs.limit(0)).collect() == []


def test_query(spark, sf_dir):
    check(queries.op6_sketches(spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
