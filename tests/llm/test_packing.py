"""Packing: exact round trip of all token ids, full windows, balanced steps."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, queries

PATH = queries.tokenizer_path()


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aB é'st1.,́  \x1c\x85\n\tΣ<|>你👍ab", max_size=40)), max_size=5))
def test_tokens(texts):
    ids, counts = packing.WordTokens(PATH).encode(pa.array(texts, pa.string()))
    expected = plain_ids(texts)
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


@pytest.mark.parametrize("cached", [1, 10**6])
def test_special_strings_and_cache(cached):
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "it's I'LL 12 3é", "", None, "word " * 1000]
    encoder = packing.WordTokens(PATH, cached)
    for _ in range(2):
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for e in plain_ids(texts) for i in e]


def check_pack(counts):
    (doc, start, length), sequence, offset, sizes = packing.pack(np.array(counts, dtype=np.int64))
    assert (length > 0).all()
    for d, n in enumerate(counts):  # each id in one piece
        mine = sorted(zip(start[doc == d], length[doc == d]))
        assert sum(x for _, x in mine) == n and all(a + x == b for (a, x), (b, _) in zip(mine, mine[1:])) and mine[0][0] == 0
    assert sorted(set(sequence)) == list(range(len(sizes)))
    for s, n in enumerate(sizes):
        mine = sorted(zip(offset[sequence == s], length[sequence == s]))
        assert mine[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(mine, mine[1:])) and sum(x for _, x in mine) == n <= 2048
    assert (packing.padded(sizes) != sizes).sum() <= 1
    step = packing.steps(sizes)
    filled = np.bincount(step, weights=packing.padded(sizes))
    assert (filled[:-1] == packing.STEP_TOKENS).all()
    return doc, sizes


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.integers(1, 5000), st.integers(1, 40), st.sampled_from([1, 128, 256, 2047, 2048, 2049, 1024, 1025])), min_size=1, max_size=60))
def test_pack(counts):
    check_pack(counts)


def test_pack_cuts_little():
    counts = np.random.default_rng(1).lognormal(6, 1, 5000).astype(int) + 1
    doc, sizes = check_pack(counts.tolist())
    assert len(doc) < 1.8 * len(counts)


def checked(frame, docs, with_ids):
    rows = frame.collect()
    ids = dict(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs])))
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length
        assert not with_ids or r.ids == part.tolist()
    return rows


@pytest.mark.parametrize("group", [50, 1 << 22])
def test_edges(spark, monkeypatch, group):
    rows = [(1, "a b"), (2, None), (3, ""), (4, "word " * 30_000), (None, "nothing here"), (5, "x" * 20_000), (6, "a b")]
    docs = spark.createDataFrame([(*r, "length") for r in rows], "doc_id long, text string, length string").repartition(2)
    found = checked(packing.packed(docs, PATH), docs.collect(), True)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert sum(p[1] for p in pieces) == pieces[0][2] <= 2048
    assert packing.packed(docs.limit(0), PATH).collect() == []
    again = packing.packed(docs.unionByName(docs), PATH, with_ids=False).collect()
    assert sum(r.length for r in again) == 2 * sum(r.length for r in found)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = checked(queries.op5_packing(spark, sf_dir), docs, False)
    tokens = sum(r.length for r in rows)
    assert tokens == sum(map(len, plain_ids([d.text for d in docs])))
    sizes = {r.sequence_id: r.sequence_tokens for r in rows}
    full = packing.padded(np.array(list(sizes.values())))
    assert full.sum() < 1.02 * tokens
