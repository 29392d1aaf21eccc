"""Near duplicates by similarity against brute-force Jaccard."""

import itertools
import random
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import similar
from corpusloom.session import written
from tests.llm.brute import groups, simhash, words


def grams(text, width=5):
    found = words(text)
    return frozenset(" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def expected(docs):
    sets = {(r.doc_id, r.text): grams(r.text) for r in docs}
    names = sorted(sets, key=lambda k: (k[0] is None, k[0] or 0, k[1] or ""))
    prints = {k: simhash(k[1], 5) for k in names}
    order = range(len(names))
    alike = lambda a, b: near(sets[a], sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2
    pairs = [(i, j) for i, j in itertools.combinations(order, 2) if alike(names[i], names[j])]
    root = groups(pairs, order)
    return {names[i] for i in order if root[i] == i}, len(pairs)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return out


@pytest.mark.parametrize("crowd, often", [(2, 2), (16, 3), (2, 10**6)])
def test_groups(spark, monkeypatch, crowd, often):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "OFTEN", often)
    rng = random.Random(7)
    line = [f"common{i}" for i in range(25)]
    texts = []
    for size in (5, 20, 60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [base] + [edited(rng, base, rng.choice([1, size // 60 + 1, size // 40 + 1])) for _ in range(12)]
        chain = base
        for _ in range(6):  # each like the one before, the ends unlike
            chain = edited(rng, chain, size // 60)
            texts.append(chain)
    texts += [line + [f"u{i}x{j}" for j in range(rng.choice([5, 10, 40]))] for i in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, "A b"), (1002, "a B"), (1003, " ".join(texts[3]).upper()), (None, " ".join(texts[0]))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay, pairs = expected(docs.collect())
    found = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert pairs > 100 and found == stay


def test_long_words_of_one_fingerprint(spark):
    """Fingerprints link texts whose sets of shingles are apart: the same words, some of them more often."""
    base = " ".join(f"w{i % 7}" for i in range(400))
    docs = spark.createDataFrame([(1, base + " end"), (2, base + " tail"), (3, "other words here")], "doc_id long, text string")
    stay, _ = expected(docs.collect())
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == stay


def test_pairs_stay_few(spark, monkeypatch, tmp_path):
    """Near copies of one text that share many cells, and texts that share one passage: the tables of
    pairs grow with the texts, not with texts times cells, nor with their square."""
    made = {}

    def kept(rows, name):
        out = written(rows, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(similar, "written", kept)
    counts = []
    for members in (100, 200):
        rng = random.Random(3)
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        passage = [f"p{i}" for i in range(50)]
        texts = [edited(rng, base, 2) for _ in range(members)]
        texts += [[*passage, *[f"u{rng.random()}" for _ in range(150)]] for _ in range(members)]
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        made.clear()
        assert corpus_pipeline.near_copies(spark, docs, "").count() == members + 1
        counts.append(sum(made["pairs"]))
    assert counts[0] < (similar.CENTRES + 4) * 100 and counts[1] < 2.5 * counts[0]


def test_long_texts_do_not_meet(spark, monkeypatch):
    """Texts of thousands of shingles that share a passage: parities tell them apart in the join already.
    Near copies on either side of a limit, where one has twice as many parities, are linked."""
    made = []

    def kept(rows, name):
        out = written(rows, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "written", kept)
    monkeypatch.setattr(similar, "CROWD", 4)
    monkeypatch.setattr(similar, "CENTRES", 2)
    monkeypatch.setattr(similar, "OFTEN", 10**6)
    passage = [f"p{i}" for i in range(600)]
    texts = [[*passage, *[f"u{i}x{j}" for j in range(2400)]] for i in range(24)]
    base = [f"w{i}" for i in range(similar.BITS)]
    texts += [[*base, *[f"v{i}x{j}" for j in range(60 * i)]] for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(range(25))
    assert len(made) == 2 and made[1] < 24


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_copies(spark, docs, "").collect() == []


def test_pipeline_leaves_no_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "mixing":
            break
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    left = [grams(r.text) for r in docs.collect()]
    assert not [1 for a, b in itertools.combinations(left, 2) if near(a, b)]


def test_repeated_rows(spark):
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " x"), (3, "other")], "doc_id long, text string")
    assert Counter(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == {1: 1, 3: 1}
