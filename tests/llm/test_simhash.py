"""SimHash fingerprints, links and components against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, simhash
from corpusloom.llm.exact_dedup import survivors
from tests.llm.brute import groups
from tests.llm.brute import simhash as plain_simhash


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "a b c d e f A B", "é x y\x0bz É w " * 50])
@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == plain_simhash(text, width)


def test_blocks(monkeypatch):
    text = " ".join(str(random.Random(1).random()) for _ in range(1)) + " " + " ".join(map(str, range(50)))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text, 3) == whole == plain_simhash(text, 3)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("crowd", [2, 64])
def test_links(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(3)
    fps = {0, 2**64 - 1, 2**63, 1, 3, 7}
    for _ in range(30):
        fp = rng.getrandbits(64)
        fps.add(fp)
        for _ in range(rng.choice([0, 2, 12])):
            fp = fp if rng.random() < 0.5 else rng.choice(list(fps))
            for _ in range(rng.choice([1, 2, 3, 3])):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = [signed(f) for f in fps]
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(frame)
    found = {(r.a, r.b) for r in edges.collect()}
    assert found <= {(min(p), max(p)) for p in near}
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    expected = {n: r for n, r in groups(near, fps).items() if any(n in p for p in near)}
    assert roots == expected


def test_exploded_rows_are_not_broadcast(spark, monkeypatch, capsys):
    """Spark takes 33 cells, or 65 flips, of a fingerprint for one row."""
    plans = []

    def explained(rows, name):
        rows.explain()
        plans.append(capsys.readouterr().out)
        return written(rows, name)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", explained)
    frame = written(spark.range(100).select(F.xxhash64("id").alias("fp")), "fps")
    edges = simhash.links(frame)
    edges.explain()
    plans.append(capsys.readouterr().out)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    few = simhash.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert any("Broadcast" in p for p in plans[2:]) and few.count() == 3
    plans.clear()
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert simhash.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
    assert plans and not any("Broadcast" in p for p in plans)


def test_components_of_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 300)
    edges = list(zip(names[:200], names[1:200])) + [(names[200], n) for n in names[201:]]
    rng.shuffle(edges)
    found = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == groups(edges, names)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def check(found, docs, width):
    fps = {(r.doc_id, r.text): plain_simhash(r.text, width) for r in docs}
    distinct = sorted(set(fps.values()))
    near = [(a, b) for a, b in itertools.combinations(distinct, 2) if bin(a ^ b).count("1") <= 2]
    root = groups(near, distinct)
    least = {}
    for (doc_id, _), fp in fps.items():
        if doc_id is not None:
            least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    expected = sorted(((r.doc_id, f"{fps[r.doc_id, r.text]:016x}", least.get(root[fps[r.doc_id, r.text]])) for r in docs), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == expected


def test_edges(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until evening comes"
    rows = [(1, base), (2, base.upper()), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, "one"), (7, "one two"),
            (None, "alone in the world"), (8, " ".join(map(str, range(30_000))))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    check(simhash.near_dedup(docs, 5).collect(), docs.collect(), 5)
    assert simhash.near_dedup(docs.limit(0)).collect() == []
    decided = simhash.one_of_each(docs, 5)
    stay = survivors(docs, decided).collect()
    assert sorted(r.doc_id for r in stay if r.doc_id is not None) == [1, 4, 6, 7, 8] and len(stay) == 6
    bare = docs.where("doc_id IS NULL")
    assert survivors(bare.unionByName(bare), simhash.one_of_each(bare.unionByName(bare), 5)).count() == 2


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(queries.op8_simhash(spark, sf_dir).collect(), docs, 3)
