"""The pipeline's stages, each against a plain version over its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from corpusloom.llm import mixing, queries, toxicity
from tests.llm.brute import words
from tests.llm.test_similar import expected as expected_near


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows that go into each stage, and come out of it."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)
    for name, (before, after) in list(stages.items())[:-1]:
        assert before.dtypes == after.dtypes, name


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_toxicity(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(before, labels)
    scored = toxicity.scored(before, model).withColumn("limit", toxicity.thresholds(model)).collect()
    assert rows_of(after) == Counter(tuple(r)[:5] for r in scored if r.score < r.limit)
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    assert len(clean & ids - kept) <= 0.03 * len(clean & ids)


def test_exact_dedup(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        key = re.sub("[\x20\x09-\x0d]", "", r.text or "")
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    assert rows_of(after) == Counter(map(tuple, best.values()))


def test_near_dedup(stages):
    before, after = stages["simhash_near_dedup"]
    stay, _ = expected_near(before.collect())
    assert {(r.doc_id, r.text) for r in after.collect()} == stay
    assert after.count() == len(stay)


def test_mixing(stages):
    before, after = stages["mixing"]
    plan = {r.doc_id: r for r in mixing.mix(before).collect()}
    found = Counter(r.doc_id for r in after.collect())
    assert found == +Counter({k: r.copies for k, r in plan.items()})
    assert set(rows_of(after)) <= set(rows_of(before))
    taken = defaultdict(int)
    for r in after.collect():
        taken[r.source] += len(words(r.text))
    for r in plan.values():
        assert abs(taken[r.source] - r.target) <= 0.15 * r.source_size


def test_packing(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tool = Tokenizer.from_file(queries.tokenizer_path())
    expected, found = Counter(), Counter()
    for r in before.collect():
        expected.update([*tool.encode(r.text or "", add_special_tokens=False).ids, 1])
    for r in after.collect():
        found.update(r.ids)
    assert found == expected


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first() == stages["packing"][1].agg({"length": "sum"}).first()


def test_edge_rows(spark, tmp_path):
    rows = [(i, f"text number {i} " + " ".join(f"w{i * j}" for j in range(30)), "en", f"s{i % 3}", 10) for i in range(20)]
    rows += [(20, None, None, None, None), (21, "", "en", "s1", 0), (None, "no id at all", "de", None, 5), (3, *rows[3][1:]), (22, "w " * 50_000, "fr", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for made in (docs, docs.limit(0)):
        left = made
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            left = stage(spark, left, str(tmp_path))
            path = str(tmp_path / f"{name}{made is docs}")
            left.write.parquet(path)
            left = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert left.columns == made.columns
        assert (left.count() > 0) == (made is docs)


def test_clashing_columns(spark, tmp_path):
    """Extra columns come through every stage with their values, whatever their names."""
    names = "score row text_key odd_id odd_key _key _id _odd stay rows _row _at key size place taken n fp set_key".split()
    rows = [(i, f"text {i} " + " ".join(f"w{i * j}" for j in range(30)), "en", f"s{i % 3}", 10) for i in range(20)]
    rows += [(20, rows[3][1], "en", "s0", 9), (21, rows[4][1] + " x", "en", "s1", 9)]
    values = lambda i: tuple(f"{name}{i}" for name in names)
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *values(r[0])) for r in rows], schema)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [f.name for f in spark.createDataFrame([], schema).schema]
        found = docs.collect()
        assert found and all(tuple(r)[5:] == values(r.doc_id) for r in found)
    assert {20, 21} & {r.doc_id for r in found} == set()
