from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions.questions import cache_key, clean_snippet
from corpusloom.operators import answers as A
from corpusloom.operators import retrieval as R
from corpusloom.operators.chunking import build_chunks
from corpusloom.operators.embedding import embed, pair_scorer
from corpusloom.plans.chat import chat
from corpusloom.plans.retrieve import retrieve

TEXTS = {
    "raw/about-me.txt": "I live by the sea. I like tea.",
    "raw/project.txt": "A compiler for tiny machines.",
    "raw/faq.txt": "Where is the work? It is here.",
}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "key string, text string")
    return embed(build_chunks(rows), "content", dim=64)


def test_retrieve(spark, chunks):
    requests = spark.createDataFrame(
        [(1, "", " compiler for tiny "), (2, " ", "x"), (3, None, None), (4, "Hello", None), (5, "compiler for tiny", "other")],
        "q_id int, q string, query string",
    )
    found = {r.q_id: r.snippets for r in retrieve(requests, chunks, gate_chit_chat=True, dim=64).collect()}
    assert set(found) == {1, 2, 3, 4, 5}
    assert [s.id for s in found[1]] == ["S1", "S2", "S3"] and found[1][0].title == "Project"
    assert found[1] == found[5] and not found[2] and not found[3] and not found[4]


def test_boost_reorders_and_missing_scores(spark):
    chunk_rows = [(f"c{i}", "", "", "text", "experience" if i == 8 else None, [1.0, i / 10]) for i in range(20)]
    store = spark.createDataFrame(
        chunk_rows + [("none", None, None, None, None, None)],
        "chunk_id string, title string, url string, content string, section string, embedding array<float>",
    )
    questions = spark.createDataFrame([(1, [1.0, 0.0], True), (2, [1.0, 0.0], False)], "q_id int, qvec array<float>, bias boolean")
    hits = {(r.q_id, r["rank"]): r for r in R.boosted_top_k(questions, store).collect()}
    assert [hits[2, n].chunk_id for n in range(1, 7)] == [f"c{i}" for i in range(6)]
    order = [hits[1, n].chunk_id for n in range(1, 7)]
    assert order.index("c8") < 6 and hits[1, order.index("c8") + 1].boosted > hits[1, order.index("c8") + 1].score
    few = store.where("chunk_id in ('c1', 'none')")
    shaped = R.shape_snippets(R.boosted_top_k(questions, few)).orderBy("q_id", "rank").collect()
    # Without a vector the score is 0: behind by distance, in front after the boost sort.
    assert [(r.q_id, r.title, r.score) for r in shaped] == [
        (1, "Snippet", 0.0), (1, "Snippet", 0.995), (2, "Snippet", 0.995), (2, "Snippet", 0.0)]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_contents_join_the_last_k_only(spark, tmp_path, broadcast_bytes):
    """No exchange above the scan of the contents but the one of their own join."""
    path = str(tmp_path / "store")
    spark.createDataFrame(
        [(f"c{i}", "t", "u", "text", "experience" if i % 3 else None, [1.0, i / 10]) for i in range(40)],
        "chunk_id string, title string, url string, content string, section string, embedding array<float>",
    ).write.parquet(path)
    questions = spark.createDataFrame([(i, [1.0, i / 5], i % 2 == 0) for i in range(9)], "q_id int, qvec array<float>, bias boolean")
    hits = R.boosted_top_k(questions, spark.read.parquet(path), broadcast_bytes=broadcast_bytes)
    plan = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window " in line]
    contents = [i for i, line in enumerate(plan) if "Relation" in line or "Project" in line and "content#" in line]
    assert windows and sum("content#" in plan[i] for i in range(windows[0], windows[-1])) == 0 and contents
    assert all(r.content == "text" for r in hits.collect()) and hits.count() == 54


def test_rerank_ties_and_failure(spark):
    rows = [(q, i, f"c{i}", f"w{i % 2}") for q in (1, 2) for i in range(1, 7)]
    candidates = spark.createDataFrame(rows, "q_id int, rank int, id string, content string")
    questions = spark.createDataFrame([(1, "w1"), (2, "w0")], "q_id int, message string")

    def model():
        return lambda ms, cs: np.array([float(m == c) if m == "w1" else np.nan for m, c in zip(ms, cs)])

    slot = pair_scorer(model)
    scored = R.rerank(candidates, questions, scorer=lambda m, c: F.nanvl(slot(m, c), F.lit(None).cast("double")))
    found = {q: [r.id for r in sorted(scored.collect(), key=lambda r: r["rank"]) if r.q_id == q] for q in (1, 2)}
    assert found == {1: ["c1", "c3", "c5", "c2"], 2: [f"c{i}" for i in range(1, 7)]}
    assert R.rerank(candidates, questions, enabled=False).count() == 12


def test_models_that_throw(spark):
    from corpusloom.operators.embedding import answer_generator

    def scorer():
        return lambda ms, cs: np.array([1.0 / int(m != "bad") for m in ms])

    def generator(max_new_tokens):
        return lambda ps: np.array([p[:max_new_tokens] + str(1 // int(p != "bad")) for p in ps], dtype=object)

    rows = spark.createDataFrame([("good", "x"), ("bad", "x")], "m string, c string").coalesce(1)
    score, write = pair_scorer(scorer, batch_size=1), answer_generator(generator, max_new_tokens=2)
    found = rows.select("m", score(F.col("m"), F.col("c")).alias("s"), write(F.col("m")).alias("a")).collect()
    assert {r.m: (r.s, r.a) for r in found} == {"good": (1.0, "go1"), "bad": (None, None)}


def test_chat(spark, chunks):
    t = datetime(2024, 1, 1)
    rows = [
        (1, "s", "Tiny  machines", t), (2, "s", "tiny machines ", t + timedelta(hours=1)),
        (3, "s", "", t), (4, None, "x", t), (5, "s", None, t),
        (6, "s", "tiny machines", t + timedelta(hours=50)), (7, "s", "stored?", t), (8, "s", "stored?", t + timedelta(hours=2)),
        (9, "s", "  ", t), (10, "s", "", t + timedelta(hours=1)), (11, "s", "", t + timedelta(hours=48)),
    ]
    requests = spark.createDataFrame(rows, schemas.CHAT_REQUEST)
    key = spark.range(1).select(cache_key(F.lit("stored?"))).first()[0]
    stored = spark.createDataFrame(
        [(key, ("kept", []), int(t.timestamp()) + 3600, t)], schemas.CACHE_ENTRY)
    result = chat(requests, chunks, stored, use_rerank=True, dim=64)
    found = {r.request_id: r for r in result.responses.collect()}
    assert {i: r.outcome for i, r in found.items()} == {
        1: "computed", 2: "cache_hit", 3: "embed_rejected", 4: "invalid", 5: "invalid",
        6: "computed", 7: "cache_hit", 8: "computed", 9: "computed", 10: "cache_hit", 11: "embed_rejected"}
    assert found[10].answer == found[9].answer and found[10].cached
    assert found[7].answer == "kept" and found[8].answer != "kept"
    assert found[1].answer == found[2].answer and found[1].answer.startswith("Found 3 relevant snippets")
    assert found[1].sources[0].title == "Project" and found[1].sources[0].rerank_score >= 2
    assert result.log.count() == 9
    entries = {r.pk: r for r in result.entries.collect()}
    assert len(entries) == 3 and entries[key].ttl == int(t.timestamp()) + 2 * 3600 + 48 * 3600


def test_listing_survives_a_bad_date(spark):
    from corpusloom.operators import catalog

    rows = spark.createDataFrame([("a", ["x"], "", "2024-03-05"), ("b", [], "", "soon"), ("c", [], "", None)],
                                 "id string, tags array<string>, summary string, publishedAt string")
    assert {r.id: r.published for r in catalog.listing(rows).collect()} == {"a": "3/5/2024", "b": None, "c": None}


def test_messages(spark):
    rows = spark.createDataFrame([("q", [("S1", "t", "x")]), ("q", [])],
                                 "m string, s array<struct<id:string,title:string,text:string>>")
    messages = A.chat_messages(F.col("m"), F.col("s"), system="sys", example="ex", instruction="do")
    found = [[(m.role, m.content) for m in r[0]] for r in rows.select(messages).collect()]
    assert found[0][2] == ("assistant", "Context (cite as S1..):\n[S1] t — x")
    assert [len(f) for f in found] == [4, 3] and found[1][-1] == ("user", "q\ndo")


def test_contents_are_cut_before_they_move(spark, monkeypatch):
    """A snippet shows the beginning of a content, so no more of it is shuffled; what is shown stays the same."""
    import corpusloom.plans.retrieve as plan

    searched, search = [], plan.boosted_top_k

    def kept(questions, chunks, **options):
        searched.append(chunks)
        return search(questions, chunks, **options)

    monkeypatch.setattr(plan, "boosted_top_k", kept)
    texts = {"a": "Alpha  beta\n" + "word " * 500, "b": "alpha http : / / example.org " * 60, "c": None, "d": ""}
    rows = [(k, k, k, "", v, [1.0, float(i)]) for i, (k, v) in enumerate(texts.items())]
    chunks = spark.createDataFrame(rows, "chunk_id string, title string, section string, url string, content string, embedding array<float>")
    asked = spark.createDataFrame([(1, "alpha beta", None)], "q_id int, q string, query string")
    found = plan.retrieve(asked, chunks, dim=2).first()
    expected = {r.chunk_id: r.text for r in chunks.select("chunk_id", clean_snippet(F.col("content")).alias("text")).collect()}
    assert {s.title: s.text for s in found.snippets} == expected
    assert searched[0].agg(F.max(F.length("content"))).first()[0] == len(expected["a"]) == 600
