"""The toxicity classifier: pooling against direct computation, held-out accuracy, edge rows."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, toxicity


def plain_score(model, text):
    words = toxicity.plain_words(pa.array([text], pa.string()))
    vectors = model.rows[toxicity.pieces(words.distinct)].sum(axis=1)[words.codes] if len(words.codes) else np.zeros((1, toxicity.WIDTH))
    vectors = np.concatenate([vectors, np.zeros((2, toxicity.WIDTH))])
    features, first = [], 0
    for w, width in enumerate(toxicity.WIDTHS):
        response = sum(vectors[j : len(vectors) - 2 + j] @ model.filters[first + j] for j in range(width)) + model.bias[w]
        first += width
        kept = np.zeros((toxicity.KEPT, toxicity.FILTERS))
        for f in range(toxicity.FILTERS):
            best = sorted({round(float(x), 4) for x in response[:, f] if x > 0}, reverse=True)[: toxicity.KEPT]
            kept[: len(best), f] = best
        features.append(kept.ravel())
    return np.concatenate(features) @ model.out + model.level


def test_pooling():
    model = toxicity.Cnn.new(3)
    model.rows *= 10
    texts = ["", None, "one", "one two", "a b c a b c a b c", "Some, words; (some) WORDS! " * 5, " ".join(map(str, range(500)))]
    found = model.raw(toxicity.Texts.of(pa.array(texts, pa.string())))
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=2e-2)
    assert found[0] == found[1]
    alone = [model.raw(toxicity.Texts.of(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(found, alone, atol=1e-4)
    assert len(model.raw(toxicity.Texts.of(pa.array([], pa.string())))) == 0


def test_words():
    words = toxicity.plain_words(pa.array(["Ab, ab! «AB» x"]))
    assert words.distinct.to_pylist() == ["ab", "x"] and words.codes.tolist() == [0, 0, 0, 1]
    one, two = toxicity.pieces(pa.array(["abcdefgh1", "abcdefgh2"]))
    assert one[0] != two[0] and (one[1:] == two[1:]).all()


def made(spark, count=1500):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(count):
        words = [f"w{n}" for n in rng.zipf(1.3, rng.integers(5, 80)) % 5000]
        bad = int(rng.random() < 0.15)
        if bad:
            for at in rng.integers(0, len(words), 3):
                words[at] = f"nastyword{rng.integers(100)}"
        rows.append((i, " ".join(words), str(rng.choice(["en", "fr"])), 0.5))
        labels.append((i, 1, bad))
    rows += [(count, None, "en", 0.1), (count + 1, "", None, 0.1), (None, "w1 w2", "xx", 0.1), (0, rows[0][1], "en", 0.2), (count + 2, "w1 " * 100_000, "en", 0.1)]
    labels += [(None, 1, 1), (0, 0, labels[0][2]), (count, 1, 0), (10**9, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learning_and_edges(spark):
    docs, labels = made(spark)
    model = toxicity.train(docs, labels)
    found = toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out()).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    apart = found[found.held_out & found.doc_id.isin(range(1500))]
    y = np.array([truth[i] for i in apart.doc_id])
    p = apart.score.to_numpy() >= toxicity.THRESHOLD
    assert (p & (y == 1)).sum() >= 0.85 * y.sum() and (p & (y == 0)).sum() <= 0.02 * len(y)
    blank = found[found.text.fillna("") == ""].score
    assert blank.nunique() == 1 and blank.iloc[0] < toxicity.THRESHOLD
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_all_labels_are_learnt(spark, monkeypatch):
    """A word that only few of many labelled texts have, and none of any one sample, counts as much in
    shards as in one; what the shards fit together tells the held-out texts apart."""
    docs, labels = made(spark)
    one = toxicity.train(docs, labels)
    fitted = []
    over = toxicity._over_shards

    def kept(rows, shards, run, average):
        fitted.append((rows.count(), shards))
        return over(rows, shards, run, average)

    monkeypatch.setattr(toxicity, "_over_shards", kept)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    many = toxicity.train(docs, labels)
    known = labels.where(~toxicity.held_out() & F.col("toxic").isNotNull()).select("doc_id").distinct().join(docs, "doc_id")
    apart = F.crc32(F.concat(F.lit("apart"), F.col("doc_id")).cast("binary")) % 5 == 0
    number = known.where(~apart).select("doc_id").distinct().count()
    assert fitted == [(number, -(-number // 150))] * 2 and number > 4 * 150
    again = toxicity.train(docs.repartition(3), labels)
    assert (again.rows == many.rows).all() and again.thresholds == many.thresholds
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    for model in (one, many):
        found = toxicity.scored(docs, model).where(toxicity.held_out() & (F.col("doc_id") < 1500)).toPandas()
        y, p = np.array([truth[i] for i in found.doc_id]), found.score.to_numpy() >= toxicity.THRESHOLD
        assert (p & (y == 1)).sum() >= 0.85 * y.sum() and (p & (y == 0)).sum() <= 0.02 * len(y)


def test_labels_are_kept_apart(spark):
    docs, labels = made(spark, 300)
    sample = toxicity.sampled(docs, labels)
    assert all(zlib.crc32(str(int(i)).encode()) % 3 != 1 for i in sample.doc_id)
    assert len(toxicity.sampled(docs, labels, rows=50)) <= 51
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end toxic")
    one, two = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (one.rows == two.rows).all() and one.shift == two.shift


def test_no_labels(spark):
    docs, labels = made(spark, 50)
    none = toxicity.scored(docs, toxicity.train(docs, labels.limit(0)))
    assert none.select("score").distinct().count() == 1 and none.first().score < 0.5
    assert toxicity.scored(docs.limit(0), toxicity.Cnn.new(1)).collect() == []
    assert toxicity.clean(docs, labels.limit(0)).count() == docs.count()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    found = queries.op1_toxicity(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").toPandas()
    assert sorted(found.doc_id) == sorted(docs.doc_id)
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = found[found.held_out].merge(labels, on="doc_id")
    hit = both[both.toxic == 1].predicted.mean()
    false = both[both.toxic == 0].predicted.mean()
    assert hit >= 0.7 and false <= 0.03
