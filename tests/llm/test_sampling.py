"""The driver's sample: bounded rows and bytes, one row per id."""

from corpusloom.llm.sampling import labelled


def test_bounds(spark):
    rows = [(i, "word " * (i + 1), "en") for i in range(50)] + [(7, "w", "fr"), (7, "w", "fr"), (8, None, "de"), (9, "x" * 10_000, "en"), (None, "none", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (99, 1)], "doc_id long, toxic int")
    found = labelled(docs, labels, "lang")
    assert found.columns.tolist() == ["doc_id", "text", "lang", "toxic"]
    assert found.doc_id.tolist() == list(range(40))
    assert found.text[7] == "w" and found.lang[7] == "fr" and found.text[8] is None and found.text[9] == "word " * 10
    assert len(labelled(docs, labels, rows=10)) == 10
    few = labelled(docs, labels, most_bytes=300)
    assert 200 < few.text.fillna("").str.len().sum() <= 300 and set(few.doc_id) < set(range(40))
    assert len(labelled(docs.limit(0), labels)) == 0 and len(labelled(docs, labels.limit(0))) == 0
