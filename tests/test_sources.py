import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.chunking import build_chunks
from corpusloom.plans.ingest import chunk_documents, embed_and_index
from corpusloom.sources import chat_log, chunk_files, chunk_store, documents


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"a.TXT": b"caf\xc3\xa9 \xff\xe2\x82x", "deep/b.Md": b"# b", "c.pdf": b"no", "d.json": b"no",
                          "deep/e.markdown": b"e", "f.htm": b"f"}.items():
        (tmp_path / name).write_bytes(content)
    found = {r.key: r.text for r in documents.documents(spark, str(tmp_path)).collect()}
    assert found == {"a.TXT": "café x", "deep/b.Md": "# b", "deep/e.markdown": "e", "f.htm": "f"}


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("raw/a.txt", "déjà vu")], "key string, text string")
    path = str(tmp_path / "chunks")
    chunk_files.write_chunks(build_chunks(rows), path)
    line = next(p for p in (tmp_path / "chunks").glob("part-*") if p.stat().st_size).read_text()
    assert json.loads(line)["id"] is None and "déjà" in line
    (tmp_path / "chunks" / "extra.json").write_text("\n\n")
    assert chunk_files.read_chunks(spark, path).count() == 1
    (tmp_path / "chunks" / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        chunk_files.read_chunks(spark, path).collect()


def test_ingest_end_to_end(spark, tmp_path):
    raw, files, store = tmp_path / "raw", str(tmp_path / "files"), str(tmp_path / "store")
    raw.mkdir()
    (raw / "my-cv.md").write_text("# Work\n\nOne. Two.")
    (raw / "b.html").write_text("<p>Hello</p>")
    chunk_documents(spark, str(raw), files)
    embed_and_index(spark, files, store, dim=16)
    first = {r.chunk_id: r for r in chunk_store.read_store(spark, store).collect()}
    assert sorted(r.content for r in first.values()) == ["Hello", "Work One. Two."]
    assert all(len(r.embedding) == 16 and r.id is not None for r in first.values())

    (raw / "b.html").write_text("<p>Hello again</p>")
    (raw / "my-cv.md").unlink()
    (raw / "c.txt").write_text("New")
    again = str(tmp_path / "again")
    chunk_documents(spark, str(raw), again)
    embed_and_index(spark, again, store, dim=16)
    second = {r.chunk_id: r for r in chunk_store.read_store(spark, store).collect()}
    assert sorted(r.content for r in second.values()) == ["Hello again", "New", "Work One. Two."]
    assert all(second[c].id == first[c].id for c in first)
    assert len({r.id for r in second.values()}) == 3


def _batch(spark, rows):
    """Rows `chunk_id, title, at` as a batch for the store, in this order."""
    return spark.createDataFrame(rows, "chunk_id string, title string, at int").selectExpr(
        "cast(null as long) id", "title", "'' url", "chunk_id", "'' content", "'' section", "'{}' metadata",
        "array(cast(at as float)) embedding", "timestamp'2020-01-01' updated_at", "at")


def _titles(spark, store):
    rows = chunk_store.read_store(spark, store, "chunk_id", "title", "id").collect()
    assert len({r.id for r in rows}) == len(rows) == len({r.chunk_id for r in rows}) and all(r.id > 0 for r in rows)
    return {r.chunk_id: r.title for r in rows}


def test_an_upsert_writes_the_buckets_it_meets(spark, tmp_path):
    store = str(tmp_path / "store")
    chunk_store.upsert(spark, store, _batch(spark, [(f"c{i}", "old", 1) for i in range(200)]), order="at", buckets=16)
    before = chunk_store.newest(spark, store)
    ids = {r.chunk_id: r.id for r in chunk_store.read_store(spark, store, "chunk_id", "id").collect()}
    assert before.buckets == 16 and len(before.held) == 16
    batch = _batch(spark, [("c7", "new", 1), ("c8", "new", 1), ("more", "new", 1)])
    met = {r.b for r in batch.select(chunk_store.bucket_of("chunk_id", 16).alias("b")).collect()}
    for n in range(2):  # a second time with the same result
        chunk_store.upsert(spark, store, batch, order="at", buckets=4)
        after = chunk_store.newest(spark, store)
        assert after.version == n + 1 and after.buckets == 16
        assert {b for b in after.held if after.held[b].write != before.held[b].write} == met and len(met) < 4
        before = after
        assert {p.name for p in (tmp_path / "store/rows" / f"write={after.held[min(met)].write}").glob("bucket=*")} == {
            f"bucket={b}" for b in met}
        titles = _titles(spark, store)
        assert len(titles) == 201 and {c for c, t in titles.items() if t == "new"} == {"c7", "c8", "more"}
    now = {r.chunk_id: r.id for r in chunk_store.read_store(spark, store, "chunk_id", "id").collect()}
    assert {c: now[c] for c in ids} == ids
    chunk_store.upsert(spark, store, batch.limit(0), order="at")
    assert chunk_store.newest(spark, store).version == 2


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_of_equal_rows_the_later_one_wins(spark, tmp_path, broadcast_bytes):
    store = str(tmp_path / "store")
    rows = [(f"c{i % 50}", f"t{i}", 1) for i in range(500)] + [("c0", "late but older", 0)]
    for _ in range(2):
        chunk_store.upsert(spark, store, _batch(spark, rows), order="at", buckets=8, broadcast_bytes=broadcast_bytes)
        assert _titles(spark, store) == {f"c{i}": f"t{450 + i}" for i in range(50)}


def test_later_lines_and_files_win(spark, tmp_path):
    def line(title):
        meta = {"src_key": "k", "updated_at": "2020-01-01T00:00:00Z"}
        return json.dumps({"id": None, "title": title, "url": "", "chunk_id": "c", "content": title, "section": None, "metadata": meta})

    files, store = tmp_path / "files", str(tmp_path / "store")
    files.mkdir()
    (files / "b.json").write_text("\n".join(line(f"b{i}") for i in range(5)))
    (files / "a.json").write_text("\n".join(line(f"a{i}") for i in range(500)))
    embed_and_index(spark, str(files), store, dim=16, buckets=4)
    assert _titles(spark, store) == {"c": "b4"}


def test_writers_at_one_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store, writers = str(tmp_path / "store"), 4

    def write(w):
        rows = [(f"w{w}-{i}", f"w{w}", 1) for i in range(5)] + [("shared", f"w{w}", 1)]
        chunk_store.upsert(spark, store, _batch(spark, rows), order="at", buckets=8)

    with ThreadPoolExecutor(writers) as pool:
        list(pool.map(write, range(writers)))
    titles = _titles(spark, store)
    assert len(titles) == 5 * writers + 1 and all(titles[f"w{w}-{i}"] == f"w{w}" for w in range(writers) for i in range(5))
    commit = chunk_store.newest(spark, store)
    assert commit.version == writers - 1


def test_store_without_versions(spark, tmp_path):
    assert chunk_store.read_store(spark, str(tmp_path / "none"), "chunk_id").collect() == []


def test_log_items(spark):
    rows = spark.createDataFrame(
        [(1, "s", "m"), (2, None, "m"), (3, "", "m"), (4, "s", None), (5, "s", "")],
        "request_id long, session_id string, message string",
    ).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    items = chat_log.log_items(rows).orderBy("message").collect()
    assert [(r.PK, r.message) for r in items] == [("CHAT#s", ""), ("CHAT#s", "m")]
    assert items[0].SK.startswith("1970-01-01T00:00:00.000Z#") and len(items[0].SK) == 61


class _Conf:
    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace

    from corpusloom.session import shared_dir

    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=_Conf(spark_master=master)))
    conf = _Conf(spark_master=master, spark_checkpoint_dir="hdfs://shared/folder/")
    assert shared_dir(SimpleNamespace(conf=conf)) == "hdfs://shared/folder"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_machine_may_use_a_folder_of_its_own(master):
    from types import SimpleNamespace

    from corpusloom.session import shared_dir

    conf = _Conf(spark_master=master)
    assert shared_dir(SimpleNamespace(conf=conf)) == conf.get("spark.checkpoint.dir")
