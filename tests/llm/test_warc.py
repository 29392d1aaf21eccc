"""Archives: round trips, formats and copies."""

import hashlib
import io
import random
import struct

import pytest
import zstandard

from corpusloom.llm import queries, warc
from tests.llm.brute import connection, same_as_sql

SCHEMA = "page_id long, url string, html string, key string, payload int, revisit string, sha1 int, of int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "no", 2, 3) for r in rows], SCHEMA)


def words(rng, n):
    return "<p>" + " ".join(rng.choice(["corpus", "thé", "page", "<b>bold</b>", "naïve", str(rng.randrange(99))]) for _ in range(n)) + "</p>"


ROWS = [
    (5, "http://a.org/x y", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "http://b.org/\r\nX: 1", "<p>one</p>"),
    (1, "http://c.org/é", None), (2, "http://c.org", ""), (None, "http://d.org", "<p>two</p>"), (4, "u", "<p>two</p>"),
    (6, "u", "<p>three</p>"), (6, "u", "<p>three</p>"), (6, "u", "<p>three</p>"), (6, None, "<p>three</p>"), (6, "t", "<p>four</p>"),
    (7, "u", "x" * 400_000), (None, None, "lonely"), (None, None, "lonely"), (8, "u", "a\r\n\r\nb\0c"),
]


def expected(rows, least=0):
    groups = {}
    for page_id, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page_id, url))
    out = []
    for payload, members in groups.items():
        members.sort(key=lambda m: (m[0] is None, m[0] or 0, m[1] is None, m[1] or ""))
        for k, (page_id, _) in enumerate(members):
            again = k > 0 and len(payload) >= least
            out.append((page_id, len(payload), warc.sha1_base32(payload), "revisit" if again else "response", members[0][0] if again else None))
    return sorted(out, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("least", [0, 1, 6, 1 << 30])
def test_edges(spark, least):
    assert found(warc.round_trip(table(spark, ROWS).repartition(3), least)) == expected(ROWS, least)
    assert warc.round_trip(table(spark, [])).collect() == []


def test_joined_payloads(spark, monkeypatch):
    from corpusloom.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert found(warc.round_trip(table(spark, ROWS))) == expected(ROWS)


def test_files(spark, tmp_path):
    """Archives of bounded size, each with a dictionary, that any Zstandard tool can read."""
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 7}.org/{i}", words(rng, rng.choice([10, 20, 200]))) for i in range(600)]
    path = str(tmp_path / "warc")
    warc.write(warc.decided(table(spark, rows).coalesce(2)), path, archive_bytes=100_000)
    files = sorted(p for p in (tmp_path / "warc").iterdir() if p.name.startswith("part-"))
    assert len(files) >= 4
    payloads, bare, stored = {}, 0, 0
    for file in files:
        content = file.read_bytes()
        stored += len(content)
        assert content.endswith(warc.EMPTY_FRAME.encode())
        assert content[:4] == warc.DICTIONARY_MAGIC
        size = struct.unpack("<I", content[4:8])[0]
        trained = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        assert trained.dict_id()
        whole = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(io.BytesIO(content), read_across_frames=True).read()
        records = list(warc.records_of(content))
        assert whole.count(b"WARC/1.1\r\n") == len(records)
        for r in records:
            alone = zstandard.ZstdDecompressor(dict_data=trained).decompress(content[r.offset : r.offset + r.length])
            headers, block = warc.parsed(alone)
            assert headers["warc-type"] == "response" and len(block) == int(headers["content-length"])
            bare += len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(alone))
            payloads[headers["warc-record-id"]] = (headers["warc-target-uri"], block.partition(b"\r\n\r\n")[2].decode())
    assert payloads == {f"<urn:page:{i}>": (url, html) for i, url, html in rows}
    assert stored < 0.6 * bare  # also with the dictionaries
    back = warc.read(spark, path)
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in back.collect()) == sorted(rows)


@pytest.mark.parametrize("size", [0, 1, 5, 300, 70_000, 400_000])
def test_frames(size):
    """The end of a frame, for all kinds of headers and blocks."""
    rng = random.Random(size)
    for payload in (bytes(size), rng.randbytes(size), (words(rng, size // 20 + 1).encode() * 3)[:size]):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            frame = zstandard.ZstdCompressor(**options).compress(payload)
            assert warc.frame_end(memoryview(b"ab" + frame + b"more"), 2) == len(frame) + 2


def test_damage(spark, tmp_path):
    path = tmp_path / "warc"
    page = warc.record(1, "u", b"payload", 7, hashlib.sha1(b"other").hexdigest())
    path.mkdir()
    (path / "part-0").write_bytes(warc.archive([page]))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read(spark, str(path)).collect()
    with pytest.raises(ValueError, match="no frame"):
        list(warc.records_of(b"not an archive"))


def test_query(spark, sf_dir):
    same_as_sql(queries.op12_warc(spark, sf_dir), connection(sf_dir), queries.SQL["op12_warc"])
