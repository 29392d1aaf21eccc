"""WARC archives with a Zstandard dictionary of their own.

A page becomes a WARC record; of pages with equal payloads one keeps it, the others
revisit that one. Records are collected until an archive has its size; a dictionary is
built from a bounded sample of them and stored in a skippable frame at the archive's
beginning, and each record is a frame of its own, so that any can be read alone.

Spark writes the archives, one file each, and reads them back: only its file systems
and its commit of whole files are used, and no task opens a path. The text writer puts
a separator after each value, here an empty skippable frame, which readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import _bounded
from corpusloom.session import new_dir, written

ARCHIVE_BYTES = 32 << 20    # of records before compression, about; one record is never cut
SAMPLE_BYTES = 4 << 20      # of records that a dictionary is built from, spread over the archive
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"

#: Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FIRST = "struct<unnamed:boolean,page_id:bigint,no_url:boolean,url:string>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _name() -> Column:
    """Orders rows of equal payloads: the first is the response."""
    return F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("no_url"), "url")


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`page_id, url, refers_to, revisit, payload, n_bytes, sha1`: a row per row of `pages`, with the payload
    where it is to be stored. Narrow rows are grouped, by SHA-256; payloads stay where they
    are while the groups of several rows are few (counted), and join them beyond that."""
    rows = pages.select("page_id", "url", _payload().alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256)).withColumn("n_bytes", F.length("payload").cast("long"))
    narrow = keyed.where(F.col("n_bytes") >= least_bytes).groupBy("key", "page_id", "url").agg(
        F.count(F.lit(1)).alias("times"), F.first("n_bytes").alias("n_bytes"), F.first(F.sha1("payload")).alias("sha1"),
    )
    named = narrow.groupBy("key").agg(
        F.sum("times").alias("rows"), F.min_by(F.struct("times", "n_bytes", "sha1"), _name()).alias("of"), F.min(_name()).alias("first"),
    )
    several = written(named.where("rows > 1").select(F.col("key").alias("group"), "first", "of"), "equal_payloads")
    met = keyed.join(_bounded(several), keyed.key == F.col("group"), "left")
    is_first = _name() == F.col("first")
    columns = [
        "page_id", "url", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to"), "revisit",
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "n_bytes", "sha1",
    ]
    made = met.withColumn("revisit", F.col("group").isNotNull() & ~F.coalesce(is_first, F.lit(False)))
    made = made.withColumn("sha1", F.sha1("payload"))
    repeated = ~F.col("revisit") & (F.coalesce(F.col("of.times"), F.lit(1)) > 1)
    once = made.where(~repeated).select(*columns)
    # Rows equal in id, url and payload: one is the response, its repetitions revisit it.
    one = made.where(repeated).dropDuplicates(["key"]).select(*columns)
    again = several.where("of.times > 1").select("first", "of", F.explode(F.sequence(F.lit(2).cast("long"), F.col("of.times"))))
    again = again.select(
        "first.page_id", "first.url", F.col("first.page_id").alias("refers_to"), F.lit(True).alias("revisit"),
        F.lit(None).cast("binary").alias("payload"), "of.n_bytes", "of.sha1",
    )
    return once.unionByName(one).unionByName(again)


def _uri(url: str | None) -> str | None:
    """The url as a header's value: what may not stand in one is escaped."""
    return None if url is None else re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def _urn(page_id: object) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: object, url: str | None, payload: bytes | None, n_bytes: int, sha1: str, refers_to: object = None) -> bytes:
    """A WARC record: a response with its payload, or, without one, a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if payload is None else None),
        ("WARC-Refers-To", _urn(refers_to) if payload is None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of a spread, bounded sample of the records; empty where they are too few or small."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [r[:SAMPLE_BYTES] for r in records[::step]]
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 20)
    if len(sample) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], found: bytes = b"") -> bytes:
    """The records as frames, behind a skippable frame that holds the dictionary `found`, if any."""
    out = [DICTIONARY_MAGIC, struct.pack("<I", len(found)), found] if found else []
    using = {"dict_data": zstandard.ZstdCompressionDict(found)} if found else {}
    tool = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **using)
    return b"".join([*out, *map(tool.compress, records)])


def write(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of the rows of `decided`, a file each, in the folder `path`. A task holds one
    archive's records at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, found = 0, b""

        def full() -> pa.RecordBatch:
            nonlocal found
            found = dictionary(held) or found  # a short last archive takes the one before
            made = pa.RecordBatch.from_arrays([pa.array([archive(held, found)], pa.binary())], names=["archive"])
            held.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                payload = None if row["revisit"] else row["payload"]
                held.append(record(row["page_id"], row["url"], payload, row["n_bytes"], row["sha1"], row["refers_to"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    size = 0
        if held:
            yield full()

    made = records.select("page_id", "url", "refers_to", "revisit", "payload", "n_bytes", "sha1").mapInArrow(run, "archive binary")
    # The cast keeps the bytes as they are, and so does the writer.
    made.select(F.col("archive").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


@dataclass(frozen=True)
class Record:
    offset: int   # of its frame in the archive
    length: int
    headers: dict[str, str]
    block: bytes


def frame_end(data: memoryview, start: int) -> int:
    """Where the frame that begins at `start` ends."""
    kind = data[start + 4]
    single, checksum = kind >> 5 & 1, kind >> 2 & 1
    at = start + 5 + (1 - single) + (0, 1, 2, 4)[kind & 3] + ((single, 2, 4, 8)[kind >> 6])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-cased name, and the block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records_of(content: bytes) -> Iterator[Record]:
    """The records of an archive, one frame at a time."""
    data, at = memoryview(content), 0
    using = {}
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if magic != FRAME_MAGIC:
            if magic[1:] != DICTIONARY_MAGIC[1:] or magic[0] >> 4 != 5:
                raise ValueError(f"no frame at {at}")
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if not at and magic == DICTIONARY_MAGIC:
                using = {"dict_data": zstandard.ZstdCompressionDict(bytes(data[8:end]))}
            at = end
            continue
        end = frame_end(data, at)
        headers, block = parsed(zstandard.ZstdDecompressor(**using).decompress(bytes(data[at:end])))
        yield Record(at, end - at, headers, block)
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """`page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, archive, offset, length`
    of all records in the archives of a folder. A response whose payload does not have the
    digest that its header names ends the job with an error."""
    kinds = (
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
        "payload_digest string, archive string, offset long, length long"
    )

    def page(urn: str | None) -> int | None:
        name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name not in ("", "none") else None

    def row(name: str, found: Record) -> tuple:
        head, _, body = found.block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\nContent-Length: *([0-9]+)", head)[1])
        digest, kind = found.headers["warc-payload-digest"].removeprefix("sha1:"), found.headers["warc-type"]
        response = kind == "response"
        if response and (sha1_base32(body) != digest or len(body) != size):
            raise ValueError(f"{name}, {found.offset}: the payload does not have its digest")
        return (
            page(found.headers["warc-record-id"]), found.headers.get("warc-target-uri"), kind, page(found.headers.get("warc-refers-to")),
            body if response else None, size, digest, name, found.offset, found.length,
        )

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for found in records_of(content.as_py()):
                    rows.append(row(name.as_py(), found))
                    size += len(found.block)
                    if size >= 1 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The records of `pages` (`page_id`, `url`, `html`, others ignored), written as archives and read
    back; the columns are those of `read`.

    A null html counts as empty. Of rows with equal payloads of at least `least_bytes`, the one
    with the smallest id (null last; then the smallest url, null last) is the response;
    of rows repeated whole, any one. A null url has no header; characters that may not
    stand in a header are percent-escaped. A null id is written as `none`, and a revisit of
    such a response has a null `refers_to`. An empty table gives an empty result."""
    path = new_dir(pages.sparkSession, "warc")
    write(decided(pages, least_bytes), path, archive_bytes)
    return read(pages.sparkSession, path)
