"""The chunk store: Parquet in buckets of chunk ids, of which an upsert writes
only those that its batch meets.

`rows/write=<name>/bucket=<n>` holds the rows that one upsert wrote. A commit,
`commits/version=<n>`, names the write that holds each bucket: a row per bucket.
Readers take the newest commit, so a job that fails leaves files which nobody
reads. A commit is made by a rename that fails where that version exists: of two
writers one comes second, and puts its batch upon the other's commit. Files that no
commit names any more are left to the folder's clean-up policy.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.schemas import CHUNK_STORE
from corpusloom.session import written
from corpusloom.sources.upsert import keyed_upsert, last_per_key

BROADCAST_BYTES = 32 << 20  # of chunk ids sent to every worker, at most
BUCKETS = 64  # of a new store, unless the caller says more: one should be about a gigabyte, and is a task's work
ATTEMPTS = 20  # of an upsert whose buckets other writers change meanwhile

COMMIT = "bucket int, buckets int, write string, last_id long"


class Bucket(NamedTuple):
    write: str
    last_id: int


class Commit(NamedTuple):
    """A version of the store: its number of buckets, and the filled ones."""

    version: int
    buckets: int
    held: dict[int, Bucket]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = _path(spark, f"{root}/commits/version=*/_SUCCESS")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in files)


def newest(spark: SparkSession, root: str) -> Commit | None:
    """The newest commit. It has a row per bucket, so its size is bounded by the store's
    number of buckets."""
    versions = _versions(spark, root)
    if not versions:
        return None
    rows = spark.read.schema(COMMIT).parquet(f"{root}/commits/version={versions[-1]:08d}").collect()
    held = {r["bucket"]: Bucket(r["write"], r["last_id"]) for r in rows if r["write"] is not None}
    return Commit(versions[-1], rows[0]["buckets"], held)


def _commit(spark: SparkSession, root: str, commit: Commit) -> bool:
    """Make a version, unless another writer has made it."""
    rows = [(b, commit.buckets, *held) for b, held in sorted(commit.held.items())]
    draft, place = f"{root}/drafts/{uuid.uuid4().hex}", f"{root}/commits/version={commit.version:08d}"
    # A store without rows keeps its number of buckets all the same.
    spark.createDataFrame(rows or [(None, commit.buckets, None, None)], COMMIT).coalesce(1).write.parquet(draft)
    conf = spark._jsc.hadoopConfiguration()
    source, target = (_path(spark, p).getFileSystem(conf).makeQualified(_path(spark, p)) for p in (draft, place))
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    target.getFileSystem(conf).mkdirs(target.getParent())
    no_overwrite = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(source, target, no_overwrite)
    except Py4JJavaError:
        if files.util().exists(target):
            return False
        raise
    return True


def _rows(spark: SparkSession, root: str, held: dict[int, Bucket]) -> DataFrame:
    paths = [f"{root}/rows/write={b.write}/bucket={n}" for n, b in sorted(held.items())]
    if not paths:
        return spark.createDataFrame([], CHUNK_STORE)
    return spark.read.schema(CHUNK_STORE).parquet(*paths)


def read_store(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The newest version; only the named columns are read."""
    commit = newest(spark, root)
    return _rows(spark, root, commit.held if commit else {}).select(*(columns or ("*",)))


def store_rows(embedded: DataFrame, *also: str, now=None) -> DataFrame:
    """Embedded chunk records as store rows: metadata as JSON, time of the write, and
    further columns."""
    moment = F.current_timestamp() if now is None else now
    return embedded.select(
        "id", "title", "url", "chunk_id", "content", "section",
        F.to_json("metadata").alias("metadata"),
        "embedding",
        moment.alias("updated_at"),
        *also,
    )


def _with_known_ids(rows: DataFrame, target: DataFrame, small: bool) -> DataFrame:
    """A known chunk keeps its id, and a new one has none yet."""
    keys = rows.select("chunk_id").distinct()
    known = target.select("chunk_id", "id").join(F.broadcast(keys) if small else keys, "chunk_id")
    return rows.drop("id").join(F.broadcast(known) if small else known, "chunk_id", "left")


def merge(
    target: DataFrame, batch: DataFrame, *, order: str, small_batch: bool = False
) -> DataFrame:
    """Upsert by chunk id. All columns but `id` are replaced; a known chunk keeps
    its id, and a new one has none yet."""
    rows = _with_known_ids(batch, target, small_batch)
    return keyed_upsert(target, rows, "chunk_id", order=order, small_batch=small_batch)


def bucket_of(chunk_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(buckets)).cast("int")


def in_order(batch: DataFrame, *order: str) -> DataFrame:
    """The batch with `_place`: of two rows of a chunk the one with the greater place
    wins. That is the one with the greater `order`, and among equals the one read later."""
    return batch.withColumn("_place", F.struct(*order, F.monotonically_increasing_id().alias("_row")))


def upsert(
    spark: SparkSession, root: str, batch: DataFrame, *, order: str | list[str],
    buckets: int = BUCKETS, broadcast_bytes: int = BROADCAST_BYTES, attempts: int = ATTEMPTS,
) -> None:
    """Merge a batch into the store as a new version, and write the buckets it meets.

    Of two rows of a chunk the one with the greater `order` wins, then the one that comes
    later in the batch. New chunks get ids above all others of their bucket: multiples of
    the number of buckets apart, so that no two buckets share one and writers need not
    agree on them. `buckets` holds for a new store only. An empty batch changes nothing.

    The batch is written down first: it is embedded once, and its ids are measured,
    which decides whether they are broadcast.
    """
    order = [order] if isinstance(order, str) else order
    columns = [c for c in CHUNK_STORE.names if c != "id"]
    rows = written(last_per_key(in_order(batch, *order), "chunk_id", "_place").select(*columns), "batch")
    sent = rows.agg(F.sum(F.coalesce(F.octet_length("chunk_id"), F.lit(0)) + 16)).first()[0]
    if sent is None:
        return
    for _ in range(attempts):
        base = newest(spark, root) or Commit(-1, buckets, {})
        wrote = _write_met(spark, root, rows, base, small=sent <= broadcast_bytes)
        # Others' commits to other buckets do not touch what was written here.
        commit = base
        while all(commit.held.get(b) == base.held.get(b) for b in wrote) and commit.buckets == base.buckets:
            if _commit(spark, root, Commit(commit.version + 1, base.buckets, {**commit.held, **wrote})):
                return
            commit = newest(spark, root)
    raise RuntimeError(f"other writers changed the same buckets of {root} {attempts} times")


def _write_met(spark: SparkSession, root: str, rows: DataFrame, base: Commit, *, small: bool) -> dict[int, Bucket]:
    """Write the buckets that the rows meet anew, with the rows in them."""
    rows = rows.withColumn("bucket", bucket_of("chunk_id", base.buckets))
    met = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    held = {b: base.held[b] for b in met if b in base.held}
    target = _rows(spark, root, held)
    rows = _with_known_ids(rows, target, small)
    # Ids go on from the greatest of a bucket: `base` rows of them, at most one per bucket.
    last = spark.createDataFrame([(b, at.last_id) for b, at in held.items()], "bucket int, _last long")
    new = Window.partitionBy("bucket", F.col("id").isNull()).orderBy("chunk_id")
    after = F.coalesce("_last", F.col("bucket") + F.lit(1 - base.buckets).cast("long"))
    rows = rows.join(F.broadcast(last), "bucket", "left").withColumn(
        "id", F.coalesce("id", after + F.row_number().over(new) * F.lit(base.buckets).cast("long")))
    keys = rows.select("chunk_id")
    kept = target.join(F.broadcast(keys) if small else keys, "chunk_id", "left_anti")
    kept = kept.withColumn("bucket", bucket_of("chunk_id", base.buckets))
    columns = [*CHUNK_STORE.names, "bucket"]
    merged = kept.select(*columns).unionByName(rows.select(*columns))
    write = uuid.uuid4().hex
    path = f"{root}/rows/write={write}"
    merged.repartition("bucket").write.partitionBy("bucket").parquet(path)
    last = spark.read.schema("id long, bucket int").parquet(path).groupBy("bucket").agg(F.max("id").alias("id"))
    return {r["bucket"]: Bucket(write, r["id"]) for r in last.collect()}
