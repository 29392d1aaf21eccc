"""Exact duplicates against immutable snapshots, screened by static filters.

Documents arrive in batches. The classes of equal texts known so far are an
immutable snapshot: one entry per digest, with a binary-fuse filter for each shard
of the digests. The copies inside a new batch are grouped on their own. Its distinct
digests are asked of the filters; most are certainly new and go no further. The
positives join the exact entries, and where the digests agree, the bytes of the
two texts are compared before the classes are put together.

Copies are counted before anything is shuffled by digest, so a group of any size is
one row per task there; the last join, which gives each row its class, is split by
adaptive execution where a class is large. Texts move only for the byte check, and
only one per positive class and side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import binary_fuse
from corpusloom.session import unsized, written

BLANK = r"[\x20\x09-\x0D]+"
SHARD_KEYS = 500_000       # distinct digests in a filter, about
LEAST_SHARDS = 64
BROADCAST_ROWS = 250_000   # of two numbers each: below 16 MB


def normalized(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def text_key() -> Column:
    """With doc_id, tells rows apart that are not repeated whole."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sketched(documents: DataFrame, arrivals: int) -> DataFrame:
    """A narrow row per document, written once, so that its number is fixed."""
    rows = documents.select(
        "doc_id", text_key().alias("text_key"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalized(F.col("text")), 256).alias("text_sha256"),
        F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals))
        .cast("int").alias("arrival"),
    )
    digest = F.unhex("text_sha256")
    return written(
        rows.withColumn("digest", digest).withColumn("key", F.xxhash64(digest))
        .drop("text_sha256").withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )


def _classes(rows: DataFrame) -> DataFrame:
    """`digest, key, n, best`: the copies of a batch among themselves. The best has
    the most code points, then the smallest id."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row")))
    return rows.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _shard(shards: int) -> Column:
    return F.pmod("key", F.lit(shards)).cast("int")


def filters_of(entries: DataFrame, shards: int) -> DataFrame:
    """A filter per shard of the snapshot, `shard, seed, segment, tags`, as a table."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = binary_fuse.build(rows.key.to_numpy())
        return pd.DataFrame({"shard": [rows.shard.iloc[0]], "seed": [made.seed], "segment": [made.segment], "tags": [made.tags]})

    keys = entries.select(_shard(shards).alias("shard"), "key")
    return written(
        keys.groupBy("shard").applyInPandas(build, "shard int, seed long, segment long, tags binary"), "filters",
    )


def screened(classes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The classes whose digest may be in the snapshot: `digest`, as a table."""

    def ask(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(rows):
            return rows[["digest"]].iloc[:0]
        one = stored.iloc[0]
        fuse = binary_fuse.Fuse(int(one.seed), int(one.segment), one.tags)
        return rows[["digest"]][binary_fuse.contains(fuse, rows.key.to_numpy().astype(np.uint64))]

    asked = classes.select(_shard(shards).alias("shard"), "digest", "key").groupBy("shard")
    return written(asked.cogroup(filters.groupBy("shard")).applyInPandas(ask, "digest binary"), "positives")


def _bounded(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few, and only then."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else unsized(rows)


def _same_bytes(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """The digests of `digest, new_id, old_id` at which both documents have the same
    normalised bytes."""
    wanted = hits.select("digest", F.explode(F.array_distinct(F.array("new_id", "old_id"))).alias("wanted_id"))
    texts = documents.select("doc_id", normalized(F.col("text")).alias("normal"))
    found = texts.join(_bounded(written(wanted, "wanted")), F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    found = found.where(F.unhex(F.sha2("normal", 256)) == F.col("digest"))
    checked = found.groupBy("digest").agg(F.min("normal").alias("low"), F.max("normal").alias("high"))
    return checked.where(F.col("low") == F.col("high")).select("digest")


def _arrive(entries: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """The digests of the new classes that equal an entry of the snapshot."""
    shards = max(LEAST_SHARDS, -(-max(entries.count(), new.count()) // SHARD_KEYS))
    positives = screened(new, filters_of(entries, shards), shards)
    hits = positives.join(new, "digest").join(entries.select("digest", F.col("best").alias("old")), "digest")
    hits = written(hits.select(
        "digest", (-F.col("best.minus_id")).alias("new_id"), (-F.col("old.minus_id")).alias("old_id"),
    ), "hits")
    return written(_same_bytes(hits, documents), "confirmed")


def exact_dedup(documents: DataFrame, arrivals: int = 2) -> DataFrame:
    """`doc_id, text_key, keep_id, group_size, kept, text_sha256, arrival`, one row per row of
    `documents` (`doc_id`, `text`, others ignored).

    Texts are equal when they are identical without ASCII white space. Of equal
    texts the one with the most code points stays, then the smallest id (a null id
    last); of rows repeated whole, any one of them. A null text counts as empty. An
    empty table gives an empty result. Batches are dealt by a checksum of the id;
    the result does not depend on their number."""
    rows = _sketched(documents.select("doc_id", "text"), arrivals)
    entries = None
    for batch in range(arrivals):
        new = written(_classes(rows.where(F.col("arrival") == batch)), "classes")
        if entries is None:
            entries = new
            continue
        same = _arrive(entries, new, documents).withColumn("same", F.lit(True))
        # Confirmed classes join the entry of the snapshot; the others are entries of their own.
        met = new.join(same, "digest", "left")
        added = met.where(F.col("same").isNull()).drop("same")
        grown = met.where("same").select("digest", F.col("n").alias("more"), F.col("best").alias("other"))
        entries = entries.join(grown, "digest", "left").select(
            "digest", "key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("best", "other").alias("best"),
        )
        entries = written(entries.unionByName(added), "snapshot")
    best = F.col("best")
    known = entries.select("digest", F.col("n").alias("group_size"), "best")
    placed = rows.join(known, "digest")
    return placed.select(
        "doc_id", "text_key", (-best.minus_id).alias("keep_id"), "group_size",
        (F.col("row") == -best.minus_row).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "arrival",
    )


def one_of_each(documents: DataFrame, arrivals: int = 2) -> DataFrame:
    """`doc_id, text_key, rows, stay` for `survivors`: how many rows there are, and how many stay."""
    by = exact_dedup(documents, arrivals).groupBy("doc_id", "text_key")
    return by.agg(F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("stay"))


def survivors(documents: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of `documents` that a table `doc_id, text_key, rows, stay` keeps: all, none or one
    of the rows with the same id and text (null ids among themselves; a null text as
    empty). Of these, any one stays. All columns come through, whatever their names. The
    texts are not shuffled while the rows to leave out are few (counted); beyond that
    they join by id. An empty table gives an empty result."""
    odd = written(decided.where("stay < rows"), "odd")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", text_key().alias("text_key"))
    right = odd.select(F.col("doc_id").alias("odd_id"), F.col("text_key").alias("odd_key"), "stay")
    match = F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("text_key") == F.col("odd_key"))
    plain = whole.join(_bounded(right), match, "left_anti")
    some = whole.join(_bounded(right.where("stay > 0")), match).dropDuplicates(["odd_id", "odd_key"])
    return plain.select("row.*").unionByName(some.select("row.*"))
