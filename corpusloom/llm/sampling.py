"""Bounded samples of labelled documents for the driver, where models are fitted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import text_key

SAMPLE_ROWS = 4000         # documents
SAMPLE_BYTES = 64 << 20    # of their texts together


def labelled(
    documents: DataFrame, labels: DataFrame, *columns: str, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES,
) -> pd.DataFrame:
    """At most `rows` documents, of `most_bytes` of text together, that have a row in `labels` (one
    per `doc_id`): `doc_id, text`, the named columns, and those of `labels`, sorted by id.

    The ids come in the order of a digest. Of several documents of an id the shortest counts
    (then the least hash of the text), once; one that no longer fits into the bytes is
    passed over. Sizes are looked at first, so texts that are not taken are never collected.
    Null ids have no label."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = labels.where("doc_id IS NOT NULL").orderBy(key, "doc_id").limit(rows)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    narrow = documents.select("doc_id", F.struct(size.alias("bytes"), text_key().alias("text_key")).alias("of"))
    sizes = narrow.join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("of").alias("of"))
    chosen, left = [], most_bytes
    for row in sizes.orderBy(key, "doc_id").collect():
        if row.of.bytes <= left:
            chosen.append((row.doc_id, row.of.text_key))
            left -= row.of.bytes
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, chosen_key long"
    wanted = documents.sparkSession.createDataFrame(chosen, schema).join(ids, "doc_id")
    met = documents.select("doc_id", "text", *columns).join(F.broadcast(wanted), "doc_id")
    found = met.where(text_key() == F.col("chosen_key")).drop("chosen_key").dropDuplicates(["doc_id"]).toPandas()
    return found.sort_values("doc_id").reset_index(drop=True)
