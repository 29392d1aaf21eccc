"""Documents to chunk files, and chunk files to the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunking import build_chunks
from corpusloom.operators.embedding import embed
from corpusloom.sources import chunk_files, chunk_store
from corpusloom.sources.documents import documents


def chunk_documents(spark: SparkSession, root: str, out: str, **options) -> None:
    """Documents below `root` to chunk files in `out`."""
    chunk_files.write_chunks(build_chunks(documents(spark, root), **options), out)


def embedded_chunks(chunks: DataFrame, *also: str, now=None, **embedding) -> DataFrame:
    """Chunk records to store rows, and further columns. No shuffle."""
    return chunk_store.store_rows(embed(chunks, "content", **embedding), *also, now=now)


def embed_and_index(spark: SparkSession, chunk_dir: str, store: str, *, buckets: int = chunk_store.BUCKETS, **embedding) -> None:
    """Embed the chunk files and upsert them. Of two rows of a chunk the one made
    later wins, and of those made at one time the later one by file name and line."""
    lines = ["made", "file_path", "file_block_start"]
    chunks = chunk_files.read_chunks(spark, chunk_dir).select("*", *(f"_metadata.{c}" for c in lines[1:]))
    batch = embedded_chunks(chunks.withColumn("made", F.col("metadata.updated_at")), *lines, **embedding)
    chunk_store.upsert(spark, store, batch, order=lines, buckets=buckets)
