"""The test tables in the roles the operators need, in Spark and in SQL.

Each pair derives the same rows. All rows of a table take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import quantize
from corpusloom.operators.chunking import build_chunks
from corpusloom.operators.embedding import embed
from corpusloom.session import written
from corpusloom.sources.documents import spread

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
NOW = "2024-02-01 00:00:00"
KINDS = ["my-resume", "cv", "project", "about-me", "faq", "note"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id, key, text, lang`."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.concat(F.lit("raw/"), kind, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return spread(rows).withColumn("key", key)


SQL_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
SQL_DOCUMENTS = f"""
SELECT doc_id, text, lang,
       'raw/' || {SQL_KINDS}[(doc_id % 6 + 1)::INT] || '-' || doc_id || '.txt' AS key
FROM documents"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`page_id, key, text`, the text being HTML."""
    rows = table(spark, sf_dir, "pages")
    key = F.concat(F.lit("raw/page-"), F.col("page_id").cast("string"), F.lit(".html"))
    return spread(rows).select("page_id", key.alias("key"), F.col("html").alias("text"))


SQL_PAGES = "SELECT page_id, 'raw/page-' || page_id || '.html' AS key, html AS text FROM pages"


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a chunk table, with the document of the same number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")
    number = F.col("vec_id").cast("string")
    section = (
        F.when(F.col("label") == 3, "experience").when(F.col("label") == 0, "")
        .otherwise(F.concat(F.lit("section_"), F.col("label").cast("string")))
    )
    return rows.select(
        F.format_string("v%08d", "vec_id").alias("chunk_id"),
        F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat("source", F.lit(" "), number)).alias("title"),
        F.when(F.col("vec_id") % 5 == 0, "")
        .otherwise(F.concat(F.lit("https://example.org/"), number)).alias("url"),
        F.col("text").alias("content"),
        section.alias("section"),
        quantize(F.col("embedding")).alias("embedding"),
    )


SQL_QUANTIZED = "list_transform({v}, lambda x: round_even(x::DOUBLE, 6)::FLOAT)"

SQL_VECTOR_STORE = f"""
SELECT printf('v%08d', vec_id) AS chunk_id,
       CASE WHEN vec_id % 7 = 0 THEN '' ELSE source || ' ' || vec_id END AS title,
       CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'https://example.org/' || vec_id END AS url,
       text AS content,
       CASE label WHEN 3 THEN 'experience' WHEN 0 THEN '' ELSE 'section_' || label END AS section,
       {SQL_QUANTIZED.format(v='embedding')} AS embedding
FROM embeddings LEFT JOIN documents ON vec_id = doc_id"""


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a question `q_id, qvec, message, bias`: the text is the
    document of the same number, and an English one is biased."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")
    return rows.select(
        F.col("vec_id").alias("q_id"),
        quantize(F.col("embedding")).alias("qvec"),
        F.col("text").alias("message"),
        F.coalesce(F.col("lang") == "en", F.lit(False)).alias("bias"),
    )


SQL_VECTOR_QUESTIONS = f"""
SELECT vec_id AS q_id, {SQL_QUANTIZED.format(v='embedding')} AS qvec,
       text AS message, coalesce(lang = 'en', false) AS bias
FROM embeddings LEFT JOIN documents ON vec_id = doc_id"""


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents with their vectors, as a table."""
    chunks = build_chunks(documents(spark, sf_dir).select("key", "text"))
    return written(embed(chunks, "content"), "embedded")


def turn_id() -> Column:
    """A name for a turn, whatever the number of turns of a conversation."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


SQL_TURN_ID = "conv_id || '-' || turn"


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the conversations as requests. Assistant turns have no session,
    so they are invalid; each user turn comes a second time a day later, with
    other blanks and case, so that the cache has something to hit."""
    rows = table(spark, sf_dir, "conversations")
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("conv_id") * 100 + F.col("turn"))
    session = F.when(F.col("role") == "user", F.col("conv_id").cast("string"))
    first = rows.select(
        turn_id().alias("request_id"), session.alias("session_id"),
        F.col("text").alias("message"), start.alias("ts"),
    )
    again = first.where(F.col("session_id").isNotNull()).select(
        F.concat("request_id", F.lit("-again")).alias("request_id"), "session_id",
        F.concat(F.lit(" "), F.translate(F.replace("message", F.lit(" "), F.lit("  ")), LOWER, UPPER)).alias("message"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"),
    )
    return first.unionByName(again)


SQL_CHAT_REQUESTS = f"""
WITH firsts AS (
  SELECT {SQL_TURN_ID} AS request_id,
         CASE WHEN role = 'user' THEN conv_id::VARCHAR END AS session_id,
         text AS message,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 100 + turn) AS ts
  FROM conversations)
SELECT * FROM firsts
UNION ALL
SELECT request_id || '-again', session_id, ' ' || translate(replace(message, ' ', '  '), '{LOWER}', '{UPPER}'),
       ts + INTERVAL 1 DAY
FROM firsts WHERE session_id IS NOT NULL"""


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timed requests of one user and kind: `key, ts, request_id`."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
    )


SQL_CACHE_REQUESTS = """
SELECT user_id || '/' || event_type AS key, ts, event_id AS request_id FROM events"""


def site_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    index = (
        F.when(F.col("p_size") % 5 == 0, "PROJECT").when(F.col("p_size") % 5 == 1, F.lit(None))
        .otherwise("OTHER")
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int"))
    return rows.select(
        F.lit("ITEM").alias("PK"),
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("SK"),
        index.alias("GSI1PK"),
        F.date_format(day, "yyyy-MM-dd").alias("GSI1SK"),
        F.when(F.col("p_size") % 10 != 0, F.split("p_name", " ")).alias("tags"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("summary"),
    )


SQL_SITE_ITEMS = """
SELECT 'ITEM' AS PK, p_name || '#' || p_partkey AS SK,
       CASE p_size % 5 WHEN 0 THEN 'PROJECT' WHEN 1 THEN NULL ELSE 'OTHER' END AS GSI1PK,
       strftime(DATE '2024-01-01' + (p_partkey % 365)::INT, '%Y-%m-%d') AS GSI1SK,
       CASE WHEN p_size % 10 <> 0 THEN string_split(p_name, ' ') END AS tags,
       CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS summary
FROM part"""
