"""From nearest chunks to snippets and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.questions import clean_snippet, preview
from corpusloom.operators.knn import top_k, with_chunks
from corpusloom.schemas import SNIPPET

# --- fixed values -----------------------------------------------------------
SEARCH_K = 6
OVERFETCH = 3
BOOST_SECTION = "experience"
BOOST_WEIGHT = 0.15
SNIPPETS = 5
CHAT_K = 12
CANDIDATES = 8
RERANK_K = 4
SCORE_DECIMALS = 3
# ----------------------------------------------------------------------------

SNIPPET_COLUMNS = ("title", "url", "content", "section")


def boosted_top_k(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = SEARCH_K,
    *,
    overfetch: int = OVERFETCH,
    section: str = BOOST_SECTION,
    weight: float = BOOST_WEIGHT,
    **search,
) -> DataFrame:
    """Questions `q_id, qvec, bias` to `q_id, rank, score, boosted` and the chunk.

    A biased question re-sorts `overfetch * k` nearest chunks by a score raised
    for one section; the others keep the k nearest. One job serves both kinds.
    Only the section is looked up to rank them; contents come to the last k.
    """

    def boosted(near: DataFrame) -> DataFrame:
        found = with_chunks(near, chunks, "section").join(questions.select("q_id", "bias"), "q_id")
        raised = F.col("similarity") + F.when(F.col("section") == section, weight).otherwise(0.0)
        found = found.withColumn("boosted", raised).withColumnRenamed("rank", "near")
        # Without bias the first key is null throughout and the distance decides.
        order = Window.partitionBy("q_id").orderBy(
            F.when(F.col("bias"), F.col("boosted")).desc_nulls_first(), F.col("near")
        )
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("q_id", "chunk_id", "rank", F.col("similarity").alias("score"), "boosted")

    near = top_k(questions, chunks, k * overfetch, then=boosted, **search)
    return with_chunks(near, chunks, *SNIPPET_COLUMNS).select(
        "q_id", "chunk_id", *SNIPPET_COLUMNS, "score", "boosted", "rank"
    )


def shape_snippets(hits: DataFrame, n: int = SNIPPETS) -> DataFrame:
    """The first n hits of each question as snippet rows `q_id, rank, …`."""
    def filled(name):
        return F.nullif(F.col(name), F.lit(""))

    return hits.where(F.col("rank") <= n).select(
        "q_id",
        "rank",
        F.concat(F.lit("S"), F.col("rank").cast("string")).alias("id"),
        F.coalesce(filled("title"), filled("section"), F.lit("Snippet")).alias("title"),
        filled("section").alias("section"),
        filled("url").alias("url"),
        clean_snippet(F.col("content")).alias("text"),
        F.round(F.coalesce("score", F.lit(0.0)), SCORE_DECIMALS).alias("score"),
    )


def gather(rows: DataFrame, fields: list[str], name: str, *also: Column) -> DataFrame:
    """Ranked rows to one ordered array per question, and other aggregates. A
    question has at most a top-k of rows, so the array is small."""
    item = F.struct(F.col("rank").alias("_rank"), *fields)
    ordered = F.array_sort(F.collect_list(item))
    plain = F.transform(ordered, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return rows.groupBy("q_id").agg(plain.alias(name), *also)


def snippets(hits: DataFrame, n: int = SNIPPETS) -> DataFrame:
    return gather(shape_snippets(hits, n), SNIPPET.fieldNames(), "snippets")


def counted(hits: DataFrame) -> DataFrame:
    """Add `n_found`, the question's number of hits, without a second search."""
    return hits.withColumn("n_found", F.count("*").over(Window.partitionBy("q_id")))


def shape_candidates(hits: DataFrame, n: int = CANDIDATES, *keep: str) -> DataFrame:
    """The first n of the nearest chunks (with title, url, content) as candidates."""
    return hits.where(F.col("rank") <= n).select(
        "q_id",
        "rank",
        F.col("chunk_id").alias("id"),
        "title",
        "url",
        "content",
        preview(F.col("content")).alias("preview"),
        F.round(F.coalesce("similarity", F.lit(0.0)), SCORE_DECIMALS).alias("similarity"),
        *keep,
    )


def token_overlap(question, content):
    """Default pair score, in place of a model: how many different words of the
    question occur in the content."""
    def words(c):
        return F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")

    shared = F.array_intersect(words(question), words(content))
    return F.size(F.filter(shared, lambda w: w != "")).cast("double")


def rerank(
    candidates: DataFrame,
    questions: DataFrame,
    *,
    scorer=token_overlap,
    top: int = RERANK_K,
    enabled: bool = True,
) -> DataFrame:
    """Score each (message, content), keep the best `top`, ties in input order.

    `scorer` maps two columns to a score column; see `embedding.pair_scorer` for
    models. Where it gives null for a question, or reranking is off, the
    candidates stay as they are.
    """
    if not enabled:
        return candidates.withColumn("rerank_score", F.lit(None).cast("double"))
    scored = candidates.join(questions.select("q_id", "message"), "q_id").withColumn(
        "rerank_score", scorer(F.col("message"), F.col("content"))
    )
    question = Window.partitionBy("q_id")
    order = question.orderBy(F.col("rerank_score").desc(), F.col("rank"))
    failed = F.max(F.col("rerank_score").isNull().cast("int")).over(question) == 1
    ranked = scored.withColumn("_failed", failed).withColumn("_best", F.row_number().over(order))
    return (
        ranked.where(F.col("_failed") | (F.col("_best") <= top))
        .withColumn("rank", F.when(F.col("_failed"), F.col("rank")).otherwise(F.col("_best")))
        .withColumn("rerank_score", F.when(~F.col("_failed"), F.col("rerank_score")))
        .drop("message", "_failed", "_best")
    )
