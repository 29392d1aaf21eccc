"""Questions against chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval as R
from corpusloom.operators.embedding import pair_scorer
from corpusloom.operators.knn import top_k, with_chunks
from corpusloom.plans.retrieve import retrieve, with_question
from workload import inputs as I
from workload.ingest import SQL_PLAIN, sql_chunks, sql_embedding, sub

JS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# ---- SQL forms ---------------------------------------------------------------
SQL_INTENT = r"(?i)\b(intern(ship)?|experience|work|job|co-?op|placement)\b"
SQL_GREETING = rf"^(hi|hey|hello|yo|sup|howdy|thanks|thank you|bye|good{JS}*(morning|evening|night))\b"


def sql_js_strip(c: str) -> str:
    return sub(c, f"^{JS}+|{JS}+$", "")


def sql_clean(c: str) -> str:
    c = sub(f"coalesce({c}, '')", f"{JS}+", " ")
    return f"substr({sub(c, rf'https?{JS}*:{JS}*/{JS}*/{JS}*', 'https://')}, 1, 600)"


def sql_chit_chat(c: str) -> str:
    text = f"lower({sql_js_strip(c)})"
    return f"(regexp_matches({text}, '{SQL_GREETING}') OR length({text}) < 4)"


def sql_scores(questions: str, chunks: str, name: str = "scored") -> str:
    """CTE `name`: every pair's similarity and its rank."""
    return f"""
{name}_q AS MATERIALIZED (SELECT *, qvec::DOUBLE[] AS qd FROM ({questions})),
{name}_c AS MATERIALIZED (SELECT *, embedding::DOUBLE[] AS cd FROM ({chunks})),
{name}_pairs AS (
  SELECT q_id, chunk_id, round(list_cosine_similarity(qd, cd), 12) AS similarity
  FROM {name}_q, {name}_c),
{name} AS MATERIALIZED (
  SELECT q_id, chunk_id, similarity, row_number() OVER (
    PARTITION BY q_id ORDER BY similarity DESC, chunk_id) AS rank
  FROM {name}_pairs
  QUALIFY rank <= 18)"""


SCORED = f"WITH {sql_scores(I.SQL_VECTOR_QUESTIONS, I.SQL_VECTOR_STORE)}"

SQL_SNIPPET = f"""
  'S' || rank AS id, coalesce(nullif(title, ''), nullif(section, ''), 'Snippet') AS title,
  nullif(section, '') AS section, nullif(url, '') AS url, {sql_clean('content')} AS text,
  round(coalesce(similarity, 0), 3) AS score"""


def sql_boosted(name: str = "scored", questions: str = "scored_q", chunks: str = "scored_c", out: str = "boosted") -> str:
    return f"""
{out} AS MATERIALIZED (
  SELECT * EXCLUDE (place), place AS rank FROM (
    SELECT s.q_id, s.chunk_id, title, url, content, section, similarity,
           similarity + CASE WHEN section = 'experience' THEN 0.15 ELSE 0 END AS raised,
           row_number() OVER (PARTITION BY s.q_id ORDER BY
             CASE WHEN bias THEN similarity + CASE WHEN section = 'experience' THEN 0.15 ELSE 0 END END DESC,
             s.rank) AS place
    FROM {name} s JOIN {chunks} USING (chunk_id) JOIN {questions} q ON q.q_id = s.q_id)
  WHERE place <= 6)"""


# ---- queries -----------------------------------------------------------------
def pair_similarity(spark, sf_dir):
    """Each vector with the one before it."""
    rows = I.table(spark, sf_dir, "embeddings")
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = rows.join(before, "vec_id")
    return both.select(
        "vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("other")), 9).alias("similarity")
    )


def _knn(k):
    def query(spark, sf_dir):
        hits = top_k(I.vector_questions(spark, sf_dir), I.vector_store(spark, sf_dir), k)
        return hits.withColumn("similarity", F.round("similarity", 9))
    return query


def knn_in_tiles(spark, sf_dir):
    """The form for many questions: blocks and tiles, nothing broadcast."""
    hits = top_k(I.vector_questions(spark, sf_dir), I.vector_store(spark, sf_dir), 6, broadcast_bytes=0)
    return hits.withColumn("similarity", F.round("similarity", 9))


def blank_question_gate(spark, sf_dir):
    rows = I.table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    requests = rows.select(
        I.turn_id().alias("q_id"),
        F.when(user, F.concat(F.lit(" "), "text", F.lit("\n"))).otherwise(F.lit("")).alias("q"),
        F.when(F.col("turn") == 1, F.lit(" \t")).when(~user, F.col("text")).alias("query"),
    )
    return with_question(requests).select("q_id", "question", "asks")


def experience_intent(spark, sf_dir):
    rows = I.documents(spark, sf_dir)
    return rows.select("doc_id", Q.experience_intent(F.col("text")).alias("bias"))


def boosted_hits(spark, sf_dir):
    return R.boosted_top_k(I.vector_questions(spark, sf_dir), I.vector_store(spark, sf_dir))


def boosted_top_6(spark, sf_dir):
    return boosted_hits(spark, sf_dir).select(
        "q_id", "rank", "chunk_id", "section",
        F.round("score", 9).alias("score"), F.round("boosted", 9).alias("boosted"),
    )


def snippet_rows(spark, sf_dir):
    return R.shape_snippets(boosted_hits(spark, sf_dir))


def snippet_lists(spark, sf_dir):
    rows = R.snippets(boosted_hits(spark, sf_dir))
    return rows.select(
        "q_id", F.size("snippets").cast("bigint").alias("n"),
        F.array_join(F.transform("snippets", lambda s: F.concat_ws("|", s["id"], s["title"], s["url"], s["text"])), "\n").alias("listed"),
    )


def snippet_cleaning(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(" "), F.lit(" \n"))
    text = F.replace(text, F.lit("."), F.lit(" http : / / x"))
    return I.documents(spark, sf_dir).select("doc_id", Q.clean_snippet(text).alias("text"))


def _near(spark, sf_dir):
    store = I.vector_store(spark, sf_dir)
    near = top_k(I.vector_questions(spark, sf_dir), store, R.CHAT_K)
    return with_chunks(near, store, "title", "url", "content")


def candidate_rows(spark, sf_dir):
    return R.shape_candidates(_near(spark, sf_dir))


def _reranked(**options):
    def query(spark, sf_dir):
        rows = R.rerank(candidate_rows(spark, sf_dir), I.vector_questions(spark, sf_dir), **options)
        return rows.select("q_id", "rank", "id", "similarity", "rerank_score")
    return query


def length_scorer():
    """A small model for the scorer slot; no score for some messages, by their first letter."""
    import numpy as np

    def predict(messages, contents):
        fails = [bool(m) and ord(m[0]) % 7 == 0 for m in messages]
        scores = [np.nan if f else -abs(len(m) - len(c)) / 8 for f, m, c in zip(fails, messages, contents)]
        return np.array(scores, dtype=np.float64)

    return predict


def model_reranked(spark, sf_dir):
    scorer = pair_scorer(length_scorer)
    text = lambda c: F.coalesce(c, F.lit(""))
    score = lambda m, c: F.nanvl(scorer(text(m), text(c)), F.lit(None).cast("double"))
    return _reranked(scorer=score)(spark, sf_dir)


def chit_chat_gate(spark, sf_dir):
    """Turns as they are, or with a greeting before them that counts, or does not."""
    rows = I.table(spark, sf_dir, "conversations")
    text = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" Good  Morning "), "text"))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("Hey "), "text"))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("Heyday "), "text"))
        .otherwise(F.col("text"))
    )
    return rows.select("conv_id", "turn", Q.chit_chat(text).alias("chit_chat"))


def text_questions(turns):
    asked = turns.where(F.col("role") == "user").select(I.turn_id().alias("q_id"), F.lit("").alias("q"), F.col("text").alias("query"))
    blank = F.struct(F.concat("q_id", F.lit("-blank")).alias("q_id"), F.lit(" ").alias("q"), F.lit(None).cast("string").alias("query"))
    return asked.select(F.explode(F.array(F.struct("q_id", "q", "query"), blank)).alias("r")).select("r.*")


def retrieve_requests(spark, sf_dir):
    """User turns as text questions, and a blank one beside each, over the embedded
    chunks of all documents."""
    chunks = I.embedded_chunks(spark, sf_dir)
    found = retrieve(text_questions(I.table(spark, sf_dir, "conversations")), chunks)
    return found.select("q_id", F.explode_outer("snippets").alias("s")).select(
        "q_id", "s.id", "s.title", "s.section", "s.text", F.round("s.score", 3).alias("score")
    )


QUERIES = {
    "pair_similarity": pair_similarity,
    "knn_top_6": _knn(6),
    "knn_top_12": _knn(12),
    "knn_in_tiles": knn_in_tiles,
    "blank_question_gate": blank_question_gate,
    "experience_intent": experience_intent,
    "boosted_top_6": boosted_top_6,
    "snippet_rows": snippet_rows,
    "snippet_lists": snippet_lists,
    "snippet_cleaning": snippet_cleaning,
    "candidate_rows": candidate_rows,
    "reranked_candidates": _reranked(),
    "model_reranked_candidates": model_reranked,
    "rerank_bypass": _reranked(enabled=False),
    "chit_chat_gate": chit_chat_gate,
    "retrieve_requests": retrieve_requests,
}

SQL_CANDIDATES = f"""
{SCORED},
candidates AS MATERIALIZED (
  SELECT q_id, rank::INT AS rank, chunk_id AS id, title, url, content,
         substr(coalesce(content, ''), 1, 220) AS preview, round(coalesce(similarity, 0), 3) AS similarity
  FROM scored JOIN scored_c USING (chunk_id) WHERE rank <= 8)"""

SQL_OVERLAP_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+')), lambda w: w <> '')"


def sql_reranked(score: str) -> str:
    return f"""
{SQL_CANDIDATES},
pair_scores AS MATERIALIZED (
  SELECT c.*, {score} AS s FROM candidates c JOIN scored_q q ON q.q_id = c.q_id),
ranked AS (
  SELECT *, max((s IS NULL)::INT) OVER (PARTITION BY q_id) = 1 AS failed,
         row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank) AS best
  FROM pair_scores)
SELECT q_id, CASE WHEN failed THEN rank ELSE best END::INT AS rank, id, similarity,
       CASE WHEN NOT failed THEN s END AS rerank_score
FROM ranked WHERE failed OR best <= 4"""


SQL = {
    "pair_similarity": """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1""",
    **{
        name: f"{SCORED} SELECT q_id, rank::INT AS rank, chunk_id, round(similarity, 9) AS similarity FROM scored WHERE rank <= {k}"
        for name, k in (("knn_top_6", 6), ("knn_top_12", 12), ("knn_in_tiles", 6))
    },
    "blank_question_gate": f"""
WITH requests AS (
  SELECT {I.SQL_TURN_ID} AS q_id,
         CASE WHEN role = 'user' THEN ' ' || text || chr(10) ELSE '' END AS q,
         CASE WHEN turn = 1 THEN ' ' || chr(9) WHEN role <> 'user' THEN text END AS query
  FROM conversations)
SELECT q_id, {sql_js_strip("coalesce(nullif(q, ''), nullif(query, ''), '')")} AS question,
       {sql_js_strip("coalesce(nullif(q, ''), nullif(query, ''), '')")} <> '' AS asks
FROM requests""",
    "experience_intent": f"SELECT doc_id, regexp_matches(text, '{SQL_INTENT}') AS bias FROM documents",
    "boosted_top_6": f"""
{SCORED}, {sql_boosted()}
SELECT q_id, rank::INT AS rank, chunk_id, section, round(similarity, 9) AS score, round(raised, 9) AS boosted
FROM boosted""",
    "snippet_rows": f"{SCORED}, {sql_boosted()} SELECT q_id, rank::INT AS rank, {SQL_SNIPPET} FROM boosted WHERE rank <= 5",
    "snippet_lists": f"""
{SCORED}, {sql_boosted()},
snips AS (SELECT q_id, rank, {SQL_SNIPPET} FROM boosted WHERE rank <= 5)
SELECT q_id, count(*) AS n,
       string_agg(concat_ws('|', id, title, url, text), chr(10) ORDER BY rank) AS listed
FROM snips GROUP BY q_id""",
    "snippet_cleaning": f"""
SELECT doc_id, {sql_clean('t')} AS text
FROM (SELECT doc_id, replace(replace(text, ' ', ' ' || chr(10)), '.', ' http : / / x') AS t FROM documents)""",
    "candidate_rows": f"{SQL_CANDIDATES} SELECT * FROM candidates",
    "reranked_candidates": sql_reranked(
        f"len(list_intersect({SQL_OVERLAP_WORDS.format(c='q.message')}, {SQL_OVERLAP_WORDS.format(c='c.content')}))::DOUBLE"),
    "model_reranked_candidates": sql_reranked(
        "CASE WHEN coalesce(q.message, '') = '' OR unicode(q.message) % 7 <> 0 THEN "
        "-abs(length(coalesce(q.message, '')) - length(coalesce(c.content, '')))::DOUBLE / 8 END"),
    "rerank_bypass": f"{SQL_CANDIDATES} SELECT q_id, rank, id, similarity, NULL::DOUBLE AS rerank_score FROM candidates",
    "chit_chat_gate": f"""
SELECT conv_id, turn, {sql_chit_chat('t')} AS chit_chat
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' Good  Morning ' || text
        WHEN 1 THEN 'Hey ' || text WHEN 2 THEN 'Heyday ' || text ELSE text END AS t FROM conversations)""",
    "retrieve_requests": f"""
WITH {sql_chunks(SQL_PLAIN, 600, 50)},
requests AS (
  SELECT {I.SQL_TURN_ID} AS q_id, {sql_js_strip("text")} AS question FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT {I.SQL_TURN_ID} || '-blank', '' FROM conversations WHERE role = 'user'),
{sql_embedding("SELECT content AS text FROM chunked UNION ALL SELECT question FROM requests WHERE question <> ''", 384)},
vec_q AS (SELECT DISTINCT question AS q_id, vec AS qvec, regexp_matches(question, '{SQL_INTENT}') AS bias
          FROM requests JOIN embedded ON question = embedded.text),
vec_c AS (SELECT chunk_id, title, url, content, section, vec AS embedding
          FROM chunked JOIN embedded ON content = embedded.text),
{sql_scores('SELECT * FROM vec_q', 'SELECT * FROM vec_c')}, {sql_boosted()},
snips AS MATERIALIZED (SELECT q_id, {SQL_SNIPPET} FROM boosted WHERE rank <= 5)
SELECT r.q_id, s.id, s.title, s.section, s.text, s.score
FROM requests r LEFT JOIN snips s ON s.q_id = r.question""",
}
