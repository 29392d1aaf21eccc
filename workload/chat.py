"""Requests to answers: log, cache, prompts, answers, and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.functions import text as T
from corpusloom.operators import answers as A
from corpusloom.operators import cache
from corpusloom.operators import retrieval as R
from corpusloom.operators.embedding import answer_generator
from corpusloom.operators.knn import top_k, with_chunks
from corpusloom.plans.chat import chat
from corpusloom.session import new_dir
from corpusloom.sources import chat_log
from corpusloom.streaming.cache import replay_stream
from corpusloom.streaming.chat_log import log_stream
from corpusloom.streaming.retrieve import retrieve_stream
from workload import inputs as I
from workload.ingest import SQL_PLAIN, sql_chunks, sql_embedding, sql_strip, sub
from workload.retrieval import SQL as RETRIEVAL_SQL
from workload.retrieval import (
    JS, SCORED, SQL_CANDIDATES, SQL_OVERLAP_WORDS, SQL_SNIPPET, boosted_hits, sql_boosted,
    sql_js_strip, sql_scores, text_questions,
)

TTL_SECONDS = 48 * 3600
PERSONA = {  # texts are the caller's
    "system": "You answer questions about a document collection.",
    "example": "Example:\nUser: hi\nAssistant: Hello! Ask me about the documents.",
    "instruction": "Answer in a few sentences.",
}

# ---- SQL forms ---------------------------------------------------------------
SQL_NORMAL = sub(f"lower({sql_js_strip('message')})", f"{JS}+", " ")
SQL_KEY = f"'q:' || sha256({SQL_NORMAL})"
SQL_VALID = "coalesce(session_id, '') <> '' AND message IS NOT NULL"
SQL_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
SQL_LOG = f"""
SELECT 'CHAT#' || session_id AS PK, {SQL_ISO} || '#' || request_id AS SK, 'chat' AS type,
       'user' AS role, message, {SQL_ISO} AS createdAt
FROM ({I.SQL_CHAT_REQUESTS}) WHERE {SQL_VALID}"""


def sql_replay(requests: str, name: str = "replayed") -> str:
    """CTEs ending in `name`: `hit` per request, by walking each key's times."""
    micros = TTL_SECONDS * 1_000_000
    return f"""
{name}_in AS MATERIALIZED (SELECT key, ts, request_id, epoch_us(ts) AS t FROM ({requests})),
{name}_chain AS MATERIALIZED (
  SELECT key, list_reduce(list_transform(list_sort(list(DISTINCT t)), lambda y: [y]), lambda a, x:
    CASE WHEN len(a) = 0 OR x[1] >= a[-1] + {micros} THEN list_append(a, x[1]) ELSE a END, []::BIGINT[]) AS misses
  FROM (SELECT key, t FROM {name}_in) GROUP BY key),
{name} AS MATERIALIZED (
  SELECT i.key, i.ts, i.request_id,
         NOT (list_contains(c.misses, t) AND
              row_number() OVER (PARTITION BY i.key, t ORDER BY request_id) = 1) AS hit
  FROM {name}_in i JOIN {name}_chain c ON c.key = i.key)"""


SQL_CLIP = f"""substr({sql_strip("replace(coalesce(content, ''), chr(10), ' ')")}, 1, 750)"""
_HEAD, _REST = A.PROMPT.split("{question}")
_MIDDLE, _TAIL = _REST.split("{contexts}")
SQL_PROMPT = lambda question, contexts: (
    f"'{_HEAD.replace(chr(39), chr(39) * 2)}' || {question} || '{_MIDDLE}' || {contexts} || '{_TAIL}'"
)


def sql_lines(expression: str, limit: int) -> str:
    return f"string_agg({expression}, chr(10) ORDER BY rank) FILTER (WHERE rank <= {limit})"


SQL_CONTEXT_LINE = f"'[' || rank || '] (' || coalesce(title, '') || ') ' || {SQL_CLIP}"
SQL_FALLBACK_LINE = "'[' || rank || '] ' || coalesce(title, '') || ' — ' || preview || '...'"


# ---- queries -----------------------------------------------------------------
def request_validation(spark, sf_dir):
    rows = I.chat_requests(spark, sf_dir)
    return rows.select("request_id", chat_log.valid_request().alias("valid"))


def chat_log_append(spark, sf_dir):
    path = new_dir(spark, "log")
    requests = I.chat_requests(spark, sf_dir)
    chat_log.append(chat_log.log_items(requests, unique=F.col("request_id").cast("string")), path)
    return spark.read.parquet(path)


def question_keys(spark, sf_dir):
    rows = I.chat_requests(spark, sf_dir)
    message = F.col("message")
    return rows.select(
        "request_id", Q.normalize_question(message).alias("normal"), Q.cache_key(message).alias("pk")
    )


def _stored(spark, sf_dir):
    """A cache filled by every valid request, for 12 hours, then by every other one, by
    its first letter, once more, for 48."""
    requests = I.chat_requests(spark, sf_dir).where(chat_log.valid_request())
    rows = requests.select(
        Q.cache_key(F.col("message")).alias("pk"), F.struct(F.col("message").alias("answer")).alias("value"),
        "ts", (F.ascii("message") % 2 == 1).alias("again"),
    )
    short = cache.cache_entries(rows, ttl_hours=12)
    later = rows.where("again").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return cache.put(cache.put(short.where("false"), short), cache.cache_entries(later))


def cache_put(spark, sf_dir):
    return _stored(spark, sf_dir).select("pk", F.col("value.answer").alias("answer"), "ttl")


def cache_lookup(spark, sf_dir):
    """Each request asked again, some hours later."""
    requests = I.chat_requests(spark, sf_dir).where(chat_log.valid_request())
    keyed = requests.select(
        "request_id", Q.cache_key(F.col("message")).alias("pk"),
        F.timestamp_seconds(F.unix_seconds("ts") + F.length("message") * 600).alias("ts"),
    )
    found = cache.lookup(keyed, _stored(spark, sf_dir))
    return found.select("request_id", "cached", F.col("value.answer").alias("answer"))


def cache_replay(spark, sf_dir):
    rows = cache.replay(I.cache_requests(spark, sf_dir))
    return rows.select("request_id", "key", "hit")


def cache_replay_hot_key(spark, sf_dir):
    """All events as requests for one answer."""
    requests = I.cache_requests(spark, sf_dir).withColumn("key", F.lit("all"))
    return cache.replay(requests, ttl_hours=1).select("request_id", "hit")


def _sources(spark, sf_dir):
    store = I.vector_store(spark, sf_dir)
    questions = I.vector_questions(spark, sf_dir)
    near = R.counted(top_k(questions, store, R.CHAT_K))
    hits = with_chunks(near, store, "title", "url", "content")
    best = R.rerank(R.shape_candidates(hits, R.CANDIDATES, "n_found"), questions, enabled=False)
    return A.gather_sources(best).join(questions.select("q_id", "message"), "q_id")


def context_blocks(spark, sf_dir):
    return _sources(spark, sf_dir).select("q_id", A.context_block(F.col("sources")).alias("contexts"))


def prompts(spark, sf_dir):
    question = T.strip(F.coalesce("message", F.lit("")))
    contexts = A.context_block(F.col("sources"), A.CHAT_CONTEXTS)
    return _sources(spark, sf_dir).select("q_id", A.render_prompt(question, contexts).alias("prompt"))


def _snippets(spark, sf_dir):
    """The questions with their snippets, and each once more with none."""
    questions = I.vector_questions(spark, sf_dir)
    found = R.snippets(boosted_hits(spark, sf_dir))
    rows = questions.select(F.col("q_id").cast("string").alias("q_id"), "message").join(
        found.withColumn("q_id", F.col("q_id").cast("string")), "q_id", "left"
    )
    none = F.array().cast(rows.schema["snippets"].dataType)
    bare = F.struct(F.concat("q_id", F.lit("-bare")).alias("q_id"), "message", none.alias("snippets"))
    return rows.select(F.explode(F.array(F.struct("q_id", "message", "snippets"), bare)).alias("r")).select("r.*")


def snippet_blocks(spark, sf_dir):
    return _snippets(spark, sf_dir).select("q_id", A.snippet_block(F.col("snippets")).alias("block"))


def chat_messages(spark, sf_dir):
    messages = A.chat_messages(F.coalesce("message", F.lit("")), F.col("snippets"), **PERSONA)
    rows = _snippets(spark, sf_dir).select("q_id", F.posexplode(messages).alias("pos", "m"))
    return rows.select("q_id", "pos", "m.role", "m.content")


def echoing_generator():
    """A small model for the generator slot: the end of the prompt; fails on every fifth
    prompt, by how often it has an e."""
    import numpy as np

    def predict(prompts):
        return np.array([p[-40:] if p and p.count("e") % 5 else None for p in prompts], dtype=object)

    return predict


def generated_answers(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    question = T.strip(F.coalesce("message", F.lit("")))
    prompt = A.render_prompt(question, A.context_block(F.col("sources"), A.CHAT_CONTEXTS))
    model = answer_generator(echoing_generator, batch_size=8)
    answer = F.when(question != "", model(prompt))
    value = A.answer_value(answer, F.col("n_found"), F.col("sources"))
    return rows.select("q_id", value.alias("v")).select(
        "q_id", "v.answer", F.size("v.sources").alias("n_sources")
    )


def fallback_answers(spark, sf_dir):
    text = A.fallback_answer(F.col("n_found"), F.col("sources"))
    return _sources(spark, sf_dir).select("q_id", text.alias("answer"))


def answer_sources(spark, sf_dir):
    value = A.answer_value(F.lit(None).cast("string"), F.col("n_found"), F.col("sources"))
    rows = _sources(spark, sf_dir).select("q_id", value.alias("v"))
    return rows.select("q_id", F.posexplode("v.sources").alias("pos", "s")).select(
        "q_id", "pos", "s.id", "s.title", "s.similarity"
    )


STORED_UNTIL = 1704110400  # 2024-01-01 12:00, between the two times a question is asked
SOURCES = (
    "array<struct<id: string, title: string, url: string, content: string, preview: string, "
    "similarity: double, rerank_score: double>>"
)


def _chat(spark, sf_dir):
    """Against a cache that holds every other question, by its first letter, for a while."""
    chunks = I.embedded_chunks(spark, sf_dir)
    requests = I.chat_requests(spark, sf_dir)
    known = requests.where(chat_log.valid_request() & (F.ascii("message") % 2 == 1))
    answers = known.groupBy(Q.cache_key(F.col("message")).alias("pk")).agg(F.min("message").alias("message"))
    value = F.struct(F.concat(F.lit("stored "), "message").alias("answer"), F.array().cast(SOURCES).alias("sources"))
    stored = answers.select(
        "pk", value.alias("value"), F.lit(STORED_UNTIL).cast("bigint").alias("ttl"), F.timestamp_seconds(F.lit(0)).alias("createdAt"),
    )
    unique = F.col("request_id").cast("string")
    generator = answer_generator(echoing_generator, batch_size=8)
    return chat(requests, chunks, stored, use_rerank=True, generator=generator, unique=unique)


def chat_responses(spark, sf_dir):
    rows = _chat(spark, sf_dir).responses
    ids = F.array_join(F.transform("sources", lambda s: s["id"]), ",")
    return rows.select("request_id", "outcome", "cached", "answer", ids.alias("source_ids"))


def chat_cache_entries(spark, sf_dir):
    rows = _chat(spark, sf_dir).entries
    return rows.select("pk", "ttl", F.length("value.answer").alias("n_chars"))


def _stream(spark, sf_dir, name):
    """A table as a stream, be it a file or a folder of files. A stream's path has to be a
    folder or a pattern: this one fits the table's name only."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def chat_log_stream(spark, sf_dir):
    """User turns as a stream into the log."""
    rows = _stream(spark, sf_dir, "conversations")
    requests = rows.select(
        I.turn_id().alias("request_id"),
        F.when(F.col("role") == "user", F.col("conv_id").cast("string")).alias("session_id"),
        F.col("text").alias("message"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
    )
    path, state = new_dir(spark, "log"), new_dir(spark, "state")
    log_stream(requests, path, state, unique=F.col("request_id").cast("string")).awaitTermination()
    return spark.read.parquet(path)


STREAM_PARTS = 4


def cache_stream(spark, sf_dir):
    """Events as a stream of requests, against expiry times kept as keyed state. They
    come in several micro-batches, a week each, so that later ones meet the state
    that the earlier ones left."""
    events, source = I.table(spark, sf_dir, "events"), new_dir(spark, "events")
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(STREAM_PARTS - 1))
    for part in range(STREAM_PARTS):  # a file each, one after the other
        events.where(week == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = stream.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
    )
    path, state = new_dir(spark, "replay"), new_dir(spark, "state")
    (
        replay_stream(rows).writeStream.format("parquet").option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    )
    return spark.read.parquet(path).select("request_id", "key", "hit")


def retrieve_stream_rows(spark, sf_dir):
    """User turns as a stream of questions over the embedded chunks of all documents."""
    chunks = I.embedded_chunks(spark, sf_dir)
    requests = text_questions(_stream(spark, sf_dir, "conversations"))
    path, state = new_dir(spark, "snippets"), new_dir(spark, "state")
    retrieve_stream(requests, chunks, path, state).awaitTermination()
    found = spark.read.parquet(path)
    return found.select("q_id", F.explode_outer("snippets").alias("s")).select(
        "q_id", "s.id", "s.title", "s.section", "s.text", "s.score"
    )


QUERIES = {
    "request_validation": request_validation,
    "chat_log_append": chat_log_append,
    "question_keys": question_keys,
    "cache_put": cache_put,
    "cache_lookup": cache_lookup,
    "cache_replay": cache_replay,
    "cache_replay_hot_key": cache_replay_hot_key,
    "context_blocks": context_blocks,
    "prompts": prompts,
    "snippet_blocks": snippet_blocks,
    "chat_messages": chat_messages,
    "generated_answers": generated_answers,
    "fallback_answers": fallback_answers,
    "answer_sources": answer_sources,
    "chat_responses": chat_responses,
    "chat_cache_entries": chat_cache_entries,
    "chat_log_stream": chat_log_stream,
    "cache_stream": cache_stream,
    "retrieve_stream": retrieve_stream_rows,
}

SQL_ENTRIES = f"""
WITH requests AS (SELECT *, {SQL_KEY} AS pk FROM ({I.SQL_CHAT_REQUESTS}) WHERE {SQL_VALID}),
writes AS (
  SELECT pk, message AS answer, ts, epoch_us(ts) // 1000000 + 43200 AS ttl, 0 AS turn FROM requests
  UNION ALL
  SELECT pk, message, ts, epoch_us(ts) // 1000000 + 1 + {TTL_SECONDS}, 1
  FROM requests WHERE message <> '' AND unicode(message) % 2 = 1),
stored AS MATERIALIZED (
  SELECT pk, answer, ttl FROM writes
  QUALIFY row_number() OVER (PARTITION BY pk ORDER BY turn DESC, ts DESC) = 1)"""

SQL_GENERATES = "(length({p}) - length(replace({p}, 'e', ''))) % 5 <> 0"

SQL_SOURCES = f"""
{SQL_CANDIDATES},
contexts AS MATERIALIZED (
  SELECT q_id, {sql_lines(SQL_CONTEXT_LINE, 6)} AS six, {sql_lines(SQL_CONTEXT_LINE, 4)} AS four,
         'Found 12 relevant snippets (generator fallback).' || chr(10) || {sql_lines(SQL_FALLBACK_LINE, 8)} AS fallback
  FROM candidates GROUP BY q_id),
asked AS MATERIALIZED (SELECT q_id, {sql_strip("coalesce(message, '')")} AS question FROM scored_q),
prompted AS MATERIALIZED (
  SELECT q_id, question, fallback, {SQL_PROMPT('question', 'four')} AS prompt FROM contexts JOIN asked USING (q_id))"""

SQL_BLOCKS = f"""
{SCORED}, {sql_boosted()},
snips AS (SELECT q_id, rank, {SQL_SNIPPET} FROM boosted WHERE rank <= 5),
blocks AS MATERIALIZED (
  SELECT q_id, string_agg('[' || id || '] ' || title || ' — ' || text, chr(10) ORDER BY rank) AS lines
  FROM snips GROUP BY q_id),
parts AS MATERIALIZED (
  SELECT q_id::VARCHAR AS q_id, coalesce(message, '') AS message, '{A.CONTEXT_HEADER}' || chr(10) || lines AS block
  FROM scored_q LEFT JOIN blocks USING (q_id)
  UNION ALL
  SELECT q_id || '-bare', coalesce(message, ''), '' FROM scored_q)"""

SQL_CHAT = f"""
WITH {sql_chunks(SQL_PLAIN, 600, 50)},
requests AS MATERIALIZED (
  SELECT *, {SQL_KEY} AS pk, {SQL_VALID} AS valid FROM ({I.SQL_CHAT_REQUESTS})),
stored AS MATERIALIZED (
  SELECT pk, 'stored ' || min(message) AS stored FROM requests
  WHERE valid AND message <> '' AND unicode(message) % 2 = 1 GROUP BY pk),
looked AS MATERIALIZED (
  SELECT r.*, CASE WHEN {STORED_UNTIL} > epoch_us(ts) / 1000000 THEN stored END AS stored
  FROM requests r LEFT JOIN stored s ON valid AND r.pk = s.pk),
earliest AS MATERIALIZED (
  SELECT pk AS q_id, arg_min(message, (ts, request_id)) AS message
  FROM looked WHERE valid AND message <> '' AND stored IS NULL GROUP BY pk),
{sql_embedding("SELECT content AS text FROM chunked UNION ALL SELECT message FROM earliest", 384)},
vec_q AS (SELECT q_id, message, vec AS qvec FROM earliest JOIN embedded ON message = embedded.text),
vec_c AS (SELECT chunk_id, title, url, content, section, vec AS embedding
          FROM chunked JOIN embedded ON content = embedded.text),
{sql_scores('SELECT * FROM vec_q', 'SELECT * FROM vec_c')},
candidates AS MATERIALIZED (
  SELECT s.q_id, s.rank, chunk_id AS id, title, content, substr(coalesce(content, ''), 1, 220) AS preview,
         len(list_intersect({SQL_OVERLAP_WORDS.format(c='q.message')}, {SQL_OVERLAP_WORDS.format(c='c.content')})) AS score
  FROM scored s JOIN scored_c c USING (chunk_id) JOIN scored_q q ON q.q_id = s.q_id WHERE s.rank <= 8),
best AS MATERIALIZED (
  SELECT q_id, id, title, content, preview, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, candidates.rank) AS rank
  FROM candidates),
shown AS MATERIALIZED (
  SELECT q_id, 'Found 12 relevant snippets (generator fallback).' || chr(10) || {sql_lines(SQL_FALLBACK_LINE, 4)} AS fallback,
         {sql_lines(SQL_CONTEXT_LINE, 4)} AS four, string_agg(id, ',' ORDER BY rank) FILTER (WHERE rank <= 4) AS source_ids
  FROM best GROUP BY q_id),
prompted AS MATERIALIZED (
  SELECT q_id, question, fallback, source_ids, {SQL_PROMPT('question', 'four')} AS prompt
  FROM (SELECT *, {sql_strip("message")} AS question FROM shown JOIN earliest USING (q_id))),
answers AS MATERIALIZED (
  SELECT q_id AS pk, source_ids,
         CASE WHEN question <> '' AND {SQL_GENERATES.format(p='prompt')} THEN right(prompt, 40) ELSE fallback END AS answer
  FROM prompted),
{sql_replay("SELECT pk AS key, ts, request_id FROM looked WHERE valid AND message <> '' AND stored IS NULL")}"""

SQL = {
    "request_validation": f"SELECT request_id, ({SQL_VALID}) AS valid FROM ({I.SQL_CHAT_REQUESTS})",
    "chat_log_append": SQL_LOG,
    "question_keys": f"SELECT request_id, {SQL_NORMAL} AS normal, {SQL_KEY} AS pk FROM ({I.SQL_CHAT_REQUESTS})",
    "cache_put": f"{SQL_ENTRIES} SELECT * FROM stored",
    "cache_lookup": f"""{SQL_ENTRIES}
SELECT r.request_id, coalesce(ttl > epoch_us(ts) // 1000000 + length(message) * 600, false) AS cached,
       CASE WHEN ttl > epoch_us(ts) // 1000000 + length(message) * 600 THEN answer END AS answer
FROM requests r LEFT JOIN stored s ON s.pk = r.pk""",
    "cache_replay": f"WITH {sql_replay(I.SQL_CACHE_REQUESTS)} SELECT request_id, key, hit FROM replayed",
    "cache_replay_hot_key": f"""
WITH {sql_replay("SELECT 'all' AS key, ts, request_id FROM (" + I.SQL_CACHE_REQUESTS + ")").replace(str(TTL_SECONDS * 1_000_000), str(3_600_000_000))}
SELECT request_id, hit FROM replayed""",
    "context_blocks": f"{SQL_SOURCES} SELECT q_id, six AS contexts FROM contexts",
    "prompts": f"{SQL_SOURCES} SELECT q_id, prompt FROM prompted",
    "snippet_blocks": f"{SQL_BLOCKS} SELECT q_id, block FROM parts",
    "chat_messages": f"""
{SQL_BLOCKS},
messages AS (
  SELECT q_id, unnest([
    {{'o': 0, 'role': 'system', 'content': '{PERSONA['system']}'}},
    {{'o': 1, 'role': 'assistant', 'content': '{PERSONA['example']}'}},
    {{'o': 2, 'role': 'assistant', 'content': block}},
    {{'o': 3, 'role': 'user', 'content': message || chr(10) || '{PERSONA['instruction']}'}}]) AS m FROM parts)
SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY m.o) - 1)::INT AS pos,
       m.role AS role, m.content AS content
FROM messages WHERE m.content <> ''""",
    "generated_answers": f"""
{SQL_SOURCES}
SELECT q_id, CASE WHEN question <> '' AND {SQL_GENERATES.format(p='prompt')} THEN right(prompt, 40) ELSE fallback END AS answer,
       6 AS n_sources FROM prompted""",
    "fallback_answers": f"{SQL_SOURCES} SELECT q_id, fallback AS answer FROM contexts",
    "answer_sources": f"{SQL_CANDIDATES} SELECT q_id, (rank - 1)::INT AS pos, id, title, similarity FROM candidates WHERE rank <= 6",
    "chat_responses": f"""
{SQL_CHAT}
SELECT r.request_id,
       CASE WHEN NOT valid THEN 'invalid' WHEN stored IS NOT NULL THEN 'cache_hit' WHEN message = '' THEN 'embed_rejected'
            WHEN hit THEN 'cache_hit' ELSE 'computed' END AS outcome,
       coalesce(hit, stored IS NOT NULL) AS cached, coalesce(stored, answer) AS answer,
       CASE WHEN stored IS NOT NULL THEN '' ELSE source_ids END AS source_ids
FROM looked r LEFT JOIN replayed p ON p.request_id = r.request_id
LEFT JOIN answers a ON p.request_id IS NOT NULL AND a.pk = r.pk""",
    "chat_cache_entries": f"""
{SQL_CHAT}
SELECT key AS pk, epoch_us(max(ts)) // 1000000 + {TTL_SECONDS} AS ttl, max(length(answer))::INT AS n_chars
FROM replayed JOIN answers ON pk = key WHERE NOT hit GROUP BY key""",
    "chat_log_stream": f"""
SELECT 'CHAT#' || session_id AS PK, {SQL_ISO} || '#' || request_id AS SK, 'chat' AS type,
       'user' AS role, message, {SQL_ISO} AS createdAt
FROM (SELECT {I.SQL_TURN_ID} AS request_id, conv_id::VARCHAR AS session_id, text AS message,
        TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 100 + turn) AS ts
      FROM conversations WHERE role = 'user')""",
    "retrieve_stream": RETRIEVAL_SQL["retrieve_requests"],
    "cache_stream": f"WITH {sql_replay(I.SQL_CACHE_REQUESTS)} SELECT request_id, key, hit FROM replayed",
}
