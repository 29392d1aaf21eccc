"""The registered queries over whole tables, each with SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    compression, exact_dedup, mixing, packing, preferences, quality, sharding, simhash, sketches, toxicity, urls, warc, whitening,
)

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document that its path ends with is of low quality or toxic."""
    document = F.regexp_extract("url", r"://[^?#]*?([0-9]+)[^/?#0-9]*/?([?#].*)?$", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", document.alias("shown"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("shown")).agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"),
    )
    return urls.judged(pages.join(labels, "shown", "left"), RULES)


_NEXT = "segments[depth + 2]"
_SQL_SHAPE = (
    f"CASE WHEN {_NEXT} IS NULL THEN 'leaf' WHEN regexp_matches({_NEXT}, '{urls.VARIABLE}') THEN 'varies'"
    f" WHEN contains({_NEXT}, '.') THEN 'page' ELSE 'other' END"
)
_SQL_COUNTED = {"pages": "true", "bad": "bad = 1", "good": "bad = 0", **{s: f"shape = '{s}'" for s in urls.SHAPES}}
_SQL_COUNTS = ", ".join(
    f"count(*) FILTER ({what}) OVER (PARTITION BY host, template{of}) AS {all_}{name}"
    for all_, of in (("", ", segment"), ("all_", "")) for name, what in _SQL_COUNTED.items()
).replace(" AS bad", " AS bads").replace(" AS good", " AS goods")
_SQL_LABEL_TEST = re.sub(r"\b(bad|good)\b", r"\1s", urls.LABEL_TEST)


def _sql_rule(value: int) -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} END"


SQL_URLS = rf"""
WITH RECURSIVE bads AS (
  SELECT doc_id AS shown, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*).*$', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*).*$', 2) AS path,
         try_cast(regexp_extract(url, '://[^?#]*?([0-9]+)[^/?#0-9]*/?([?#].*)?$', 1) AS BIGINT) AS shown
  FROM pages),
listed AS (
  SELECT page_id, host, path, bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS found
  FROM cut LEFT JOIN bads USING (shown)),
levels AS (
  SELECT page_id, host, path, bad, found AS segments, 0 AS depth, '' AS template FROM listed
  UNION ALL
  SELECT page_id, host, path, bad, segments, depth + 1,
         template || '/' ||
         CASE WHEN regexp_matches(segment, '{urls.VARIABLE}') OR segment IN ('*', '**') OR pages < {urls.LEAST_PAGES} THEN '*'
              WHEN {_SQL_LABEL_TEST} < {urls.LABEL_LIMIT}
                AND (CASE WHEN pages = all_pages THEN false ELSE {urls.SHAPE_TEST} < {urls.SHAPE_LIMIT} END) THEN '*'
              ELSE segment END
  FROM (SELECT *, {_SQL_COUNTS}
        FROM (SELECT *, segments[depth + 1] AS segment, {_SQL_SHAPE} AS shape FROM levels WHERE depth < len(segments)))),
named AS (SELECT page_id, host, path, bad, host || template AS template FROM levels WHERE depth = len(segments)),
counted AS (
  SELECT template, count(*) FILTER (bad = 1) AS bads, count(*) FILTER (bad = 0) AS goods FROM named GROUP BY template),
shares AS (
  SELECT template, (bads + {urls.SMOOTHING}::DOUBLE * ((sum(bads) OVER ())::DOUBLE / greatest(1, sum(bads) OVER () + sum(goods) OVER ())))
         / (bads + goods + {urls.SMOOTHING}) AS purity
  FROM counted)
SELECT page_id, host, path, {_sql_rule(0)} AS rule,
       coalesce({_sql_rule(1)}, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 6) AS purity
FROM named JOIN shares USING (template)"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(table(spark, sf_dir, "documents"), SHARDS, seed=2024)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(documents, model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.thresholds(model)).alias("rejected"),
    )


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen over a worse one: by its number, the last answer turned
    round, the first answer turned round and nothing after it, or no last answer."""
    turns = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    answers = turns.groupBy(F.col("conv_id").alias("of")).agg(F.min(answer).alias("first"), F.max(answer).alias("last"))
    met = turns.join(answers, F.col("conv_id") == F.col("of"))
    kind = F.col("conv_id") % 3
    at = F.when(kind == 1, F.col("first")).otherwise(F.col("last"))
    gone = ((kind == 1) & (F.col("turn") > at)) | ((kind == 2) & (F.col("turn") == at))
    worse = met.where(~F.coalesce(gone, F.lit(False))).withColumn(
        "text", F.when(F.col("turn") == at, F.reverse("text")).otherwise(F.col("text"))
    )
    sides = [rows.select(F.col("conv_id").alias("pair_id"), F.lit(side).alias("side"), "turn", "role", "text")
             for rows, side in ((turns, "chosen"), (worse, "rejected"))]
    return preferences.formatted(sides[0].unionByName(sides[1]))


SQL_PREFERENCES = """
WITH answers AS (
  SELECT conv_id, min(turn) FILTER (role = 'assistant') AS first, max(turn) FILTER (role = 'assistant') AS last
  FROM conversations GROUP BY conv_id),
met AS (SELECT *, CASE WHEN conv_id % 3 = 1 THEN first ELSE last END AS cut FROM conversations JOIN answers USING (conv_id)),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, 'rejected', turn, role, CASE WHEN turn = cut THEN reverse(text) ELSE text END FROM met
  WHERE NOT coalesce((conv_id % 3 = 1 AND turn > cut) OR (conv_id % 3 = 2 AND turn = cut), false)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS number FROM sides),
heads AS (
  SELECT pair_id, coalesce(min(number) FILTER (differs), max(number) + 1)::INT AS common
  FROM (SELECT pair_id, number, count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text) AS differs
        FROM numbered GROUP BY pair_id, number)
  GROUP BY pair_id),
pieces AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS header, header || text || '<|end|>' || chr(10) AS piece, number < common AS ahead
  FROM numbered JOIN heads USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN ahead THEN 0 ELSE length(piece) END) OVER (
           PARTITION BY pair_id, side ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM pieces),
spans AS (
  SELECT *, CASE WHEN NOT ahead AND role = 'assistant' THEN (start + length(header)) || '-' || (start + length(piece) - 1) END AS span
  FROM placed)
SELECT pair_id, any_value(common) AS prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY number) FILTER (ahead AND side = 'chosen'), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY number) FILTER (NOT ahead AND side = 'chosen'), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY number) FILTER (NOT ahead AND side = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY number) FILTER (side = 'chosen'), '') AS chosen_spans,
       coalesce(string_agg(span, ',' ORDER BY number) FILTER (side = 'rejected'), '') AS rejected_spans
FROM spans GROUP BY pair_id"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.round(F.element_at(F.filter("positions", lambda p: p.isNotNull()), 1), 9)
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("copies") > 0, first).alias("first_position"),
    )


def _sql_position() -> str:
    cases = []
    for number, knots in enumerate(mixing.SCHEDULES):
        out = "0.0::DOUBLE"
        for start, weight, slope, before in mixing.integrated(knots):
            more = f"(share - {before!r}::DOUBLE)"
            time = f"{start!r}::DOUBLE + 2 * {more} / ({weight!r}::DOUBLE + sqrt({weight * weight!r}::DOUBLE + {2 * slope!r}::DOUBLE * {more}))"
            out = f"CASE WHEN {more} > 0 THEN {time} ELSE {out} END"
        cases.append(f"WHEN {number} THEN {out}")
    return f"least(CASE turn {' '.join(cases)} END, 1.0)"


SQL_MIXING = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || '/mix/' || md5(coalesce(text, ''))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         row_number() OVER (PARTITION BY source ORDER BY key, size) AS place
  FROM sized),
weighted AS (
  SELECT *, CASE turn {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))} END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS turn
        FROM sized GROUP BY source)),
filled AS (
  SELECT *, {mixing.SHARE} * sum(source_size) OVER () AS total,
         coalesce(sum({mixing.MOST} * source_size) OVER (ORDER BY {mixing.MOST} * source_size / weight, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY {mixing.MOST} * source_size / weight DESC, source DESC ROWS UNBOUNDED PRECEDING) AS free
  FROM weighted),
levels AS (
  SELECT arg_min((total - capped)::DOUBLE / free, -free) AS level FROM filled
  WHERE NOT weight * ((total - capped)::DOUBLE / free) > {mixing.MOST} * source_size),
aimed AS (
  SELECT source, source_size, turn, least(coalesce(weight * level, 'infinity'), ({mixing.MOST} * source_size)::DOUBLE) AS target
  FROM weighted, levels),
rounds AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM aimed),
rests AS (SELECT *, target - rounds * source_size AS rest FROM rounds),
joined AS (
  SELECT p.*, source_size, turn, target, rounds, rest,
         coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY p.source), 0) AS done
  FROM placed p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source),
fitted AS (
  SELECT source, done AS before, rest - done AS missing, 0 AS place, 0::BIGINT AS size FROM joined GROUP BY source, done, rest
  UNION ALL
  SELECT f.source, any_value(f.before + f.size), any_value(f.missing - f.size), min(j.place), arg_min(j.size, j.place)
  FROM fitted f JOIN joined j ON j.source IS NOT DISTINCT FROM f.source
  WHERE j.place > f.place AND j.upto > j.rest AND j.size > 0 AND j.size <= f.missing - f.size GROUP BY f.source),
ends AS (
  SELECT source, max(before + size) AS done, min(missing - size) AS missing FROM fitted GROUP BY source),
tried AS (
  SELECT j.* EXCLUDE (done), e.done, e.missing, f.before AS late
  FROM joined j JOIN ends e ON j.source IS NOT DISTINCT FROM e.source
  LEFT JOIN fitted f ON j.source IS NOT DISTINCT FROM f.source AND j.place = f.place),
extras AS (
  SELECT source, min(struct_pack(o := abs(size - missing), k := key, p := place, s := size)) AS extra
  FROM tried WHERE upto > rest AND late IS NULL AND abs(size - missing) < missing GROUP BY source),
chosen AS (
  SELECT t.*, extra, coalesce(extra.p = place, false) AS is_extra
  FROM tried t LEFT JOIN extras e ON t.source IS NOT DISTINCT FROM e.source),
copied AS (
  SELECT *, least(rounds + (upto <= rest OR is_extra OR late IS NOT NULL)::BIGINT, {mixing.MOST}) AS copies,
         ((CASE WHEN rounds = 0 AND is_extra THEN done WHEN rounds = 0 AND late IS NOT NULL THEN late ELSE upto - size END) + size / 2)
         / greatest(rounds * source_size + done + coalesce(extra.s, 0), 1) AS share
  FROM chosen)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round({_sql_position()}, 9) END AS first_position
FROM copied"""

#: Grades from the two labels: 0 low quality and toxic, 1 low quality, 2 toxic, 3 neither.
GRADES, LEAST_GRADE = 4, 2


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = 2 * F.col("quality") + 1 - F.col("toxic")
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    model = quality.train(documents, ratings, GRADES)
    return quality.graded(documents, model, LEAST_GRADE).select(
        "doc_id", quality.held_out().alias("held_out"), "expected_grade", "tail_probability", "kept",
    )


WINDOW_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """The public vocabulary the packing query is told to use."""
    import public_tokenizers

    return public_tokenizers.path(WINDOW_TOKENIZER)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False, block_bytes=8 << 20, cached_parts=400_000,
    )


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256",
    )


SQL_EXACT_DEDUP = r"""
WITH sized AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
placed AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM sized)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM placed"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"), width=3).select(
        "doc_id", "fingerprint", "component_id",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.report(table(spark, sf_dir, "embeddings"), components=8)
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
    )


SQL_WARC = """
WITH paid AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, unhex(sha1(encode(coalesce(html, ''))))::BIT::VARCHAR AS bits FROM pages),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS first
  FROM paid)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '')
         AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to
FROM placed"""


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compressed(table(spark, sf_dir, "embeddings"))


def _sql_round(number: int, last: bool) -> str:
    """The nearest entries of all parts, and the entries after that."""
    near = f"""
near{number} AS MATERIALIZED (
  SELECT vec_id, label, p, v, min(struct_pack(d := far, e := entry)) AS best
  FROM (SELECT c.*, entry, list_inner_product(c.v, c.v) - 2 * list_inner_product(c.v, b.w) + list_inner_product(b.w, b.w) AS far
        FROM cut c JOIN book{number} b USING (p))
  GROUP BY ALL)"""
    if last:
        return near
    return near + f""",
sums{number} AS (
  SELECT p, entry, list(mean ORDER BY i) AS w
  FROM (SELECT p, best.e AS entry, i, floor(sum(v[i]) / count(*)) AS mean
        FROM near{number}, range(1, (SELECT max(len(v)) FROM cut) + 1) r(i) GROUP BY ALL)
  GROUP BY ALL),
book{number + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(s.w, b.w) AS w FROM book{number} b LEFT JOIN sums{number} s USING (p, entry)),"""


SQL_COMPRESSION = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, label, p::INT AS p, x[p * len(x) // {compression.PARTS} + 1 : (p + 1) * len(x) // {compression.PARTS}] AS v
  FROM whole, range({compression.PARTS}) r(p)),
book0 AS MATERIALIZED (
  SELECT p, (place - 1)::INT AS entry, v AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS place FROM cut) WHERE place <= {compression.ENTRIES}),
{"".join(_sql_round(k, k == compression.ROUNDS) for k in range(compression.ROUNDS + 1))},
hashed AS (
  SELECT sha256(string_agg(array_to_string(list_transform(w, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY p, entry)) AS codebooks_sha256
  FROM book{compression.ROUNDS}),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
  FROM near{compression.ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded, hashed"""


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_preferences": op2_preferences,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_sketches": op6_sketches,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_urls": op9_urls,
    "op10_sharding": op10_sharding,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_compression": op13_compression,
}
SQL: dict[str, str] = {
    "op2_preferences": SQL_PREFERENCES,
    "op3_mixing": SQL_MIXING,
    "op7_exact_dedup": SQL_EXACT_DEDUP,
    "op9_urls": SQL_URLS,
    "op12_warc": SQL_WARC,
    "op13_compression": SQL_COMPRESSION,
}
