"""Document preparation, chunk files, chunk store and embedding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import chunking, embedding, extract
from corpusloom.plans import ingest
from corpusloom.session import new_dir
from corpusloom.sources import chunk_files, chunk_store
from corpusloom.sources import documents as D
from workload import inputs as I

# ---- SQL forms of the text rules (no lookaround in that dialect) -------------
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sub(c: str, pattern: str, text: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({c}, '{quoted}', '{text}', 'g')"


def sql_strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$", "")


def sql_tidy(c: str) -> str:
    return sql_strip(sub(sub(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def sql_hyphens(c: str) -> str:
    return sub(f"replace({c}, chr(173), '')", rf"-{WS}*\n{WS}*", "-")


def sql_bullets(c: str) -> str:
    return sub(c, "[•●▪◦‣]", "- ")


def sql_blanks(c: str) -> str:
    return sub(sub(f"replace({c}, chr(13), '')", r"[ \t]+", " "), r"\n{3,}", "\n\n")


def sql_glued(c: str) -> str:
    # A digit can stand in two pairs; each pattern is run twice, as a match takes
    # both characters.
    for left, right in (("[a-z]", "[A-Z]"), ("[0-9]", "[A-Za-z]"), ("[A-Za-z]", "[0-9]")):
        for _ in range(2):
            c = sub(c, f"({left})({right})", r"\1 \2")
    return c


def sql_punctuation(c: str) -> str:
    c = sub(c, rf"{WS}+([,.;:!?])", r"\1")
    return sub(c, r"([,.;:!?])([A-Za-z])", r"\1 \2")


def sql_collapse(c: str) -> str:
    return sql_strip(sub(c, f"{WS}+", " "))


def sql_normalize(c: str) -> str:
    return sql_collapse(sql_punctuation(sql_glued(sql_blanks(sql_bullets(sql_hyphens(sql_tidy(c)))))))


def sql_sentences(c: str) -> str:
    marked = sub("line", rf"([.!?]){WS}+([A-Z(\"'])", r"\1' || chr(1) || '\2")
    for _ in range(1):
        marked = sub(marked, rf"([.!?]){WS}+([A-Z(\"'])", r"\1' || chr(1) || '\2")
    lines = f"list_transform(string_split({c}, chr(10)), lambda line: string_split({marked.replace('line', sql_strip('line'))}, chr(1)))"
    return f"list_filter(flatten({lines}), lambda s: s <> '')"


TOKENS = "greatest(1, length({s}) // 4)"


def sql_pack(sentences: str, max_tokens: int, overlap: int) -> str:
    items = f"list_transform({sentences}, lambda s: {{'s': s, 't': {TOKENS.format(s='s')}}})"
    none = "[]::STRUCT(s VARCHAR, t BIGINT)[]"
    joined = "array_to_string(list_transform(a.cur, lambda y: y.s), ' ')"
    seed = (
        "list_filter(a.cur, lambda y, i: "
        f"list_sum(list_transform(a.cur[i:], lambda z: z.t)) <= {overlap})"
    )
    total = "coalesce(list_sum(list_transform({l}, lambda z: z.t)), 0)"
    open_total = total.format(l="a.cur")
    step = (
        f"CASE WHEN len(a.cur) > 0 AND {open_total} + x.t > {max_tokens} "
        f"THEN {{'cur': list_append({seed}, x), 'done': list_append(a.done, {joined})}} "
        f"ELSE {{'cur': list_append(a.cur, x), 'done': a.done}} END"
    )
    # The items are wrapped so that they have the type of the state.
    fold = (
        f"list_reduce(list_transform({items}, lambda s: {{'cur': [s], 'done': []::VARCHAR[]}}), "
        f"lambda a, w: {step.replace('x.t', 'w.cur[1].t').replace(', x)', ', w.cur[1])')}, "
        f"{{'cur': {none}, 'done': []::VARCHAR[]}})"
    )
    last = joined.replace("a.cur", "f.cur")
    return (
        f"list_extract(list_transform([{fold}], lambda f: "
        f"CASE WHEN len(f.cur) > 0 THEN list_append(f.done, {last}) ELSE f.done END), 1)"
    )


SQL_DOC_TYPE = """CASE
  WHEN contains(lower(key), 'resume') OR contains(lower(key), 'cv') THEN 'resume'
  WHEN contains(lower(key), 'project') OR contains(lower(key), 'portfolio') THEN 'projects'
  WHEN contains(lower(key), 'bio') OR contains(lower(key), 'about') THEN 'bio'
  WHEN contains(lower(key), 'faq') OR contains(lower(key), 'qna') THEN 'faq'
  ELSE 'doc' END"""
SQL_TITLE = (
    "array_to_string(list_transform(regexp_extract_all("
    r"replace(regexp_replace(regexp_extract(key, '[^/]*$'), '\.[^.]*$', ''), '-', ' '), "
    "'[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
)
SQL_CHUNK_ID = (
    "substr(sha256(key || '::' || chunk_index), 1, 16) || '-' || "
    "CASE WHEN chunk_index < 10000 THEN lpad(chunk_index::VARCHAR, 4, '0') ELSE chunk_index::VARCHAR END"
)


def sql_chunks(documents: str, max_tokens: int, overlap: int, base_url: str = "", name: str = "chunked") -> str:
    """CTEs ending in `name`: documents `key, text` (plain) to chunk rows."""
    url = f"'{base_url}/' || regexp_extract(key, '[^/]*$')" if base_url else "NULL::VARCHAR"
    return f"""
{name}_norm AS MATERIALIZED (SELECT key, {sql_normalize('text')} AS text FROM ({documents})),
{name}_sents AS MATERIALIZED (SELECT key, {sql_sentences('text')} AS sentences FROM {name}_norm),
{name}_packed AS MATERIALIZED (
  SELECT key, {sql_pack('sentences', max_tokens, overlap)} AS chunks FROM {name}_sents),
{name}_rows AS MATERIALIZED (
  SELECT key, unnest(chunks) AS content, unnest(range(len(chunks))) AS chunk_index,
         len(chunks) AS n_chunks FROM {name}_packed),
{name} AS (
  SELECT key AS src_key, {SQL_TITLE} AS title, {url} AS url, {SQL_CHUNK_ID} AS chunk_id,
         content, {SQL_DOC_TYPE} AS section, chunk_index::INT AS chunk_index,
         n_chunks::INT AS n_chunks
  FROM {name}_rows)"""


SQL_CHUNK_COLUMNS = "src_key, title, url, chunk_id, content, section, chunk_index, n_chunks"
SQL_PLAIN = f"SELECT key, text FROM ({I.SQL_DOCUMENTS})"


def flat(chunks):
    return chunks.select(
        F.col("metadata.src_key").alias("src_key"), "title", "url", "chunk_id", "content",
        "section", F.col("metadata.chunk_index").alias("chunk_index"),
        F.col("metadata.n_chunks").alias("n_chunks"),
    )


# ---- SQL form of a page's text -----------------------------------------------
def sql_html(c: str) -> str:
    border = "chr(1)"
    for pattern in (
        r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->",
        r"(?s)<![^>]*>", r"(?s)</?[a-zA-Z][^>]*>",
    ):
        c = f"regexp_replace({c}, '{pattern}', {border}, 'g')"
    nodes = f"list_filter(string_split({c}, chr(1)), lambda n: n <> '')"
    decoded = "n"
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        decoded = f"replace({decoded}, '&{entity};', '{char}')"
        decoded = sub(decoded, f"&{entity}([^-.a-zA-Z0-9]|$)", rf"{char}\1")
    blank = r"CASE WHEN regexp_full_match(n, '[ \t\n\f\r]*') THEN CASE WHEN contains(n, chr(10)) THEN chr(10) ELSE ' ' END ELSE n END"
    return (
        f"array_to_string(list_transform(list_transform({nodes}, lambda n: {decoded}), "
        f"lambda n: {blank}), chr(10))"
    )


def sql_markdown(c: str) -> str:
    nl = "' || chr(10) || '"
    c = sub(c, r"(?m)^[ ]{0,3}(```+|~~~+)[ \t]*", "")
    c = sub(c, r"(?m)^[ ]{0,3}(#{1,6})[ \t]+", "")
    c = sub(c, r"(?m)[ \t]+#+[ \t]*$", "")
    c = sub(c, r"(?m)^[ ]{0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$", "")
    c = sub(c, r"(?m)^[ ]{0,3}(>[ ]?)+", "")
    c = sub(c, r"(?m)^[ \t]*([*+-]|[0-9]{1,9}\.)[ \t]+", "")
    c = sub(c, r"!\[[^\]\n]*\]\([^)\n]*\)", nl)
    c = sub(c, r"\[([^\]\n]+)\]\([^)\n]*\)", rf"{nl}\1{nl}")
    c = sub(c, r"`([^`\n]+)`", rf"{nl}\1{nl}")
    c = sub(c, r"\*\*([^\s*](?:[^*\n]*[^\s*])?)\*\*", rf"{nl}\1{nl}")
    return sub(c, r"\*([^\s*](?:[^*\n]*[^\s*])?)\*", rf"{nl}\1{nl}")


# ---- SQL form of the default embedding ---------------------------------------
def _mul(a: str, b: int) -> str:
    return f"((({a}) * {b}::UBIGINT) & 4294967295::UBIGINT)"


def _rotl(a: str, n: int) -> str:
    # The operand is named once: it may be long.
    return f"list_extract(list_transform([{a}], lambda r: ((r << {n}) & 4294967295::UBIGINT) | (r >> {32 - n})), 1)"


def _xor_shift(a: str, n: int) -> str:
    return f"list_extract(list_transform([{a}], lambda r: xor(r, r >> {n})), 1)"


def sql_embedding(texts: str, dim: int, name: str = "embedded") -> str:
    """CTEs ending in `name`: distinct `text` to its `vec`: words hashed (murmur3,
    32 bits, seed 42) into buckets, counted, unit length, six decimals."""
    nibble = "(instr('0123456789ABCDEF', substr(h, {p}, 1)) - 1)"
    byte = lambda i: (
        f"({nibble.format(p=f'2 * ({i}) + 1')} * 16 + {nibble.format(p=f'2 * ({i}) + 2')})::UBIGINT"
    )
    word = " | ".join(f"({byte(f'4 * b + {j}')} << {8 * j})" for j in range(4))
    mix = lambda k: _mul(_rotl(_mul(k, 0xCC9E2D51), 15), 0x1B873593)
    rows = f"list_transform(range(n // 4), lambda b: {word})"
    body = f"list_reduce({rows}, lambda a, k: {_mul(_rotl('xor(a, ' + mix('k') + ')', 13), 5)} + 3864292196::UBIGINT & 4294967295::UBIGINT, 42::UBIGINT)"
    tail = (
        "list_reduce(list_transform(range(n % 4), lambda i: "
        f"{byte('n // 4 * 4 + i')} << (8 * i)::INT), lambda a, k: a | k, 0::UBIGINT)"
    )
    done = _xor_shift(_mul(_xor_shift(_mul(_xor_shift(
        f"xor(CASE WHEN n % 4 = 0 THEN body ELSE xor(body, {mix('tail')}) END, n::UBIGINT)", 16),
        0x85EBCA6B), 13), 0xC2B2AE35), 16)
    signed = "(u::BIGINT - CASE WHEN u >= 2147483648 THEN 4294967296 ELSE 0 END)"
    return f"""
{name}_texts AS MATERIALIZED (SELECT DISTINCT text FROM ({texts})),
{name}_words AS MATERIALIZED (
  SELECT text, unnest(regexp_split_to_array(lower('query: ' || text), '{WS}+')) AS w FROM {name}_texts),
{name}_hex AS MATERIALIZED (
  SELECT w, hex(encode(w)) AS h, octet_length(encode(w)) AS n FROM (SELECT DISTINCT w FROM {name}_words)),
{name}_parts AS MATERIALIZED (SELECT w, n, {body} AS body, {tail} AS tail FROM {name}_hex),
{name}_hash AS MATERIALIZED (SELECT w, {done} AS u FROM {name}_parts),
{name}_bucket AS MATERIALIZED (SELECT w, ({signed} % {dim} + {dim}) % {dim} AS b FROM {name}_hash),
{name}_counts AS MATERIALIZED (
  SELECT text, b, count(*)::DOUBLE AS c FROM {name}_words JOIN {name}_bucket USING (w) GROUP BY text, b),
{name}_maps AS MATERIALIZED (
  SELECT text, map(list(b), list(c)) AS m, sqrt(sum(c * c)) + 1e-12 AS size FROM {name}_counts GROUP BY text),
{name} AS MATERIALIZED (
  SELECT text, list_transform(range({dim}),
    lambda b: round_even((coalesce(m[b], 0.0) / size)::FLOAT::DOUBLE, 6)::FLOAT) AS vec FROM {name}_maps)"""


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_model():
    """A small model for the encoder slot: how often each letter occurs."""
    import numpy as np

    def predict(texts):
        return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)

    return predict


# ---- queries -----------------------------------------------------------------
def _text_rule(rule, change=lambda c: c):
    def query(spark, sf_dir):
        return I.documents(spark, sf_dir).select("doc_id", rule(change(F.col("text"))).alias("text"))
    return query


def _sql_rule(rule, change="text"):
    return f"SELECT doc_id, {rule} AS text FROM (SELECT doc_id, {change} AS text FROM documents)"


FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(chr(0x21 + i) for i in range(94))


def document_scan(spark, sf_dir):
    """Documents written as text files, found by name below a root and read back
    as whole files; a file's text is the texts of its rows, line by line."""
    root = new_dir(spark, "raw")
    rows = I.documents(spark, sf_dir).select("lang", F.col("text"))
    rows.write.partitionBy("lang").option("maxRecordsPerFile", 5000).text(root)
    found = D.documents(spark, root)
    lang = F.regexp_extract("key", "lang=([a-z]+)/", 1)
    return found.groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("n_chars"))


def tolerant_decode(spark, sf_dir):
    """Every text with stray bytes around it and the rest of a cut character."""
    bad = F.concat(
        F.unhex(F.lit("FF")), F.col("text").cast("binary"), F.unhex(F.lit("E282")),
        F.col("lang").cast("binary"), F.unhex(F.lit("C3")),
    )
    return I.documents(spark, sf_dir).select("doc_id", D.decode_utf8(bad).alias("text"))


def html_text(spark, sf_dir):
    pages = I.pages(spark, sf_dir)
    return pages.select("page_id", extract.html_text(F.col("text")).alias("text"))


def markdown_text(spark, sf_dir):
    rows = I.documents(spark, sf_dir)
    return rows.select("doc_id", extract.markdown_text(_as_markdown(F.col("text"))).alias("text"))


def _as_markdown(c):
    """Sentences as headings, quotes and list items, some words in strong or emphasis."""
    for plain, marked in MARKED_WORDS:
        c = F.replace(c, F.lit(plain), F.lit(marked))
    c = F.regexp_replace(c, r"\. ", ".\n## ")
    c = F.regexp_replace(c, ", ", "\n- ")
    c = F.regexp_replace(c, r" (of|de|der) ", " **$1** ")
    return F.regexp_replace(c, r" (the|la|und) ", " [$1](x) ")


#: Words that get tags, entities, escapes and code with marks in it.
MARKED_WORDS = [
    (" to ", " <b>to</b> "), (" el ", " &lt;el&gt; "), (" die ", " \\*die\\* "), (" le ", " `*le* <b> &amp;` "),
    (" is ", " <https://example.org/is> "), (" que ", " <!-- que --> "),
]
MARKED_TEXT = [
    (" to ", " \nto\n "), (" el ", " <el> "), (" die ", " *die* "), (" le ", " \n*le* <b> &amp;\n "),
    (" is ", " \nhttps://example.org/is\n "), (" que ", " \n "),
]

def sql_word_places(c: str) -> str:
    """A character in place of each marked word."""
    for i, (plain, _) in enumerate(MARKED_WORDS):
        c = f"replace({c}, '{plain}', ' ' || chr({0xE000 + i}) || ' ')"
    return c


SQL_AS_MARKDOWN = sub(sub(sub(sub(
    sql_word_places("text"), r"\. ", ".' || chr(10) || '## "), ", ", "' || chr(10) || '- "),
    " (of|de|der) ", r" **\1** "), " (the|la|und) ", r" [\1](x) ")


def sql_marked_words(c: str) -> str:
    """The texts that the marked words leave, put in their places after the other rules."""
    for i, (_, text) in enumerate(MARKED_TEXT):
        feeds = text.strip(" ").replace("\n", "' || chr(10) || '")
        c = f"replace({c}, chr({0xE000 + i}), '{feeds}')"
    return c


def markup_routing(spark, sf_dir):
    plain = I.documents(spark, sf_dir).select("key", "text")
    pages = I.pages(spark, sf_dir).select("key", "text")
    return extract.with_text(plain.unionByName(pages))


def sentence_split(spark, sf_dir):
    rows = I.documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("pos", "sentence"))


def token_estimate(spark, sf_dir):
    return I.documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def sentence_packing(spark, sf_dir):
    rows = I.documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("sentences"))
    return chunking.explode_chunks(chunking.pack(rows, max_tokens=60, overlap=20))


def key_columns(spark, sf_dir):
    key = F.col("key")
    return I.documents(spark, sf_dir).select(
        "doc_id", T.doc_type(key).alias("section"), T.title_from_key(key).alias("title"),
        T.url_from_base("https://example.org", key).alias("url"),
        T.chunk_id(key, F.col("doc_id")).alias("chunk_id"),
    )


def _build(max_tokens, overlap, base_url=""):
    def query(spark, sf_dir):
        docs = I.documents(spark, sf_dir).select("key", "text")
        return flat(chunking.build_chunks(docs, max_tokens=max_tokens, overlap=overlap, base_url=base_url))
    return query


def page_chunks(spark, sf_dir):
    pages = I.pages(spark, sf_dir).select("key", "text")
    return flat(chunking.build_chunks(pages, max_tokens=60, overlap=20))


def chunk_files_round_trip(spark, sf_dir):
    path = new_dir(spark, "chunks")
    docs = I.documents(spark, sf_dir).select("key", "text")
    chunk_files.write_chunks(chunking.build_chunks(docs), path)
    return flat(chunk_files.read_chunks(spark, path))


def chunk_upsert(spark, sf_dir):
    """The store holds every vector, and each once more as an old chunk. The batch
    brings every vector anew, twice, and each as a new chunk."""
    store = I.vector_store(spark, sf_dir)
    number = F.expr("substring(chunk_id, 2)").cast("bigint")

    def renamed(rows, prefix):
        return rows.withColumn("chunk_id", F.concat(F.lit(prefix), "chunk_id"))

    known = store.withColumn("id", number)
    target = known.unionByName(renamed(known.withColumn("id", -number), "o"))
    first = store.withColumn("at", F.lit(1)).withColumn("title", F.lit("first"))
    second = store.withColumn("at", F.lit(2)).withColumn("title", F.concat(F.lit("second "), "chunk_id"))
    batch = first.unionByName(second).unionByName(renamed(second, "n"))
    merged = chunk_store.merge(target, batch, order="at")
    return merged.select("id", "title", "url", "chunk_id", "section", F.size("embedding").alias("dim"))


def chunk_store_scan(spark, sf_dir):
    """The store written and read at its newest version, two columns of it."""
    root = new_dir(spark, "store")
    rows = I.vector_store(spark, sf_dir).withColumn("at", F.lit(1))
    batch = rows.withColumn("metadata", F.lit("{}")).withColumn("updated_at", F.lit(I.NOW).cast("timestamp"))
    chunk_store.upsert(spark, root, batch, order="at")
    return chunk_store.read_store(spark, root, "chunk_id", "section")


def model_input_prefix(spark, sf_dir):
    return I.documents(spark, sf_dir).select("doc_id", embedding.model_input(F.col("text")).alias("text"))


def _exploded(rows, key):
    # The outer form: the inner one adds a filter that embeds once more.
    return rows.select(key, F.posexplode_outer("embedding").alias("pos", "x")).select(
        key, "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


def default_embedding(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    rows = embedding.embed(docs, "text", dim=64)
    return _exploded(rows, "doc_id")


def model_embedding(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    rows = embedding.embed(docs, "text", model=embedding.embedding_model(letter_model))
    return _exploded(rows, "doc_id")


def l2_normalized(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * F.lit(4.0)).cast("float"))
    return _exploded(rows.select("vec_id", V.l2_normalize(scaled).alias("embedding")), "vec_id")


def quantized(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", V.quantize(F.col("embedding")).alias("embedding"))
    return vectors.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
        "vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x")
    )


def embed_and_index(spark, sf_dir):
    """Documents to chunk files to the store, whole."""
    files, store = new_dir(spark, "chunks"), new_dir(spark, "store")
    docs = I.documents(spark, sf_dir).select("key", "text")
    now = F.lit(I.NOW).cast("timestamp")
    chunk_files.write_chunks(chunking.build_chunks(docs, now=now), files)
    ingest.embed_and_index(spark, files, store, dim=64)
    rows = chunk_store.read_store(spark, store)
    return rows.select(
        "chunk_id", "title", "section", F.get_json_object("metadata", "$.src_key").alias("src_key"),
        F.length("content").alias("n_chars"),
        F.round(V.norm(F.col("embedding")), 3).alias("norm"),
        # In millionths, as the store keeps them.
        F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint")), ",").alias("vector"),
        (F.count("id").over(Window.partitionBy("id")) == 1).alias("own_id"),
    )


QUERIES = {
    "document_scan": document_scan,
    "tolerant_decode": tolerant_decode,
    "html_text": html_text,
    "markdown_text": markdown_text,
    "markup_routing": markup_routing,
    "whitespace_tidy": _text_rule(T.tidy_whitespace, lambda c: F.replace(c, F.lit(". "), F.lit(".\n\n\t\n \n\n\n"))),
    "unicode_nfkc": _text_rule(T.nfkc, lambda c: F.translate(c, ASCII, FULL_WIDTH)),
    "hyphen_joining": _text_rule(
        T.join_hyphens, lambda c: F.replace(F.replace(c, F.lit("e "), F.lit("e-\r\n ")), F.lit("th"), F.lit("t­h"))),
    "bullet_rewriting": _text_rule(T.bullets, lambda c: F.replace(F.replace(c, F.lit(". "), F.lit("•")), F.lit(", "), F.lit("‣"))),
    "blank_cleanup": _text_rule(T.clean_blanks, lambda c: F.replace(F.replace(c, F.lit(". "), F.lit(".\r\n\r\n\r\n")), F.lit(" "), F.lit(" \t"))),
    "glued_token_split": _text_rule(T.split_glued, lambda c: F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("th"), F.lit("5t7"))),
    "punctuation_spacing": _text_rule(
        T.space_punctuation, lambda c: F.replace(F.replace(c, F.lit(", "), F.lit(" \n,")), F.lit(". "), F.lit("."))),
    "final_collapse": _text_rule(T.collapse_all, lambda c: F.concat(F.lit(" \n"), F.replace(c, F.lit(" "), F.lit(" \t ")))),
    "normalized_text": _text_rule(T.normalize),
    "sentence_split": sentence_split,
    "token_estimate": token_estimate,
    "sentence_packing": sentence_packing,
    "key_columns": key_columns,
    "chunks_60_20": _build(60, 20, "https://example.org/docs"),
    "chunks_600_50": _build(600, 50),
    "page_chunks": page_chunks,
    "chunk_files_round_trip": chunk_files_round_trip,
    "chunk_upsert": chunk_upsert,
    "chunk_store_scan": chunk_store_scan,
    "model_input_prefix": model_input_prefix,
    "default_embedding": default_embedding,
    "model_embedding": model_embedding,
    "l2_normalized": l2_normalized,
    "quantized": quantized,
    "embed_and_index": embed_and_index,
}

_CHUNKED = f"SELECT {SQL_CHUNK_COLUMNS} FROM chunked"
SQL = {
    "document_scan": "SELECT lang, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY lang",
    "tolerant_decode": "SELECT doc_id, text || lang AS text FROM documents",
    "html_text": f"SELECT page_id, {sql_html('html')} AS text FROM pages",
    "markdown_text": _sql_rule(sql_marked_words(sql_markdown("text")), SQL_AS_MARKDOWN),
    "markup_routing": f"""
SELECT key, text FROM ({I.SQL_DOCUMENTS})
UNION ALL SELECT key, {sql_html('text')} AS text FROM ({I.SQL_PAGES})""",
    "whitespace_tidy": _sql_rule(sql_tidy("text"), r"replace(text, '. ', e'.\n\n\t\n \n\n\n')"),
    "unicode_nfkc": _sql_rule("text"),
    "hyphen_joining": _sql_rule("replace(text, 'e ', 'e-')"),
    "bullet_rewriting": _sql_rule(sql_bullets("text"), "replace(replace(text, '. ', '•'), ', ', '‣')"),
    "blank_cleanup": _sql_rule(sql_blanks("text"), r"replace(replace(text, '. ', e'.\r\n\r\n\r\n'), ' ', e' \t')"),
    "glued_token_split": _sql_rule(sql_glued("text"), "replace(replace(text, ' ', ''), 'th', '5t7')"),
    "punctuation_spacing": _sql_rule(sql_punctuation("text"), r"replace(replace(text, ', ', e' \n,'), '. ', '.')"),
    "final_collapse": _sql_rule(sql_collapse("text")),
    "normalized_text": _sql_rule(sql_normalize("text")),
    "sentence_split": f"""
SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)""",
    "token_estimate": f"SELECT doc_id, {TOKENS.format(s='text')}::INT AS tokens FROM documents",
    "sentence_packing": f"""
WITH s AS MATERIALIZED (SELECT doc_id, {sql_sentences('text')} AS sentences FROM documents),
p AS MATERIALIZED (SELECT doc_id, {sql_pack('sentences', 60, 20)} AS chunks FROM s)
SELECT doc_id, unnest(range(len(chunks)))::INT AS chunk_index, len(chunks)::INT AS n_chunks,
       unnest(chunks) AS content FROM p""",
    "key_columns": f"""
SELECT doc_id, {SQL_DOC_TYPE} AS section, {SQL_TITLE} AS title,
       'https://example.org/' || regexp_extract(key, '[^/]*$') AS url,
       {SQL_CHUNK_ID} AS chunk_id
FROM (SELECT *, doc_id AS chunk_index FROM ({I.SQL_DOCUMENTS}))""",
    "chunks_60_20": f"WITH {sql_chunks(SQL_PLAIN, 60, 20, 'https://example.org/docs')} {_CHUNKED}",
    "chunks_600_50": f"WITH {sql_chunks(SQL_PLAIN, 600, 50)} {_CHUNKED}",
    "page_chunks": f"""
WITH {sql_chunks(f"SELECT key, {sql_html('text')} AS text FROM ({I.SQL_PAGES})", 60, 20)} {_CHUNKED}""",
    "chunk_files_round_trip": f"WITH {sql_chunks(SQL_PLAIN, 600, 50)} {_CHUNKED}",
    "chunk_upsert": f"""
WITH store AS (SELECT *, substr(chunk_id, 2)::BIGINT AS id, len(embedding)::INT AS dim FROM ({I.SQL_VECTOR_STORE}))
SELECT id, 'second ' || chunk_id AS title, url, chunk_id, section, dim FROM store
UNION ALL SELECT -id, title, url, 'o' || chunk_id, section, dim FROM store
UNION ALL SELECT NULL, 'second ' || chunk_id, url, 'n' || chunk_id, section, dim FROM store""",
    "chunk_store_scan": f"SELECT chunk_id, section FROM ({I.SQL_VECTOR_STORE})",
    "model_input_prefix": "SELECT doc_id, 'query: ' || text AS text FROM documents",
    "default_embedding": f"""
WITH {sql_embedding('SELECT text FROM documents', 64)}
SELECT doc_id, unnest(range(64))::INT AS pos,
       round(unnest(vec)::DOUBLE, 6) AS x FROM documents JOIN embedded USING (text)""",
    "model_embedding": f"""
WITH counts AS MATERIALIZED (
  SELECT doc_id, list_transform(string_split('{LETTERS}', ''),
    lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE) AS v
  FROM (SELECT doc_id, 'query: ' || text AS t FROM documents)),
sized AS MATERIALIZED (
  SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 AS size FROM counts)
SELECT doc_id, unnest(range(26))::INT AS pos,
       round(unnest(list_transform(v, lambda x: round_even((x / size)::FLOAT::DOUBLE, 6))), 6) AS x FROM sized""",
    "l2_normalized": """
WITH scaled AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 4) AS v FROM embeddings),
sized AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-12 AS size FROM scaled)
SELECT vec_id, unnest(range(len(v)))::INT AS pos,
       round(unnest(list_transform(v, lambda x: (x / size)::FLOAT::DOUBLE)), 6) AS x FROM sized""",
    "quantized": """
SELECT vec_id, unnest(range(len(embedding)))::INT AS pos,
       round(unnest(list_transform(embedding, lambda x: round_even(x::DOUBLE, 6)::FLOAT::DOUBLE)), 6) AS x
FROM embeddings""",
    "embed_and_index": f"""
WITH {sql_chunks(SQL_PLAIN, 600, 50)}, {sql_embedding('SELECT content AS text FROM chunked', 64)}
SELECT chunk_id, title, section, src_key, length(content)::INT AS n_chars, 1.0::DOUBLE AS norm,
       array_to_string(list_transform(vec, lambda x: round(x::DOUBLE * 1000000)::BIGINT), ',') AS vector,
       true AS own_id
FROM chunked JOIN embedded ON text = content""",
}
