"""Queries over the benchmark tables by name, each with DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import chunking, fusion, grep, lexical, mutation, search, sessions, store, tokenizer, vault, vectors
from quirebook.sources import files, scratch
from quirebook.sources import tables as S
from quirebook.streaming import events as E
from quirebook.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).select(F.col("id").alias("key"), "vector")


# --- retrieval -------------------------------------------------------------------------------------------------------

WORDS = "unnest(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+'))"


def bm25_sql(queries: str, k: int, name: str = "ranked") -> str:
    """CTEs up to `name` (q, key, score, rank); queries is a CTE (q, text)."""
    return f"""
words AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS w FROM documents),
total AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM words),
terms AS (SELECT DISTINCT q, {WORDS} AS term FROM {queries}),
postings AS (SELECT key, len(w) AS len, term, count(*) AS tf FROM (SELECT key, w, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scores AS (SELECT q, key, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM terms JOIN postings USING (term) JOIN df USING (term), total GROUP BY q, key),
{name} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM scores QUALIFY rank <= {k})"""


def knn_sql(queries: str, k: int, name: str = "near") -> str:
    return f"""
{name} AS (SELECT q, id AS key, round(list_cosine_similarity(v.vector::DOUBLE[], items.vector::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM {queries} v, items QUALIFY rank <= {k})"""


@query(f"{S.sql('text_queries')},{bm25_sql('text_queries', 10)}\nSELECT q, key, score, rank FROM ranked")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(S.text_queries(spark, d), docs(spark, d), 10)


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, {WORDS} AS term FROM documents) GROUP BY ALL) GROUP BY term")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_statistics(docs(spark, d))


@query(f"{S.sql('items', 'vector_queries')},{knn_sql('vector_queries', 1)}\nSELECT q, key, score, rank FROM near")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(S.vector_queries(spark, d), item_keys(spark, d), 1)


@query(f"{S.sql('items', 'vector_queries')},{knn_sql('vector_queries', 10)}\nSELECT q, key, score, rank FROM near")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn(S.vector_queries(spark, d), item_keys(spark, d), 10)


@query(f"""{S.sql('items', 'vector_queries')},{knn_sql('vector_queries', 50)},
best AS (SELECT q, label AS document, key, score, row_number() OVER (PARTITION BY q, label ORDER BY score DESC, key) AS n FROM near JOIN items ON id = key QUALIFY n = 1)
SELECT q, document, key, score FROM best""")
def best_chunk_per_doc(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(S.vector_queries(spark, d), item_keys(spark, d), 50)
    labels = S.items(spark, d).select(F.col("id").alias("key"), F.col("label").alias("document"))
    return vectors.best_chunk(near.join(labels, "key"))


@query(f"""{S.sql('items')}, p AS (SELECT a.id AS id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS score FROM items a JOIN items b ON b.id = a.id + 1)
SELECT id, score, CASE WHEN score > 0.8 THEN 'similar' WHEN score > 0.5 THEN 'related' ELSE 'different' END AS label, round(greatest(0, least(1, (score + 1) / 2)), 6) AS bar FROM p""")
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = item_keys(spark, d).alias("a"), item_keys(spark, d).alias("b")
    score = F.round(vectors.cosine(F.col("a.vector"), F.col("b.vector")), 9)
    pairs = a.join(b, F.col("b.key") == F.col("a.key") + 1).select(F.col("a.key").alias("id"), score.alias("score"))
    return pairs.select("id", "score", T.similarity_label(F.col("score")).alias("label"), F.round(T.similarity_bar(F.col("score")), 6).alias("bar"))


@query(f"""{S.sql('items')}, n AS (SELECT id, vector::DOUBLE[] AS v, sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) AS n FROM items)
SELECT id, round(n, 9) AS norm, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM n""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = F.aggregate(vectors.l2_normalize("vector"), F.lit(0.0), lambda s, x: s + x)
    return S.items(spark, d).select("id", F.round(vectors.norm("vector"), 9).alias("norm"), F.round(unit, 6).alias("total"))


@query(f"{S.sql('items')} SELECT id, len(vector)::BIGINT AS size FROM items")
def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    return S.items(spark, d).select("id", F.size(vectors.checked("vector", 64)).cast("long").alias("size"))


HYBRID = f"""{S.sql('items', 'text_queries')}, asked AS (SELECT q, vector FROM text_queries JOIN items ON id = q),{bm25_sql('text_queries', 20)},{knn_sql('asked', 20)},
lists AS (SELECT q, 0 AS list, rank - 1 AS pos, key, score FROM ranked UNION ALL SELECT q, 1, rank - 1, key, score FROM near),
fused AS (SELECT q, key, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS score, min((list, pos)) AS first, list((list, score) ORDER BY list, pos) AS places FROM lists GROUP BY q, key),
cited AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, first) AS index FROM fused QUALIFY index <= 10)
"""


@query(f"{HYBRID} SELECT q, key, score, index FROM cited")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    texts = S.text_queries(spark, d)
    asked = texts.select("q").join(item_keys(spark, d), F.col("q") == F.col("key")).select("q", "vector")
    return search.hybrid(texts, asked, docs(spark, d), item_keys(spark, d), 10, 20)


def variants(spark: SparkSession, d: str) -> DataFrame:
    """(q, variant, text): the queries, and two rewrites that begin a word later each."""
    answer = F.concat_ws("\n", F.concat(F.lit("1. "), F.col("b")), F.concat(F.lit("2. "), F.col("c")))
    b, c = S.text_queries(spark, d, 2).withColumnRenamed("text", "b"), S.text_queries(spark, d, 3).withColumnRenamed("text", "c")
    answers = b.join(c, "q").select("q", answer.alias("answer"))
    return search.variants(S.text_queries(spark, d), answers)


def variant_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(q, variant, vector): each variant's vector is that of an item; the last variant has none."""
    asked = variants(spark, d).where("variant < 2").select("q", "variant", (F.col("q") + F.col("variant")).alias("key"))
    return asked.join(item_keys(spark, d), "key").select("q", "variant", "vector")


MULTI = rf"""{S.sql('items')}, moved AS (SELECT item_id, v, array_to_string(regexp_split_to_array(text, '\s+')[v + 1 :], ' ') AS text FROM benchmark, unnest(range(3)) AS s(v) WHERE item_id % 100 = 0),
asked AS (SELECT (item_id, v) AS q, text FROM moved), asked_vectors AS (SELECT (item_id, v) AS q, vector FROM moved JOIN items ON id = item_id + v WHERE v < 2),{bm25_sql('asked', 20)},{knn_sql('asked_vectors', 20)},
mixed AS (SELECT q, 0 AS list, rank - 1 AS pos, key FROM ranked UNION ALL SELECT q, 1, rank - 1, key FROM near),
variant_scores AS (SELECT q, key, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS score, min((list, pos)) AS first FROM mixed GROUP BY q, key),
variant_ranks AS (SELECT q, key, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, first) AS rank FROM variant_scores QUALIFY rank <= 10),
lists AS (SELECT struct_extract(q, 1) AS q, struct_extract(q, 2) AS list, rank - 1 AS pos, key, score FROM variant_ranks),
fused AS (SELECT q, key, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS rrf_score, min((list, pos)) AS first, max(score) FILTER (WHERE list = 0) AS s0, max(score) FILTER (WHERE list = 1) AS s1, max(score) FILTER (WHERE list = 2) AS s2 FROM lists GROUP BY q, key),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rrf_score DESC, first) AS rank FROM fused QUALIFY rank <= 5)
"""


def multi(spark: SparkSession, d: str) -> DataFrame:
    return search.multi_query(variants(spark, d), docs(spark, d), 5, 2, variant_vectors(spark, d), item_keys(spark, d))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Search with a reranker that gives nothing for texts whose length is a multiple of three."""
    some = lambda asked, content: F.when(F.length(content) % 3 != 0, fusion.lexical_score(asked, content))
    return search.search(variants(spark, d), docs(spark, d), 5, some, variant_vectors(spark, d), item_keys(spark, d))


@query(f"{MULTI} SELECT q, key, rrf_score, rank FROM top")
def rrf_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return multi(spark, d).select("q", "key", "rrf_score", "rank")


@query(f"{MULTI} SELECT q, key, s0, s1, s2 FROM top")
def rrf_source_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = fusion.source_scores(multi(spark, d), 3)
    return scored.select("q", "key", *(F.get("source_scores", F.lit(i)).alias(f"s{i}") for i in range(3)))


@query(f"{MULTI} SELECT q, key, struct_extract(first, 1)::BIGINT AS list, struct_extract(first, 2)::BIGINT AS pos, lang AS tag FROM top JOIN documents ON doc_id = key")
def fused_metadata(spark: SparkSession, d: str) -> DataFrame:
    tags = S.notes(spark, d).select(F.col("doc_id").alias("key"), "tag")
    return multi(spark, d).join(tags, "key").select("q", "key", F.col("first.list").cast("long").alias("list"), F.col("first.pos").cast("long").alias("pos"), "tag")


RERANKED = f"""{MULTI}, asked0 AS (SELECT q, list_distinct(regexp_extract_all(lower(t), '[a-zà-ÿ0-9]+')) AS w FROM (SELECT item_id AS q, text AS t FROM moved WHERE v = 0)),
rr AS (SELECT top.q, top.key, rrf_score, CASE WHEN length(text) % 3 <> 0 THEN round(CASE WHEN len(a.w) = 0 THEN 0 ELSE len(list_intersect(a.w, words.w)) / len(a.w) END, 9) END AS s
  FROM top JOIN asked0 a USING (q) JOIN words USING (key) JOIN documents ON doc_id = key),
cited AS (SELECT q, key, coalesce(s, rrf_score) AS score, s IS NOT NULL AS reranked, row_number() OVER (PARTITION BY q ORDER BY coalesce(s, rrf_score) DESC, key) AS index FROM rr)
"""


@query(f"{RERANKED} SELECT q, key, score, reranked, index FROM cited")
def rerank_merge(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d)


@query(f"{RERANKED} SELECT q, bool_or(reranked) AS any_reranked FROM cited GROUP BY q")
def any_reranked(spark: SparkSession, d: str) -> DataFrame:
    return sessions.any_reranked(reranked(spark, d))


@query(f"{S.sql('text_queries')},{bm25_sql('text_queries', 5)}\nSELECT q, key, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS index FROM ranked")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return fusion.cite(lexical.bm25(S.text_queries(spark, d), docs(spark, d), 5).drop("rank"))


@query(f"{S.sql('items', 'vector_queries')},{knn_sql('vector_queries', 10)}\nSELECT q, key, round(score, 3) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'mid' ELSE 'low' END AS band FROM near")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(S.vector_queries(spark, d), item_keys(spark, d), 10)
    return near.select("q", "key", F.round("score", 3).alias("score"), T.band(F.col("score")).alias("band"))


@query(f"WITH items AS (SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE label IN (1, 2)), {S.SQL['vector_queries']},{knn_sql('vector_queries', 10)}\nSELECT q, key, score, rank FROM near")
def filtered_knn(spark: SparkSession, d: str) -> DataFrame:
    rows = S.items(spark, d).select(F.col("id").alias("key"), "vector", F.array(F.col("label").cast("string")).alias("tags"), F.lit("").alias("path"))
    return vectors.knn(S.vector_queries(spark, d), search.filtered(rows, ["1", "2"]), 10)


@query("SELECT event_id AS doc_id, 'user-' || user_id AS path, value AS score, value > 50 AS reranked FROM events WHERE event_id % 3 <> 0")
def result_flatten(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit('{"path":"user-'), F.col("user_id").cast("string"), F.lit('"}'))
    metadata = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(path)
    rows = S.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), metadata.alias("metadata"), F.col("value").alias("score"), (F.col("value") > 50).alias("reranked"))
    return search.flatten_results(rows)


@query(f"{S.sql('items', 'vector_queries')},{knn_sql('vector_queries', 5)}\nSELECT q, key, score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS preview FROM near JOIN documents ON doc_id = key")
def diagnostic_knn(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.knn(S.vector_queries(spark, d), item_keys(spark, d), 5)
    return near.join(docs(spark, d), "key").select("q", "key", "score", T.preview(F.col("content")).alias("preview"))


# --- text ------------------------------------------------------------------------------------------------------------

TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
CHUNKS = f"""WITH RECURSIVE {S.SQL['notes']},
cut(path, rest, piece, i) AS (
  SELECT path, content, NULL::VARCHAR, -1 FROM notes WHERE length({TRIMMED.format('content')}) > 0 AND length(content) > 750
  UNION ALL
  SELECT path, CASE WHEN length(rest) <= 500 THEN NULL ELSE substr(rest, greatest(c + 1 - 100, 1)::INT + 1) END, CASE WHEN length(rest) <= 500 THEN rest ELSE substr(rest, 1, c::INT + 1) END, i + 1
  FROM (SELECT path, rest, i, CASE WHEN p >= 150 THEN p ELSE 500 END AS c
    FROM (SELECT path, rest, i, CASE WHEN strpos(reverse(substr(rest, 1, 502)), ' .') = 0 THEN -1 ELSE length(substr(rest, 1, 502)) - strpos(reverse(substr(rest, 1, 502)), ' .') - 1 END AS p FROM cut WHERE rest IS NOT NULL AND rest <> ''))),
chunked AS (SELECT path, i AS chunk_index, {TRIMMED.format('piece')} AS chunk FROM cut WHERE piece IS NOT NULL
  UNION ALL SELECT path, 0, {TRIMMED.format('content')} FROM notes WHERE length({TRIMMED.format('content')}) > 0 AND length(content) <= 750)
"""


@query(f"{CHUNKS} SELECT path, chunk_index::INT AS chunk_index, path || '#chunk-' || chunk_index AS chunk_id, chunk FROM chunked")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_notes(S.notes(spark, d)).select("path", "chunk_index", "chunk_id", "chunk")


@query(f"{CHUNKS} SELECT (SELECT count(*) FROM notes) AS indexed, 0::BIGINT AS errors, count(*) AS chunks FROM chunked")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    return chunking.index_counts(notes, chunking.chunk_notes(notes))


MARKED = """notes AS (SELECT 'conv-' || conv_id AS path, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {MARKED}, lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM notes),
n AS (SELECT *, sum(CASE WHEN pos > 1 AND regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS section FROM lines)
SELECT path, section::BIGINT AS section, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM n GROUP BY path, section""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.lit("# "), "role", F.lit("\n"), "text")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n")
    notes = S.table(spark, d, "conversations").groupBy(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("path")).agg(joined.alias("content"))
    return chunking.heading_sections(notes)


TOKENS = r"""ceil(round(len(regexp_extract_all({0}, '[\x00-\x7F]')) / 4 + len(regexp_extract_all({0}, '[\x{{4E00}}-\x{{9FFF}}]')) / 1.5 + (length({0}) - len(regexp_extract_all({0}, '[\x00-\x7F]')) - len(regexp_extract_all({0}, '[\x{{4E00}}-\x{{9FFF}}]'))) / 3, 9))::BIGINT"""


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def char_token_count(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query(f"{S.sql('notes')} SELECT path, sha256(content) AS hash FROM notes")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.notes(spark, d).select("path", F.sha2("content", 256).alias("hash"))


@query(f"{S.sql('notes')} SELECT path, sha256(content) AS hash, tag <> 'en' AS changed FROM notes")
def unchanged_by_hash(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    stored = notes.select("path", F.sha2(F.when(F.col("tag") == "en", F.col("content")).otherwise(F.concat("content", F.lit("x"))), 256).alias("hash"))
    return mutation.unchanged(notes, stored)


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+'), lambda x: length(x)::INT) AS ids FROM documents),
e AS (SELECT doc_id, list_concat([101::INT], list_concat(ids[1:510], [102::INT])) AS b FROM t)
SELECT doc_id, list_sum(b)::BIGINT AS total, len(b)::BIGINT AS attended, 512::BIGINT AS size, 0::BIGINT AS types FROM e""")
def encode_pad(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(T.words(F.col("text")), F.length)
    made = S.table(spark, d, "documents").select("doc_id", tokenizer.encode(ids).alias("e"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("doc_id", total("e.input_ids").alias("total"), total("e.attention_mask").alias("attended"), F.size("e.input_ids").cast("long").alias("size"), total("e.token_type_ids").alias("types"))


REWRITES = f"""SELECT item_id AS id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || '7. '), chr(10)), lambda x: {TRIMMED.format("regexp_replace(" + TRIMMED.format("x") + r", '^[0-9]+[.]\s*', '')")}), lambda x: x <> '')[1:2] AS rewrites FROM benchmark"""


@query(REWRITES)
def rewrite_parse(spark: SparkSession, d: str) -> DataFrame:
    answer = F.replace("text", F.lit(". "), F.lit(".\n7. "))
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.parse_rewrites(answer).alias("rewrites"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'rag') THEN 'rag' WHEN contains(lower(text), 'direct') THEN 'direct' ELSE 'rag' END AS intent FROM documents")
def intent_case(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.intent(F.col("text")).alias("intent"))


@query("SELECT page_id, (length(html) - length(replace(html, '<p', ''))) / 2 % 2 = 0 AS closed FROM pages")
def fences_closed(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", T.fences_closed(F.replace("html", F.lit("<p"), F.lit("```"))).alias("closed"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS preview FROM documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT item_id, regexp_replace(text, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM benchmark")
def regex_escape(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "benchmark").select("item_id", T.escape_regex(F.col("text")).alias("escaped"))


# --- exact search ----------------------------------------------------------------------------------------------------


def grep_sql(condition: str, column: str, context: int = 2, extra: str = "") -> str:
    return f"""{S.sql('notes')}, l AS (SELECT path, string_split(content, chr(10)) AS lines FROM notes WHERE path LIKE '%.md' {extra}),
e AS (SELECT path, lines, i, lines[i] AS text FROM l, unnest(range(1, len(lines) + 1)) AS s(i)),
hits AS (SELECT path, i AS line, {column}::BIGINT AS "column", rtrim(text, ' ' || chr(9) || chr(13)) AS match,
  list_transform(lines[greatest(i - {context}, 1) : i - 1], lambda x: rtrim(x, ' ' || chr(9) || chr(13))) AS before, list_transform(lines[i + 1 : i + {context}], lambda x: rtrim(x, ' ' || chr(9) || chr(13))) AS after FROM e WHERE {condition})
"""


@query(f"""{grep_sql("contains(lower(text), 'the ')", "strpos(lower(text), 'the ')")} SELECT path, line, "column", match FROM hits""")
def grep_literal(spark: SparkSession, d: str) -> DataFrame:
    return grep.grep(S.notes(spark, d), "the ", regex=False, limit=None).select("path", "line", "column", "match")


REGEX = "[0-9]{3}-[0-9]{4}"


@query(f"""{grep_sql(f"regexp_matches(text, '{REGEX}')", f"strpos(text, regexp_extract(text, '{REGEX}'))")} SELECT path, line, "column", match FROM hits""")
def grep_regex(spark: SparkSession, d: str) -> DataFrame:
    return grep.grep(S.notes(spark, d), REGEX, limit=None).select("path", "line", "column", "match")


@query(f"""{grep_sql("contains(text, 'token')", "strpos(text, 'token')")} SELECT path, line, "column", match, array_to_string(before, '|') AS before, array_to_string(after, '|') AS after FROM hits""")
def grep_context(spark: SparkSession, d: str) -> DataFrame:
    found = grep.grep(S.notes(spark, d), "token", regex=False, ignore_case=False, limit=None)
    return found.withColumn("before", F.array_join("before", "|")).withColumn("after", F.array_join("after", "|"))


@query(f"""{grep_sql("contains(lower(text), 'an')", "strpos(lower(text), 'an')", 2, "AND starts_with(path, 'src1/')")} SELECT path, line, "column", match FROM hits ORDER BY path, line LIMIT 50""")
def grep_limit(spark: SparkSession, d: str) -> DataFrame:
    return grep.grep(S.notes(spark, d), "an", regex=False, folder="src1/").select("path", "line", "column", "match")


@query(f"{S.sql('notes')} SELECT path FROM notes WHERE regexp_full_match(path, 'src1[^/]*/(.*/)?doc-[^/]*[^/]0[.]md')")
def glob_match(spark: SparkSession, d: str) -> DataFrame:
    return vault.glob(S.notes(spark, d), "src1*/**/doc-*?0.md")


@query(f"{S.sql('notes')} SELECT path FROM notes WHERE path = 'src2/fr' OR starts_with(path, 'src2/fr/')")
def under_dir(spark: SparkSession, d: str) -> DataFrame:
    return S.notes(spark, d).where(T.under(F.col("path"), "src2/fr/")).select("path")


HIDDEN = "SELECT CASE doc_id % 3 WHEN 0 THEN '.obsidian/' || doc_id WHEN 1 THEN '.trash' ELSE '.trashed/' || doc_id END AS path, doc_id FROM documents"


def hidden(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(".obsidian/"), n)).when(F.col("doc_id") % 3 == 1, ".trash").otherwise(F.concat(F.lit(".trashed/"), n))
    return S.table(spark, d, "documents").select(path.alias("path"), "doc_id")


@query(f"SELECT doc_id, path, path = '.trash' OR starts_with(path, '.trash/') OR path = '.obsidian' OR starts_with(path, '.obsidian/') AS excluded FROM ({HIDDEN})")
def excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    return hidden(spark, d).select("doc_id", "path", T.excluded(F.col("path")).alias("excluded"))


@query(f"""{S.sql('notes')} SELECT split_part(path, '/', 2) AS name, 'folder' AS kind, count(*) AS n FROM notes WHERE starts_with(path, 'src3/') GROUP BY 1""")
def list_dir(spark: SparkSession, d: str) -> DataFrame:
    return vault.list_folder(S.notes(spark, d), "src3")


@query(f"""{S.sql('notes')} SELECT doc_id, path AS normalized, CASE WHEN doc_id % 5 = 0 THEN 'traversal' END AS error FROM notes""")
def path_normalize(spark: SparkSession, d: str) -> DataFrame:
    rough = F.concat(F.lit("/./"), F.replace("path", F.lit("/"), F.lit("//")))
    shown = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("../"), "path")).otherwise(rough)
    return S.notes(spark, d).select("doc_id", T.normalize_path(rough).alias("normalized"), T.path_error(shown).alias("error"))


@query(f"""{S.sql('notes')} SELECT path, starts_with(path, 'src1/') AND NOT ends_with(path, '7.md') OR starts_with(path, 'src4/de/') AS ignored FROM notes""")
def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = files.ignore_rules(["# comment", "src1/", "!*7.md", "src4/de/"])
    return S.notes(spark, d).select("path", files.ignored(F.col("path"), rules).alias("ignored"))


@query(f"{S.sql('notes')} SELECT path, length(content)::BIGINT AS n FROM notes WHERE starts_with(path, 'src5/en/doc-1')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    kept = store.Store(spark, scratch.folder(spark), "path string, content string")
    kept.overwrite(S.notes(spark, d).select("path", "content"))
    return kept.by_prefix("src5/en/doc-1").select("path", F.length("content").cast("long").alias("n"))


# --- links -----------------------------------------------------------------------------------------------------------


@query(f"{S.sql('links')} SELECT dst, src, sum(n)::BIGINT AS n FROM links GROUP BY dst, src")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return vault.backlinks(S.links(spark, d))


@query(f"{S.sql('links')} SELECT dst, count(DISTINCT src) AS sources, sum(n)::BIGINT AS n FROM links GROUP BY dst")
def backlink_counts(spark: SparkSession, d: str) -> DataFrame:
    return vault.backlinks(S.links(spark, d)).groupBy("dst").agg(F.count("*").alias("sources"), F.sum("n").alias("n"))


@query(f"{S.sql('links')} SELECT url AS path, length(html)::BIGINT AS n, b AS backlinks FROM pages LEFT JOIN (SELECT dst, array_to_string(list_sort(list(DISTINCT src)), ' ') AS b FROM links GROUP BY dst) ON dst = url")
def read_note(spark: SparkSession, d: str) -> DataFrame:
    notes = S.table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("n"))
    return vault.read_notes(notes, S.links(spark, d)).select("path", "n", F.array_join("backlinks", " ").alias("backlinks"))


@query(f"{S.sql('links', 'notes')}, every AS (SELECT url AS path FROM pages UNION ALL SELECT path FROM notes) SELECT path FROM every WHERE path NOT IN (SELECT dst FROM links) AND path NOT IN (SELECT src FROM links)")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    every = S.table(spark, d, "pages").select(F.col("url").alias("path")).unionByName(S.notes(spark, d).select("path"))
    return vault.orphans(every, S.links(spark, d))


@query(f"""{S.sql('links')}, one AS (SELECT DISTINCT src, dst FROM links), every AS (SELECT src, dst, 1 AS s FROM one UNION ALL SELECT a.src, b.dst, 2 FROM one a JOIN one b ON a.dst = b.src)
SELECT src, dst, min(s)::BIGINT AS steps FROM every WHERE src <> dst GROUP BY src, dst""")
def follow_links_2hop(spark: SparkSession, d: str) -> DataFrame:
    return vault.within_two_steps(S.links(spark, d))


# --- changes ---------------------------------------------------------------------------------------------------------


@query(f"{S.sql('file_events')} SELECT path, max_by(op, (ts, seq)) AS op, max_by(seq, (ts, seq)) AS seq FROM file_events GROUP BY path")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return mutation.latest(S.file_events(spark, d)).select("path", "op", "seq")


@query(f"{S.sql('notes')} SELECT path, tag FROM notes WHERE tag <> 'fr'")
def delete_by_path(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d).select("path", "tag")
    return mutation.delete(notes, notes.where("tag = 'fr'"))


@query(f"{S.sql('notes')} SELECT count(*) FILTER (WHERE tag = 'de') AS deleted FROM notes")
def delete_missing_ok(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d).select("path", "tag")
    gone = notes.where("tag = 'de'").select("path")
    return mutation.deleted_count(notes, gone.union(gone.select(F.concat("path", F.lit("x")))))


@query(f"""{S.sql('notes')} SELECT path, sha256(content || '!') AS hash, false AS created FROM notes WHERE tag = 'es' UNION ALL SELECT path || 'x', sha256('!'), true FROM notes WHERE tag = 'es'""")
def append_note(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    some = notes.where("tag = 'es'").select("path")
    rows = some.union(some.select(F.concat("path", F.lit("x")))).withColumn("suffix", F.lit("!"))
    return mutation.append(notes, rows).select("path", F.sha2("content", 256).alias("hash"), "created")


@query(f"""{S.sql('notes')}, n AS (SELECT path, content, (length(content) - length(replace(content, 'token', ''))) / 5 AS n FROM notes)
SELECT path, sha256(CASE WHEN n = 1 THEN replace(content, 'token', '$&') ELSE content END) AS hash, n::BIGINT AS n, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' END AS error FROM n""")
def edit_once(spark: SparkSession, d: str) -> DataFrame:
    return mutation.edit(S.notes(spark, d), F.lit("token"), F.lit("$&")).select("path", F.sha2("content", 256).alias("hash"), "n", "error")


@query(f"{S.sql('notes')} SELECT path, tag = 'de' AS trashed FROM notes")
def trash_note(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d).select("path", "tag")
    left, bin_ = mutation.trash(notes, notes.limit(0), notes.where("tag = 'de'"))
    return left.select("path", F.lit(False).alias("trashed")).union(bin_.select("path", F.lit(True)))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'an', ''))) / 2)::BIGINT AS n FROM documents")
def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("an")).alias("n"))


@query(f"{S.sql('notes')} SELECT path, sha256(content || CASE WHEN tag = 'en' THEN '+' ELSE '' END) AS hash FROM notes UNION ALL SELECT 'new/' || path, sha256('+') FROM notes WHERE tag = 'es'")
def write_note(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    changed = notes.where("tag = 'en'").select("path", F.concat("content", F.lit("+")).alias("content"))
    fresh = notes.where("tag = 'es'").select(F.concat(F.lit("new/"), "path").alias("path"), F.lit("+").alias("content"))
    after, _ = mutation.write(notes, changed.union(fresh))
    return after.select("path", F.sha2("content", 256).alias("hash"))


# --- events ----------------------------------------------------------------------------------------------------------


@query(f"""{S.sql('file_events')}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM file_events WINDOW w AS (PARTITION BY path ORDER BY ts, seq)),
r AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts, seq) AS run FROM g)
SELECT path, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM r GROUP BY path, run""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.debounce_sessions(S.file_events(spark, d), "1 hour")


@query(f"""{S.sql('file_events')}, n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, seq) AS following FROM file_events)
SELECT path, seq, op, CASE WHEN op = 'delete' THEN ts ELSE ts + INTERVAL 3600 SECOND END AS due FROM n WHERE op = 'delete' OR following IS NULL OR following > ts + INTERVAL 3600 SECOND""")
def debounce_with_delete(spark: SparkSession, d: str) -> DataFrame:
    return E.debounce(S.file_events(spark, d), 3600)


@query(f"{S.sql('file_events')} SELECT path, max_by(op, (ts, seq)) AS op, min(seq) AS first_seq FROM file_events GROUP BY path")
def queue_last_op(spark: SparkSession, d: str) -> DataFrame:
    return E.last_ops(S.file_events(spark, d))


RAW = "raw AS (SELECT ts, event_id AS seq, 'user-' || user_id || '.md' AS path, 'old-' || user_id || '.md' AS old_path, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' ELSE 'modify' END AS op FROM events)"


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    named = lambda prefix: F.concat(F.lit(prefix), F.col("user_id").cast("string"), F.lit(".md"))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "rename").otherwise("modify")
    return S.table(spark, d, "events").select("ts", F.col("event_id").alias("seq"), named("user-").alias("path"), named("old-").alias("old_path"), op.alias("op"))


@query(f"WITH {RAW} SELECT seq, path, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS op FROM raw UNION ALL SELECT seq, old_path, 'delete' FROM raw WHERE op = 'rename'")
def rename_split(spark: SparkSession, d: str) -> DataFrame:
    return E.normalize(raw_events(spark, d)).select("seq", "path", "op")


@query(f"WITH {RAW} SELECT seq, path, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS op FROM raw WHERE op = 'delete' OR NOT starts_with(path, 'user-1') UNION ALL SELECT seq, old_path, 'delete' FROM raw WHERE op = 'rename'")
def event_ignore(spark: SparkSession, d: str) -> DataFrame:
    rules = files.ignore_rules(["user-1*"])
    return E.normalize(raw_events(spark, d), lambda path: files.ignored(path, rules)).select("seq", "path", "op")


@query("SELECT user_id AS path, max_by(event_type, event_id) AS state, count(*) AS n FROM events GROUP BY user_id")
def index_state(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(S.table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@query("SELECT count(*) AS total, max(ts) AS last_time, false AS indexing FROM events")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").agg(F.count("*").alias("total"), F.max("ts").alias("last_time"), F.lit(False).alias("indexing"))


# --- sessions --------------------------------------------------------------------------------------------------------


@query(rf"""{S.sql('messages')}, c AS (SELECT *, len(regexp_extract_all(content, '[\x00-\x7F]')) AS a, len(regexp_extract_all(content, '[\x{{4E00}}-\x{{9FFF}}]')) AS z FROM messages),
w AS (SELECT session_id, ord, ceil(round(sum(a) OVER w / 4 + sum(z) OVER w / 1.5 + sum(length(content) - a - z) OVER w / 3, 9)) AS tokens, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ord DESC))
SELECT session_id, ord FROM w WHERE tokens <= 300 OR n = 1""")
def history_trim(spark: SparkSession, d: str) -> DataFrame:
    return sessions.trim_history(S.messages(spark, d), 300).select("session_id", "ord")


@query(f"{S.sql('messages')}, u AS (SELECT session_id, sum({TOKENS.format('content')})::BIGINT AS used FROM messages GROUP BY session_id) SELECT session_id, used, 1000::BIGINT AS max, round(used * 100 / 1000)::BIGINT AS percentage FROM u")
def context_usage(spark: SparkSession, d: str) -> DataFrame:
    return sessions.context_usage(S.messages(spark, d), 1000)


@query(f"{S.sql('messages')}, s AS (SELECT session_id, count(*) AS updated_at FROM messages GROUP BY session_id) SELECT session_id, updated_at FROM s ORDER BY updated_at DESC, session_id LIMIT 20")
def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    made = S.messages(spark, d).groupBy("session_id").agg(F.count("*").alias("updated_at"))
    return sessions.recent(made, "updated_at", 20)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def hook_log_tail(spark: SparkSession, d: str) -> DataFrame:
    return sessions.recent(S.table(spark, d, "events").select("event_id", "event_type"), "event_id", 50, "event_id")


@query(f"{S.sql('messages')} SELECT session_id, ord FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) <= 2")
def compact_last(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_messages(S.messages(spark, d)).select("session_id", "ord")


@query("""WITH d AS (SELECT user_id AS session_id, event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN 'text' ELSE 'think' END AS kind, event_type AS text FROM events),
g AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY session_id ORDER BY ord) = kind THEN 0 ELSE 1 END AS s FROM d), n AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ord) AS segment FROM g)
SELECT session_id, segment::BIGINT AS segment, kind, string_agg(text, '' ORDER BY ord) AS text, count(*) AS n FROM n GROUP BY session_id, segment, kind""")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "view"), "text").otherwise("think")
    rows = S.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.col("event_type").alias("text"))
    return sessions.merge_segments(rows)


@query("""WITH e AS (SELECT user_id AS session_id, event_id AS ord, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'result' END AS kind, event_type AS name FROM events)
SELECT session_id, ord, name, (SELECT max(c.ord) FROM e c WHERE c.session_id = e.session_id AND c.name = e.name AND c.kind = 'call' AND c.ord < e.ord) AS call_ord FROM e WHERE kind = 'result'""")
def tool_pairing(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "call").otherwise("result")
    return sessions.pair_tools(S.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), kind.alias("kind"), F.col("event_type").alias("name")))


@query(f"{S.sql('messages')} SELECT session_id, sha256(string_agg(content, '' ORDER BY ord)) AS hash FROM messages GROUP BY session_id")
def delta_concat(spark: SparkSession, d: str) -> DataFrame:
    return sessions.join_deltas(S.messages(spark, d).withColumnRenamed("content", "text")).select("session_id", F.sha2("text", 256).alias("hash"))


@query(f"{S.sql('text_queries')},{bm25_sql('text_queries', 3)}\nSELECT q, sha256(string_agg('[' || rank || '] doc-' || key || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS hash FROM ranked JOIN documents ON doc_id = key GROUP BY q")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    found = lexical.bm25(S.text_queries(spark, d), docs(spark, d), 3).join(docs(spark, d), "key")
    rows = found.select("q", F.col("rank").alias("index"), F.concat(F.lit("doc-"), F.col("key").cast("string")).alias("path"), "content")
    return sessions.context_block(rows).select("q", F.sha2("block", 256).alias("hash"))


@query("""WITH e AS (SELECT event_id, user_id % 50 AS stream_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS pos, event_type FROM events)
SELECT stream_id, pos AS ord, event_type AS content, CASE WHEN event_id % 10 = 0 THEN 'stop' END AS finish FROM e WHERE event_id % 7 <> 0""")
def sse_parse(spark: SparkSession, d: str) -> DataFrame:
    return sessions.parse_sse(sse_streams(spark, d)).select("stream_id", "ord", "content", "finish")


def sse_streams(spark: SparkSession, d: str) -> DataFrame:
    finish = F.when(F.col("event_id") % 10 == 0, F.lit(',"finish_reason":"stop"')).otherwise(F.lit(""))
    line = F.when(F.col("event_id") % 7 == 0, F.lit("data: {broken")).otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit('"}'), finish, F.lit("}]}")))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return S.table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("stream_id")).agg(F.concat(lines, F.lit("\n\ndata: [DONE]")).alias("raw"))


MODELS = (("chat-large", 64000), ("chat-", 32000), ("chat-large-2", 128000))


@query("""WITH m AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'chat-large' WHEN 1 THEN 'chat-large-2' WHEN 2 THEN 'chat-mini' ELSE 'other' END AS model FROM benchmark)
SELECT model, CASE model WHEN 'chat-large' THEN 64000 WHEN 'chat-large-2' THEN 128000 WHEN 'chat-mini' THEN 32000 END::BIGINT AS context FROM m""")
def model_context_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("item_id") % 4
    models = S.table(spark, d, "benchmark").select(F.when(n == 0, "chat-large").when(n == 1, "chat-large-2").when(n == 2, "chat-mini").otherwise("other").alias("model"))
    known = spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "ord int, name string, context int")
    return sessions.model_context(models, known)


#: (message, status, code, kind of error): every rule, in turn, and what comes before what.
ERRORS = (
    ("not yet", None, "INDEX_NOT_READY", "model"), ("索引未就绪", None, None, "model"), ("x", 401, None, "config"), ("No API key", None, None, "config"), ("Unauthorized fetch", None, None, "config"),
    ("x", 404, None, "config"), ("Model gpt not found", None, None, "config"), ("Failed to fetch", None, None, "network"), ("ECONNREFUSED", 400, None, "network"), ("request TIMEOUT", 429, None, "network"),
    ("wasm trap", None, None, "model"), ("embedding invalid", None, None, "model"), ("x", 400, None, "runtime"), ("Invalid temperature", None, None, "runtime"), ("x", 429, None, "network"),
    ("Rate limit hit", None, None, "network"), ("x", 403, None, "unknown"), ("undefined is null", None, None, "unknown"),
)


@query(f"SELECT event_id, [{', '.join(repr(e[3]) for e in ERRORS)}][event_id % {len(ERRORS)} + 1] AS type FROM events")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*(F.struct(F.lit(m).alias("message"), F.lit(s).cast("int").alias("status"), F.lit(c).cast("string").alias("code")) for m, s, c, _ in ERRORS))
    events = S.table(spark, d, "events").select("event_id", F.get(cases, (F.col("event_id") % len(ERRORS)).cast("int")).alias("e"))
    return events.select("event_id", T.error_type(F.col("e.message"), F.col("e.status"), F.col("e.code")).alias("type"))


@query(f"""{S.sql('notes')}, c AS (SELECT doc_id, ['read_note', 'grep', 'list_files'][doc_id % 3 + 1] AS tool, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN left(content, 40) ELSE '.' END AS arg FROM notes)
SELECT doc_id, tool || CASE WHEN coalesce(arg, '') = '' THEN '' WHEN tool = 'list_files' THEN ' /' WHEN tool = 'grep' AND length(arg) > 30 THEN ' ' || left(arg, 30) || '…' ELSE ' ' || arg END AS label FROM c""")
def tool_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 3
    tool = F.when(n == 0, "read_note").when(n == 1, "grep").otherwise("list_files")
    argument = F.when(n == 0, F.col("path")).when(n == 1, F.substr("content", F.lit(1), F.lit(40))).otherwise(".")
    return S.notes(spark, d).select("doc_id", T.tool_label(tool, argument, n != 1).alias("label"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"))


@query("SELECT doc_id, CASE WHEN n_chars % 101 >= 95 THEN 'danger' WHEN n_chars % 101 >= 80 THEN 'warning' ELSE 'normal' END AS band FROM documents")
def usage_bands(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.usage_band(F.col("n_chars") % 101).alias("band"))


@query("SELECT conv_id AS session_id, sum(length(text))::BIGINT AS size, count(*) FILTER (WHERE length(text) > 0) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def attachment_sum(spark: SparkSession, d: str) -> DataFrame:
    attached = S.messages(spark, d).where("role = 'user'").select("session_id", F.length("content").cast("long").alias("size"))
    return sessions.attachment_sums(attached)


@query("SELECT batch, pos, vec_id AS key FROM (SELECT vec_id // 16 AS batch, vec_id % 16 AS pos, vec_id FROM embeddings)")
def embedding_order(spark: SparkSession, d: str) -> DataFrame:
    mixed = S.items(spark, d).select(F.floor(F.col("id") / 16).cast("long").alias("batch"), F.struct((F.col("id") % 16).alias("index"), F.col("id").alias("value")).alias("part"))
    answers = mixed.groupBy("batch").agg(F.collect_list("part").alias("parts"))  # 16 parts at most
    return vectors.in_asked_order(answers).withColumnRenamed("value", "key")


@query("""WITH a AS (SELECT user_id, list_distinct(list(event_type)) AS types FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(types, lambda x: NOT list_contains(['click', 'view'], x))), ',') AS rest FROM a""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    types = S.table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return types.select("user_id", F.array_join(F.sort_array(F.array_except("types", F.array(F.lit("click"), F.lit("view")))), ",").alias("rest"))


@query("""WITH q AS (SELECT event_id AS id, user_id, ts, event_type FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id - 1 AS id, ts, event_type FROM events WHERE event_id % 6 = 1)
SELECT q.id, CASE WHEN r.id IS NULL THEN 'timeout' WHEN r.ts < q.ts OR r.ts > q.ts + INTERVAL 60 SECONDS THEN 'timeout' ELSE r.event_type END AS answer FROM q LEFT JOIN r USING (id)""")
def request_response(spark: SparkSession, d: str) -> DataFrame:
    return E.answered(*asked_and_answered(spark, d), 60)


def asked_and_answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "ts")
    return asked, events.where("event_id % 6 = 1").select((F.col("event_id") - 1).alias("id"), "ts", F.col("event_type").alias("answer"))


@query(ORACLE_SQL["request_response"])
def request_response_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from two streams in several micro-batches, run until the watermark has passed all."""
    asked, answers = (flows.replayed(flows.closed(x, -1 - i), "ts") for i, x in enumerate(asked_and_answered(spark, d)))
    return E.drained(flows.answered_stream(asked, answers, 60), spark).where("id >= 0")


@query(ORACLE_SQL["sse_parse"])
def sse_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The frames of sse_parse, from a stream of pieces of 1 to 40 bytes."""
    flows.rocks(spark)
    lines = flows.sse_lines(flows.replayed(flows.chunked(sse_streams(spark, d)), "seq"))
    return E.drained(sessions.parsed_lines(lines).select("stream_id", "ord", "content", "finish"), spark)


@query("""WITH c AS (SELECT event_id, user_id AS session_id, CASE event_type WHEN 'click' THEN 'read_note' WHEN 'view' THEN 'write_note' ELSE 'custom' END AS tool, 'n-' || user_id AS path FROM events)
SELECT event_id, CASE WHEN tool = 'write_note' AND session_id % 2 = 0 THEN 'allow' WHEN tool = 'read_note' THEN 'allow' ELSE 'ask' END AS decision FROM c""")
def permission_decide(spark: SparkSession, d: str) -> DataFrame:
    events = S.table(spark, d, "events")
    tool = F.when(F.col("event_type") == "click", "read_note").when(F.col("event_type") == "view", "write_note").otherwise("custom")
    calls = events.select("event_id", F.col("user_id").alias("session_id"), tool.alias("tool"), F.concat(F.lit("n-"), F.col("user_id").cast("string")).alias("path"))
    settings = spark.createDataFrame([("read_note", "allow"), ("write_note", "ask")], "tool string, permission string")
    grants = events.where("user_id % 2 = 0").select(F.col("user_id").alias("session_id"), F.concat(F.lit("write_note:n-"), F.col("user_id").cast("string")).alias("grant")).distinct()
    return sessions.decide(calls, settings, grants).select("event_id", "decision")


@query("""SELECT user_id AS call_id, NOT bool_or(event_type = 'error') AS allowed, 'hook ' || min(event_id) FILTER (WHERE event_type = 'error') AS reason FROM events GROUP BY user_id""")
def hook_chain(spark: SparkSession, d: str) -> DataFrame:
    allow = F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type") != "error")
    return sessions.first_denial(S.table(spark, d, "events").select(F.col("user_id").alias("call_id"), F.col("event_id").alias("ord"), allow.alias("allow"), F.concat(F.lit("hook "), F.col("event_id").cast("string")).alias("reason")))
