"""Logical tables of the engine over the benchmark tables. Each has an expression of the same meaning in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_path(source: str = "source", lang: str = "lang", doc: str = "doc_id"):
    return F.concat_ws("/", source, lang, F.concat(F.lit("doc-"), F.col(doc).cast("string"), F.lit(".md")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, content, tag)"""
    return table(spark, sf_dir, "documents").select("doc_id", note_path().alias("path"), F.col("text").alias("content"), F.col("lang").alias("tag"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label)"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): links of pages, counted."""
    found = table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, ord, role, content)"""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, seq, path, op)"""
    path = F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "events").select("ts", F.col("event_id").alias("seq"), path.alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))


def text_queries(spark: SparkSession, sf_dir: str, first: int = 1) -> DataFrame:
    """(q, text): the stated query set, every hundredth benchmark item, from its first-th word on."""
    words = F.split("text", r"\s+")
    return table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("q"), F.array_join(F.slice(words, first, F.size(words)), " ").alias("text"))


def vector_queries(spark: SparkSession, sf_dir: str, every: int = 100) -> DataFrame:
    """(q, vector): the stated query set, every hundredth item."""
    return items(spark, sf_dir).where(F.col("id") % every == 0).select(F.col("id").alias("q"), "vector")


#: The same tables as common table expressions.
SQL = {
    "notes": "notes AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text AS content, lang AS tag FROM documents)",
    "items": "items AS (SELECT vec_id AS id, embedding AS vector, label::BIGINT AS label FROM embeddings)",
    "links": "links AS (SELECT src, dst, count(*) AS n FROM (SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages) GROUP BY src, dst)",
    "messages": "messages AS (SELECT conv_id AS session_id, turn AS ord, role, text AS content FROM conversations)",
    "file_events": "file_events AS (SELECT ts, event_id AS seq, 'user-' || user_id || '.md' AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events)",
    "text_queries": r"text_queries AS (SELECT item_id AS q, array_to_string(regexp_split_to_array(text, '\s+'), ' ') AS text FROM benchmark WHERE item_id % 100 = 0)",
    "vector_queries": "vector_queries AS (SELECT vec_id AS q, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0)",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
