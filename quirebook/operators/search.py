"""Search: keyword and vector lists of each query variant, fused, reranked and cited in one plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import fusion, lexical, vectors
from quirebook.sources import scratch

#: Hits, with their queries' texts, that are broadcast.
BROADCAST = 20_000


def hybrid(text_queries: DataFrame, vector_queries: DataFrame, docs: DataFrame, items: DataFrame, k: int = 10, candidates: int = 20) -> DataFrame:
    """(q, key, score, index): BM25 over docs (key, content) and cosine over items (key, vector), each with its best
    candidates, fused. A query without a word of the corpus has the vector list alone, and the other way round."""
    return _fused([lexical.bm25(text_queries, docs, candidates), vectors.knn(vector_queries, items, candidates)], k)


def _fused(ranked: list[DataFrame], k: int) -> DataFrame:
    lists = reduce(DataFrame.unionByName, (fusion.positions(x, i) for i, x in enumerate(ranked)))
    fused = fusion.rrf(lists, top=k)
    return fused.select("q", "key", F.col("rrf_score").alias("score"), F.col("rank").alias("index"))


def hybrid_or_vectors(text_queries: DataFrame, vector_queries: DataFrame, docs: DataFrame, items: DataFrame, k: int = 10, candidates: int = 20) -> tuple[DataFrame, Exception | None]:
    """hybrid, and None; or where the keyword list can't be made (texts can't be read, say), the vector list alone by its
    cosine, and the error. The keyword list is made here, so that its errors are met here."""
    try:
        folder = scratch.folder(text_queries.sparkSession)
        lexical.bm25(text_queries, docs, candidates).write.parquet(folder)
    except Exception as error:  # noqa: BLE001  whatever it is, vectors may still answer
        warnings.warn(f"searching by vectors alone: {error}", stacklevel=2)
        return vectors.knn(vector_queries, items, k).withColumnRenamed("rank", "index"), error
    return _fused([text_queries.sparkSession.read.parquet(folder), vectors.knn(vector_queries, items, candidates)], k), None


def variants(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """(q, variant, text): the query itself (variant 0) and up to two rewrites from a model's answers (q, answer)."""
    met = queries.join(answers, "q", "left")
    texts = F.concat(F.array(F.col("text")), T.parse_rewrites(F.col("answer")))
    return met.select("q", F.posexplode(texts).alias("variant", "text"))


def multi_query(asked: DataFrame, docs: DataFrame, k: int = 5, overfetch: int = 2, vector_queries: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(q, key, rrf_score, first, places, rank): hybrid search for each variant (q, variant, text) with its vector in
    vector_queries (q, variant, vector), twice as deep as asked, fused over variants; first is the list and place where
    a key was seen first, places its lists with their scores. Without vectors, keyword search. All variants of all
    queries run in one plan; a variant without words or vector (whose embedding failed, say) adds nothing."""
    each = asked.select(F.struct("q", "variant").alias("q"), "text")
    if vector_queries is None:
        found = lexical.bm25(each, docs, k * overfetch).withColumnRenamed("rank", "index")
    else:
        found = hybrid(each, vector_queries.select(F.struct("q", "variant").alias("q"), "vector"), docs, items, k * overfetch, 2 * k * overfetch)
    lists = found.select(F.col("q.q").alias("q"), F.col("q.variant").alias("list"), (F.col("index") - 1).alias("pos"), "key", "score")
    return fusion.rrf(lists, top=k)


def search(queries: DataFrame, docs: DataFrame, k: int = 5, reranker: Callable | None = fusion.lexical_score, vector_queries: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(q, key, score, reranked, index) for queries (q, variant, text); the original variant's text is reranked
    against the documents' whole texts. Where the reranker gives null, the fused score stays. Results are keys and
    scores, never texts."""
    fused = multi_query(queries, docs, k, 2, vector_queries, items).select("q", "key", "rrf_score")
    if reranker is None:
        return fusion.rerank(fused, fused.select("q", "key", F.col("rrf_score").alias("score")).limit(0), k)
    folder = scratch.folder(queries.sparkSession)  # used twice, and made once
    fused.write.parquet(folder)
    fused = queries.sparkSession.read.parquet(folder)
    original = queries.where("variant = 0").select("q", "text")
    asked = fused.join(original, "q")
    # few hits are sent to the texts, instead of all texts to the hits
    asked = F.broadcast(asked) if fused.count() <= BROADCAST else asked
    scored = docs.join(asked, "key").select("q", "key", F.round(reranker(F.col("text"), F.col("content")), 9).alias("score"))
    return fusion.rerank(fused, scored, k)


def flatten_results(results: DataFrame) -> DataFrame:
    """(doc_id, path, score, reranked) of results (doc_id, score, metadata, reranked): those whose metadata has no
    path as a string are dropped."""
    return results.select("doc_id", T.tool_path(F.col("metadata")).alias("path"), "score", F.coalesce("reranked", F.lit(False)).alias("reranked")).where("path is not null")


def filtered(items: DataFrame, tags: Iterable[str] = (), prefix: str = "") -> DataFrame:
    """items (path, tags, ...) with a tag of tags, if any is asked for, below prefix. Runs before scoring."""
    tags = list(tags)
    some = F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(True)
    return items.where(some & F.col("path").startswith(prefix))
