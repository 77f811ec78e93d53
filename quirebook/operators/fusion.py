"""Reciprocal rank fusion, reranking and citations over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(ranked: DataFrame, k: int = K, top: int | None = None) -> DataFrame:
    """(q, key, rrf_score, first, places, rank) from lists (q, list, pos, key, score) with places from 0: an item adds
    1 / (k + pos) for each place it has. Equal scores follow in the order of first appearance. places holds an
    item's lists and scores. One union and one aggregation, whatever the number of lists."""
    items = ranked.groupBy("q", "key").agg(
        F.round(F.sum(1.0 / (F.lit(float(k)) + F.col("pos"))), 12).alias("rrf_score"), F.min(F.struct("list", "pos")).alias("first"),
        F.sort_array(F.collect_list(F.struct("list", "pos", "score"))).alias("places"),
    )
    order = Window.partitionBy("q").orderBy(F.desc("rrf_score"), "first")
    out = items.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if top is None else out.where(F.col("rank") <= top)


def source_scores(fused: DataFrame, lists: int) -> DataFrame:
    """With source_scores, an array with the score in each of `lists` lists, null where the item is absent."""

    def of(i):
        mine = F.filter("places", lambda p: p["list"] == i)
        return F.try_element_at(mine, F.lit(-1))["score"]

    return fused.withColumn("source_scores", F.transform(F.sequence(F.lit(0), F.lit(lists - 1)), of))


def positions(scored: DataFrame, list_no: int) -> DataFrame:
    """A ranked list (q, key, score, rank) as one of the lists to fuse."""
    return scored.select("q", F.lit(list_no).alias("list"), (F.col("rank") - 1).alias("pos"), "key", "score")


def rerank(fused: DataFrame, reranked: DataFrame, top: int) -> DataFrame:
    """fused (q, key, rrf_score) with the scores of a reranker (q, key, score) where it gave one; sorted again."""
    met = fused.join(reranked.select("q", "key", F.col("score").alias("_rerank")), ["q", "key"], "left")
    out = met.select("q", "key", F.coalesce("_rerank", "rrf_score").alias("score"), F.col("_rerank").isNotNull().alias("reranked"))
    return cite(out).where(F.col("index") <= top)


def cite(results: DataFrame) -> DataFrame:
    """results (q, key, score, ...) with a citation number from 1 in each query."""
    return results.withColumn("index", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key")).cast("long"))


def lexical_score(query, content):
    """The default reranker: the share of the query's distinct words that the text holds."""
    from quirebook.functions.text import words

    asked = F.array_distinct(words(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words(content))) / F.size(asked))
