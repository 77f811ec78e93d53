"""Keyword search: BM25 over words, for batches of queries.

Only postings of words that some query asks for are made, so what is shuffled follows the queries' words and not the
corpus. One pass over the texts, in Arrow batches, counts the words of each that some query asks for, and the length of
all; what it gives is written once, and the rest reads that. More than BROADCAST query words go by joins instead."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.sources import scratch

K1, B = 1.2, 0.75
#: Query words that are broadcast, and the parts of a bucket of the index, over which a hot word's postings spread.
BROADCAST, SPLIT = 500_000, 8
#: Query words that are pushed down to the index's files.
PUSHED = 2_000


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, cf) over docs (key, content): documents with the term, and its occurrences."""
    each = docs.select("key", F.explode(T.words(F.col("content"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, key, len, tf) of docs (key, content): of all words, or of the words in terms (term)."""
    words = docs.select("key", T.words(F.col("content")).alias("words"))
    each = words.select("key", F.size("words").alias("len"), F.explode("words").alias("term"))
    if terms is not None:
        each = each.join(terms.select("term").distinct(), "term")
    return each.groupBy("term", "key", "len").agg(F.count("*").alias("tf"))


def corpus(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avg_len)."""
    return docs.select(F.size(T.words(F.col("content"))).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(q, term): a query's repeated words count once."""
    return queries.select("q", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))


def scored(terms: DataFrame, found: DataFrame, total: DataFrame, k: int, few: bool | None = None) -> DataFrame:
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    if few or few is None and terms.limit(BROADCAST + 1).count() <= BROADCAST:  # a word in every document is one key: no shuffle by words
        terms, df = F.broadcast(terms), F.broadcast(df)
    weights = found.join(df, "term").join(F.broadcast(total)).select("term", "key", (idf * F.col("tf") * (K1 + 1) / norm).alias("w"))
    return top(terms.join(weights, "term").groupBy("q", "key").agg(F.round(F.sum("w"), 6).alias("score")), k)


def matched(docs: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, len, tf) of terms in docs, and the one row of corpus, from one pass over the texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(terms))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, find = shared.value, re.compile(T.WORD).findall
        for batch in batches:
            lengths, found = [], []
            for text in batch.column(1):
                words = find(text.as_py().lower()) if text.is_valid else []
                lengths.append(len(words) if text.is_valid else None)
                found.append(list(Counter(filter(asked.__contains__, words)).items()))
            columns = [batch.column(0), pa.array(lengths, pa.int32()), pa.array(found, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "len", "hits"])

    folder = scratch.folder(spark)
    docs.select("key", "content").mapInArrow(run, f"key {kind}, len int, hits map<string, bigint>").write.parquet(folder)
    rows = spark.read.parquet(folder)
    total = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    return rows.select("key", "len", F.explode("hits").alias("term", "tf")).select("term", "key", "len", "tf"), total


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """(q, key, score, rank): the k best documents (key, content) of each query (q, text), ranked from 1, equal scores
    by key, straight from the texts."""
    terms = query_terms(queries)
    asked = [r["term"] for r in terms.select("term").distinct().limit(BROADCAST + 1).collect()]
    if len(asked) > BROADCAST:
        return scored(terms, postings(docs, terms), corpus(docs), k, False)
    found, total = matched(docs, asked)
    return scored(terms, found, total, k, True)


class Index:
    """Postings as a Parquet table, partitioned by a hash of the term: a search reads the partitions of its terms. A build
    goes to a folder of its own and counts once it is whole; a search meanwhile, or after a build that failed, reads the
    one before, which the next build clears."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._system = self._fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets))

    def _builds(self, whole: bool) -> list[int]:
        found = self._system.globStatus(self._fs.Path(f"{self.path}/build-*" + "/corpus/_SUCCESS" * whole)) or ()
        return sorted(int(re.search(r"build-(\d+)", f.getPath().toString())[1]) for f in found)

    def _at(self, build: int) -> str:
        return f"{self.path}/build-{build:08d}"

    def build(self, docs: DataFrame) -> Index:
        whole, every = self._builds(True), self._builds(False)
        for old in every:
            if old not in whole[-1:]:
                self._system.delete(self._fs.Path(self._at(old)), True)
        at = self._at(max(every, default=0) + 1)
        made = postings(docs).withColumn("bucket", self._bucket())
        made.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPLIT))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        corpus(docs).write.parquet(f"{at}/corpus")  # the last thing: with it the build is whole
        return self

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        at, terms = self._at(self._builds(True)[-1]), query_terms(queries)
        asked = terms.select("term", self._bucket().alias("bucket")).distinct().limit(PUSHED + 1).collect()
        found = self.spark.read.parquet(f"{at}/postings")
        if len(asked) <= PUSHED:  # files are sorted by term, so that most of their row groups are passed over
            found = found.where(F.col("bucket").isin({r["bucket"] for r in asked}) & F.col("term").isin([r["term"] for r in asked]))
        else:
            needed = [r[0] for r in terms.select(self._bucket()).distinct().collect()]  # `buckets` numbers at most
            found = found.where(F.col("bucket").isin(needed)).join(terms.select("term").distinct(), "term", "left_semi")
        return scored(terms, found.drop("bucket"), self.spark.read.parquet(f"{at}/corpus"), k, len(asked) <= PUSHED or None)


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best (q, key, score) of each q, with their rank."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
