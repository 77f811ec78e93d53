"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm, from the greatest, and cut into buckets of up to BUCKET rows, each a row of a written
table. Anchors come in blocks of about ANCHORS, whose vectors are broadcast. By Cauchy-Schwarz no score in a bucket
exceeds |anchor| * (the bucket's greatest norm); an anchor leaves out a bucket where this is below what it needs: the
running k-th score and, for negatives, the lower limit of the positive's window. Each task goes through its buckets from
the greatest norm down. The LEAD buckets of the greatest norms go first as a job of their own, whose k-th scores every
task of the next job starts from; so a task sends on few rows that can't be among the final ones.

A first search finds each anchor's positives, a second one the negatives within the positives' windows; both end in a
ranking of an anchor's rows from all tasks. Scores are exact whole numbers, multiplied as floats, which hold them.

Defined cases: a row without label, without vector or with a null or non-finite component takes no part; a null id is no
anchor, keeps its label, and comes after all others in ties; a row of a repeated id is a row of its own, so each copy of
an anchor has positives and negatives of its own, and its copies are other rows to it; vectors of different lengths are
multiplied as if the shorter ended in zeros; a positive of negative score has an empty window; an empty table gives no
rows. A vector of norm 2^25.5 or more, whose scores floats may not hold exactly, raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirebook.llm.clusters import whole
from quirebook.llm.common import Scratch, read

BUCKET, LEAD = 2048, 32
#: Anchors of a block, and those multiplied with a bucket at once.
ANCHORS, TILE = 32_768, 512
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's, at least and at most.
LOWEST, HIGHEST = 30, 90
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SLACK = 1 + 1e-9


def prepare(docs: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, norm2): whole numbers, without rows that take no part."""
    rows = docs.where("label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding"), scale).alias("v")).where("v is not null")
    # so that every score is below 2^52 and floats hold it exactly
    fits = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < 2.0**51
    return rows.withColumn("norm2", F.when(fits, F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).otherwise(F.raise_error(F.lit("a vector is too long for exact scores")).cast("long")))


def _matrix(values: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, the shorter ones filled up with zeros."""
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(values.flatten())
    return out


def buckets(rows: DataFrame) -> DataFrame:
    """(norm, ids, labels, vectors): a row a bucket, norm its greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                v = part.column(2)
                vectors = _matrix(v, np.asarray(v.value_lengths(), np.int64))
                columns = [float(np.sqrt(max(part.column(3)[0].as_py(), 0))), np.asarray(part.column(0).fill_null(NO_ID), np.int64).tobytes(), np.asarray(part.column(1), np.int64).tobytes(), vectors.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], ["norm", "ids", "labels", "vectors"])

    # ranges of norms, equal norms dealt by a hash so that no range is larger than others
    dealt = rows.repartitionByRange(F.desc("norm2"), F.xxhash64("vec_id", "v")).sortWithinPartitions(F.desc("norm2"))
    return dealt.select("vec_id", "label", "v", "norm2").mapInArrow(run, "norm double, ids binary, labels binary, vectors binary")


def keep(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, found: np.ndarray, names: np.ndarray) -> None:
    """Puts found (a row for each of rows, a column for each of names; -inf: not wanted) into the k best of scores and ids
    by score, then smaller id. scores and ids are sorted and changed in place."""
    k = scores.shape[1]
    hit = found >= scores[rows, -1:]
    hit &= found > -np.inf
    if hit.sum() > 4 * k * len(rows) and found.shape[1] > k:
        hit &= found >= np.partition(found, found.shape[1] - k, 1)[:, -k, None]
    row, column = np.nonzero(hit)
    if not len(row):
        return
    touched = np.unique(row)
    each = np.concatenate([row, np.repeat(touched, k)])
    score = np.concatenate([found[row, column], scores[rows[touched]].ravel()])
    name = np.concatenate([names[column], ids[rows[touched]].ravel()])
    order = np.lexsort((name, -score, each))
    each, score, name = each[order], score[order], name[order]
    first = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
    rank = np.arange(len(each)) - np.repeat(first, np.diff(np.append(first, len(each))))
    best = rank < k
    scores[rows[each[best]], rank[best]], ids[rows[each[best]], rank[best]] = score[best], name[best]


class Search:
    """One block of anchors. limits None: rows of an anchor's label. Else (lowest, highest) of each anchor's slots: rows of
    other labels with scores within them. floor: of each anchor and slot, a score that k rows are known to reach."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, k: int, floor: np.ndarray, limits: tuple[np.ndarray, np.ndarray] | None):
        self.vectors, self.labels, self.k, self.floor, self.limits = vectors, labels, k, floor, limits
        self.norms = np.sqrt((vectors.astype(float) ** 2).sum(1)) * SLACK
        self.scores = [np.full((len(labels), k), -np.inf) for _ in range(floor.shape[1])]
        self.ids = [np.full((len(labels), k), NO_ID) for _ in range(floor.shape[1])]
        self.multiplied = 0

    def need(self, slot: int) -> np.ndarray:
        """The least score that can still count, by anchor."""
        least = np.maximum(self.floor[:, slot], self.scores[slot][:, -1])
        return least if self.limits is None else np.maximum(least, self.limits[0][:, slot])

    def product(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        width = min(self.vectors.shape[1], vectors.shape[1])
        self.multiplied += len(rows) * len(vectors)
        return self.vectors[rows, :width].astype(float) @ vectors[:, :width].astype(float).T

    def bucket(self, norm: float, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        reach = self.norms * norm * SLACK
        needs = [self.need(s) for s in range(self.floor.shape[1])]
        active = np.flatnonzero(np.any([reach >= n for n in needs], 0))
        if self.limits is None:
            active = active[np.isin(self.labels[active], labels)]
        for at in range(0, len(active), TILE):
            rows = active[at : at + TILE]
            found = self.product(rows, vectors)
            same = self.labels[rows, None] == labels
            for slot, need in enumerate(needs):
                wanted = same if self.limits is None else ~same & (found <= self.limits[1][rows, slot, None])
                wanted = wanted & (found >= need[rows, None])
                if wanted.any():
                    keep(self.scores[slot], self.ids[slot], rows, np.where(wanted, found, -np.inf), ids)

    def result(self) -> Iterator[pa.RecordBatch]:
        for slot, (scores, ids) in enumerate(zip(self.scores, self.ids)):
            anchor, place = np.nonzero(scores > -np.inf)
            if len(anchor):
                columns = [anchor.astype(np.int32), np.full(len(anchor), slot, np.int32), scores[anchor, place].astype(np.int64), ids[anchor, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "score", "id"])


def _search(table: DataFrame, anchors: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray, limits) -> DataFrame:
    """(anchor, slot, score, id): of each task, the best k rows of each anchor's slots."""
    shared = table.sparkSession.sparkContext.broadcast((*anchors, k, floor, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                search.bucket(row["norm"], ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1))
        yield from search.result()

    return table.select("norm", "ids", "labels", "vectors").mapInArrow(run, "anchor int, slot int, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(scratch: Scratch, name: str, lead: DataFrame, rest: DataFrame | None, anchors, k: int, floor: np.ndarray, limits) -> DataFrame:
    """The best k of each anchor and slot over all buckets, written."""
    first = scratch.write(f"{name}_lead", _best(_search(lead, anchors, k, floor, limits), k))
    if rest is None:
        return first
    known = first.where(F.col("rank") == k).select("anchor", "slot", "score").toArrow()
    floor = floor.copy()
    floor[np.asarray(known["anchor"]), np.asarray(known["slot"])] = np.asarray(known["score"])
    return scratch.write(name, _best(first.drop("rank").union(_search(rest, anchors, k, floor, limits)), k))


def _positives(found: pa.Table, ids: np.ndarray, norms2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (NONE: no such) and ids of each anchor's positives, from its best POSITIVES + 1 rows, of which one may be
    the anchor itself."""
    anchor, rank, score, name = (np.asarray(found[c]) for c in ("anchor", "rank", "score", "id"))
    order = np.lexsort((rank, anchor))
    anchor, score, name = anchor[order], score[order], name[order]
    itself = np.flatnonzero((name == ids[anchor]) & (score == norms2[anchor]))
    others = np.delete(np.arange(len(anchor)), itself[np.unique(anchor[itself], return_index=True)[1]])
    anchor, score, name = anchor[others], score[others], name[others]
    first = np.searchsorted(anchor, anchor)
    slot = np.arange(len(anchor)) - first
    kept = slot < POSITIVES
    scores, names = np.full((len(ids), POSITIVES), NONE), np.full((len(ids), POSITIVES), NO_ID)
    scores[anchor[kept], slot[kept]], names[anchor[kept], slot[kept]] = score[kept], name[kept]
    return scores, names


def mine(docs: DataFrame, is_anchor, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from docs (vec_id, embedding, label)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = prepare(docs, scale)
    table = scratch.write("buckets", buckets(rows).withColumn("bucket", F.monotonically_increasing_id()))
    top = [r["bucket"] for r in table.select("bucket", "norm").orderBy(F.desc("norm"), "bucket").limit(LEAD + 1).collect()]
    lead = table if len(top) <= LEAD else table.where(F.col("bucket").isin(top[:LEAD]))
    rest = None if len(top) <= LEAD else table.where(~F.col("bucket").isin(top[:LEAD]))
    # equal rows are one anchor, found once and given for each of them
    each = rows.where(is_anchor).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies"))
    each = scratch.write("anchors", each.withColumn("hash", F.xxhash64("vec_id", "label", "v")))
    blocks, out = -(-each.count() // ANCHORS), []
    for b in range(blocks):
        chosen = each.where(F.pmod("hash", F.lit(blocks)) == b).toArrow().combine_chunks()
        ids, labels, v = np.asarray(chosen["vec_id"], np.int64), np.asarray(chosen["label"], np.int64), chosen["v"].combine_chunks()
        vectors = _matrix(v, np.asarray(v.value_lengths(), np.int64)).astype(np.int32)
        norms2 = (vectors.astype(np.int64) ** 2).sum(1)
        k = POSITIVES + 1
        found = _found(scratch, f"positives_{b}", lead, rest, (vectors, labels), k, np.full((len(ids), 1), -np.inf), None)
        scores, names = _positives(found.toArrow().combine_chunks(), ids, norms2)
        limits = tuple(np.where(scores >= 0, x, np.inf) for x in (-(-LOWEST * scores // 100), HIGHEST * scores // 100))
        found = _found(scratch, f"negatives_{b}", lead, rest, (vectors, labels), NEGATIVES, np.full(scores.shape, -np.inf), limits)
        anchor, slot = np.nonzero(scores >= 0)
        about = pa.table({"anchor": pa.array(anchor, pa.int32()), "slot": pa.array(slot, pa.int32()), "anchor_id": ids[anchor], "copies": np.asarray(chosen["copies"], np.int64)[anchor], "positive_id": pa.array(names[anchor, slot], mask=names[anchor, slot] == NO_ID), "positive_score": scores[anchor, slot]})
        if not len(anchor):
            continue
        # POSITIVES rows an anchor of the block at most
        named = found.join(F.broadcast(spark.createDataFrame(about)), ["anchor", "slot"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        result = named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != int(NO_ID), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(scratch.write(f"found_{b}", result) if blocks > 1 else result)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out[0] if len(out) == 1 else spark.read.schema(out[0].schema).parquet(*(f"{scratch.root}/found_{b}" for b in range(len(out))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_negatives: see the README for its columns."""
    docs = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(docs.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS row,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT, 0) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
