"""Centroid clustering (k-means) with exact whole numbers, by Exponion search.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to any other.
A round moves the bounds by how far the centroids moved. Only where the upper bound isn't below the lower one, nor below
half the way from the centroid to its nearest neighbour, is the distance worked out; and only where it still isn't, are
other centroids looked at: those within 2 * upper + (distance to the nearest neighbour) around the vector's own centroid,
a prefix of the sorted list of distances between centroids. The radius is inclusive and bounds are rounded outwards, so
that ties are seen and go to the smaller number. Distances that decide are exact whole numbers.

A vector's state travels in blocks of up to BLOCK vectors, one row each: ids, vectors, centroids and bounds as bytes, and
the sums by which the block changes the centroids' totals. A round reads the blocks, writes the next ones to the shared
folder (which cuts lineage), and then adds up nothing but the columns of changes, a row a task. The driver holds the k
centroids and their totals.

Defined cases: rows whose vector is null, has another length or a null or non-finite component are left out; a null id
counts as the empty text where the first centroids are chosen, and equal ids are told apart by their vectors; with fewer
vectors than k, each is a centroid (equal vectors too: the later of two equal centroids stays empty); repeated rows are
each a vector; an empty table gives no rows. Components so large that a distance may not fit a long raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirebook.llm.common import Scratch, read

BLOCK = 4096
#: Bounds are widened by this share, so that rounding can't make them wrong.
SLACK = 1e-9
ROWS = "ids binary, nulls binary, vectors binary, cluster binary, upper binary, lower binary, changes array<long>, looked long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs (null where one is null or not finite)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    # a component beyond the longs would be cut off by the cast
    return F.when(fine, F.when(F.exists(vector, lambda x: F.abs(x.cast("double") * scale) > 2.0**52), F.raise_error(F.lit("a component is too large for whole numbers")).cast("array<long>")).otherwise(scaled))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors (vec_id, v) of the k smallest hashes of seed and id, in their order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(text, 256), "v").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Centroids:
    """Centroids and, of each, the others by distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        apart = np.sqrt(((values[:, None, :] - values[None, :, :]).astype(float) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, 1, kind="stable")[:, :-1]
        self.apart = np.take_along_axis(apart, self.order, 1) * (1 - SLACK)
        self.nearest = self.apart[:, 0] if len(values) > 1 else np.full(len(values), np.inf)

    def squared(self, vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        away = vectors - self.values[cluster]
        return np.einsum("ij,ij->i", away, away)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroids and bounds, and how many distances to other centroids were worked out."""
        cluster, upper, lower, looked = cluster.copy(), upper.copy(), lower.copy(), 0
        safe = np.maximum(lower, self.nearest[cluster] / 2)
        doubt = np.flatnonzero(upper >= safe)
        upper[doubt] = np.sqrt(self.squared(vectors[doubt], cluster[doubt])) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= safe[doubt]]
        for own in np.unique(cluster[doubt]):
            rows = doubt[cluster[doubt] == own]
            radius = 2 * upper[rows] + self.nearest[own]
            # each row looks at a prefix of the list: the number of centroids inside its ball
            inside = np.searchsorted(self.apart[own], radius, "right")
            best, number = self.squared(vectors[rows], cluster[rows]), cluster[rows].copy()
            second = np.full(len(rows), np.inf)
            for place in range(inside.max(initial=0)):
                near = np.flatnonzero(inside > place)
                other = self.order[own, place]
                looked += len(near)
                found = self.squared(vectors[rows[near]], np.full(len(near), other))
                better = (found < best[near]) | ((found == best[near]) & (other < number[near]))
                second[near] = np.minimum(second[near], np.where(better, best[near], found))
                best[near], number[near] = np.where(better, found, best[near]), np.where(better, other, number[near])
            # what lies outside of the ball is at least radius - upper away from the vector
            outside = np.where(inside < self.apart.shape[1], radius - upper[rows], np.inf)
            upper[rows] = np.sqrt(best) * (1 + SLACK)
            lower[rows] = np.minimum(np.sqrt(second), outside) * (1 - SLACK)
            cluster[rows] = number
        return cluster, upper, lower, looked


def _changes(k: int, width: int, vectors: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Counts and sums by which centroids' totals change; before -1: was in none."""
    out = np.zeros((k, width + 1), np.int64)
    moved = before != after
    rows = np.hstack([np.ones((moved.sum(), 1), np.int64), vectors[moved]])
    np.add.at(out, after[moved], rows)
    was = before[moved] >= 0
    np.subtract.at(out, before[moved][was], rows[was])
    return out


def _batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.binary()] * 6 + [pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(columns, kinds)], ["ids", "nulls", "vectors", "cluster", "upper", "lower", "changes", "looked"])


def _start(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of (vec_id, v), assigned with every centroid looked at."""
    k, width = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(shared.value)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                ids = batch.column(0)
                values = np.asarray(batch.column(1).flatten()).reshape(-1, width)
                n = len(values)
                cluster, upper, lower, looked = near.assign(values, np.zeros(n, np.int16), np.full(n, np.inf), np.zeros(n))
                nulls = np.asarray(ids.is_null())
                yield _batch([np.asarray(ids.fill_null(0), np.int64).tobytes(), np.packbits(nulls).tobytes(), values.tobytes(), cluster.tobytes(), upper.tobytes(), lower.tobytes(), _changes(k, width, values, np.full(n, -1), cluster).ravel().tolist(), looked])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, ROWS)


def _step(blocks: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """Blocks assigned anew, after the centroids went from before to after."""
    k, width = after.shape
    shared = blocks.sparkSession.sparkContext.broadcast((before, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        near = Centroids(after)
        moved = np.sqrt(((after - before).astype(float) ** 2).sum(1)) * (1 + SLACK)
        # of the other centroids, the one that moved furthest can have come that much nearer
        others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.int64).reshape(-1, width)
                cluster = np.frombuffer(row["cluster"], np.int16)
                upper = (np.frombuffer(row["upper"]) + moved[cluster]) * (1 + SLACK)
                lower = np.frombuffer(row["lower"]) * (1 - SLACK) - others[cluster]
                now, upper, lower, looked = near.assign(vectors, cluster, upper, lower)
                yield _batch([row["ids"], row["nulls"], row["vectors"], now.tobytes(), upper.tobytes(), lower.tobytes(), _changes(k, width, vectors, cluster, now).ravel().tolist(), looked])

    return blocks.mapInArrow(run, ROWS)


def _summed(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The blocks' changes in all: each task adds up its own."""
    k, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (width + 1), np.int64)
        for batch in batches:
            total += np.asarray(batch.column(0).flatten()).reshape(-1, len(total)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "n"])

    rows = blocks.select("changes").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * (width + 1), np.int64)
    for r in rows:
        out[r["place"]] = r["n"]
    return out.reshape(k, width + 1)


def kmeans(docs: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for each vector of docs (vec_id, embedding) with width components, and the final
    centroids. Components are floor(scale * x)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    vectors = docs.where(F.size("embedding") == width).select("vec_id", whole(F.col("embedding"), scale).alias("v")).where("v is not null")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, width), np.int64)
    largest = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0]
    if width * (2 * largest) ** 2 >= 1 << 63:
        raise OverflowError("a squared distance may not fit a long")
    blocks = scratch.write("0", _start(vectors, centroids))
    totals = np.zeros((len(centroids), width + 1), np.int64)
    for i in range(1, rounds + 1):
        totals += _summed(blocks, centroids.shape)
        after = np.where(totals[:, :1] > 0, totals[:, 1:] // np.maximum(totals[:, :1], 1), centroids)
        blocks = scratch.write(str(i), _step(blocks, centroids, after))
        scratch.drop(str(i - 1))
        centroids = after
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(ids)).astype(bool)
                cluster = np.frombuffer(row["cluster"], np.int16)
                far = near.squared(np.frombuffer(row["vectors"], np.int64).reshape(-1, width), cluster)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "nulls", "vectors", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_clusters: see the README for its columns."""
    found, centroids = kmeans(read(spark, sf_dir, "embeddings"))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    if len(centroids):
        named = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, components string")
    else:
        named = spark.createDataFrame([], "cluster int, components string")
    # one row a centroid on either side, k at most
    about = named.join(inertia, "cluster").select("cluster", "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same by brute force, a round after the other."""
    assigned = """
a{i} AS MATERIALIZED (SELECT vec_id, v, row, min({{'d': d, 'c': c}}).c AS c, min(d) AS d FROM (
  SELECT x.vec_id, x.v, x.row, z.c, list_sum(list_transform(list_zip(x.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors x, c{i} z) GROUP BY ALL)"""
    moved = """
c{j} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM c{i} z LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS v FROM (
    SELECT c, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i}) GROUP BY c, place) GROUP BY c) m USING (c))"""
    steps = ",".join(assigned.format(i=i) + ("," + moved.format(i=i, j=i + 1) if i < rounds else "") for i in range(rounds + 1))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v FROM vectors
  ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v LIMIT {k}),{steps}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} z USING (c)"""


SQL = _sql()
