"""Vector functions and exact nearest neighbours.

A batch of queries is one matrix, shipped to the tasks in blocks of at most BLOCK numbers; each Arrow batch of vectors
is multiplied with it and keeps its own k best for each query, so that what is shuffled is k rows for each query and
batch, and no pair of query and vector ever becomes a row. Of several blocks one is in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirebook.operators.lexical import top
from quirebook.sources import scratch

BLOCK = 8_000_000
#: Scores that a task holds at once.
TILE = 4_000_000
DIGITS = 9


def _d(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Fails on vectors of different lengths; 0 with a zero vector."""
    size = F.when(F.size(_d(a)) != F.size(_d(b)), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    n = norm(a) * norm(b)
    return F.coalesce(size, F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once a row: what a lambda takes from outside is otherwise worked out again for
    each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(a: Column | str) -> Column:
    return _let(_d(a), lambda v: _let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))))


def checked(a: Column | str, size: int) -> Column:
    """The vector; fails unless it has the given length."""
    v = F.col(a) if isinstance(a, str) else a
    return F.when(F.size(v) == size, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {size} numbers, got "), F.size(v).cast("string"))))


def mean_pool(states: Column, mask: Column) -> Column:
    """The normalised mean of the token vectors whose mask is not 0."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda t: t["m"] != 0), lambda t: _d(t["v"]))
    zero = F.transform(_d(F.get(states, F.lit(0))), lambda x: x * 0)

    def mean(vs: Column) -> Column:
        total = F.aggregate(vs, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        return F.transform(total, lambda x: F.when(F.size(vs) == 0, 0.0).otherwise(x / F.size(vs)))

    return l2_normalize(_let(kept, mean))


def _blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Queries with a vector, in blocks; fails if their lengths differ."""
    ids, rows, held = [], [], 0
    for r in queries.select("q", _d("vector").alias("vector")).where("vector is not null").toLocalIterator():
        ids.append(r["q"])
        rows.append(r["vector"])
        held += len(r["vector"])
        if held >= BLOCK:
            yield ids, np.array(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield ids, np.array(rows)


def knn(queries: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(q, key, score, rank): the k items (key, vector) of the highest cosine for each query (q, vector), ranked from
    1; scores are rounded to nine digits, equal ones go by key. Null vectors neither ask nor are found; vectors of
    different lengths fail."""
    types = {"q": queries.schema["q"].dataType.simpleString(), "key": items.schema["key"].dataType.simpleString()}
    schema = f"q {types['q']}, key {types['key']}, score double"
    q_type, found, blocks = to_arrow_type(queries.schema["q"].dataType), None, _blocks(queries)
    block = next(blocks, None)
    while block is not None:
        (ids, matrix), block = block, next(blocks, None)
        shared = items.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                vectors = batch.column(1)
                if pc.any(pc.not_equal(pc.list_value_length(vectors), q.shape[1])).as_py():
                    raise ValueError("vectors differ in length")
                x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                keys = np.argsort(np.argsort(np.array(batch.column(0).to_pylist()), kind="stable"), kind="stable")
                n = min(k, batch.num_rows)
                tile = max(1, TILE // batch.num_rows)
                for first in range(0, len(q), tile):
                    scores = np.round(q[first : first + tile] @ x.T, DIGITS)
                    best = np.empty((len(scores), n), np.int64)
                    for i, row in enumerate(scores):  # the n best and their equals, of which the keys' order decides
                        near = np.flatnonzero(row >= np.partition(row, len(row) - n)[len(row) - n])
                        best[i] = near[np.lexsort((keys[near], -row[near]))[:n]]
                    qs = pa.array([q_ids[first + i] for i in range(len(scores)) for _ in range(n)], q_type)
                    yield pa.RecordBatch.from_arrays([qs, batch.column(0).take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, 1).ravel())], ["q", "key", "score"])

        part = items.select("key", "vector").mapInArrow(run, schema)
        if found is not None or block is not None:  # of several blocks, each is answered before the next is sent
            folder = scratch.folder(items.sparkSession)
            top(part, k).select("q", "key", "score").write.parquet(folder)
            shared.destroy()
            part = items.sparkSession.read.schema(schema).parquet(folder)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = items.sparkSession.createDataFrame([], schema)
    return top(found, k)


def best_chunk(hits: DataFrame) -> DataFrame:
    """Of the hits (q, document, key, score) of each query and document the best; of equal ones the least key."""
    best = F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), F.col("key"))).alias("best")
    return hits.where("document is not null").groupBy("q", "document").agg(best).select("q", "document", "best.key", "best.score")


def in_asked_order(answers: DataFrame) -> DataFrame:
    """(batch, pos, value): the parts (index, value) of each batch's answer in the order of their index, which a
    service need not keep."""
    return answers.select("batch", F.posexplode(F.transform(F.array_sort("parts"), lambda p: p["value"])).alias("pos", "value"))


def similar_pairs(items: DataFrame, k: int, least: float, size: int = 2048, groups: int = 8) -> DataFrame:
    """(key, other, score, rank): of each item (key, vector) the k others of the highest cosine, those of `least` or more;
    scores are rounded to nine digits, equal ones go by key. Null vectors have no partner.

    Items are packed into blocks of up to `size` vectors, and blocks into groups. A grid of groups x groups cells gets each
    block once a row and once a column of cells, and a cell multiplies its blocks pair by pair: a row is a pair of blocks,
    and of its products only the k best of each item leave it. More data want more groups."""
    kind = items.schema["key"].dataType.simpleString()
    key_type = to_arrow_type(items.schema["key"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes()])], ["keys", "x"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, others = batch.column(0)[row].values, batch.column(2)[row].values
                x, y = (np.frombuffer(batch.column(i)[row].as_py()).reshape(len(v), -1) for i, v in ((1, keys), (3, others)))
                if x.shape[1] != y.shape[1]:
                    raise ValueError("vectors differ in length")
                names, mine = np.array(others.to_pylist()), keys.to_pylist()
                order = np.argsort(np.argsort(names, kind="stable"), kind="stable")
                a, b, scores = [], [], []
                for first in range(0, len(x), max(1, TILE // len(y))):
                    part = np.round(x[first : first + max(1, TILE // len(y))] @ y.T, DIGITS)
                    for i, found in enumerate(part, first):
                        near = np.flatnonzero(found >= least)
                        near = near[names[near] != mine[i]]
                        near = near[np.lexsort((order[near], -found[near]))[:k]]
                        a += [i] * len(near)
                        b += near.tolist()
                        scores += found[near].tolist()
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(a, pa.int64())), others.take(pa.array(b, pa.int64())), pa.array(scores, pa.float64())], ["key", "other", "score"])

    blocks = items.select("key", _d("vector").alias("vector")).where("vector is not null").mapInArrow(pack, f"keys array<{kind}>, x binary")
    placed = blocks.withColumn("group", F.pmod(F.xxhash64("keys"), F.lit(groups)))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = placed.select("keys", "x", "group", every.alias("column")).select("keys", "x", (F.col("group") * groups + F.col("column")).alias("cell"))
    right = placed.select(F.col("keys").alias("others"), F.col("x").alias("y"), "group", every.alias("line")).select("others", "y", (F.col("line") * groups + F.col("group")).alias("cell"))
    found = left.join(right.hint("shuffle_hash"), "cell").select("keys", "x", "others", "y").mapInArrow(products, f"key {kind}, other {kind}, score double")
    ranked = top(found.select(F.col("key").alias("q"), F.col("other").alias("key"), "score"), k)
    return ranked.select(F.col("q").alias("key"), F.col("key").alias("other"), "score", "rank")
