import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirebook.llm import negatives

LAST = 1 << 70


def brute(rows, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[1], LAST if r[0] is None else r[0])
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(kept[b][0], sum(x * y for x, y in zip(v, kept[b][2])), kept[b][1] == label) for b in range(len(kept)) if b != a]
        for p, ps, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            fit = sorted((r for r in scored if not r[2] and 30 * ps <= 100 * r[1] <= 90 * ps), key=order)[:10]
            out += [(i, p, rank, n, ps, ns) for rank, (n, ns, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash"))
    return sorted((tuple(r) for r in negatives.mine(docs, F.col("vec_id") % 100 == 0).collect()), key=str)


def made(n, seed, norms=(0.1, 4.0)):
    rng = random.Random(seed)
    return [(i, [round(rng.uniform(*norms) * rng.choice((-1, 1, 1)), 1) for _ in range(4)], rng.randrange(3)) for i in range(n)]


def test_ties_copies_nulls_and_lengths(spark):
    rows = made(900, 1) + [(200, [1.0, 1.0, 0.5, 0.0], 1)] * 9 + [(301, [2.0, 2.0, 2.0, 2.0], 2)] * 300
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], 1), (400, None, 1), (500, [1.0, None], 1), (600, [float("nan")] * 4, 1), (700, [1.0] * 4, None), (800, [3.0], 2), (800, [], 2), (-100, [1.0, 2.0, 3.0, 4.0, 5.0], 1)]
    random.Random(2).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_many_buckets_and_blocks_of_anchors(spark, monkeypatch):
    """With few leading buckets and several blocks, all bounds are at work."""
    monkeypatch.setattr(negatives, "LEAD", 3)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rows = made(2500, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # a bucket has no more rows than a batch
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor


def test_too_long_vectors_are_told(spark):
    with pytest.raises(Exception, match="too long"):
        run(spark, [(100, [1e9], 1), (1, [1.0], 1)])


def test_buckets_are_left_out():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(6000, 16)) * rng.lognormal(0, 1, 6000)[:, None] * 100).astype(np.int32)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(1))
    vectors = vectors[np.argsort(-norms)]
    norms = np.sort(norms)[::-1]
    labels = rng.integers(0, 3, 6000)
    search = negatives.Search(vectors[:200], labels[:200], 6, np.full((200, 1), -np.inf), None)
    for at in range(0, 6000, 100):
        search.bucket(norms[at], np.arange(at, at + 100), labels[at : at + 100], vectors[at : at + 100])
    assert search.multiplied < 0.5 * 200 * 6000
    scores = np.where(labels[:200, None] == labels, vectors[:200].astype(float) @ vectors.T.astype(float), -np.inf)
    assert (search.scores[0] == -np.sort(-scores, 1)[:, :6]).all()
