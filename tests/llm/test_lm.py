import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirebook.llm import lm
from quirebook.llm.common import Scratch, pack, unpack


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def mod(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7


class Brute:
    """The same model over plain counters."""

    def __init__(self, rows, training, held):
        self.full, self.held = (Counter(), Counter()), (Counter(), Counter())
        for d, text in rows:
            if training(d):
                self.add(self.full, text)
                if held(d):
                    self.add(self.held, text)
        self.n, self.v = sum(self.full[0].values()), len(self.full[0])
        cells = Counter()
        for d, text in rows:
            if training(d) and held(d):
                for a, b in self.steps(text):
                    c = [self.full[i][x] - self.held[i][x] for i, x in ((0, a), (1, (a, b)), (0, b))]
                    p = self.parts(*c, self.n - sum(self.held[0].values()))
                    cells[(math.ceil(math.log2(c[0] + 1)), *(round(-lm.STEPS * math.log2(x)) if x else -1 for x in p[:2]))] += 1
        self.weights = lm.mixture(np.array([(*k, n) for k, n in cells.items()]).reshape(-1, 4), self.v)

    @staticmethod
    def steps(text):
        t = tokens(text)
        return list(zip([b" ", *t], t))

    def add(self, counts, text):
        for a, b in self.steps(text):
            counts[0][b] += 1
            counts[1][a, b] += 1

    def parts(self, context, pair, word, n):
        uniform = 1 / (self.v + 1)
        single = word / n if n else uniform
        return pair / context if context else single, single, uniform

    def p(self, a, b):
        context = self.full[0][a]
        w = self.weights[math.ceil(math.log2(context + 1))]
        return sum(x * y for x, y in zip(w, self.parts(context, self.full[1][a, b], self.full[0][b], self.n)))

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.full[0][x] + 1) / (self.n + self.v + 1)) for x in t)
        return len(t), sum(self.full[0][x] > 0 for x in t), self.n, base, sum(math.log10(self.p(a, b)) for a, b in self.steps(text))


def same(got, want):
    return tuple(got[:3]) == want[:3] and all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) for a, b in zip(got[3:], want[3:]))


def test_query_against_brute_force(spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    brute = Brute(rows, lambda d: mod(d) != 2, lambda d: mod(d) == 3)
    texts = dict(rows)
    for chunk, size in ((lm.CHUNK, lm.RANGE_BYTES), (3000, 20_000)):  # one chunk, or many that meet in many ranges
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "RANGE_BYTES", size)
        got = lm.query(spark, sf).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        for r in got:
            assert r.held_out == (mod(r.doc_id) == 2) and same(r[2:], brute.row(texts[r.doc_id]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 100  # the model beats its base


def test_probabilities_sum_to_one():
    rows = [(i, " ".join(f"w{(i * j) % 13}" for j in range(i % 9))) for i in range(200)]
    brute = Brute(rows, lambda d: True, lambda d: d % 5 == 0)
    for a in (b" ", b"w1", b"w12", b"never"):
        assert math.isclose(sum(brute.p(a, b) for b in brute.full[0]) + brute.p(a, b"unseen"), 1)


def test_weights_are_learned():
    good = np.array([(10, 4, 40, 900), (10, -1, 40, 100), (3, -1, 20, 500), (3, 2, 20, 1)])
    weights = lm.mixture(good, 1000)
    assert weights[10, 0] > 0.85 and weights[3, 0] < 0.1 and np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(lm.mixture(np.empty((0, 4)), 10), 1 / 3)


def test_packing_is_reversible():
    rng = np.random.default_rng(1)
    for values in ([], [0], [1 << 63, 5, (1 << 64) - 1], rng.integers(0, 1 << 40, 1000), rng.integers(0, 3, 1000)):
        values = np.array(values, np.uint64)
        assert (unpack(pack(values)) == values).all()


def test_defined_cases(spark):
    rows = [(1, "A b c"), (1, "A b c"), (2, None), (3, ""), (4, "zzz " * 30_000), (None, "a b"), (5, "b a\x00 É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("chunk", F.lit(1))
    for training, held in ((F.lit(True), F.col("doc_id").eqNullSafe(4)), (F.col("text") == "A b c", F.lit(False)), (F.lit(True), F.lit(True)), (F.lit(False), F.lit(True))):
        training = F.coalesce(training, F.lit(False))
        got = lm.score(docs, training, held, lm.train(docs, training, held, Scratch(spark))).collect()
        chosen = {(r[0], r[1]): (r.t, r.h) for r in docs.select("doc_id", "text", training.alias("t"), held.alias("h")).collect()}
        brute = Brute([((d, t), t) for d, t in rows], lambda d: chosen[d][0], lambda d: chosen[d][1])
        want = sorted(((d, *brute.row(t)) for d, t in rows), key=str)
        assert len(got) == len(want)
        for g, w in zip(sorted(map(tuple, got), key=str), want):
            assert g[0] == w[0] and same(g[1:], w[1:])
    none = docs.limit(0)
    assert lm.score(none, F.lit(True), F.lit(True), lm.train(none, F.lit(True), F.lit(True), Scratch(spark))).count() == 0


def test_docs_read_otherwise_raise(spark):
    a, b = (spark.createDataFrame([(1, t)], "doc_id long, text string") for t in ("a b c", "a b d"))
    model = lm.train(a, F.lit(True), F.lit(False), Scratch(spark))
    with pytest.raises(Exception, match="not read alike"):
        lm.score(b, F.lit(True), F.lit(False), model).collect()
