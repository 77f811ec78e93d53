import zlib

import numpy as np
from pyspark.sql import functions as F

from quirebook.llm import toxicity
from quirebook.llm.common import Scratch

WORDS = "the of and river stone garden window letter market winter harbour silver morning paper street forest candle mountain".split()
WORDS += [a + b for a in WORDS for b in ("ly", "ing", "er", "work", "less", "land")]


def made(n, seed, bad=()):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(40, 120)))
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.integers(len(words)), str(rng.choice(bad)) + "." * (i % 2))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_and_shape(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.query(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    # the English insults that the labels know, in texts whose labels weren't read
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    known = [r for r in held if any(w in (docs[r.doc_id] or "").lower() for w in ("idiot", "moron", "pathetic", "worthless", "stupid"))]
    clean = [r for r in held if labels[r.doc_id] == 0]
    assert sum(r.predicted for r in known) >= 0.8 * len(known) > 20
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_learns_from_labels_alone(spark):
    rows = made(900, 1, ("zaxxor", "brimlode", "kweftig"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("score", F.lit("clash"))
    model = toxicity.learn(docs, docs.where("doc_id < 700"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, toxic) for i, _, toxic in rows if i >= 700]
    assert np.mean([p == t for p, t in held]) > 0.95
    worst = {i: text.encode()[got[i].worst : got[i].worst + toxicity.WINDOW].decode() for i, text, toxic in rows if toxic and got[i].worst is not None}
    assert len(worst) > 200 and np.mean([any(w in part for w in ("zaxxor", "brimlode", "kweftig")) for part in worst.values()]) > 0.9
    # columns other than the text don't count
    again = toxicity.score(docs.withColumns({"toxic": F.lit(1), "lang": F.lit("xx")}), model).collect()
    assert sorted(again) == sorted(got.values())


def test_windows_cover_the_whole_text():
    found = toxicity.Windows(b"a dictionary of brimlode", b"a dictionary of other words")
    for n in (0, 1, 63, 64, 65, 96, 97, 1000):
        assert len(found.excess("x" * n)) == (0 if n == 0 else 1 if n <= 64 else -(-(n - 64) // 32) + 1)
    text = " ".join(WORDS * 40)
    assert found.excess(text + " brimlode brimlode").argmax() == len(found.excess(text + " brimlode brimlode")) - 1


def test_copies_count_once():
    a = " ".join(WORDS * 5).encode()
    assert toxicity.without_near_copies([a, a, a + b" more", b"quite another text, with nothing of it" * 9]) == [a, b"quite another text, with nothing of it" * 9]


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (2, None), (3, ""), (None, "kweftig"), (4, "word " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r for r in got if r.doc_id == 1}) == 1
    none = toxicity.learn(docs, labels.limit(0))
    assert {(r.score, r.predicted, r.n_over, r.worst) for r in toxicity.score(docs, none).collect()} == {(0.0, 0, 0, None)}
    assert toxicity.learn(docs, labels.where("toxic = 1")).base == 1.0
    assert toxicity.learn(docs.limit(0), labels).weights == []
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_every_labelled_text_counts(spark):
    """Runs are counted in all texts, however many there are and wherever they stand; of copies one counts."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, " ".join(rng.choice(WORDS, 8)) + f" {rng.integers(10**9)}") for i in range(9_000)] + [(9_000, 1, "word " * 3_000 + "zaxxor"), (9_001, 1, "zaxxor " * 9)]
    texts = spark.createDataFrame(rows, "key long, label int, text string")
    sums = toxicity.run_counts(texts)
    run = lambda word: int.from_bytes(word, "big")
    got = {r.run: (r.toxic, r.ordinary) for r in sums.where(F.col("run").isin(run(b"zaxxo"), run(b"stone"))).collect()}
    assert got == {run(b"zaxxo"): (2, 0), run(b"stone"): (0, sum("stone" in t for _, _, t in rows))}
    twins = [(i, 0, t) for i, t in enumerate([" ".join(WORDS * 5)] * 3 + ["quite another text, with nothing of it" * 9, "short", "short"])]
    kept = toxicity.originals(spark.createDataFrame(twins, "key long, label int, text string"), Scratch(spark))
    assert sorted(twins[r.key][2] for r in kept.collect()) == sorted({t for _, _, t in twins})
