import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quirebook.llm import quality


def brute(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = text.replace("\n", " ").split(" ")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(inside)


def texts():
    rng = random.Random(9)
    out = ["", None, " \n\t", "a", "a " * 8, "a " * 9, "a b c d e f g h " * 3, "x\x85y z", "#*$ |<> & %", "word " * 5000]
    for _ in range(60):
        out.append("".join(rng.choice("ab") + rng.choice([" ", "\n", "\t", "  ", "é "]) for _ in range(rng.randint(0, 60))))
    return out


def test_measures_against_brute_force(spark):
    rows = [(i, t, "h", 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, quality int").withColumnRenamed("quality", "host")
    got = {r.row.doc_id: r.quality for r in quality.ruled(docs).collect()}
    for i, t in enumerate(texts()):
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_repeat_words) == brute(t), t


def test_lines(spark):
    rows = [(1, "a b\na b\n\n \n\nc\na b"), (2, "a b\na b \n"), (3, "\n\n"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert {r.row.doc_id: r.quality.n_dup_lines for r in quality.ruled(docs).collect()} == {1: 2, 2: 0, 3: 0, 4: 0}


def test_hosts_are_shrunk_and_joined_back(spark):
    good = " ".join(f"word{i}" for i in range(30))
    loud = " ".join(f"WORD{i}!!" for i in range(30))
    rows = [(i, good, "good") for i in range(40)] + [(100, loud, "good"), (101, "short", "good")]
    rows += [(200 + i, loud if i % 2 else good, "half") for i in range(40)] + [(300, good, "once"), (301, good, None), (302, loud, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_host", F.lit(1)).withColumn("kept", F.lit("x"))
    rates = {r.host: r.rate for r in quality.host_rates(quality.ruled(docs)).collect()}
    assert rates["good"] < 0.2 < rates["half"] and rates["bad"] < 0.95 and 0 < rates["once"] < rates["half"]
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(40)) | {300, 301} | set(range(200, 240, 2)) <= ids and not ids & {101, 302, 201}
    assert quality.clean(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(quality.SQL).fetchall())
    assert sorted(map(tuple, quality.query(spark, sf).collect())) == want
    assert {r[-1] for r in want} == {True, False}


def test_many_hosts_are_judged_like_few(spark, sf, monkeypatch):
    want = sorted(map(tuple, quality.query(spark, sf).collect()))
    monkeypatch.setattr(quality, "BROADCAST", 5)
    assert sorted(map(tuple, quality.query(spark, sf).collect())) == want
