import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from quirebook.llm import decontam


def brute(docs, items, width=10):
    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if ord(c) > 127 or c.isalnum() and c == c.lower() else " " for c in t).split(" ")

    clean = lambda t: [w for w in words(t) if w]
    windows = {}
    for item, text in items:
        w = clean(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = clean(text), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[i : i + n]) in windows and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = ["a", "b", "é", "das", "x9", "Wort"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\t"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(99, "..."), (98, None), (None, "a"), (3, "a a a a a a a a a a a a")]
    docs = [(i, text(rng.randint(0, 80)) + (items[i % 12][1] or "") + text(5)) for i in range(30)] + [(50, None), (51, ""), (51, ""), (None, items[4][1]), (52, "a " * 400)]
    return docs, items


def rows(df, spark):
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return sorted(((r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[2] > 0) for r in df.select("doc_id", "n_words", n_hit, "items").collect()), key=str)


def test_phrases_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, [(i, t) for i, t in items if i is not None and t is not None]), key=str)
    assert rows(decontam.phrase_matches(d, b), spark) == want
    assert rows(decontam.phrase_matches(d, b, block_bytes=120), spark) == want
    for size in (decontam.BLOCK_BYTES, 120):
        kept = decontam.clean(d, b, block_bytes=size)
        assert kept.dtypes == d.dtypes
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.phrase_matches(d, none).collect()] == [(1, 2, [], [], [])]
    assert decontam.phrase_matches(d.limit(0), none).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x x b x x c"), (2, "c b a"), (3, "a b"), (4, "a " + "x " * 30 + "b c")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.proximity_matches(d, q, slop=7).collect())
    assert got == [(1, "7", 0, 7), (2, "7", 0, 3)]
    assert sorted(r[0] for r in decontam.proximity_matches(d, q, slop=6).collect()) == [2]


def test_near_windows_against_brute_force(spark):
    docs, items = cases()
    items = [(i, t) for i, t in items if i is not None and t is not None]
    fold = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c > "\x7f" or c.isalnum() else " " for c in t or "").split(" ") if w]
    want = []
    for d, t in docs:
        w, near = fold(t), set()
        for item, text in items:
            x = fold(text)
            for i in range(max(1, len(x) - 9) if x else 0):
                window = set(x[i : i + 10])
                slop = max(12, len(x[i : i + 10]))
                if any(window <= set(w[k : k + slop]) for k in range(len(w))):
                    near.add(str(item))
        want.append((d, sorted(near)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.BLOCK_BYTES, 120):
        got = [(r.doc_id, r.near) for r in decontam.phrase_matches(d, b, block_bytes=size, slop=12).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_an_index_is_read_again(spark, tmp_path):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    decontam.index(d).write.parquet(f"{tmp_path}/index")
    stored = spark.read.parquet(f"{tmp_path}/index")
    for some in (items[:5], items[5:]):
        b = spark.createDataFrame(some, "item_id long, text string")
        got = decontam.search(stored, "bigint", b, decontam.Scratch(spark))
        assert rows(got, spark) == sorted(brute(docs, [(i, t) for i, t in some if i is not None and t is not None]), key=str)


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(decontam.SQL).fetchall())
    assert sorted(map(tuple, decontam.query(spark, sf).collect())) == want
    assert any(r[5] for r in want)
