import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quirebook.llm import pii


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m[0])) <= 15]
    return out


MODEL = [-1.5, 1.0, 1.0, 1.0, 1.0, 1.0, *[0.0] * len(pii.KINDS)]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", pii.spans(spark, MODEL).alias("s")).collect()
    return {r.doc_id: [(c.kind, c.start, c.end) for c in r.s] for r in got}


def test_base_patterns_against_brute_force(spark):
    rng = random.Random(6)
    parts = [*"0123456789", "4111111111111111", "1234", "192.168.0.1", "256", ".", "-", " ", "+", "(", ")", "+1 (523) 555-1055", "a", "b.c", "@", "a@b.co", "_", "%", "é🎉", "\n", "x@y", "@@", "..", "00000000", "  "]
    texts = [None, "", "a@b.com_x@y.org", "a@b.c.a@b.c", "1.2.3.4.5.6.7.8", "4111-1111 1111-1111", "+1234567890123456", "a@b..c", "01.002.0003.255"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] < 4] == brute(t), t


def test_long_runs(spark):
    texts = [unit * (24_000 // len(unit)) for unit in ("a", "1", "1 ", "1.", "+1", "a@", "a@b.", "(1", "[", "Mr A", "AB12 ", "123-45-")]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert [s for s in got[i] if s[0] < 4] == brute(text)


def test_texts_of_megabytes_take_seconds(spark):
    units = ["1234 ", "12 34,", "anna.b@mail.example.org; ", "10.0.0.1 ", "+1 (523) 555-1055, ", "4111111111111111\n", "Mr Hans Maier said so. ", "Mr Anna x@y.de "]
    rows = [(i, unit * (400_000 // len(unit))) for i, unit in enumerate(units)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    docs.select(pii.spans(spark, MODEL).alias("s")).limit(0).collect()  # not the time to plan
    began = time.monotonic()
    got = docs.select("doc_id", pii.spans(spark, MODEL).alias("s")).select("doc_id", F.size("s").alias("n"), F.filter("s", lambda c: c["kind"] < 4).alias("s")).collect()
    clean = {r.doc_id: r.text for r in pii.redact(docs, MODEL).collect()}
    assert time.monotonic() - began < 60
    for r in got:
        assert [(c.kind, c.start, c.end) for c in r.s] == brute(rows[r.doc_id][1])
        assert len(re.findall(r"\[[A-Z]+\]", clean[r.doc_id])) == r.n


def test_spans_apart_and_merged_against_brute_force(spark):
    rng = random.Random(8)
    span = lambda: (lambda a: (a, a + rng.randint(1, 6), rng.randrange(4)))(rng.randrange(40))
    rows = [([span() for _ in range(rng.randint(0, 8))], [span() for _ in range(rng.randint(0, 8))]) for _ in range(300)]
    kind = "array<struct<start:int,end:int,kind:int>>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select("a", "b", pii.apart(F.col("a"), F.col("b")).alias("free"), pii.merged(F.col("a")).alias("merged")).collect()
    for r in got:
        assert sorted(map(tuple, r.free)) == sorted(tuple(x) for x in r.b if not any(s < x[1] and x[0] < e for s, e, _ in r.a))
        want = []
        for s, e, k in sorted(map(tuple, r.a)):
            if want and s < want[-1][1]:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e, k])
        assert [list(x) for x in r.merged] == want


def test_further_kinds_and_their_votes(spark):
    texts = ["call (523) 555-1055 now", "ssn 123-45-6789.", "iban DE89 3704 0044 0532 0130 00 ok", "met Dr. Anna Schmidt there", "order 123-45-6789x", "DE00 3704 0044 0532 0130 00", "+1 (523) 555-1055"]
    got = found(spark, texts)
    names = [[pii.KINDS[k] for k, _, _ in got[i]] for i in range(len(texts))]
    assert names[:4] == [["local"], ["ssn"], ["iban"], ["name"]] and names[6] == ["phone"]
    (k, a, b), = got[2]
    assert texts[2][a:b] == "DE89 3704 0044 0532 0130 00"
    assert names[4] == []


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        z = rng.random() < 0.4
        good = lambda r: (1 if z else -1) * (1 if rng.random() < r else -1)
        votes = (good(0.95), good(0.9), good(0.85), good(0.9) if rng.random() < 0.5 else 0, rng.choice([-1, 1]))
        counts[votes, z] = counts.get((votes, z), 0) + 1
    keys = sorted({v for v, _ in counts})
    patterns = [(4, v, counts.get((v, True), 0) + counts.get((v, False), 0)) for v in keys]
    likely = dict(zip(keys, pii.expectation_maximisation(patterns)))
    right = sum(n for (v, z), n in counts.items() if (likely[v] >= 0.5) == z)
    assert right / 4000 > 0.95


def test_redaction_and_defined_cases(spark):
    rows = [(1, "mail a@b.com or +1 (523) 555-1055!", 34, "x"), (1, "mail a@b.com or +1 (523) 555-1055!", 34, "x"), (2, None, None, None), (3, "clean", 5, "y"), (None, "4111111111111111", 16, "z"), (4, "+4111111111111111", 17, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string").withColumn("row", F.lit(1)).withColumn("clean", F.lit("c"))
    clean = pii.redact(docs)
    assert clean.schema == docs.schema
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in clean.collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] or [PHONE]!", 24)] * 2 + [(2, None, None), (3, "clean", 5), (None, "[CARD]", 6), (4, "+[CARD]", 7)], key=str)
    assert pii.redact(docs.limit(0)).count() == 0
    assert pii.train(docs.limit(0))[0] == -1.5


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert tuple(r)[1:5] == tuple(sum(k == i for k, _, _ in want) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)
