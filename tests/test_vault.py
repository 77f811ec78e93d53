import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirebook.operators import agent, tokenizer, vault, vectors
from quirebook.sources import files
from quirebook.sources.vault_source import VaultSource, changes
from quirebook.streaming import events as E


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text, newline="")


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(VaultSource)
    root = tmp_path / "vault"
    for path, text in (("a.md", "one\r\n"), ("b/c.md", "two"), ("b/ü.md", "drei"), ("b/no.txt", "x"), (".hidden/d.md", "x")):
        put(root, path, text)
    return root


def test_notes_in_a_batch(spark, root):
    got = {r.path: r.content for r in spark.read.format("vault").option("parts", 2).load(str(root)).collect()}
    assert got == {"a.md": "one\r\n", "b/c.md": "two", "b/ü.md": "drei"}
    (root / "empty").mkdir()
    assert spark.read.format("vault").load(str(root / "empty")).count() == 0


def test_a_stream_of_changes_over_restarts(spark, root, tmp_path):
    stream = spark.readStream.format("vault").option("log", str(tmp_path / "log")).load(str(root))

    def run():
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
        new, run.seen = rows[run.seen :], len(rows)
        return [(r.op, r.path, r.old_path) for r in new]

    run.seen = 0
    assert run() == [("create", "a.md", None), ("create", "b/c.md", None), ("create", "b/ü.md", None)]
    put(root, "a.md", "other text")
    put(root, "new.md", "n")
    os.rename(root / "b/c.md", root / "moved.md")
    os.remove(root / "b/ü.md")
    os.utime(root / "new.md")
    assert run() == [("delete", "b/ü.md", None), ("modify", "a.md", None), ("rename", "moved.md", "b/c.md"), ("create", "new.md", None)]
    os.utime(root / "a.md")  # another time, the same text
    assert run() == []
    put(root, "a.md", "third")
    assert run() == [("modify", "a.md", None)]
    ops = E.normalize(spark.read.parquet(str(tmp_path / "out")))
    assert {(r.path, r.op) for r in E.last_ops(ops).collect()} == {("a.md", "upsert"), ("b/c.md", "delete"), ("b/ü.md", "delete"), ("moved.md", "upsert"), ("new.md", "upsert")}


def test_changes_name_each_rename_once():
    before = {"a": [1, 1, "x"], "b": [1, 1, "x"], "c": [1, 1, "y"]}
    after = {"c": [1, 2, "y"], "d": [1, 1, "x"], "e": [1, 1, "x"], "f": [1, 1, "x"]}
    assert changes(before, after) == [("d", "a", "rename"), ("e", "b", "rename"), ("f", None, "create")]


def test_writes_are_one_commit(spark, root):
    rows = [("a.md", " more", "append"), ("n/e/w.md", "made", "write"), ("b/c.md", None, "delete"), ("none.md", None, "delete"), ("x.md", "made too", None)]
    spark.createDataFrame(rows, "path string, content string, op string").repartition(3).write.format("vault").mode("append").save(str(root))
    got = {r.path: r.content for r in spark.read.format("vault").load(str(root)).collect()}
    assert got == {"a.md": "one\r\n more", "n/e/w.md": "made", "b/ü.md": "drei", "x.md": "made too"}
    assert (root / ".trash/b/c.md").read_text() == "two" and not os.listdir(root / ".quirebook-tmp")
    for bad in ("../out.md", "/etc/out.md", "b/../../out.md"):
        with pytest.raises(Exception, match="leads out"):
            spark.createDataFrame([("ok.md", "x"), (bad, "x")], "path string, content string").coalesce(1).write.format("vault").mode("append").save(str(root))
    assert not (root / "ok.md").exists() and not (root.parent / "out.md").exists()


def longest_first(word, vocabulary, unknown):
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (word[at:e] if not at else "##" + word[at:e]) in vocabulary), None)
        if end is None:
            return [*out, unknown]
        out.append(vocabulary[word[at:end] if not at else "##" + word[at:end]])
        at = end
    return out


def test_word_pieces_by_trie():
    pick = random.Random(1)
    tokens = ["[UNK]"] + sorted({("##" if pick.random() < 0.6 else "") + "".join(pick.choice("ab#") for _ in range(pick.randint(1, 4))) for _ in range(40)})
    vocabulary = {t: i for i, t in enumerate(tokens)}
    pieces = tokenizer.Pieces(vocabulary)
    for _ in range(3000):
        word = "".join(pick.choice("abc#") for _ in range(pick.randint(0, 12)))
        assert pieces.of(word) == longest_first(word, vocabulary, 0)
    began = time.perf_counter()
    assert len(tokenizer.Pieces({"a": 0, "##a": 1, "##aaaa": 2}).of("a" * 1_000_001)) == 250_001
    assert time.perf_counter() - began < 5


def test_suggested_links(spark):
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 8))
    notes = [(f"n{i:03d}", (hubs[i % 12] + rng.normal(size=8) * 0.35).tolist()) for i in range(300)] + [("none", None), ("zero", [0.0] * 8), ("copy", None)]
    notes[-1] = ("copy", notes[0][1])
    links = [("n000", "n012"), ("n000", "copy"), ("n005", "n017")]
    frame = spark.createDataFrame(notes, "path string, vector array<double>")
    got = vault.suggest_links(frame, spark.createDataFrame(links, "src string, dst string"), 3, 0.75).collect()
    x = {p: np.array(v) / max(np.linalg.norm(v), 1e-300) for p, v in notes if v}
    want = set()
    for p in x:
        near = sorted((-round(float(x[p] @ x[o]), 9), o) for o in x if o != p and round(float(x[p] @ x[o]), 9) >= 0.75 and (p, o) not in links)[:3]
        want |= {(p, o, i) for i, (_, o) in enumerate(near, 1)}
    assert {(r.path, r.other, r["rank"]) for r in got} == want and len(want) > 500
    blocks = vectors.similar_pairs(frame.select(F.col("path").alias("key"), "vector").repartition(5), 3, 0.75, size=16, groups=3)
    free = vault.suggest_links(frame, spark.createDataFrame([], "src string, dst string"), 3)
    assert sorted((r.key, r.other) for r in blocks.collect()) == sorted((r.path, r.other) for r in free.collect())


def test_ten_thousand_rules_as_a_table(spark):
    pick = random.Random(5)
    folders = [f"{a}{i}" for a in "xyz" for i in range(30)]
    lines = [f"{pick.choice(folders)}/{pick.choice(folders)}/n{i}.md" for i in range(9000)] + [f"!n{i}.md" for i in range(0, 900, 3)] + [f"/{pick.choice(folders)}/*/n{i}*.md" for i in range(400)]
    lines += ["*.tmp", "draft-*", "# comment", "", "z1/", "**/y2/x3/", "!keep.tmp", "[ab]c.md", "a.?d"] + [f"{pick.choice(folders)}/" for _ in range(10)] + ["!x5/x6/"]
    pick.shuffle(lines)
    paths = [f"{pick.choice(folders)}/{pick.choice(folders)}/n{pick.randrange(9000)}.md" for _ in range(3000)] + ["a.tmp", "q/keep.tmp", "b/draft-1.md", "ac.md", "q/bc.md", "a.md", "p/y2/x3/q.md", "z1/q/r.md", "x5/x6/n1.md", ""]
    rules = [(i, *r) for i, line in enumerate(lines) for r in files.ignore_rules([line])[len(files.DEFAULT_IGNORES) :]]
    compiled = [(re.compile(regex), negated) for _, regex, negated in rules]
    want = {}
    for p in paths:
        want[p] = False
        for regex, negated in compiled:
            if regex.search(p):
                want[p] = not negated
    table = files.rule_table(spark.createDataFrame(list(enumerate(lines)), "ord long, line string"))
    got = files.ignored_by(spark.createDataFrame([(p,) for p in paths], "path string"), table)
    assert {r.path: r.ignored for r in got.collect()} == want and 50 < sum(want.values()) < 2900


def test_work_that_takes_too_long_is_stopped(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    tools = agent.Tools()
    tools.register("grep", lambda args: spark.range(4).select(slow("id")).collect())
    asked = iter([{"calls": [("1", "grep", {})]}, {"text": "done"}])
    began = time.monotonic()
    events = list(agent.run(lambda messages: next(asked), tools, "hi", within=agent.limited(spark, 2)))
    assert time.monotonic() - began < 15
    assert [e["code"] for e in events if e["type"] == "error"] == ["TIMEOUT"] and events[-2] == {"type": "delta", "text": "done"}
    stop = time.monotonic() + 1
    with pytest.raises(agent.Cancelled):
        agent.limited(spark, cancelled=lambda: time.monotonic() > stop)(lambda: [spark.range(4).select(slow("id")).count() for _ in range(9)])
    assert time.monotonic() - began < 30
    assert agent.limited(spark, 60)(lambda: spark.range(5).count()) == 5
    with pytest.raises(ZeroDivisionError):
        agent.limited(spark, 60)(lambda: 1 / 0)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
