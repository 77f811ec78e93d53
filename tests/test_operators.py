import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirebook.operators import agent, chunking, fusion, grep, lexical, mutation, search, sessions, tokenizer, vault, vectors


def ranked(spark, lists):
    rows = [(0, i, pos, key, score) for i, items in enumerate(lists) for pos, (key, score) in enumerate(items)]
    return spark.createDataFrame(rows, "q int, list int, pos int, key string, score double")


@pytest.mark.parametrize("lists, k, top, want", [
    ([], 60, None, []),
    ([[("a", 0.9), ("b", 0.8)]], 60, None, [("a", 1 / 60), ("b", 1 / 61)]),
    ([[("a", 0.9), ("b", 0.8)], [("a", 0.85), ("c", 0.7)]], 60, None, [("a", 2 / 60), ("b", 1 / 61), ("c", 1 / 61)]),
    ([[("a", 0.9)]], 40, None, [("a", 1 / 40)]),
    ([[("a", 1.0), ("b", 1.0), ("c", 1.0)]], 60, 2, [("a", 1 / 60), ("b", 1 / 61)]),
    ([[("a", 1.0), ("b", 1.0)], [("b", 1.0), ("a", 1.0)]], 60, None, [("a", 1 / 60 + 1 / 61), ("b", 1 / 60 + 1 / 61)]),
    ([[("a", 1.0), ("a", 0.5)]], 60, None, [("a", 1 / 60 + 1 / 61)]),
])
def test_rrf(spark, lists, k, top, want):
    got = [(r.key, r.rrf_score) for r in fusion.rrf(ranked(spark, lists), k, top).orderBy("rank").collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_source_scores_have_holes(spark):
    fused = fusion.source_scores(fusion.rrf(ranked(spark, [[("a", 0.9), ("b", None)], [("c", 1.0), ("a", 0.85)], []])), 3)
    assert {r.key: r.source_scores for r in fused.collect()}["a"] == [0.9, 0.85, None]


def test_rerank_keeps_what_the_reranker_passes_over(spark):
    fused = spark.createDataFrame([(0, "a", 0.03), (0, "b", 0.02)], "q int, key string, rrf_score double")
    scored = spark.createDataFrame([(0, "a", 0.95)], "q int, key string, score double")
    got = [tuple(r) for r in fusion.rerank(fused, scored, 5).orderBy("index").collect()]
    assert got == [(0, "a", 0.95, True, 1), (0, "b", 0.02, False, 2)]


def test_best_chunk(spark):
    hits = spark.createDataFrame([(0, "doc-1", 0, 0.8), (0, "doc-1", 1, 0.9), (0, "doc-1", 2, 0.9), (0, "doc-2", 3, 0.6), (0, None, 4, 1.0)], "q int, document string, key int, score double")
    assert sorted(map(tuple, vectors.best_chunk(hits).collect())) == [(0, "doc-1", 1, 0.9), (0, "doc-2", 3, 0.6)]


def test_vectors(spark, monkeypatch):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(40, 8)))]
    items = spark.createDataFrame(rows, "key int, vector array<double>").repartition(3)
    queries = items.where("key < 5").select(F.col("key").alias("q"), "vector")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(k)) for q in range(5) for k in np.argsort(-(m[q] @ m.T))[:3]}
    for block in (vectors.BLOCK, 10):  # one block of queries, and several
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert {(r.q, r.key) for r in vectors.knn(queries, items, 3).collect()} == want
    assert vectors.knn(queries.limit(0), items, 3).count() == 0
    x = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 0.0], [9.0, 9.0], [0.0, 1.0]], [1, 0, 1])], "a array<float>, z array<float>, s array<array<double>>, m array<int>")
    r = x.select(vectors.l2_normalize("a"), vectors.l2_normalize("z"), vectors.cosine("a", "z"), vectors.cosine("a", "a"), vectors.mean_pool(F.col("s"), F.col("m"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and r[2] == 0 and abs(r[3] - 1) < 1e-12 and np.allclose(r[4], [0.5**0.5] * 2)
    with pytest.raises(Exception, match="expected 3"):
        x.select(vectors.checked("a", 3)).collect()


def vault_of(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_grep(spark):
    notes = vault_of(spark, [("notes/a.md", "one\nx 死 y  \nthree"), (".obsidian/hidden.md", "死"), ("other/b.md", "É\né")])
    got = grep.grep(notes, "死", regex=False).collect()
    assert [tuple(r) for r in got] == [("notes/a.md", 2, 3, "x 死 y", ["one"], ["three"])]
    assert grep.grep(notes, "é").count() == 2 and grep.grep(notes, "é", ignore_case=False).count() == 1
    assert grep.grep(notes, ".", folder="other").count() == 2 and grep.grep(notes, ".", limit=1).first().path == "notes/a.md"
    assert grep.grep(vault_of(spark, [("a.md", "🚀a")]), "a").first().column == 3
    with pytest.raises(ValueError):
        grep.grep(notes, "(")


def test_listing_and_metadata(spark):
    notes = vault_of(spark, [("a.md", "---\ntitle: T\nx: y: z\n---\n#tag and #b/c [[Target|name]] [[Other#h]]"), ("d/b.md", "plain"), ("d/e/c.md", ""), (".trash/x.md", "")])
    assert {(r.name, r.kind) for r in vault.list_folder(notes, ".").collect()} == {("a.md", "file"), ("d", "folder")}
    assert {(r.name, r.kind) for r in vault.list_folder(notes, "d").collect()} == {("b.md", "file"), ("e", "folder")}
    meta = {r.path: r for r in vault.metadata(notes).collect()}
    assert meta["a.md"].frontmatter == {"title": "T", "x": "y: z"} and meta["a.md"].tags == ["tag", "b/c"] and meta["a.md"].links == ["Target", "Other"]
    assert meta["d/b.md"].frontmatter is None and meta["d/b.md"].tags is None
    assert vault.exists(notes, "a.md") and vault.read(notes, "d/b.md").first().content == "plain"
    with pytest.raises(FileNotFoundError):
        vault.read(notes, "zzz")


CHUNK_TEXTS = ["", "   \n", "Hello world", "Word " * 200, "A" * 1000, "# A\nx\n## B\ny", "# A\n" + "a" * 400 + "\n# B\n" + "b" * 400, "第一句。第二句。第三句。第四句。", "🎉" * 40, "```\n" + "code\n" * 60 + "```", "---\na: b\n---\ntext", "p one.\n\n" * 90]


@pytest.mark.parametrize("size, overlap", [(500, 100), (100, 20), (15, 3), (10, 10), (20, 50)])
def test_chunks(size, overlap):
    for text in CHUNK_TEXTS:
        found = chunking.chunks(text, size, overlap)
        assert bool(found) == bool(text.strip())
        assert all(len(c) <= 1.5 * size + 1 for c, _, _ in found)
        squeezed = "".join(text.split())
        position = 0
        for c, _, _ in found:  # chunks cover the text in order, with overlaps
            piece = "".join(c.split())
            at = squeezed.rfind(piece, 0, position + len(piece))
            assert 0 <= at <= position
            position = max(position, at + len(piece))
        assert position == len(squeezed)


def test_chunk_fixtures(spark):
    assert chunking.chunks("Hello world") == [("Hello world", 0, 11)]
    assert len(chunking.chunks("# A\nx\n## B\ny")) == 1
    two = chunking.chunks("# A\n" + "a" * 400 + "\n# B\n" + "b" * 400, 300, 50)
    assert len(two) > 1 and any(c.startswith("#") for c, _, _ in two)
    assert len(chunking.chunks("A" * 1000, 300, 50)[0][0]) == 301
    got = chunking.chunk_notes(vault_of(spark, [("a", "Word " * 300), ("b", None), ("c", "")])).collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and got[0].chunk_id == "a#chunk-0"
    assert tuple(chunking.index_counts(vault_of(spark, [("a", "x"), ("c", "")]), chunking.chunk_notes(vault_of(spark, [("a", "x"), ("c", "")]))).first()) == (2, 0, 1)


def test_tokenizer(spark):
    words = tokenizer.parse_vocabulary("[PAD]\n[UNK]\n\n[CLS]\r\n[SEP]\nhello\nworld\n##s\n你\n好")
    assert words["[CLS]"] == 3 and words["好"] == 9
    assert tokenizer.basic_tokens("Héllo, wörld-你好_x") == ["Hello", "world", "你", "好", "_x"]
    assert tokenizer.Pieces(words).of("worlds") == [6, 7] and tokenizer.Pieces(words).of("worldx")[0] == 6
    texts = spark.createDataFrame([(1, "hello worlds 你"), (2, None)], "key int, content string")
    made = tokenizer.tokenize(texts, words).select("key", tokenizer.encode(F.col("ids"), words, 8).alias("e")).orderBy("key").collect()
    assert made[0].e.input_ids == [3, 5, 6, 7, 8, 4, 0, 0] and made[0].e.attention_mask == [1] * 6 + [0] * 2 and made[1].e.input_ids[:3] == [3, 4, 0]
    vec = tokenizer.embed(texts.where("key = 1"), lambda batch: [[float(len(t)), 1.0] for t in batch], 2).first()
    assert vec.vector == [14.0, 1.0]
    with pytest.raises(ValueError):
        tokenizer.parse_vocabulary("\n\n")


def test_edits_and_trash(spark):
    notes = vault_of(spark, [("a", "foo bar baz"), ("b", "x bar bar"), ("c", "none")])
    got = {r.path: (r.content, r.error) for r in mutation.edit(notes, F.lit("bar"), F.lit("qux")).collect()}
    assert got == {"a": ("foo qux baz", None), "b": ("x bar bar", "not unique"), "c": ("none", "not found")}
    after, done = mutation.write(notes, vault_of(spark, [("a", "new"), ("z", "made")]))
    assert {r.path: r.created for r in done.collect()} == {"a": False, "z": True} and after.count() == 4
    left, moved = mutation.trash(notes, notes.limit(0), notes.where("path = 'a'"))
    assert left.count() == 2 and moved.first().path == "a"


def test_history_and_context(spark):
    rows = [("s", i, "user", "x" * 100) for i in range(5)] + [("t", 0, "user", "y" * 4000)]
    messages = spark.createDataFrame(rows, "session_id string, ord int, role string, content string")
    assert sorted((r.session_id, r.ord) for r in sessions.trim_history(messages, 50).collect()) == [("s", 3), ("s", 4), ("t", 0)]
    assert sorted((r.session_id, r.ord) for r in sessions.trim_history(messages, 10).collect()) == [("s", 4), ("t", 0)]
    made = sessions.assemble(messages.limit(1), messages.limit(0), messages).collect()
    assert {r.part for r in made} == {0, 2}


def test_streams_of_an_answer(spark):
    raw = "\n\n".join([
        'data: {"choices":[{"delta":{"reasoning_content":"hm"}}]}', 'data: {"choices":[{"delta":{"content":"Hi"}}]}', "data: {bad", ": comment",
        'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c1","function":{"name":"grep","arguments":"{\\"a\\":"}}]}}]}',
        'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":"1}"}},{"index":1,"id":"c2","function":{"name":"glob","arguments":"{x"}}]},"finish_reason":"tool_calls"}],"usage":{"total_tokens":7}}', "data: [DONE]",
    ])
    events = sessions.parse_sse(spark.createDataFrame([(1, raw)], "stream_id int, raw string"))
    rows = events.orderBy("ord").collect()
    assert [r.content for r in rows if r.content] == ["Hi"] and rows[0].reasoning == "hm" and rows[-1].finish == "tool_calls" and rows[-1].usage.total_tokens == 7
    assert sorted(map(tuple, sessions.tool_calls(events).collect())) == [(1, 0, "c1", "grep", '{"a":1}'), (1, 1, "c2", "glob", '{"raw":"{x"}')]


def test_filters_and_variants(spark):
    rows = spark.createDataFrame([("a/x", ["t"]), ("b/y", ["u"])], "path string, tags array<string>")
    assert search.filtered(rows, ["t"]).count() == 1 and search.filtered(rows, prefix="b/").count() == 1 and search.filtered(rows).count() == 2
    q = spark.createDataFrame([(1, "one"), (2, "two")], "q int, text string")
    a = spark.createDataFrame([(1, "1. alpha\n2. beta\n3. gamma")], "q int, answer string")
    assert sorted(map(tuple, search.variants(q, a).collect())) == [(1, 0, "one"), (1, 1, "alpha"), (1, 2, "beta"), (2, 0, "two")]


def test_agent():
    tools = agent.Tools()
    tools.register("grep", lambda args: {"found": agent.require(args, "pattern")})
    tools.register("write_note", lambda args: {"path": args["path"]})
    answers = iter([{"text": "look", "calls": [("1", "grep", {"pattern": "x"}), ("2", "grep", {}), ("3", "write_note", {"path": "a"}), ("4", "odd", {})]}, {"text": "done", "calls": []}])
    events = list(agent.run(lambda messages: next(answers), tools, "hi", agent.Gate(confirm=lambda name, args: "session" if name == "write_note" else "deny")))
    assert [e["type"] for e in events] == ["start", "delta", "call", "result", "call", "error", "result", "call", "result", "call", "error", "delta", "end"]
    assert [e.get("code") for e in events if e["type"] == "error"] == ["INVALID_ARGS", "TOOL_DENIED"]
    loop = list(agent.run(lambda messages: {"calls": [("1", "grep", {"pattern": "x"})]}, tools, "hi", steps=3))
    assert loop[-2]["code"] == "STEP_LIMIT" and loop[-1]["type"] == "end"
    assert [e["type"] for e in agent.run(lambda m: 1 / 0, tools, "x")] == ["start", "error", "end"]
    assert agent.hooks_deny([lambda n, a: 1 / 0, lambda n, a: "no", lambda n, a: "later"], "grep", {}) == "no"
    gate = agent.Gate(settings={"x": "deny"})
    assert not gate.allows("x", {}) and gate.allows("x", {}) is False and agent.Gate(trust=True).allows("x", {})


def test_index_gives_what_the_texts_give(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    queries = spark.createDataFrame([(1, "the of thing"), (2, "zzz"), (3, "la de que")], "q int, text string")
    index = lexical.Index(spark, str(tmp_path / "i"), buckets=5).build(docs)
    assert sorted(map(tuple, index.search(queries).collect())) == sorted(map(tuple, lexical.bm25(queries, docs).collect()))
    assert index.search(queries.where("q = 2")).count() == 0
    before = sorted(map(tuple, index.search(queries).collect()))
    with pytest.raises(Exception, match="half way"):  # a build that fails leaves the one before
        index.build(docs.withColumn("content", F.when(F.col("key") == 5, F.raise_error(F.lit("half way")).cast("string")).otherwise(F.col("content"))))
    assert sorted(map(tuple, index.search(queries).collect())) == before
    few = docs.where("key < 50")
    assert sorted(map(tuple, index.build(few).search(queries).collect())) == sorted(map(tuple, lexical.bm25(queries, few).collect()))
    many = spark.createDataFrame([(i, f"the of w{i}") for i in range(2500)], "q int, text string")  # more words than are pushed down
    assert index.search(many).where("q = 1").count() == lexical.bm25(many.where("q = 1"), few).count()


def test_several_blocks_of_queries_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(300)], "key int, vector array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(40)], "q int, vector array<double>")
    want = sorted(map(tuple, vectors.knn(queries, items, 4).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 50)
    assert sorted(map(tuple, vectors.knn(queries, items, 4).collect())) == want and len(want) == 160


def test_mean_pool_takes_one_pass(spark):
    """Long vectors: work by the square of their length takes minutes here."""
    size = 20_000
    rows = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    pooled = vectors.mean_pool(F.array("v", F.transform("v", lambda x: x * 3), F.transform("v", lambda x: x * 9)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    begun = time.monotonic()
    for r in rows.select("id", pooled.alias("v"), vectors.l2_normalize("v").alias("u")).collect():
        n = sum((i + r.id) ** 2 for i in range(1, size + 1)) ** 0.5
        assert all(abs(x - (i + r.id) / n) < 1e-12 for i, x in enumerate(r.v, 1)) and max(abs(x - y) for x, y in zip(r.v, r.u)) < 1e-12
    assert time.monotonic() - begun < 60
