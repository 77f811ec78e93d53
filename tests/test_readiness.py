import os

import pytest
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import indexing, search
from quirebook.sources import files


def test_a_model_that_comes_later(spark, tmp_path):
    model = indexing.Model(1)
    kept = indexing.NoteIndex(spark, str(tmp_path / "i"), model, 1, buckets=2)
    notes = spark.createDataFrame([("a", "one")], "path string, content string")
    with pytest.raises(indexing.NotReady) as raised:
        kept.reindex(notes)
    assert raised.value.code == "INDEX_NOT_READY" and not model.ready and kept.store.version() == 0
    model.model = lambda texts: [[1.0] for _ in texts]
    assert kept.reindex(notes)["indexed"] == 1 and model.ready


def test_search_by_vectors_where_texts_fail(spark):
    text = spark.createDataFrame([(1, "alpha beta")], "q int, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q int, vector array<double>")
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "key string, vector array<double>")
    docs = spark.createDataFrame([("b", "beta"), ("c", "gamma")], "key string, content string")
    found, error = search.hybrid_or_vectors(text, asked, docs, items, 2)
    assert error is None and sorted(map(tuple, found.collect())) == sorted(map(tuple, search.hybrid(text, asked, docs, items, 2).collect()))
    broken = docs.withColumn("content", F.raise_error(F.lit("the disk is gone")).cast("string"))
    with pytest.warns(UserWarning, match="vectors alone"):
        found, error = search.hybrid_or_vectors(text, asked, broken, items, 2)
    assert "the disk is gone" in str(error) and [(r.key, r["index"]) for r in found.orderBy("index").collect()] == [("a", 1), ("c", 2)]


def test_notes_are_read_again_only_when_they_changed(spark, tmp_path):
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "b.md").write_text("two")
    cache = files.CachedNotes(spark, str(tmp_path))
    assert {r.path: r.content for r in cache.read().collect()} == {"a.md": "one", "b.md": "two"}
    assert cache.read() is cache.read() and cache.reads == 1
    (tmp_path / "a.md").write_text("changed")
    assert {r.path: r.content for r in cache.read().collect()} == {"a.md": "changed", "b.md": "two"} and cache.reads == 2
    os.remove(tmp_path / "b.md")
    assert cache.read().count() == 1 and cache.reads == 3
    cache.drop()


def test_rows_of_a_model(spark):
    rows = [("NotStarted", None, None), ("Checking", None, None), ("Downloading", 0.425, None), ("Initializing", None, None), ("Ready", None, None), ("Failed", None, "no"), ("Switching", None, None)]
    frame = spark.createDataFrame(rows, "state string, progress double, reason string")
    got = frame.select(T.model_row(F.col("state"), F.col("progress"), F.col("reason"), F.lit("a"), F.lit("b")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [("idle", None), ("checking", None), ("downloading", "43%"), ("initializing", None), ("ready", None), ("failed", "no"), ("checking", "a → b")]


def test_mermaid_blocks_as_they_stand(spark):
    html = '<code id="1" class="a language-mermaid b"> x &amp;quot; &lt;b&gt;\n</code><code class="language-js">no</code><code class="language-mermaid"></code>'
    assert spark.range(1).select(T.mermaid_blocks(F.lit(html)).alias("m")).first().m == [' x " <b>\n', ""]
