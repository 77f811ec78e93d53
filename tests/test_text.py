import pytest
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.sources import files


def one(spark, expr, *values):
    row = spark.range(1).select(*(F.lit(v).alias(f"c{i}") for i, v in enumerate(values)))
    return row.select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize("text, n", [("", 0), ("hello world", 3), ("你好世界测试", 4), ("hello 你好", 3), ("🎉🎊🎈", 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.estimate_tokens, text) == n


def test_count_tokens_is_utf16(spark):
    assert one(spark, T.count_tokens, "🎉🎊🎈") == 2 and one(spark, T.count_tokens, "") == 0


@pytest.mark.parametrize("glob, path, hit", [
    ("*.md", "readme.md", True), ("*.md", "notes/readme.md", False), ("daily/*.md", "daily/2026-06-26.md", True), ("daily/*.md", "other/2026.md", False),
    ("**/*.md", "a/b/c.md", True), ("**/*.md", "root.md", True), ("note?.md", "note1.md", True), ("note?.md", "note12.md", False), ("a{b}.md", "a{b}.md", True),
])
def test_glob(spark, glob, path, hit):
    assert one(spark, lambda p: T.glob_match(p, glob), path) is hit


def test_escape(spark):
    assert one(spark, T.escape_regex, "a.b(c)") == r"a\.b\(c\)"


@pytest.mark.parametrize("path, plain, error", [
    ("notes/foo.md", "notes/foo.md", None), ("notes//bar.md", "notes/bar.md", None), ("/etc/passwd", "etc/passwd", None), ("/", "", None), ("./a/./b", "a/b", None),
    ("", "", "empty"), ("C:/x", "C:/x", "absolute"), ("a/../b", "a/../b", "traversal"), (".obsidian/x", ".obsidian/x", "excluded"), ("/.trash", ".trash", "excluded"), (".trashed/x", ".trashed/x", None),
])
def test_paths(spark, path, plain, error):
    assert one(spark, T.normalize_path, path) == plain and one(spark, T.path_error, path) == error


@pytest.mark.parametrize("lines, path, hit", [
    ((), ".obsidian/plugins/foo.md", True), ((), "notes/daily.md", False), (("drafts/",), "drafts/wip.md", True), (("drafts/",), "notes/draft.md", False),
    (("*.md", "!important.md"), "notes/important.md", False), (("*.md", "!important.md"), "notes/daily.md", True), (None, ".trash/x.md", True), (("# c", "", "/a/b"), "a/b/c.md", True),
])
def test_ignore_rules(spark, lines, path, hit):
    assert one(spark, lambda p: files.ignored(p, files.ignore_rules(lines)), path) is hit


def test_edit_helpers(spark):
    assert one(spark, lambda t: T.replace_once(t, F.lit("bar"), F.lit("$&qux")), "foo bar bar") == "foo $&qux bar"
    assert one(spark, lambda t: T.occurrences(t, F.lit("aa")), "aaaaa") == 2 and one(spark, lambda t: T.occurrences(t, F.lit("")), "a") == 0


@pytest.mark.parametrize("answer, found", [("a b\nc d", ["a b", "c d"]), ("", []), (None, []), ("1. x\n 2.  y\n\n3. z", ["x", "y"])])
def test_rewrites(spark, answer, found):
    assert one(spark, lambda a: T.parse_rewrites(a.cast("string")), answer) == found


def test_intent_bands_and_errors(spark):
    assert [one(spark, T.intent, x) for x in (" RAG ", "Direct", "what", "")] == ["rag", "direct", "rag", "rag"]
    assert [one(spark, T.band, x) for x in (0.8, 0.6, 0.59)] == ["high", "mid", "low"]
    assert [one(spark, T.usage_band, x) for x in (95, 80, 79)] == ["danger", "warning", "normal"]
    assert one(spark, lambda m: T.percentage(F.lit(5), m), 0) == 0
    assert one(spark, T.error_type, "401 Unauthorized") == "config"
    assert one(spark, lambda n: T.tool_label(n, F.lit("x" * 31), F.lit(False)), "grep") == "grep " + "x" * 30 + "…"
    assert one(spark, lambda m: T.attachment_error(m, F.lit(6_000_000), F.lit(1)), "image/png") == "size"
    assert one(spark, lambda w: T.image_tokens(w, F.lit(750)), 2) == 2 and one(spark, lambda w: T.image_tokens(w, F.lit(750)), 0) == 0
    assert one(spark, T.escape_html, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, T.mermaid_blocks, '<pre><code class="language-mermaid">a --&gt; b\n</code></pre>') == ["a --> b\n"]
    assert one(spark, T.mermaid_blocks, '<pre><code class="hljs language-mermaid">graph TD\n  A--&gt;B</code></pre>') == ["graph TD\n  A-->B"]
    assert one(spark, T.fences_closed, "```a```") is True and one(spark, T.fences_closed, "```") is False
    assert one(spark, T.parse_args, "{bad") == '{"raw":"{bad"}' and one(spark, T.tool_path, '{"path":"a"}') == "a" and one(spark, T.tool_path, '{"path":1}') is None
    assert one(spark, lambda b: T.status_tone(F.lit(False), b, F.lit(False), F.lit(True)), True) == "error"
    assert tuple(one(spark, lambda x: T.transfer_eta(x, F.lit(100), F.lit(0)), 50)) == (0.0, 0.0)
    assert one(spark, lambda x: T.enough_disk(x, F.lit(100)), 119) is False


def test_hash(spark):
    assert one(spark, lambda x: F.sha2(x, 256), "hello").startswith("2cf24dba") and one(spark, lambda x: F.sha2(x, 256), "hello").endswith("938b9824")


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# é")
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "c.txt").write_text("c")
    got = {r.path: r.content for r in files.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"a/x.md": "# é", "b.md": "b"}
