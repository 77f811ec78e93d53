"""Reading and listing notes, and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import vectors


def glob(notes: DataFrame, pattern: str, folder: str = "") -> DataFrame:
    path = F.col("path")
    return notes.where(~T.excluded(path) & T.under(path, folder) & T.glob_match(path, pattern)).select("path")


def list_folder(notes: DataFrame, folder: str = "") -> DataFrame:
    """(name, kind, n): files and folders directly in a folder; '' and '.' are the root."""
    folder = "" if folder in ("", ".") else folder.rstrip("/") + "/"
    rest = F.substr("path", F.lit(len(folder) + 1))
    inside = notes.where(F.col("path").startswith(folder) & ~T.excluded(F.col("path"))).select(F.substring_index(rest, "/", 1).alias("name"), F.when(F.contains(rest, F.lit("/")), "folder").otherwise("file").alias("kind"))
    return inside.groupBy("name", "kind").agg(F.count("*").alias("n"))


def read(notes: DataFrame, path: str) -> DataFrame:
    """The one note of a path; fails when there is none."""
    found = notes.where(F.col("path") == path)
    if not found.limit(1).count():
        raise FileNotFoundError(path)
    return found


def exists(notes: DataFrame, path: str) -> bool:
    return bool(notes.where(F.col("path") == path).limit(1).count())


def existing(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """paths with `found`: whether there is a note of the path; of a null path there is none."""
    known = notes.select("path", F.lit(True).alias("found")).distinct()
    return paths.join(known, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def metadata(notes: DataFrame) -> DataFrame:
    """(path, frontmatter, tags, links): what the text itself says; null where there is nothing."""
    block = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    front = F.map_from_entries(F.transform(pairs, lambda x: F.struct(T.trim(F.substring_index(x, ":", 1)), T.trim(F.substr(x, F.instr(x, F.lit(":")) + 1)))))
    tags = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![\p{L}\p{N}#])#([\p{L}][\p{L}\p{N}_/-]*)"), 1))
    links = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#\n]+)[^\]\n]*\]\]"), 1))
    some = lambda a: F.when(F.size(a) > 0, a)
    return notes.select("path", F.when(F.size(pairs) > 0, front).alias("frontmatter"), some(tags).alias("tags"), some(links).alias("links"))


def backlinks(links: DataFrame, target: str | None = None) -> DataFrame:
    """(dst, src, n): what links to each target, or to one."""
    found = links if target is None else links.where(F.col("dst") == target)
    return found.groupBy("dst", "src").agg(F.sum("n").alias("n"))


def read_notes(notes: DataFrame, links: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """notes with `backlinks`, the sorted sources (null if there are none), and metadata if given."""
    sources = links.groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("backlinks"))
    out = notes.join(sources, notes["path"] == sources["dst"], "left").drop("dst")
    return out if meta is None else out.join(meta, "path", "left")


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """An extra: notes without any link to or from them."""
    linked = links.select(F.col("src").alias("path")).union(links.select(F.col("dst").alias("path")))
    return notes.join(linked, "path", "left_anti").select("path")


def within_two_steps(links: DataFrame) -> DataFrame:
    """An extra: (src, dst, steps): what can be reached in one step or two."""
    one = links.select("src", "dst").distinct()
    two = one.alias("a").join(one.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    every = one.withColumn("steps", F.lit(1)).union(two.withColumn("steps", F.lit(2))).where("src <> dst")
    return every.groupBy("src", "dst").agg(F.min("steps").cast("long").alias("steps"))


#: Suggested links of a note, and the cosine of one at least.
SUGGESTIONS, CONFIDENCE = 5, 0.75


def suggest_links(vectors_: DataFrame, links: DataFrame, k: int = SUGGESTIONS, least: float = CONFIDENCE) -> DataFrame:
    """An extra: (path, other, confidence, rank): notes (path, vector) that a note is most like and has no link to among
    links (src, dst)."""
    linked = links.select("src", "dst").distinct()
    most = linked.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    # so many more are looked for that those linked already can be left out
    found = vectors.similar_pairs(vectors_.select(F.col("path").alias("key"), "vector"), k + most, least)
    fresh = found.join(linked, (F.col("key") == F.col("src")) & (F.col("other") == F.col("dst")), "left_anti")
    order = Window.partitionBy("key").orderBy("rank")
    return fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(F.col("key").alias("path"), "other", F.col("score").alias("confidence"), F.col("place").cast("long").alias("rank"))
