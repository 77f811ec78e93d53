"""Notes in folders of Markdown files, and rules for paths that are ignored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.functions import text as T

#: Fixed values.
DEFAULT_IGNORES = (".obsidian/", ".trash/", ".augmented-canvas/", ".obsidian-canvas/", ".obsidian-snippets/")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, mtime) of all Markdown files below root, paths relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))


class CachedNotes:
    """read_notes, kept in memory and on disk by the executors as long as no file's name, size or time changes. Asking costs
    a listing, and no content is read again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.state, self.notes, self.reads = spark, root, None, None, 0

    def _now(self) -> tuple:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(self.root)
        return tuple(files.select("path", "modificationTime", "length").agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())

    def read(self) -> DataFrame:
        if (now := self._now()) != self.state:
            self.drop()
            self.notes, self.state = read_notes(self.spark, self.root).persist(StorageLevel.MEMORY_AND_DISK), now
            self.reads += 1
        return self.notes

    def drop(self) -> None:
        if self.notes is not None:
            self.notes.unpersist()
        self.notes = self.state = None


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def _rule(line: str) -> tuple[str, bool, str] | None:
    """(regex, negated, key) of a line in gitignore syntax; None: not a rule. Paths that the rule matches have its key
    among path_keys."""
    rule = line.strip()
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.lstrip("!")
    anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
    body = T.glob_to_regex(rule.strip("/"))[1:-1]
    regex = ("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if folder else "(?:/.*)?$")
    parts = rule.strip("/").split("/")
    plain = next((i for i, p in enumerate(parts) if any(c in _SPECIAL for c in p)), len(parts))
    if anchored:
        return regex, negated, "/" + "/".join(parts[:plain])
    ending = parts[0].rpartition(".")[2]
    return regex, negated, ":" + parts[0] if plain else "." + ending if "." in parts[0] and not any(c in _SPECIAL for c in ending) else ""


#: Characters that a glob gives a meaning.
_SPECIAL = "*?[]{}!\\"


def ignore_rules(lines: Iterable[str] | None) -> list[tuple[str, bool]]:
    """(regex, negated) of rules in gitignore syntax, after the defaults. None: the rules can't be read."""
    return [rule[:2] for line in [*DEFAULT_IGNORES, *(lines or ())] if (rule := _rule(line))]


def rule_table(lines: DataFrame) -> DataFrame:
    """(ord, regex, negated, key) of the rules among lines (ord, line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(o, *r) for o, line in zip(batch["ord"], batch["line"]) if line is not None and (r := _rule(line))]
            yield pd.DataFrame(made, columns=["ord", "regex", "negated", "key"])

    return lines.select(F.col("ord").cast("long"), "line").mapInPandas(run, "ord long, regex string, negated boolean, key string")


def path_keys(path: Column) -> Column:
    """Keys of the rules that can match path: its folders from the top and itself (/a/b), its parts' names (:a), what
    stands behind the last dot of each (.md), and that of rules that say nothing of the kind."""
    parts = F.split(path, "/")
    above = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    endings = F.transform(F.filter(parts, lambda p: p.contains(".")), lambda p: F.concat(F.lit("."), F.substring_index(p, ".", -1)))
    return F.array_distinct(F.concat(F.array(F.lit("/"), F.lit("")), above, F.transform(parts, lambda p: F.concat(F.lit(":"), p)), endings))


def ignored_by(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of paths (path) by any number of rules (ord, regex, negated, key): the last that matches decides.
    A path meets only rules that share a key with it; then patterns are tried."""
    sent = paths.select("path").distinct().withColumn("key", F.explode(path_keys(F.col("path"))))
    met = sent.join(rules, "key").where(F.regexp_like("path", F.col("regex"))).groupBy("path").agg(F.max_by(~F.col("negated"), "ord").alias("ignored"))
    return paths.join(met, "path", "left").select(*paths.columns, F.coalesce("ignored", F.lit(False)).alias("ignored"))


def ignored(path: Column, rules: Iterable[tuple[str, bool]]) -> Column:
    """The last rule that matches decides. A rule file is read whole by its reader, so its rules are one expression."""
    verdict = F.lit(False)
    for regex, negated in rules:
        verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict
