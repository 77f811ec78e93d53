"""Changes to keyed tables, as new tables: Parquet has no row updates. See store for tables that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirebook.functions import text as T


def latest(changes: DataFrame, key: str = "path", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, *(F.col("last")[c].alias(c) for c in rest))


def upsert(table: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """table with rows put in, in the place of rows of the same key."""
    return table.join(rows.select(key), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """table without keys; missing ones don't matter."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(table.columns)


def deleted_count(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("deleted"))


def write(notes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after writing rows (path, content), and (path, created) for each."""
    had = notes.select("path", F.lit(True).alias("had"))
    done = rows.join(had, "path", "left").select("path", F.col("had").isNull().alias("created"))
    return upsert(notes.select("path", "content"), rows), done


def append(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, content, created): the notes of rows (path, suffix) with the suffix at their end, or as new notes."""
    met = rows.join(notes.select("path", "content"), "path", "left")
    return met.select("path", F.concat(F.coalesce("content", F.lit("")), "suffix").alias("content"), F.col("content").isNull().alias("created"))


def edit(notes: DataFrame, old: Column, new: Column) -> DataFrame:
    """(path, content, n, error): the one occurrence of old replaced, literally; none or several are an error."""
    n = T.occurrences(F.col("content"), old)
    error = F.when(n == 0, "not found").when(n > 1, "not unique")
    return notes.select("path", F.when(n == 1, T.replace_once(F.col("content"), old, new)).otherwise(F.col("content")).alias("content"), n.alias("n"), error.alias("error"))


def trash(notes: DataFrame, bin_: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and bin after moving paths from one to the other."""
    moved = notes.join(paths.select("path").distinct(), "path", "left_semi")
    return delete(notes, paths), bin_.unionByName(moved)


def unchanged(notes: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, hash, changed): notes held against stored hashes (path, hash)."""
    now = notes.select("path", F.sha2("content", 256).alias("hash"))
    return now.join(stored.select("path", F.col("hash").alias("_had")), "path", "left").select("path", "hash", (F.col("_had").isNull() | (F.col("_had") != F.col("hash"))).alias("changed"))


def contents(table: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """(key, content) for each of keys; null where the table has none."""
    return keys.select(key).distinct().join(table.select(key, "content"), key, "left")
