"""Line search over notes (path, content)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirebook.functions import text as T


def compiled(pattern: str, regex: bool = True, ignore_case: bool = True) -> str:
    """The pattern for Spark; an invalid one fails here, before any job. Upper and lower case are Unicode's."""
    if not pattern:
        raise ValueError("the pattern is empty")
    body = pattern if regex else re.escape(pattern)
    try:
        re.compile(body)
    except re.error as error:
        raise ValueError(f"invalid pattern: {error}") from error
    return ("(?iu)" if ignore_case else "") + body


def grep(notes: DataFrame, pattern: str, regex: bool = True, ignore_case: bool = True, include: str = "**/*.md", folder: str = "", context: int = 2, limit: int | None = 50) -> DataFrame:
    """(path, line, column, match, before, after): a row for each line with a match; line and column (in UTF-16 units)
    count from 1; context lines are cut at their right end. Paths are filtered before lines are made; notes without a
    match are dropped before they are split. With a limit, the first in the order of path and line."""
    found = compiled(pattern, regex, ignore_case)
    path = F.col("path")
    some = notes.where(~T.excluded(path) & T.under(path, folder) & T.glob_match(path, include)).where(F.col("content").rlike(found))
    lines = some.select("path", F.split("content", "\n", -1).alias("lines")).select("path", "lines", F.posexplode("lines").alias("pos", "text")).where(F.col("text").rlike(found))
    cut = lambda part: F.transform(part, lambda x: F.rtrim(x, F.lit(T.WHITE)))
    before = F.slice("lines", F.greatest(F.col("pos") - context, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(context)))
    hits = lines.select(
        "path", (F.col("pos") + 1).cast("long").alias("line"), F.regexp_instr("text", F.lit(found)).cast("long").alias("column"), F.rtrim("text", F.lit(T.WHITE)).alias("match"),
        cut(before).alias("before"), cut(F.slice("lines", F.col("pos") + 2, F.lit(context))).alias("after"),
    )
    return hits if limit is None else hits.orderBy("path", "line").limit(limit)
