"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text is measured and held against rules. Failures are counted by host (the documents' source), and each host's
failure rate is shrunk towards the mean of all hosts with a beta prior fitted to the hosts' rates by the method of
moments, so that a host with few documents isn't judged by them alone. Host verdicts are joined back: a document that
fails a base rule goes anywhere; one that fails a soft rule goes on a suspect host, and one that fails two goes on any
host; on a host that is bad nearly throughout, every document goes. A host's counts are summed before the shuffle, and
its verdict is broadcast, so no task gets the rows of a host with a third of them.

Defined cases: a null text has no words (and so fails); documents of null source share one nameless host; repeated
rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import Scratch, let, read

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 20
WINDOW = 8
#: A host above the first rate is suspect, above the second bad.
SUSPECT, BAD = 0.1, 0.9
#: Strength of the prior where the hosts' rates don't spread, in documents.
STRENGTH = 100.0
#: Hosts whose rates are broadcast: some megabytes.
BROADCAST = 100_000


def _repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of width words that the text holds twice or more. Hashes of all windows tell whether any
    repeats; only then are they sorted with their places, equal neighbours compared word by word, and the union of
    their places measured."""
    window = lambda i: F.slice(words, i, width)
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(window(i)))

    def covered(ranked: Column) -> Column:
        n = F.size(ranked)

        def same(i: Column, j: Column) -> Column:
            a, b = F.try_element_at(ranked, i), F.try_element_at(ranked, j)
            return (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))

        twins = F.filter(F.sequence(F.lit(1), n), lambda k: ((k > 1) & same(k, F.greatest(k - 1, F.lit(1)))) | ((k < n) & same(k, k + 1)))
        places = F.sort_array(F.transform(twins, lambda k: F.try_element_at(ranked, k)["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["n"] + i + width - F.greatest(s["end"], i)).alias("n"), (i + width).alias("end"))
        return F.aggregate(places, zero, step, lambda s: s["n"])

    ranked = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(window(i)).alias("h"), i.alias("i"))))
    some = let(hashes, lambda h: F.size(h) > F.size(F.array_distinct(h)))
    return F.when((F.size(words) > width) & some, let(ranked, covered)).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of all that is counted in a text."""
    text = F.coalesce(text, F.lit(""))
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _repeat_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(F.array_remove(F.split(text, SPACE, -1), ""), of_words).alias("words"), let(lines, of_lines).alias("lines"),
        without(r"[#*$%&|<>]+").alias("n_symbols"), without("[A-Z]+").alias("n_upper"),
    )


def _rules(m: Column, host: Column) -> Column:
    words, n = m["words"], m["words"]["n_words"]
    base = (n < MIN_WORDS) | (100 * words["n_repeat_words"] > 30 * n)
    soft = (10 * m["n_symbols"] > n, 10 * m["lines"]["n_dup_lines"] > 3 * m["lines"]["n_lines"], (words["word_chars"] < 2 * n) | (words["word_chars"] > 20 * n), 2 * m["n_upper"] > words["word_chars"])
    n_soft = sum((F.when(s, 1).otherwise(0) for s in soft), F.lit(0))
    counts = [n.alias("n_words"), words["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["n_dup_lines"].alias("n_dup_lines"), words["n_repeat_words"].alias("n_repeat_words")]
    return F.struct(*counts, base.alias("base_failed"), n_soft.alias("n_soft"), host.alias("host"))


def ruled(docs: DataFrame) -> DataFrame:
    """(row, quality) for each row of docs: the row as a struct, so that no column of it can clash; and the measures,
    base_failed, n_soft (soft rules that fail) and host."""
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), let(measures(F.col("text")), lambda m: _rules(m, host)).alias("quality"))


def host_rates(marked: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): the shrunk failure rate of each host of marked (quality)."""
    failed = F.col("quality.base_failed") | (F.col("quality.n_soft") > 0)
    hosts = marked.groupBy(F.col("quality.host").alias("host")).agg(F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed"))
    hosts = Scratch(marked.sparkSession).write("hosts", hosts)
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("mean"), F.var_samp(raw).alias("var")).first()  # one row of two numbers
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    strength = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else STRENGTH
    return hosts.withColumn("rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def verdicts(marked: DataFrame, rates: DataFrame) -> DataFrame:
    """marked (row, quality) with host_rate and kept.

    Up to BROADCAST hosts are broadcast. Of more, those with over 1 / BROADCAST of all documents, of which there are
    fewer than BROADCAST, are broadcast, and only documents of the others, each a small group, are shuffled."""
    soft = F.when(F.col("host_rate") > SUSPECT, 1).otherwise(2)
    # one expression over both sides: no part of it can be pushed below the join, where it would measure the text again
    kept = F.when(F.col("host_rate") > BAD, False).otherwise(~F.col("quality.base_failed") & (F.col("quality.n_soft") < soft))
    sums = rates.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs")).first()
    named = rates.select("host", "n_docs", F.col("rate").alias("host_rate"))
    if sums["hosts"] <= BROADCAST:
        joined = marked.join(F.broadcast(named), F.col("quality.host") == F.col("host"), "left")
    else:
        hot = F.col("n_docs") * BROADCAST > sums["docs"]
        first = marked.join(F.broadcast(named.where(hot)), F.col("quality.host") == F.col("host"), "left")
        rest = first.where("host is null").select("row", "quality").join(named.where(~hot), F.col("quality.host") == F.col("host"), "left")
        joined = first.where("host is not null").unionByName(rest)
    return joined.withColumn("kept", kept).drop("host", "n_docs")


def clean(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep. The measured rows are written once, which is cheaper than to measure the
    texts for the hosts' counts and again for the verdicts."""
    marked = Scratch(docs.sparkSession).write("measured", ruled(docs))
    return verdicts(marked, host_rates(marked)).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_quality: see the README for its columns."""
    docs = read(spark, sf_dir, "documents")
    marked = Scratch(spark).write("quality", ruled(docs.select("doc_id", "text", "source")).select(F.struct("row.doc_id").alias("row"), "quality"))
    found = verdicts(marked, host_rates(marked))
    return found.select("row.doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), "kept")


#: The query's rows in DuckDB SQL.
SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM doc),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS p FROM w, unnest(range(1, len(w) - 6)) AS s(i)),
twin AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM win GROUP BY doc_id, p HAVING count(*) > 1)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM twin, unnest(range(i, i + 8)) AS s(j) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM doc JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, (10 * n_symbols > n_words)::INT + (10 * n_dup_lines > 3 * len(lines))::INT + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + (2 * n_upper > word_chars)::INT AS n_soft FROM r),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR n_soft > 0) AS k FROM f GROUP BY host),
p AS (SELECT avg(k / n) AS a, coalesce(var_samp(k / n), 0) AS v FROM h),
g AS (SELECT host, (k + a * s) / (n + s) AS rate FROM h, (SELECT a, CASE WHEN v > 0 AND v < a * (1 - a) THEN a * (1 - a) / v - 1 ELSE 100.0::DOUBLE END AS s FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_soft < CASE WHEN rate > 0.1 THEN 1 ELSE 2 END AND rate <= 0.9 AS kept
FROM f JOIN g USING (host)
"""
