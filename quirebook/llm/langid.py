"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of its labelled texts. A text is encoded
with every language's dictionary, and the language with the smallest encoding wins. Where the margin is narrow, the
text is encoded again by a slower, stronger compressor; if the margin stays below REJECT, the answer is rejected.
Texts and dictionaries are lower-cased first, as shouting would hide what they share.

The sample is the one bounded thing: about SAMPLE_DOCS texts a language (drawn by a hash of id and text), SLICE
characters from a hashed place of each, DICTIONARY bytes in all, and less where there are more languages than ALL bytes
have room for, so that the dictionaries' broadcast is bounded. Every text is encoded whole, with every language.

Defined cases: a text that is null or has no letter is `und` with score 0; without labelled texts every text is `und`;
a language none of whose rows is drawn takes no part; with one language only, its score is 1; equal sizes go to the
language with more labelled texts; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import crc_mod, read

SAMPLE_DOCS, SLICE, DICTIONARY, ALL = 400, 1500, 64_000, 16_000_000
#: Relative margins: below the first, the stronger level decides; below the second, the answer is rejected.
NARROW, REJECT = 0.05, 0.01
FAST, STRONG = 3, 12
UNKNOWN = "und"


class Languages:
    """A compressor for each language, for each of two levels."""

    def __init__(self, dictionaries: dict[str, bytes], priors: dict[str, int]):
        self.names = sorted(dictionaries, key=lambda name: (-priors[name], name))
        self.compressors = {level: [self._compressor(dictionaries[name], level) for name in self.names] for level in (FAST, STRONG)}

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_dict_id=False)

    def _best(self, data: bytes, level: int) -> tuple[str, float]:
        sizes = [len(c.compress(data)) for c in self.compressors[level]]
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = 1 - sizes[ranked[0]] / sizes[ranked[1]] if len(ranked) > 1 else 1.0
        return self.names[ranked[0]], margin

    def guess(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 (1 from a margin of a tenth), and whether the answer is rejected."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        name, margin = self._best(data, FAST)
        if margin < NARROW:
            name, margin = self._best(data, STRONG)
        return name, min(1.0, 10 * margin), margin < REJECT


def learn(labelled: DataFrame) -> tuple[dict[str, bytes], dict[str, int]]:
    """Dictionaries and counts by language, from (doc_id, text, lang); rows without text or lang don't count."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    priors = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not priors:
        return {}, {}
    drawn = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for name, n in priors.items() for x in (name, min(1.0, SAMPLE_DOCS / n))))
    place = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.greatest(F.length("text") - SLICE, F.lit(0)) + 1)
    sample = rows.where(drawn < share[F.col("lang")]).select("lang", F.substr("text", place.cast("int") + 1, F.lit(SLICE)).alias("part"), drawn.alias("drawn"))
    parts: dict[str, dict[str, float]] = {name: {} for name in priors}
    # copies of a row draw the same number and are one, so that about SAMPLE_DOCS rows a language come
    for r in sample.groupBy("lang", "drawn").agg(F.min("part").alias("part")).toLocalIterator():
        parts[r["lang"]][r["part"].lower()] = r["drawn"]
    # the longest pieces first when short ones abound; equal ones in the order drawn
    ordered = {name: sorted(p, key=lambda x: (len(x) < 200, p[x], x)) for name, p in parts.items()}
    return {name: "\n".join(p).encode("utf-8", "surrogatepass")[: min(DICTIONARY, ALL // len(priors))] for name, p in ordered.items() if p}, priors


def identify(docs: DataFrame, dictionaries: dict[str, bytes], priors: dict[str, int]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of docs (doc_id, text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast((dictionaries, priors))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(*shared.value)
        for batch in batches:
            names, scores, rejected = zip(*(languages.guess(t.as_py()) for t in batch.column(1))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_langid: see the README for its columns."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, *learn(docs.where(crc_mod("doc_id", 5) != 0)))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
