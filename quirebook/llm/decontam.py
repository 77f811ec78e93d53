"""Benchmark decontamination on a distributed positional inverted index.

The index is a written table, partitioned by document: a row is a shard, the posting lists of some megabytes of
documents: all their terms, and for each the sorted places of its occurrences, numbered through the shard. A test phrase
is answered inside every shard by intersecting the posting lists of its terms, each shifted by the term's offset in the
phrase, from the shard's rarest term on; a phrase with a term that the shard lacks is dropped before any list is
touched. Proximity keeps the places of the rarest term that have every other term near, and slides a window around
those. As a document's postings all lie in one shard, no posting is shuffled, a hot term has a list in each shard
instead of one long list, and a lost executor costs its tasks only.

The test set is broadcast in blocks of at most BLOCK_BYTES of item text. One block is the usual case; of a larger set,
each block is read, broadcast, answered from the index into a table of hits, and released before the next.

Defined cases: a null text has no words; items with a null id or text, or without words, match nothing; repeated items
and rows count as given; an empty test set marks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import Scratch, pack, read, unpack

WINDOW = 10
BLOCK_BYTES = 4_000_000
SHARD_BYTES = 6_000_000
#: A-Z become a-z; of ASCII only letters and digits stay, and all other characters belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<start:int,end:int>>"
#: Places between two documents of a shard: no phrase or proximity match is longer.
GAP = 64
#: Words that a proximity match of a window may take.
SLOP = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """Test phrases over a vocabulary of their own terms: a row of term numbers each (-1 beyond its end), and the
    items that hold it."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        phrases: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                phrases.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.items = [sorted(x) for x in phrases.values()]
        self.lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
        self.terms = np.full((len(phrases), width), -1, np.int32)
        for row, p in enumerate(phrases):
            self.terms[row, : len(p)] = p


class Shard:
    """Posting lists of some documents: sorted terms, and for each its places."""

    def __init__(self, terms: list[bytes], counts: np.ndarray, positions: np.ndarray, sizes: np.ndarray):
        self.terms, self.counts, self.positions, self.sizes = terms, counts, positions, sizes
        self.starts = np.cumsum([0, *(n + GAP for n in sizes)])  # a gap keeps matches inside their document
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    @staticmethod
    def of(texts: list[str | None]) -> Shard:
        table: dict[bytes, int] = {}
        parts, places, at = [], [], 0
        for text in texts:
            ids = [table.setdefault(w, len(table)) for w in words(text)]
            parts.append(np.array(ids, np.int64))
            places.append(np.arange(at, at + len(ids)))
            at += len(ids) + GAP
        ids = np.concatenate(parts)
        terms = sorted(table)
        rank = np.empty(len(terms), np.int64)
        rank[[table[t] for t in terms]] = np.arange(len(terms))
        ids = rank[ids]
        order = np.argsort(ids, kind="stable")
        return Shard(terms, np.bincount(ids, minlength=len(terms)), np.concatenate(places)[order], np.array([len(p) for p in parts]))

    def stored(self) -> tuple[bytes, ...]:
        steps = np.diff(self.positions, prepend=0)
        starts = self.first[:-1]
        steps[starts] = self.positions[starts]  # each list starts anew
        return pack(self.sizes), zstandard.compress(b" ".join(self.terms), 1), pack(self.counts), pack(steps)

    @staticmethod
    def read(sizes: bytes, terms: bytes, counts: bytes, steps: bytes) -> Shard:
        counts, steps = unpack(counts).astype(np.int64), unpack(steps).astype(np.int64)
        sums = np.cumsum(steps)
        starts = np.cumsum(counts) - counts
        return Shard(zstandard.decompress(terms).split(), counts, sums - np.repeat((sums - steps)[starts], counts), unpack(sizes).astype(np.int64))

    def numbers(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """The shard's numbers of a vocabulary's terms; -1 for those it lacks, and in the last place."""
        out = np.full(len(vocabulary) + 1, -1, np.int64)
        for i, t in enumerate(self.terms):
            if (k := vocabulary.get(t)) is not None:
                out[k] = i
        return out

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the phrase starts: shifted lists are intersected from the rarest term on."""
        order = np.argsort(self.counts[terms], kind="stable")
        at = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            listed = self.postings(terms[k])
            i = np.searchsorted(listed, at + k)
            at = at[listed[np.minimum(i, len(listed) - 1)] == at + k]
            if not len(at):
                break
        return at

    def near(self, terms: np.ndarray, slop: int) -> list[tuple[int, int]]:
        """Shortest spans (first, last place) of at most slop words that hold all of terms."""
        wanted = sorted(set(terms.tolist()), key=lambda t: self.counts[t])
        at = self.postings(wanted[0])
        for t in wanted[1:]:
            listed = self.postings(t)
            at = at[np.searchsorted(listed, at + slop) > np.searchsorted(listed, at - slop + 1)]
            if not len(at):
                return []
        places = []
        for t in wanted:
            listed = self.postings(t)
            a, b = np.searchsorted(listed, at - slop + 1), np.searchsorted(listed, at + slop)
            places += [(int(p), t) for p in np.unique(np.concatenate([listed[i:j] for i, j in zip(a, b)]))]
        spans, last = [], {}
        for p, t in sorted(places):
            last[t] = p
            if len(last) == len(wanted) and p - (a := min(last.values())) < slop:
                if not spans or spans[-1][0] != a:
                    spans.append((a, p))
        return spans

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _shards(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Consecutive rows with some megabytes of text, and their texts."""
    for batch in batches:
        first, texts, size = 0, [], 0
        for row, value in enumerate(batch.column(text), 1):
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= SHARD_BYTES or row == batch.num_rows:
                yield batch.slice(first, len(texts)), texts
                first, texts, size = row, [], 0


STORED = ["sizes", "terms", "counts", "steps"]


def index(docs: DataFrame) -> DataFrame:
    """Shards (shard, ids, sizes, terms, counts, steps) of docs (doc_id, text, ...), to be written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rows, texts) in enumerate(_shards(batches)):
            ids, sink = rows.select(["doc_id"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as out:
                out.write_batch(ids)
            values = TaskContext.get().partitionId() << 32 | number, sink.getvalue().to_pybytes(), *Shard.of(texts).stored()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["shard", "ids", *STORED])

    return docs.select("doc_id", "text").mapInArrow(run, f"shard long, ids binary, {', '.join(f'{c} binary' for c in STORED)}")


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Disjoint spans, in order, of the union."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")


def _n_blocks(items: DataFrame, block_bytes: int) -> int:
    return -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1


def _block(items: DataFrame, i: int, n: int) -> list[tuple[str, str]]:
    return [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toLocalIterator()]


def _found(shard: Shard, phrases: Phrases, slop: int) -> dict[int, tuple[list, set, set]]:
    """By document of the shard: spans of phrases, their items, and with slop also the items of phrases that are near."""
    numbers = shard.numbers(phrases.vocabulary)
    local = numbers[phrases.terms]
    out: dict[int, tuple[list, set, set]] = {}
    for row in np.flatnonzero(((local >= 0) | (phrases.terms < 0)).all(axis=1)):
        n = phrases.lengths[row]
        terms = local[row, :n]
        at = shard.phrase(terms)
        for d, p in zip(shard.document(at).tolist(), at.tolist()):
            spans, items, _ = out.setdefault(d, ([], set(), set()))
            spans.append((int(p - shard.starts[d]), int(p - shard.starts[d] + n)))
            items.update(phrases.items[row])
        if slop:
            near = np.array([a for a, _ in shard.near(terms, max(slop, n))], np.int64)
            for d in shard.document(near).tolist():
                out.setdefault(d, ([], set(), set()))[2].update(phrases.items[row])
    return out


_FOUND = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def _answers(ids: pa.Table, sizes: list[int], hits: dict[int, tuple[list, set, set]]) -> pa.RecordBatch:
    rows = [hits.get(d, ([], (), ())) for d in range(len(sizes))]
    columns = [sizes, [_merged(r[0]) for r in rows], [sorted(r[1]) for r in rows], [sorted(r[2]) for r in rows]]
    return pa.RecordBatch.from_arrays([ids.column("doc_id").combine_chunks(), *(pa.array(c, f.type) for c, f in zip(columns, _FOUND))], ["doc_id", *_FOUND.names])


def search(shards: DataFrame, kind: str, benchmark: DataFrame, scratch: Scratch, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """phrase_matches from a written index whose doc_id has the type kind."""
    if not 0 < width <= GAP or not 0 <= slop <= GAP:
        raise ValueError(f"matches have {GAP} words at most")
    items = _items(benchmark)
    n, context = _n_blocks(items, block_bytes), shards.sparkSession.sparkContext
    schema = f"doc_id {kind}, n_words long, spans {SPANS}, items array<string>, near array<string>"

    def answered(shared, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard.read(*(row[c] for c in STORED))
                    hits = _found(shard, shared.value, slop)
                    if whole:
                        yield _answers(pa.ipc.open_stream(row["ids"]).read_all(), shard.sizes.tolist(), hits)
                    elif hits:
                        flat = [(row["shard"], d, [{"start": a, "end": b} for a, b in s], sorted(i), sorted(m)) for d, (s, i, m) in hits.items()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), [pa.int64(), pa.int64(), *_FOUND.types[1:]])], ["shard", "row", "spans", "items", "near"])

        return run

    if n == 1:
        return shards.mapInArrow(answered(context.broadcast(Phrases(_block(items, 0, 1), width)), True), schema)
    parts = f"shard long, row long, spans {SPANS}, items array<string>, near array<string>"
    tables = []
    for i in range(n):
        shared = context.broadcast(Phrases(_block(items, i, n), width))
        tables.append(scratch.write(f"hits{i}", shards.mapInArrow(answered(shared, False), parts)))
        shared.destroy()
    own = shards.select("shard", F.lit(-1).cast("long").alias("row"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<string>").alias("near"), "ids", "sizes")
    both = own
    for t in tables:
        both = both.unionByName(t, allowMissingColumns=True)

    def merged(table: pa.Table) -> pa.Table:
        hits: dict[int, tuple[list, set, set]] = {}
        for r in table.to_pylist():
            if r["row"] < 0:
                ids, sizes = pa.ipc.open_stream(r["ids"]).read_all(), unpack(r["sizes"]).tolist()
                continue
            spans, found, near = hits.setdefault(r["row"], ([], set(), set()))
            spans += [(x["start"], x["end"]) for x in r["spans"]]
            found.update(r["items"])
            near.update(r["near"])
        return pa.Table.from_batches([_answers(ids, sizes, hits)])

    return both.groupBy("shard").applyInArrow(merged, schema)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, spans, items, near) for each row of docs: the disjoint word spans [start, end) covered by
    occurrences of a window of width consecutive item words (of the whole item, if it has fewer), and the ids of the
    items with such a window, sorted; with slop also the ids of items with a window whose words all lie, in any order,
    within slop words."""
    scratch = Scratch(docs.sparkSession)
    return search(scratch.write("index", index(docs)), docs.schema["doc_id"].dataType.simpleString(), benchmark, scratch, width, block_bytes, slop)


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end): the shortest word spans [start, end) of at most slop words that hold every word
    of a query (item_id, text), in any order."""
    if not 0 < slop <= GAP:
        raise ValueError(f"matches have {GAP} words at most")
    scratch, context = Scratch(docs.sparkSession), docs.sparkSession.sparkContext
    shards, items = scratch.write("index", index(docs)), _items(queries)
    kind = docs.schema["doc_id"].dataType.simpleString()
    n, out = _n_blocks(items, block_bytes), None
    for b in range(n):
        shared = context.broadcast(_block(items, b, n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = [(item, sorted(set(words(text)))) for item, text in shared.value]
            vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(q for _, q in asked))))}
            for batch in batches:
                for row in batch.to_pylist():
                    shard, found = Shard.read(*(row[c] for c in STORED)), []
                    numbers = shard.numbers(vocabulary)
                    for item, query in asked:
                        terms = numbers[[vocabulary[w] for w in query]] if query else np.array([-1])
                        if (terms >= 0).all():
                            for a, z in shard.near(terms, slop):
                                d = int(shard.document(np.array([a]))[0])
                                found.append((d, item, int(a - shard.starts[d]), int(z - shard.starts[d]) + 1))
                    rows, *columns = list(zip(*found)) or [[]] * 4
                    columns = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))]
                    ids = pa.ipc.open_stream(row["ids"]).read_all().column("doc_id").combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *columns], ["doc_id", "item_id", "start", "end"])

        made = scratch.write(f"near{b}", shards.mapInArrow(run, f"doc_id {kind}, item_id string, start int, end int"))
        shared.destroy()
        out = made if out is None else out.unionByName(made)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_decontam: see the README for its columns."""
    found = phrase_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_items, n_near, near_sha256): documents against the proximity of the test set's windows."""
    found = phrase_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a window of the test set. Rows are judged where they are read, against posting
    lists made on the way; of a larger test set, what a block leaves is written before the next."""
    items, scratch, context = _items(benchmark), Scratch(docs.sparkSession), docs.sparkSession.sparkContext
    n = _n_blocks(items, block_bytes)
    for b in range(n):
        shared = context.broadcast(Phrases(_block(items, b, n), width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, texts in _shards(batches):
                hits = _found(Shard.of(texts), shared.value, 0)
                yield rows.filter(pa.array([d not in hits for d in range(len(texts))], pa.bool_()))

        kept = docs.mapInArrow(run, docs.schema)
        if n > 1:
            kept = scratch.write(f"kept{b}", kept)
            shared.destroy()
        docs = kept
    return docs


#: The query's rows in DuckDB SQL.
SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS p FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS s(i)),
hit AS (SELECT DISTINCT doc_id, i, place.n, item_id FROM place JOIN win USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS s(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
