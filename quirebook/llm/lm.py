"""N-gram language model with deleted interpolation.

Model. The probability of a word after another mixes the maximum-likelihood estimates of the word bigram and of the
word, and the uniform distribution over all known words and one unknown. The weights of the mixture depend on a bucket
of the context's frequency (powers of two). Expectation-maximisation learns them on counts that are held out of the
estimates (the training texts of one fold), after which the fold's counts join the estimates. For that, a held-out
token is put into a cell by its bucket and its two estimates in steps of 1/4 of a doubling; cells are what is summed.
A context or word without counts leaves its share to the coarser estimate, so that probabilities sum to one.

Counting. Every word and every bigram of the corpus is counted, however rare. Words are told apart by 62 bits of
XXH64, bigrams by 62 bits of a hash of theirs. A task packs its texts into chunks of CHUNK tokens. A chunk *asks* once
for each of its distinct keys, which also carries the key's count in the chunk; keys are sorted, so that a range of the
key space takes about six bytes a key. All asks of a range meet in one group, which sums them and *replies* to each
chunk in the order of its keys. So hot words cost a key a chunk, and no text and no table of bigrams is shuffled or
broadcast. Replies meet their chunk (its words' hashes and its tokens as numbers) in a second shuffle, where texts are
scored.

Chunks are cut anew from docs for asking and for scoring, so docs have to be read alike each time (from files, say);
a chunk whose keys don't match its replies raises. CHUNK bounds a task's memory, unless one text is longer.

A text's tokens are its words and one end, which also is the first word's context. Defined cases: a null text has the
end only; without training texts every token is unseen and no token is known; repeated rows are scored alike; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import Scratch, crc_mod, pack, read, unpack

#: The token that ends a text. No word holds a space.
END = b" "
CHUNK = 1_500_000
#: Bytes of text whose keys make one range of the key space.
RANGE_BYTES = 16_000_000
#: Words whose hashes a task remembers.
TABLE = 400_000
EM_ROUNDS, BUCKETS, STEPS = 30, 64, 4
ROW = "chunk long, part int, x binary, y binary, z binary, sign long"
_LOW, _WORD, _PAIR = np.uint64(3), np.uint64(1), np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hashes(dict):
    """Words to hashes; remembers TABLE of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 5)
        return found


class Chunk:
    """Tokens of consecutive texts, as numbers into `known`, the distinct words' hashes by frequency."""

    def __init__(self, known: np.ndarray, tokens: np.ndarray):
        self.known, self.tokens = known, tokens
        self.before = np.roll(tokens, 1)  # the first text's context, too, is an end
        single = known & ~_LOW | _WORD
        pairs = (known[self.before] * _MIX + known[tokens]) & ~_LOW | _PAIR
        distinct, self.pair = np.unique(pairs, return_inverse=True)
        keys = np.concatenate([single, distinct])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.sign = int(np.bitwise_xor.reduce(self.keys).view(np.int64)) if len(keys) else 0

    @staticmethod
    def of(hashes: np.ndarray) -> Chunk:
        known, tokens, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return Chunk(known[order], rank[tokens])

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the tokens' weights for each key, in the order of keys."""
        pairs = len(self.order) - len(self.known)
        return np.concatenate([np.bincount(self.tokens, weights, len(self.known)), np.bincount(self.pair, weights, pairs)])[self.order]

    def spread(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: counts of its context, of its bigram, of its word."""
        back = np.empty(len(counts), np.float64)
        back[self.order] = counts
        single, pairs = back[: len(self.known)], back[len(self.known) :]
        return single[self.before], pairs[self.pair], single[self.tokens]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk, list, np.ndarray, np.ndarray]]:
    """(number, chunk, ids, sizes, training) for batches (doc_id, text, training, held); held-out texts make chunks of
    their own, numbered alike where only they are read."""
    hashes, number = Hashes(), [0, 0]
    open_: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
    size = [0, 0]

    def closed(held: int):
        ids, parts, training = open_[held]
        tokens = np.concatenate([np.frombuffer(p, np.uint64) for p in parts])
        sizes = np.array([len(p) // 8 for p in parts])
        made = (TaskContext.get().partitionId() << 32 | number[held] << 1 | held, Chunk.of(tokens), ids, sizes, np.array(training))
        open_[held], size[held] = ([], [], []), 0
        number[held] += 1
        return made

    for batch in batches:
        for row, (text, training, held) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            tokens = words(text.as_py())
            packed = np.fromiter(map(hashes.__getitem__, (*tokens, END)), np.uint64, len(tokens) + 1).tobytes()
            for kept, value in zip(open_[held], (batch.column(0).slice(row, 1), packed, training)):
                kept.append(value)
            size[held] += len(tokens) + 1
            if size[held] >= CHUNK:
                yield closed(held)
    for held in (0, 1):
        if size[held]:
            yield closed(held)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


_NAMES, _TYPES = ["chunk", "part", "x", "y", "z", "sign"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]


def asks(docs: DataFrame, parts: int) -> DataFrame:
    """For each chunk and range of keys: the keys (as differences), their counts, and those in the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _, sizes, training in _chunks(batches):
            n = chunk.counts(np.repeat(training, sizes).astype(np.float64)).astype(np.uint64)
            held = n * np.uint64(number & 1)
            part = ((chunk.keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            filled = np.flatnonzero(np.diff(edges))
            for some in np.array_split(filled, len(filled) // 200 + 1):
                rows = []
                for p in some.tolist():
                    at = slice(edges[p], edges[p + 1])
                    keys = chunk.keys[at]
                    rows.append((number, p, pack(np.diff(keys, prepend=np.uint64(0))), pack(n[at]), pack(held[at]), 0))
                yield _rows(rows, _NAMES, _TYPES)

    return docs.mapInArrow(run, ROW)


def replies(asked: DataFrame) -> DataFrame:
    """The rows of asked with the counts of the whole corpus in the place of the chunk's, and sums over the range's
    words in one row of each range: types, tokens, held-out tokens."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in table["x"].to_pylist()]
        ends = np.cumsum([0, *map(len, keys)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, held = (np.bincount(at, np.concatenate([unpack(v) for v in table[c].to_pylist()])) for c in ("y", "z"))
        word = distinct & _LOW == _WORD
        rows = []
        for i, (chunk, part) in enumerate(zip(table["chunk"].to_pylist(), table["part"].to_pylist())):
            mine = at[ends[i] : ends[i + 1]]
            first = i == 0
            sums = (int((n[word] > 0).sum()), int(n[word].sum()), int(held[word].sum())) if first else (0, 0, 0)
            rows.append((chunk, part, pack(n[mine]), pack(held[mine]), b"", int(np.bitwise_xor.reduce(keys[i]).view(np.int64)), *sums))
        return pa.Table.from_batches([_rows(rows, [*_NAMES, "types", "tokens", "held"], [*_TYPES, *[pa.int64()] * 3])])

    return asked.groupBy("part").applyInArrow(run, f"{ROW}, types long, tokens long, held long")


def _own(docs: DataFrame) -> DataFrame:
    """Each chunk's own row: its documents' ids and sizes, its words' hashes, its tokens. part is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, ids, sizes, _ in _chunks(batches):
            column = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64())], ["doc_id", "size"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, column.schema) as out:
                out.write_batch(column)
            yield _rows([(number, -1, sink.getvalue().to_pybytes(), pack(chunk.known), pack(chunk.tokens), chunk.sign)], _NAMES, _TYPES)

    return docs.mapInArrow(run, ROW)


def _met(table: pa.Table) -> tuple[pa.Table, Chunk, np.ndarray, np.ndarray]:
    """A chunk's documents, the chunk, and its keys' counts and held-out counts, from its own row and its replies."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "x", "y", "z", "sign"))))
    own, answered = rows[0], rows[1:]
    if own[0] != -1:
        raise RuntimeError("docs are not read alike each time: write them to files first")
    chunk = Chunk(unpack(own[2]), unpack(own[3]).astype(np.int64))
    n, held = (np.concatenate([unpack(r[i]) for r in answered]).astype(np.float64) for i in (1, 2))
    if own[4] != np.bitwise_xor.reduce([r[4] for r in answered]) or len(n) != len(chunk.keys):
        raise RuntimeError("docs are not read alike each time: write them to files first")
    return pa.ipc.open_stream(own[1]).read_all(), chunk, n, held


def bucket(context: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(context + 1.0)).astype(np.int64)


def estimates(context: np.ndarray, pair: np.ndarray, word: np.ndarray, tokens: float, types: float) -> np.ndarray:
    """The three estimates of each token (columns): bigram, word, uniform."""
    uniform = np.full(len(word), 1 / (types + 1))
    single = word / tokens if tokens else uniform
    return np.stack([np.where(context > 0, pair / np.maximum(context, 1), single), single, uniform], axis=1)


def _steps(p: np.ndarray) -> np.ndarray:
    """Minus the logarithm to base 2 in whole steps; -1 for zero."""
    return np.where(p > 0, np.rint(-STEPS * np.log2(np.maximum(p, 1e-300))), -1).astype(np.int64)


def mixture(cells: np.ndarray, types: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation over cells (bucket, steps of the bigram's estimate, of
    the word's, count). A bucket's weights start from, and are smoothed by one token of, those of all."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not len(cells):
        return weights
    at, n = cells[:, 0].astype(np.int64), cells[:, 3].astype(np.float64)
    p = np.stack([np.where(cells[:, i] >= 0, 2.0 ** (-cells[:, i] / STEPS), 0.0) for i in (1, 2)] + [np.full(len(n), 1 / (types + 1))], axis=1)
    for _ in range(rounds):
        shares = weights[at] * p
        shares *= (n / shares.sum(axis=1))[:, None]
        whole = shares.sum(axis=0) / n.sum()
        sums = np.stack([np.bincount(at, s, BUCKETS) for s in shares.T], axis=1) + whole
        weights = sums / sums.sum(axis=1, keepdims=True)
    # a word may be unseen after any context, so the uniform part keeps a little everywhere
    return (weights + 1e-6) / (weights + 1e-6).sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Replies to the chunks of docs (a table), sizes of the training set, and the weights."""

    replies: DataFrame
    tokens: int
    types: int
    weights: np.ndarray


def _marked(docs: DataFrame, training: Column, held: Column) -> DataFrame:
    return docs.select("doc_id", "text", training.alias("training"), (training & held).alias("held"))


def train(docs: DataFrame, training: Column, held: Column, scratch: Scratch) -> Model:
    """Counts over the rows of docs where training, asked for by all rows; weights from the rows where held, too."""
    marked = _marked(docs, training, held)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    answered = scratch.write("replies", replies(asks(marked, size // RANGE_BYTES + 1)))
    sums = answered.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "held"))).first()
    types, tokens, n_held = map(int, sums)
    answered = answered.drop("types", "tokens", "held")

    def run(table: pa.Table) -> pa.Table:
        _, chunk, n, held = _met(table)
        parts = chunk.spread(n - held)
        p = estimates(*parts, tokens - n_held, types)
        cells, counts = np.unique(np.stack([bucket(parts[0]), _steps(p[:, 0]), _steps(p[:, 1])]), axis=1, return_counts=True)
        return pa.Table.from_arrays([*map(pa.array, cells), pa.array(counts)], ["bucket", "pair", "single", "n"])

    both = _own(marked.where("held")).unionByName(answered.where("chunk % 2 = 1"))
    cells = both.groupBy("chunk").applyInArrow(run, "bucket long, pair long, single long, n long")
    cells = cells.groupBy("bucket", "pair", "single").agg(F.sum("n").alias("n"))
    table = cells.toArrow()  # cells of a grid: 64 buckets, and up to some hundred steps of either estimate
    return Model(answered, tokens, types, mixture(np.array([c.to_numpy() for c in table.columns]).T.reshape(-1, 4), types))


def score(docs: DataFrame, training: Column, held: Column, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, which the model was trained on
    with the same training and held."""
    tokens, types, weights = model.tokens, model.types, model.weights

    def run(table: pa.Table) -> pa.Table:
        found, chunk, n, _ = _met(table)
        context, pair, word = chunk.spread(n)
        p = (weights[bucket(context)] * estimates(context, pair, word, tokens, types)).sum(axis=1)
        size = found["size"].to_numpy()
        starts = np.cumsum(size) - size
        sums = [np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), np.log10(word + 1) - np.log10(tokens + types + 1), np.log10(p))]
        return pa.table({"doc_id": found["doc_id"], "n_tokens": size, "n_known": sums[0], "train_tokens": np.full(len(size), tokens), "base_score": sums[1], "score": sums[2]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = _own(_marked(docs, training, held)).unionByName(model.replies)
    return both.groupBy("chunk").applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_lm: see the README for its columns."""
    docs, fold = read(spark, sf_dir, "documents"), crc_mod("doc_id", 7)
    model = train(docs, fold != 2, fold == 3, Scratch(spark))
    found = score(docs, fold != 2, fold == 3, model)
    return found.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
