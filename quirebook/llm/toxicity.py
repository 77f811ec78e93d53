"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into overlapping windows,
each is compressed with both, and a window's excess is what it takes longer with the ordinary dictionary than with the
toxic one. What the numbers and shares of windows over each of THRESHOLDS say of a text is calibrated by logistic
regression on labelled texts that no dictionary was trained on, and so is the threshold from which a window is reported.

A dictionary is what both share (pieces that are common in ordinary text, so that ordinary language costs the same with
both) and then the kind's own pieces: runs of bytes that its texts hold and the other kind's don't, by a lower
bound of their odds ratio, those in a share of at least SUPPORT of its texts only. Near copies count as one text in
training, else a text that was copied often would be taken for the kind. Texts are lower-cased first.

All labelled texts are learned from, whole: of ids by hash seven in ten for the dictionaries and the others for threshold
and weights. Runs and pieces are counted by Spark; the driver gets those that stand in SUPPORT of a kind's texts or more
(so of runs at most 1 / SUPPORT times as many as a text has on average) and the sums of each step of the regression. Of
near copies the first by a hash stays; a row of a repeated id is a text like any other.

Defined cases: a text that is null, empty or shorter than a window is one window or none and gets the score that its
features have; a row of labels without id or label is no row, one id with several labels is toxic if one of them says
so; where either kind has no text to learn from, every score is the share of toxic labels learned from (0 without any);
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import Scratch, crc_mod, read

#: Labels and keys that are broadcast; more are shuffled. Bytes of text that are counted at once.
BROADCAST, COUNTED = 2_000_000, 2 << 20
WINDOW, STEP = 64, 32
#: Bytes of a piece at least, of what both dictionaries share, and of each kind's own pieces.
GRAM, SHARED, OWN = 5, 4096, 4096
#: Of a kind's own pieces: the odds ratio's logarithm at least (two standard errors below the estimate), texts with it.
CONTRAST, SUPPORT, SUPPORT_TEXTS = 1.4, 0.02, 3
#: Of the ordinary windows at most this share may reach the threshold of a reported window.
FALSE_WINDOWS = 0.002
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10)
PREDICT, MOST = 0.3, 31


def grams(data: bytes, size: int = GRAM) -> np.ndarray:
    """All runs of size bytes, as whole numbers (hashes where size is over 8)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw, out = np.frombuffer(data, np.uint8).astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(size):
        out = (out << np.uint64(8) | raw[j : j + n]) if size <= 8 else out * np.uint64(0x100000001B3) + raw[j : j + n]
    return out


def copy_runs(text: bytes) -> np.ndarray:
    """Of the distinct 32-byte runs one in sixteen, by hash."""
    runs = grams(text, 32)
    return np.unique(runs[(runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60) == 0])


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """Texts less than half of whose runs stand in a text before. (originals does so for a table.)"""
    kept, seen = [], set()
    for text in texts:
        runs = set(copy_runs(text).tolist())
        if not runs or 2 * len(runs & seen) < len(runs):
            kept.append(text)
            seen |= runs
    return kept


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def originals(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key) of texts (key, label, text): those less than half of whose runs stand in a text of their label with a lesser
    hash; of equal texts one. Only counts are gathered, no group of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [lowered(t.as_py()) for t in batch.column(2)]
            h = np.array([xxhash.xxh64_intdigest(d) for d in data], np.uint64).view(np.int64)
            runs = [r.view(np.int64) if len(r) else h[i : i + 1] for i, r in enumerate(map(copy_runs, data))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h), pa.array(runs, pa.list_(pa.int64()))], ["key", "label", "h", "runs"])

    marks = scratch.write("marks", texts.select("key", "label", "text").mapInArrow(run, "key long, label int, h long, runs array<long>"))
    first = marks.select("label", "h", F.explode("runs").alias("run")).groupBy("label", "run").agg(F.min("h").alias("h")).groupBy("label", "h").agg(F.count("*").alias("first"))
    one = marks.groupBy("label", "h").agg(F.min("key").alias("key"), F.min(F.size("runs")).alias("n"))
    return scratch.write("originals", one.join(first, ["label", "h"]).where("2 * first > n").select("key"))


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs and in how many texts they stand."""
    found = [np.unique(grams(t)) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))


def odds(count: np.ndarray, n: int, other: np.ndarray, m: int) -> np.ndarray:
    """Lower bounds of the logarithms of odds ratios."""
    a, b, c, d = count + 0.5, n - count + 0.5, other + 0.5, m - other + 0.5
    return np.log(a / b) - np.log(c / d) - 2 * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def run_counts(texts: DataFrame) -> DataFrame:
    """(run, toxic, ordinary): in how many of texts (label, text) of each kind a run stands."""

    def rows(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for label, data in held.items():
            runs, n = counted(data)
            none = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n.astype(np.int64) if label else none), pa.array(none if label else n.astype(np.int64))], ["run", "toxic", "ordinary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = lowered(text.as_py())
                held.setdefault(label, []).append(data)
                size += len(data)
                if size >= COUNTED:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    every = texts.select("label", "text").mapInArrow(run, "run long, toxic long, ordinary long")
    return every.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def pieces(text: bytes, runs: np.ndarray, counts: np.ndarray, strength: np.ndarray) -> dict[bytes, float]:
    """Around the strongest run of each stretch of a text's strong runs (runs, sorted), as far as half of its texts reach."""
    here, found = grams(text), {}
    if not len(here) or not len(runs):
        return found
    at = np.minimum(np.searchsorted(runs, here), len(runs) - 1)
    strong = np.concatenate(([False], runs[at] == here, [False]))
    edges = np.flatnonzero(strong[1:] != strong[:-1]).tolist()
    for begin, end in zip(edges[::2], edges[1::2]):
        peak = begin + int(strength[at[begin:end]].argmax())
        low = high = peak
        while low > begin and 2 * counts[at[low - 1]] >= counts[at[peak]]:
            low -= 1
        while high + 1 < end and 2 * counts[at[high + 1]] >= counts[at[peak]]:
            high += 1
        piece = text[low : high + GRAM]
        found[piece] = max(found.get(piece, -1e9), float(strength[at[peak]]))
    return found


def chosen(found: list[tuple[bytes, float]], most: int) -> list[bytes]:
    """The strongest pieces that are new by half, of `most` bytes together."""
    kept, seen, size = [], set(), 0
    for piece, _ in sorted(found, key=lambda p: (-p[1], -len(p[0]), p[0])):
        parts = set(grams(piece).tolist())
        if 2 * len(parts - seen) > len(parts) and size + len(piece) <= most:
            kept.append(piece)
            seen |= parts
            size += len(piece)
    return kept


def trained(parts: list[bytes]) -> bytes:
    random.Random(1).shuffle(parts)
    try:
        return zstandard.train_dictionary(SHARED, parts, k=32, d=6).as_bytes()[-SHARED:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(parts)[-SHARED:]


def common(texts: DataFrame, scratch: Scratch) -> bytes:
    """Pieces that are common in texts (text): each COUNTED bytes of all texts give a dictionary, and these give one in
    turn, until they fit one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                data = value if isinstance(value, bytes) else lowered(value)
                parts += [data[i : i + WINDOW] for i in range(0, len(data) - WINDOW + 1, WINDOW)]
                size += len(data)
                if size >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array([trained(parts)], pa.binary())], ["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([trained(parts)], pa.binary())], ["content"])

    most = COUNTED // SHARED
    now = scratch.write("common0", texts.select("text").mapInArrow(run, "content binary"))
    level, n = 1, now.count()
    while n > most:
        now = scratch.write(f"common{level}", now.repartition(-(-n // most), F.xxhash64("content")).mapInArrow(run, "content binary"))
        level, n = level + 1, now.count()
    found = sorted(bytes(r["content"]) for r in now.collect())
    for i in range(level):
        scratch.drop(f"common{i}")
    return found[0] if len(found) == 1 else trained([c[i : i + WINDOW] for c in found for i in range(0, len(c) - WINDOW + 1, WINDOW)])


def dictionaries(texts: DataFrame, scratch: Scratch) -> tuple[bytes, bytes]:
    """Of toxic and of ordinary text, from texts (label, text). zstandard reaches the end of a dictionary with the
    shortest offsets, so the strongest pieces stand last."""
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, ordinary = n.get(1, 0), n.get(0, 0)
    least, least_other = (max(SUPPORT_TEXTS, SUPPORT * x) for x in (toxic, ordinary))
    often = run_counts(texts).where((F.col("toxic") >= least) | (F.col("ordinary") >= least_other)).orderBy("run").toArrow()
    runs, a, b = (often.column(c).to_numpy() for c in ("run", "toxic", "ordinary"))
    runs = runs.astype(np.uint64)
    own, other = odds(a, toxic, b, ordinary), odds(b, ordinary, a, toxic)
    # by kind: 1 a toxic text's own, 0 an ordinary one's own
    tables = {}
    for kind, counts, strength, which in ((1, a, own, (own > CONTRAST) & (a >= least)), (0, b, other, (other > CONTRAST) & (b >= least_other))):
        tables[kind] = runs[which], counts[which], strength[which]
    shared = texts.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece, strength in pieces(lowered(text.as_py()), *shared.value[label]).items():
                    for column, value in zip(out, (label, piece, strength)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())], ["kind", "piece", "strength"])

    found = texts.select("label", "text").mapInArrow(run, "kind int, piece binary, strength double").groupBy("kind", "piece").agg(F.count("*").alias("n"), F.max("strength").alias("strength"))
    found = found.where(F.col("n") >= F.when(F.col("kind") == 1, least).otherwise(least_other)).collect()
    kept = {kind: chosen([(bytes(r["piece"]), r["strength"]) for r in found if r["kind"] == kind], OWN) for kind in tables}
    own, others = (b" ".join(kept[kind][::-1]) for kind in (1, 0))
    both = common(texts.where("label = 0"), scratch)
    return both + own, both + others


class Windows:
    """Compresses windows with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes):
        # matches shorter than a piece say nothing of the kind of a text
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=14, chain_log=14, search_log=4, min_match=GRAM, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False)
        shared = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=shared, compression_params=how).compress

    def excess(self, text: str | None) -> np.ndarray:
        """Of each window: bytes with the ordinary dictionary less bytes with the toxic one, 0 to MOST."""
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        toxic, ordinary = self.toxic, self.ordinary
        last = max(len(data) - WINDOW, 0)
        starts = [*range(0, last, STEP), last] if data else []
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in (data[i : i + WINDOW] for i in starts)), np.int64, len(starts)).clip(0, MOST)


@dataclass
class Model:
    """Dictionaries, the threshold of an excess, and weights of a text's features."""

    toxic: bytes = b""
    ordinary: bytes = b""
    threshold: int = MOST
    weights: list[float] = field(default_factory=list)
    base: float = 0.0

    @staticmethod
    def features(excess: np.ndarray) -> np.ndarray:
        """Of each threshold, how many windows reach it and what share of all; the greatest and the mean excess."""
        reach = np.array([(excess >= t).sum() for t in THRESHOLDS])
        n = max(len(excess), 1)
        return np.concatenate(([1.0, excess.max(initial=0) / 8, excess.sum() / n, np.log1p(n)], np.log1p(reach), 10 * reach / n))

    def score(self, excess: np.ndarray) -> float:
        if not self.weights:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(self.features(excess) @ np.array(self.weights), -30, 30))))


def _features(rows: DataFrame, toxic: bytes, ordinary: bytes) -> DataFrame:
    """(label, features, counts) of rows (label, text): counts says how many windows have each excess."""
    shared = rows.sparkSession.sparkContext.broadcast((toxic, ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value)
        for batch in batches:
            found = [windows.excess(t.as_py()) for t in batch.column(1)]
            features = pa.array([Model.features(e).tolist() for e in found], pa.list_(pa.float64()))
            counts = pa.array([np.bincount(e, minlength=MOST + 1).tolist() for e in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), features, counts], ["label", "features", "counts"])

    return rows.select("label", "text").mapInArrow(run, "label int, features array<double>, counts array<long>")


def _summed(rows: DataFrame, values: str) -> np.ndarray:
    """The sums of an array column by place."""
    found = rows.select(F.posexplode(values).alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(found, key=lambda r: r["place"])], float)


def _step(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Of the logistic regression's sums over rows (label, features): the gradient, then the second derivatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) * (len(weights) + 1))
        for batch in batches:
            if batch.num_rows:
                labels, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                total += np.concatenate((x.T @ (labels - p), ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return _summed(rows.select("label", "features").mapInArrow(run, "sums array<double>"), "sums")


def calibrated(toxic: bytes, ordinary: bytes, rows: DataFrame, base: float) -> Model:
    """rows as from _features."""
    windows = _summed(rows.where("label = 0"), "counts")
    reach = windows[::-1].cumsum()[::-1] / max(windows.sum(), 1)
    # labels are noisy: some ordinary ones stand on toxic texts, so the rule is about a share and not about all
    model = Model(toxic, ordinary, max(1, int((reach > FALSE_WINDOWS).sum())), [], base)
    size = len(Model.features(np.zeros(0, np.int64)))
    weights, ridge = np.zeros(size), np.diag([1e-6] + [0.1] * (size - 1))
    for _ in range(50):
        sums = _step(rows, weights)
        step = np.linalg.solve(sums[size:].reshape(size, size) + ridge, sums[:size] - ridge @ weights)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = weights.tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    known = known.withColumn("fits", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(10)) < 7)
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(n.values())
    base = n.get(1, 0) / total if total else 0.0
    met = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known) if total <= BROADCAST else known, "doc_id")
    texts = scratch.write("texts", met.select(F.monotonically_increasing_id().alias("key"), "label", "fits", "text"))
    held = {(r["label"], r["fits"]): r["count"] for r in texts.groupBy("label", "fits").count().collect()}
    if not {(0, True), (1, True)} <= held.keys():
        return Model(base=base)
    fit = texts.where("fits").select("key", "label", "text")
    few = held[0, True] + held[1, True] <= BROADCAST
    keys = originals(fit, scratch)
    contents = dictionaries(fit.join(F.broadcast(keys) if few else keys, "key", "left_semi"), scratch)
    # with few labels, texts that dictionaries were made from have to do
    apart = texts.where("not fits") if {(0, False), (1, False)} <= held.keys() else texts
    rows = scratch.write("features", _features(apart, *contents))
    model = calibrated(*contents, rows, base)
    for name in ("texts", "marks", "originals", "features"):
        scratch.drop(name)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_over, worst) for each row of docs: n_over windows reach the threshold; worst is where
    the window of the greatest excess begins, in bytes of the lower-cased text, null if no window reaches it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        windows = Windows(model.toxic, model.ordinary)
        for batch in batches:
            scores, over, worst = [], [], []
            for text in batch.column(1):
                excess = windows.excess(text.as_py())
                scores.append(model.score(excess))
                over.append(int((excess >= model.threshold).sum()))
                worst.append(int(excess.argmax()) * STEP if over[-1] else None)
            predicted = [int(s >= PREDICT) for s in scores]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(over, pa.int64()), pa.array(worst, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "n_over", "worst"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_over long, worst long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_toxicity: see the README for its columns."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = score(docs, learn(docs, labels.where(crc_mod("doc_id", 4) != 2)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_over")
