"""From notes to rows of an index: cut, embed, and put in the place of a note's older rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import chunking, vectors
from quirebook.operators.store import Store, observed

SCHEMA = "path string, chunk_index int, chunk_id string, chunk string, vector array<double>, error string"
TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string())
#: Rows that a task holds before it hands them on.
HELD = 1024


class NotReady(RuntimeError):
    code = "INDEX_NOT_READY"


class Model:
    """A place for an embedding model that comes later: until it's set, a call raises NotReady."""

    def __init__(self, dimension: int, model: Callable[[list[str]], list[list[float]]] | None = None):
        self.dimension, self.model = dimension, model

    @property
    def ready(self) -> bool:
        return self.model is not None

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.model is None:
            raise NotReady("the embedding model isn't ready")
        return self.model(texts)


def index(notes: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """(path, chunk_index, chunk_id, chunk, vector, error) for notes (path, content). The model is called once a note with
    all its chunks. A note that fails has one row, with the error, and none of its chunks; a blank one has no row."""

    def note(path: str, content: str | None) -> list[tuple]:
        try:
            cut = [c[0] for c in chunking.chunks(content, size, overlap)]
            made = model(cut) if cut else []
            if len(made) != len(cut) or any(len(v) != dimension for v in made):
                raise ValueError(f"the model's vectors aren't {dimension} numbers each")
            return [(path, i, f"{path}#chunk-{i}", c, v, None) for i, (c, v) in enumerate(zip(cut, made))]
        except Exception as error:  # noqa: BLE001  a note's failure is a row
            return [(path, None, None, None, None, str(error))]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, TYPES)], ["path", "chunk_index", "chunk_id", "chunk", "vector", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for found in batches:
            for path, content in zip(found.column(0).to_pylist(), found.column(1)):
                rows += note(path, content.as_py())
                if len(rows) >= HELD:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    return notes.select("path", "content").mapInArrow(run, SCHEMA)


def outcomes(notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, indexed, errors) of each note on its own; a blank note counts as neither (over a whole index, see
    chunking.index_counts, it counts as indexed)."""
    found = indexed.groupBy("path").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    met = notes.select("path").join(found, "path", "left")
    return met.select("path", F.coalesce((~F.col("failed")).cast("long"), F.lit(0)).alias("indexed"), F.coalesce(F.col("failed").cast("long"), F.lit(0)).alias("errors"))


def refresh(table: DataFrame, notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """The index after notes were indexed anew: their older rows go, but for notes that failed, which keep them."""
    failed = indexed.where("error is not null").select("path")
    done = notes.select("path").join(failed, "path", "left_anti").distinct()
    fresh = indexed.where("error is null").select(table.columns)
    return table.join(done, "path", "left_anti").select(table.columns).unionByName(fresh)


class NoteIndex:
    """An index of notes that is kept: chunks and vectors in a Store, a note's rows under its path. The model is called once
    a note; what it gives is written before it is used, so that rows and counts come of the same answers."""

    ROWS = "path string, chunk_index int, chunk_id string, chunk string, vector array<double>"

    def __init__(self, spark: SparkSession, root: str, model: Callable[[list[str]], list[list[float]]], dimension: int, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, buckets: int = 16):
        self.spark, self.root, self.model, self.dimension, self.size, self.overlap = spark, root.rstrip("/"), model, dimension, size, overlap
        self.store = Store(spark, f"{self.root}/store", self.ROWS, buckets=buckets)

    def _made(self, notes: DataFrame) -> tuple[DataFrame, dict, str]:
        """The rows of notes, written; how many notes have errors, and how many of them are indexed (blank ones are)."""
        if not getattr(self.model, "ready", True):
            raise NotReady("the embedding model isn't ready")  # rather than an error for each note
        folder = f"{self.root}/staged-{uuid.uuid4().hex}"
        rows, seen = observed(index(notes, self.model, self.dimension, self.size, self.overlap), errors=F.count("error"), chunks=F.count("chunk_id"))
        rows.write.parquet(folder)
        counts = seen()
        return self.spark.read.schema(SCHEMA).parquet(folder), {"errors": counts["errors"], "indexed": notes.select("path").count() - counts["errors"], "chunks": counts["chunks"]}, folder

    def _drop(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def reindex(self, notes: DataFrame) -> dict:
        """The index of notes (path, content) in the place of all rows, in one commit. Rows of notes that aren't there any
        more go; a note that fails keeps the rows that it had. Gives the counts."""
        made, counts, folder = self._made(notes)
        try:
            failed = made.where("error is not null").select("path")
            kept = self.store.read().join(failed, "path", "left_semi")
            fresh = made.where("error is null").select(kept.columns)
            self.store.overwrite(fresh.unionByName(kept), lambda: counts)
        finally:
            self._drop(folder)
        return counts

    def update(self, notes: DataFrame, gone: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """The rows of notes (path, content) in the place of their older ones, and none of gone (path), in one commit."""
        made, counts, folder = self._made(notes)
        try:
            failed = made.where("error is not null").select("path")
            done = notes.select("path").join(failed, "path", "left_anti")
            fresh = made.where("error is null").select(*(c.split()[0] for c in self.ROWS.split(", ")))
            self.store.apply(fresh, done if gone is None else done.union(gone.select("path")), batch, lambda: counts)
        finally:
            self._drop(folder)
        return counts

    def delete(self, paths: DataFrame) -> None:
        self.store.delete(paths)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(q, path, chunk_id, score, rank): of queries (q, vector) the k best notes, each by its best chunk."""
        rows = self.store.read()
        most = rows.agg(F.max("chunk_index")).first()[0]
        # so many chunks are of k notes at least
        found = vectors.knn(queries, rows.select(F.col("chunk_id").alias("key"), "vector"), k * ((most or 0) + 1))
        best = vectors.best_chunk(found.select("q", F.regexp_replace("key", r"#chunk-\d+$", "").alias("document"), "key", "score"))
        ranked = vectors.top(best.select("q", F.struct("document", "key").alias("key"), "score"), k)
        return ranked.select("q", F.col("key.document").alias("path"), F.col("key.key").alias("chunk_id"), "score", "rank")

    def status(self) -> dict:
        """Chunks and the time of the last commit (milliseconds), as the version's file has them."""
        state = self.store.state()
        return {"chunks": sum(f["rows"] for f in state["files"]), "last_index_time": state["at"] or None, "ready": state["version"] > 0}


def held(log: DataFrame) -> DataFrame:
    """(index, due, path, op): what the queue hands on, from a log (index, seq, kind, path, op) of events, pauses and
    resumes. An event is due at its own seq, or while its index is paused at the next resume (null: still held); the last
    op of a path is the one handed on."""
    back, ahead = "PARTITION BY index ORDER BY seq ROWS UNBOUNDED PRECEDING", "PARTITION BY index ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    paused = F.expr(f"last(CASE WHEN kind <> 'event' THEN kind END, true) OVER ({back})") == "pause"
    resumes = F.expr(f"min(CASE WHEN kind = 'resume' THEN seq END) OVER ({ahead})")
    due = F.when(paused, resumes).otherwise(F.col("seq"))
    return log.withColumn("due", due).where("kind = 'event'").groupBy("index", "due", "path").agg(F.max_by("op", "seq").alias("op"))


def states(log: DataFrame) -> DataFrame:
    """(index, seq, state): an index's state after each step of its log (index, seq, step, pending). Steps are ready and
    failed (a run ended), enqueue, pause and resume; pending is the queue's length. A resume with an empty queue gives back
    the state before the pause, or Ready if that was a passing one; a second pause or resume changes nothing."""
    before = "PARTITION BY index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    upto = "PARTITION BY index ORDER BY seq ROWS UNBOUNDED PRECEDING"
    paused = F.coalesce(F.expr(f"last(CASE WHEN step IN ('pause', 'resume') THEN step END, true) OVER ({before})") == "pause", F.lit(False))
    rows = log.withColumn("_paused", paused)
    settled = (
        F.when(F.col("step") == "pause", None).when((F.col("step") == "resume") & F.col("_paused"), F.when(F.col("pending") > 0, "Ready")).when((F.col("step") == "resume") | F.col("_paused"), None)
        .when(F.col("step") == "failed", "Failed").otherwise("Ready")
    )
    rows = rows.withColumn("_settled", settled).withColumn("_settled", F.coalesce(F.expr(f"last(_settled, true) OVER ({upto})"), F.lit("Idle")))
    state = (
        F.when((F.col("step") == "pause") & ~F.col("_paused"), "Paused").when((F.col("step") == "resume") & F.col("_paused"), F.when(F.col("pending") > 0, "Queueing").otherwise(F.col("_settled")))
        .when(F.col("step") == "enqueue", F.when(F.col("_paused"), "Paused").otherwise("Queueing")).when(F.col("step") == "ready", "Ready").when(F.col("step") == "failed", "Failed")
    )
    rows = rows.withColumn("_state", state)
    return rows.select("index", "seq", F.coalesce(F.expr(f"last(_state, true) OVER ({upto})"), F.lit("Idle")).alias("state"))


def search_error(embedding: Column, index_: Column) -> Column:
    """The error of a search before model and index are ready, else null."""
    return F.when(~((embedding == "ready") & (index_ == "ready")), "INDEX_NOT_READY")


def percent_done(files: DataFrame, total: int) -> DataFrame:
    """files (ord, ...) with `percent` of all that are done after each."""
    return files.withColumn("percent", T.percentage(F.col("ord"), F.lit(total)))
