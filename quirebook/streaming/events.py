"""File events: debounced, deduplicated, and applied to a store. Batch forms and their streaming twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from quirebook.sources import scratch

DELAY, WATERMARK = "5 seconds", "10 seconds"


def normalize(events: DataFrame, ignored=None) -> DataFrame:
    """(ts, seq, path, op) with op upsert or delete, from create, modify, delete and rename (path, old_path) events. A
    rename deletes the old path. Ignored paths never upsert; deletes always pass."""
    ops = F.when(F.col("op") == "rename", F.array(F.struct(F.col("old_path").alias("path"), F.lit("delete").alias("op")), F.struct(F.col("path"), F.lit("upsert").alias("op")))).otherwise(
        F.array(F.struct(F.col("path"), F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("op")))
    )
    rows = events.select("ts", "seq", F.explode(ops).alias("e")).select("ts", "seq", "e.path", "e.op")
    return rows if ignored is None else rows.where((F.col("op") == "delete") | ~ignored(F.col("path")))


def debounce_sessions(events: DataFrame, gap: str = DELAY) -> DataFrame:
    """(path, start, end, n): runs of a path's events with gaps of at most `gap`; an upsert is due at the end. Works on
    a batch and on a stream with a watermark."""
    return events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def debounce(events: DataFrame, seconds: float = 5) -> DataFrame:
    """(path, seq, op, due): upserts fire `seconds` after the path's last event, unless one comes before; deletes fire
    at once and cancel a waiting upsert. Batch form."""
    following = F.lead("ts").over(Window.partitionBy("path").orderBy("ts", "seq"))
    wait = F.expr(f"INTERVAL {seconds} SECONDS")
    fires = (F.col("op") == "delete") | following.isNull() | (following > F.col("ts") + wait)
    due = F.when(F.col("op") == "delete", F.col("ts")).otherwise(F.col("ts") + wait)
    return events.withColumn("fires", fires).withColumn("due", due).where("fires").select("path", "seq", "op", "due")


class Debouncer(StatefulProcessor):
    """A path's waiting upsert. Within a micro-batch events are taken in order, and one that comes after the waiting
    upsert was due fires it first; the timer is set once, at the end."""

    def __init__(self, seconds: float):
        self.wait = timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", StructType([StructField("seq", LongType()), StructField("ts", TimestampType())]))

    def _row(self, key, seq: int, op: str, due: datetime) -> dict:
        return {"path": key[0], "seq": seq, "op": op, "due": due}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        held = self.waiting.get() if self.waiting.exists() else None
        every = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, seq, op in zip(every["ts"], every["seq"], every["op"]):
            ts = ts.to_pydatetime()
            if held is not None and ts > held[1] + self.wait:
                out.append(self._row(key, held[0], "upsert", held[1] + self.wait))
            held = None if op == "delete" else (int(seq), ts)
            if op == "delete":
                out.append(self._row(key, int(seq), "delete", ts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.waiting.clear()
        else:
            self.waiting.update(held)
            self.handle.registerTimer(int((held[1] + self.wait).timestamp() * 1000))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            seq, ts = self.waiting.get()
            self.waiting.clear()
            yield pd.DataFrame([self._row(key, seq, "upsert", ts + self.wait)])

    def close(self) -> None:
        pass


DUE = StructType([StructField("path", StringType()), StructField("seq", LongType()), StructField("op", StringType()), StructField("due", TimestampType())])


def debounce_stream(events: DataFrame, seconds: float = 5, watermark: str = WATERMARK) -> DataFrame:
    """The streaming twin of debounce. ts must be a TIMESTAMP; needs the RocksDB state store."""
    keyed = events.withWatermark("ts", watermark).groupBy("path")
    return keyed.transformWithStateInPandas(statefulProcessor=Debouncer(seconds), outputStructType=DUE, outputMode="append", timeMode="eventTime")


def drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """All that a stream gives up to the present end of its sources, from files below spark.checkpoint.dir."""
    folder = scratch.folder(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def last_ops(events: DataFrame) -> DataFrame:
    """(path, op, first_seq): the queue's content: the last op of each path, in the place of its first."""
    return events.groupBy("path").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"), F.min("seq").alias("first_seq"))


def apply_to(store, contents: Callable[[DataFrame], DataFrame], name: str):
    """A function for foreachBatch: of each path's due events the last counts; deletes leave the store, and for upserts
    contents(paths) gives the current rows (a path without a row is dropped). A micro-batch is one commit under the
    stream's name and the batch's id, so that one which is run again after a failure isn't a second commit."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.count()  # a stateful stream's batch has to be worked out whole, also where the store passes it over
            ops = batch.groupBy("path").agg(F.max_by("op", F.struct("due", "seq")).alias("op"))
            store.apply(contents(ops.where("op = 'upsert'").select("path")), ops.select("path"), (name, number))
        finally:
            batch.unpersist()

    return run


def transitions(steps: DataFrame) -> DataFrame:
    """(path, state, n): the last state of an index's log (path, seq, state) and the number of steps."""
    return steps.groupBy("path").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n"))


def answered(requests: DataFrame, responses: DataFrame, seconds: float) -> DataFrame:
    """(id, answer): requests (id, ts) with the answer of responses (id, ts, answer) that comes within `seconds`, else
    "timeout". Works on a batch, and on two streams with watermarks."""
    wait = F.expr(f"INTERVAL {seconds} SECONDS")
    later = responses.select(F.col("id").alias("_id"), F.col("ts").alias("_ts"), "answer")
    met = requests.join(later, (F.col("id") == F.col("_id")) & (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + wait), "left")
    return met.select("id", F.coalesce("answer", F.lit("timeout")).alias("answer"))
