"""Streams that keep state: a queue that can be paused, frames of server-sent events cut at any byte, and requests that
wait for their responses. Each has a batch twin, which tests and queries hold it against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from quirebook.sources import scratch
from quirebook.streaming import events as E


def _schema(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HANDED = _schema(index=LongType(), due=LongType(), seq=LongType(), path=StringType(), op=StringType())
#: Rows of a file of a replayed stream, about.
ROWS = 100_000
LINES = _schema(stream_id=LongType(), ord=LongType(), line=StringType())


def replayed(table: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """A stream of table's rows in `parts` micro-batches by order, from files in the shared folder. The table is worked
    out once. All parts have one number of files, which grows with the table and is a micro-batch's."""
    spark, folder = table.sparkSession, scratch.folder(table.sparkSession)
    table.write.parquet(f"{folder}/whole")
    table = spark.read.schema(table.schema).parquet(f"{folder}/whole")
    held = table.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)]).alias("cuts"), F.count("*").alias("n")).first()
    cuts = held["cuts"] or []
    n = max(1, min(spark.sparkContext.defaultParallelism, held["n"] // (parts * ROWS)))
    place = sum((F.when(F.col(order).cast("double") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):  # one after the other, as a file source goes by the files' times
        path = f"{folder}/parts/{i}"
        table.where(place == i).coalesce(n).write.parquet(path)
        # a task without rows writes no file
        for pad in range(len(spark.read.schema(table.schema).parquet(path).inputFiles()), n):
            spark.createDataFrame([], table.schema).coalesce(1).write.parquet(f"{path}-{pad}")
    return spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", n).parquet(f"{folder}/parts")


# --- requests and responses ------------------------------------------------------------------------------------------


def answered_stream(requests: DataFrame, responses: DataFrame, seconds: float, watermark: str = E.WATERMARK) -> DataFrame:
    """The streaming twin of events.answered for two streams (id, ts) and (id, ts, answer). A request that waits is given
    as "timeout" when the watermark of both streams has passed its time and `seconds`; rows later than the watermark are
    dropped, and state older than it."""
    return E.answered(requests.withWatermark("ts", watermark), responses.withWatermark("ts", watermark), seconds)


def closed(rows: DataFrame, id: int, at: str = "9000-01-01 00:00:00") -> DataFrame:
    """rows (id, ts, ...) with a last one of the given id and a far ts, which moves a watermark over all others. (A
    filter of that id belongs behind the stream: Spark would push it before the watermark.)"""
    values = {"id": F.lit(id), "ts": F.to_timestamp(F.lit(at))}
    end = rows.sparkSession.range(1).select(*(values.get(c, F.lit(None)).cast(k).alias(c) for c, k in rows.dtypes))
    return rows.unionByName(end)


# --- a queue that can be paused --------------------------------------------------------------------------------------


class Queue(StatefulProcessor):
    """An index's queue. While it is paused, a path's slot holds its last op; the resume hands on all slots."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paused = handle.getValueState("paused", _schema(paused=BooleanType()))
        self.slots = handle.getMapState("slots", _schema(path=StringType()), _schema(seq=LongType(), op=StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, before = [], self.paused.get()
        paused = was = bool(before[0]) if before else False
        kept, waits = was, {}  # whether slots may be kept from earlier batches; this batch's slots, which go to the state at its end
        every = pd.concat(list(rows)).sort_values("seq")
        for seq, kind, path, op in zip(*(every[c].tolist() for c in ("seq", "kind", "path", "op"))):
            if kind == "pause":
                paused = True
            elif kind == "resume":
                paused = False
                slots = {held: slot for (held,), slot in self.slots.iterator()} if kept else {}
                for held in slots:
                    self.slots.removeKey((held,))
                out += [(key[0], seq, int(at), held, last) for held, (at, last) in (slots | waits).items()]
                kept, waits = False, {}
            elif paused:
                waits[path] = (seq, op)
            else:
                out.append((key[0], seq, seq, path, op))
        for path, slot in waits.items():
            self.slots.updateValue((path,), slot)
        if before is None or paused != was:
            self.paused.update((paused,))
        if out:
            yield pd.DataFrame(out, columns=HANDED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def queue_stream(log: DataFrame) -> DataFrame:
    """(index, due, seq, path, op): the streaming twin of indexing.held for a stream (index, seq, kind, path, op) whose
    micro-batches come in the order of seq; what is still held isn't given. Needs the RocksDB state store."""
    return log.groupBy("index").transformWithStateInPandas(statefulProcessor=Queue(), outputStructType=HANDED, outputMode="append", timeMode="None")


# --- server-sent events ----------------------------------------------------------------------------------------------


class Splitter(StatefulProcessor):
    """A stream's unfinished line, as bytes, and the number of its next line of data."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _schema(tail=BinaryType(), next=LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, number = self.open.get() or (b"", 0)
        every, out = pd.concat(list(rows)).sort_values("seq"), []
        # a line is decoded when it is whole, so that no character is cut
        parts = b"".join([bytes(tail), *every["chunk"].dropna()]).split(b"\n")
        ended = bool(every["last"].any())
        for raw in parts if ended else parts[:-1]:
            line = raw.decode("utf-8", "replace")
            if line.startswith("data: ") and line.strip() != "data: [DONE]":
                out.append((key[0], int(number), line[6:]))
                number += 1
        self.open.update((b"" if ended else parts[-1], int(number)))
        if out:
            yield pd.DataFrame(out, columns=LINES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def sse_lines(chunks: DataFrame) -> DataFrame:
    """(stream_id, ord, line): the lines of data in a stream of chunks (stream_id, seq, chunk, last), in the order of
    seq, which are bytes cut anywhere; the last one of a stream ends its last line. sessions.parsed_lines reads them.
    Needs the RocksDB state store."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=Splitter(), outputStructType=LINES, outputMode="append", timeMode="None")


def chunked(streams: DataFrame, most: int = 40) -> DataFrame:
    """(stream_id, seq, chunk, last) of streams (stream_id, raw): pieces of 1 to `most` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (raw.as_py() or "").encode()
                cycle = 1 + (np.arange(most) * 7 + stream) % most
                ends = np.tile(cycle, len(data) // int(cycle.sum()) + 1).cumsum()
                ends = np.concatenate(([0], np.minimum(ends[: np.searchsorted(ends, len(data)) + 1], len(data))))
                for first in range(0, len(ends) - 1, ROWS):
                    cut = ends[first : first + ROWS + 1]
                    n, at = len(cut) - 1, (cut - cut[0]).astype(np.int32)
                    chunks = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[cut[0] : cut[-1]])])
                    seq = np.arange(first, first + n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, stream)), pa.array(seq), chunks, pa.array(seq == len(ends) - 2)], ["stream_id", "seq", "chunk", "last"])

    return streams.select(F.col("stream_id").cast("long"), "raw").mapInArrow(run, "stream_id long, seq long, chunk binary, last boolean")


def rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
