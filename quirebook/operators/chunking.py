"""Notes into overlapping chunks.

Packing is a fold over a note's sections, so each note is cut by a Python function on Arrow batches; notes are
independent and nothing is shuffled. A note that fails yields a row with its error instead of stopping the job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirebook.functions.text import WHITE

SIZE, OVERLAP = 500, 100
HEADING = re.compile(r"^#{1,6}\s")
SCHEMA = "path string, chunk_index int, chunk_id string, chunk string, start int, end int, error string"


def overlap_tail(text: str, n: int) -> str:
    """The last n characters, from after their first new line unless that is their last character."""
    if n <= 0 or len(text) <= n:
        return ""
    tail = text[-n:]
    at = tail.find("\n")
    return tail[at + 1 :] if 0 <= at < len(tail) - 1 else tail


def split_long(text: str, size: int, overlap: int) -> Iterator[str]:
    """Pieces that end at a paragraph, else a sentence, else anywhere; never in the first three tenths of `size`. The
    character at the cut belongs to the piece."""
    at = 0
    while at < len(text):
        if len(text) - at <= size:
            yield text[at:]
            return
        for mark in ("\n\n", "。", ". "):
            cut = text.rfind(mark, at, at + size + len(mark)) - at
            if cut >= 0.3 * size:
                break
        else:
            cut = size
        yield text[at : at + cut + 1]
        at += max(cut + 1 - overlap, 1)


def sections(text: str) -> list[str]:
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if HEADING.match(line) and out[-1]:
            out.append([])
        out[-1].append(line)
    return ["\n".join(s) for s in out]


def chunks(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(chunk, start, end). Sections are packed while they fit; what then is much too long is split. Offsets are those
    of the packed text, in which sections are a blank line apart."""
    if not (text or "").strip(WHITE):
        return []
    out: list[tuple[str, int, int]] = []
    held, start = "", 0
    for section in sections(text):
        if held and len(held) + len(section) > size:
            out.append((held.strip(WHITE), start, start + len(held)))
            tail = overlap_tail(held, overlap)
            start += len(held) - len(tail)
            held = tail + section
        else:
            held += ("\n\n" if held else "") + section
        if len(held) > 1.5 * size:
            for piece in split_long(held, size, overlap):
                out.append((piece.strip(WHITE), start, start + len(piece)))
            start += len(held)
            held = ""
    if held.strip(WHITE):
        out.append((held.strip(WHITE), start, start + len(held)))
    return out


def chunk_notes(notes: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk_index, chunk_id, chunk, start, end, error) for notes (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows += [(path, i, f"{path}#chunk-{i}", *c, None) for i, c in enumerate(chunks(content.as_py(), size, overlap))]
                except Exception as error:  # noqa: BLE001  a note's failure is a row
                    rows.append((path, None, None, None, None, None, str(error)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "chunk_index", "chunk_id", "chunk", "start", "end", "error"])

    return notes.select("path", "content").mapInArrow(run, SCHEMA)


def heading_sections(notes: DataFrame) -> DataFrame:
    """(path, section, text, n_lines): sections by heading, as a running sum over lines."""
    lines = notes.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    by = Window.partitionBy("path").orderBy("pos")
    starts = (F.col("line").rlike(r"^#{1,6}\s") & (F.col("pos") > 0)).cast("long")
    numbered = lines.withColumn("section", F.sum(starts).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("path", "section").agg(text.alias("text"), F.count("*").alias("n_lines"))


def index_counts(notes: DataFrame, chunked: DataFrame) -> DataFrame:
    """(indexed, errors, chunks): notes that were cut (blank ones count), that failed, and rows of the index."""
    failed = chunked.where("error is not null").select("path").distinct().agg(F.count("*").alias("errors"))
    made = chunked.where("error is null").agg(F.count("*").alias("chunks"))
    total = notes.agg(F.count("*").alias("n"))
    return total.join(F.broadcast(failed)).join(F.broadcast(made)).select((F.col("n") - F.col("errors")).alias("indexed"), "errors", "chunks")
