"""A folder of notes as a data source of Spark: its notes in a batch, its changes as a stream, and writes in one commit.

    spark.dataSource.register(VaultSource)
    spark.read.format("vault").load(folder)                                   # (path, content, mtime)
    spark.readStream.format("vault").option("log", log_folder).load(folder)   # (ts, seq, path, old_path, op)
    changes.write.format("vault").mode("append").save(folder)                 # (path, content, op)

The stream compares snapshots of the folder. A snapshot (each note's size, time and digest) is a file in the log folder,
and an offset is its number, so a query that starts anew compares with where it ended. A note that went and one of the same
text that came are a rename. Only notes whose size or time changed are read for their digest.

A write puts each task's notes below a hidden folder and moves them when all tasks are done; a task that fails leaves the
vault as it was. op is write (the default), append, or delete, which moves a note to .trash. Paths that lead out of the
folder are refused. The folder has to be visible to driver and executors by the same path.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NOTES = "path string, content string, mtime timestamp"
EVENTS = "ts timestamp, seq long, path string, old_path string, op string"
HIDDEN, TRASH = ".quirebook-tmp", ".trash"


def listed(root: str) -> Iterator[tuple[str, os.stat_result]]:
    """Notes below root that aren't in a hidden folder, by path."""
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        for name in sorted(names):
            if name.endswith(".md"):
                full = os.path.join(folder, name)
                try:
                    yield os.path.relpath(full, root).replace(os.sep, "/"), os.stat(full)
                except FileNotFoundError:
                    continue  # gone meanwhile


def snapshot(root: str, before: dict[str, list]) -> dict[str, list]:
    """path: [size, time in ns, digest]"""
    found = {}
    for path, stat in listed(root):
        had = before.get(path)
        if had and had[:2] == [stat.st_size, stat.st_mtime_ns]:
            found[path] = had
            continue
        try:
            with open(os.path.join(root, path), "rb") as f:
                found[path] = [stat.st_size, stat.st_mtime_ns, hashlib.sha256(f.read()).hexdigest()]
        except FileNotFoundError:
            continue
    return found


def changes(before: dict[str, list], after: dict[str, list]) -> list[tuple[str, str | None, str]]:
    """(path, old_path, op): deletes first, then the rest by path."""
    gone, came = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    by_text: dict[str, list[str]] = {}
    for path in reversed(gone):
        by_text.setdefault(before[path][2], []).append(path)
    renamed = {path: by_text[after[path][2]].pop() for path in came if by_text.get(after[path][2])}
    left = set(gone) - set(renamed.values())
    rows = [(path, renamed.get(path), "rename" if path in renamed else "create") for path in came]
    rows += [(path, None, "modify") for path in after.keys() & before.keys() if after[path][2] != before[path][2]]
    return [(path, None, "delete") for path in gone if path in left] + sorted(rows)


@dataclass
class Part(InputPartition):
    rows: list


class VaultReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.root, self.parts = root, parts

    def partitions(self) -> list[Part]:
        paths = [path for path, _ in listed(self.root)]
        return [Part(paths[i :: self.parts]) for i in range(min(self.parts, len(paths)) or 1)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.rows:
            full = os.path.join(self.root, path)
            try:
                with open(full, encoding="utf-8", errors="replace", newline="") as f:
                    yield path, f.read(), datetime.fromtimestamp(os.stat(full).st_mtime, timezone.utc)
            except FileNotFoundError:
                continue


class VaultStream(DataSourceStreamReader):
    def __init__(self, root: str, log: str, first: str, parts: int):
        self.root, self.log, self.first, self.parts = root, log, first, parts
        os.makedirs(log, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.log, f"{number:010d}.json")

    def _snapshot(self, number: int) -> dict[str, list]:
        if number < 0:
            return {}
        with open(self._file(number)) as f:
            return json.load(f)["notes"]

    def _last(self) -> int:
        return max((int(n.removesuffix(".json")) for n in os.listdir(self.log) if n.endswith(".json")), default=-1)

    def _keep(self, number: int, notes: dict[str, list]) -> int:
        hidden = os.path.join(self.log, f".{uuid.uuid4().hex}")
        with open(hidden, "w") as f:
            json.dump({"at": time.time(), "notes": notes}, f)
        os.rename(hidden, self._file(number))
        return number

    def initialOffset(self) -> dict:
        """Where a new query begins: at nothing (first = all, every note is created), or at the folder as it is (now)."""
        if self.first == "all":
            return {"snapshot": -1}
        return {"snapshot": self._keep(self._last() + 1, snapshot(self.root, {}))}

    def latestOffset(self) -> dict:
        last = self._last()
        before = self._snapshot(last)
        now = snapshot(self.root, before)
        return {"snapshot": last if now == before else self._keep(last + 1, now)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        rows = changes(self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"]))
        with open(self._file(end["snapshot"])) as f:
            at = json.load(f)["at"]
        # the snapshot's number and the place in it order all changes
        numbered = [(at, end["snapshot"] * 1_000_000_000 + i, *row) for i, row in enumerate(rows)]
        return [Part(numbered[i :: self.parts]) for i in range(min(self.parts, len(numbered)) or 1)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for at, *row in partition.rows:
            yield datetime.fromtimestamp(at, timezone.utc), *row

    def commit(self, end: dict) -> None:
        """Snapshots before the last committed one aren't asked for again."""
        for name in os.listdir(self.log):
            if name.endswith(".json") and int(name.removesuffix(".json")) < end["snapshot"]:
                os.remove(os.path.join(self.log, name))


@dataclass
class Written(WriterCommitMessage):
    notes: list


class VaultWriter(DataSourceWriter):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names, self.job = root, names, uuid.uuid4().hex

    def _full(self, path: str) -> str:
        full = os.path.normpath(os.path.join(self.root, path))
        if os.path.isabs(path) or not full.startswith(os.path.normpath(self.root) + os.sep):
            raise ValueError(f"{path} leads out of the vault")
        return full

    def write(self, iterator) -> Written:
        folder, notes = os.path.join(self.root, HIDDEN, self.job, uuid.uuid4().hex), []
        os.makedirs(folder, exist_ok=True)
        for i, row in enumerate(iterator):
            values = dict(zip(self.names, row))
            path, op = values["path"], values.get("op") or "write"
            full, content = self._full(path), values.get("content") or ""
            if op not in ("write", "append", "delete"):
                raise ValueError(f"no such operation: {op}")
            hidden = None
            if op != "delete":
                hidden = os.path.join(folder, str(i))
                with open(hidden, "w", encoding="utf-8", newline="") as f:
                    if op == "append" and os.path.exists(full):
                        with open(full, encoding="utf-8", newline="") as old:
                            f.write(old.read())
                    f.write(content)
            notes.append((path, op, hidden))
        return Written(notes)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            for path, op, hidden in message.notes if message else ():
                full = self._full(path)
                if op == "delete":
                    if os.path.exists(full):
                        kept = os.path.join(self.root, TRASH, path)
                        os.makedirs(os.path.dirname(kept), exist_ok=True)
                        os.replace(full, kept)
                else:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    os.replace(hidden, full)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.root, HIDDEN, self.job), ignore_errors=True)


class VaultSource(DataSource):
    """Options: path; parts (tasks, 8); for a stream log (a folder) and first (all or now)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def _root(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        return EVENTS if "log" in self.options else NOTES

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(self._root(), int(self.options.get("parts", 8)))

    def streamReader(self, schema: StructType) -> VaultStream:
        return VaultStream(self._root(), self.options["log"], self.options.get("first", "all"), int(self.options.get("parts", 8)))

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        if overwrite:
            raise ValueError("notes are written one by one: mode append")
        return VaultWriter(self._root(), schema.names)
