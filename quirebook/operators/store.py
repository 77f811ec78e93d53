"""A versioned table on shared storage: a key owns any number of rows, and a change of keys is one commit.

Rows lie in Parquet files that never change, dealt over buckets of key ranges and sorted by key. A version is a small file
that names the data files with their least and greatest keys, so a read of a key, a range or a prefix opens only files
that can hold it. A change rewrites the buckets that its keys fall in.

* Publishing is atomic: a version is written under another name and then linked or renamed to its number, which fails if
  the number is taken. Readers see versions that are whole; a crash before that step leaves the version before.
* A writer that finds its number taken reads what came between. If that touched other buckets, it publishes its own
  files on top; else it works its change out anew, RETRIES times.
* A change may carry a writer's name and a running number (as a stream's batch id); one that was committed is passed over.
* Data files that no kept version names are cleared by vacuum.

Keys are strings, none null. Renaming without overwriting has to be atomic on the file system (HDFS; local disks by hard
links); object stores without it need another way to publish.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RETRIES = 10
#: Keys drawn for each bucket's bound.
DRAWN = 100
EMPTY = {"version": 0, "bounds": None, "files": [], "batches": {}, "metrics": {}, "touched": [], "at": 0}


class Conflict(RuntimeError):
    """Others committed to the same buckets again and again."""


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "path", buckets: int = 16):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._path("").getFileSystem(self._conf)

    # --- files -------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self._system.listStatus(path)] if self._system.exists(path) else []

    def _read_version(self, version: int) -> dict:
        stream = self._system.open(self._path(f"versions/{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """False if the number is taken."""
        hidden = self._path(f"versions/.{uuid.uuid4().hex}")
        out = self._system.create(hidden, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        named = self._path(f"versions/{state['version']:010d}.json")
        try:
            if self._system.getScheme() == "file":
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Path
                files.createLink(paths.of(named.toUri().getPath(), self._strings()), paths.of(hidden.toUri().getPath(), self._strings()))
            else:
                rule = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                rules = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                rules[0] = rule
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(named.toUri(), self._conf).rename(hidden, named, rules)
        except Py4JJavaError as error:
            if not self._system.exists(named):
                raise
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._system.delete(hidden, False)
        return True

    def _strings(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    # --- reading -----------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")), default=0)

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self._read_version(version) if version else dict(EMPTY)

    def files(self, low: str | None = None, high: str | None = None, version: int | None = None) -> list[str]:
        """Data files that can hold keys from low to high (both inclusive, None: open)."""
        return [f["name"] for f in self.state(version)["files"] if (low is None or f["high"] >= low) and (high is None or f["low"] <= high)]

    def _of(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{n}" for n in names))

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.files(version=version))

    def get(self, key: str) -> DataFrame:
        return self._of(self.files(key, key)).where(F.col(self.key) == key)

    def by_prefix(self, prefix: str) -> DataFrame:
        # no string that starts with prefix is greater than prefix with the greatest character after it
        return self._of(self.files(prefix, prefix + "\U0010ffff")).where(F.col(self.key).startswith(prefix))

    def recent(self, column: str, limit: int | None = None) -> DataFrame:
        rows = self.read().orderBy(F.desc(column), self.key)
        return rows.limit(limit) if limit else rows

    # --- changing ----------------------------------------------------------------------------------------------------

    def _bucket(self, bounds: list[str]) -> Column:
        """How many bounds the key reaches, by halving."""

        def place(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.col(self.key) < bounds[middle], place(low, middle)).otherwise(place(middle + 1, high))

        return place(0, len(bounds))

    def _bounds(self, rows: DataFrame) -> list[str]:
        """Keys that cut rows into buckets of about as many, from a sample of bounded size."""
        keys = rows.select(self.key)
        n = keys.count()
        share = min(1.0, DRAWN * self.buckets / max(n, 1))
        drawn = sorted(r[0] for r in keys.sample(share, 1).limit(2 * DRAWN * self.buckets).collect())
        return sorted({drawn[i * len(drawn) // self.buckets] for i in range(1, self.buckets)} - {drawn[0]}) if drawn else []

    def _write(self, rows: DataFrame, bounds: list[str]) -> list[dict]:
        """New data files of rows, with the keys they hold."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("_bucket", self._bucket(bounds))
        # rebalancing splits buckets that are too large for a task, and packs small ones
        placed.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        if not any(n.startswith("_bucket=") for n in self._names(folder)):
            return []
        made = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_path").alias("f"), "_bucket").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        return [{"name": f"{folder}/" + r["f"].split(f"{folder}/", 1)[1], "bucket": r["_bucket"], "low": r["low"], "high": r["high"], "rows": r["rows"]} for r in made.collect()]

    def _commit(self, change: Callable[[dict], tuple[list[int] | None, list[dict], list[str]] | None], batch: tuple[str, int] | None, metrics: Callable[[], dict]) -> dict | None:
        """change(state) gives touched buckets (None: all), new files and bounds, or None if there is nothing to do."""
        state = self.state()
        for _ in range(RETRIES):
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return None
            made = change(state)
            if made is None:
                return None
            touched, files, bounds = made
            while True:
                kept = [] if touched is None else [f for f in state["files"] if f["bucket"] not in touched]
                batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
                after = {"version": state["version"] + 1, "bounds": bounds, "files": kept + files, "batches": batches, "metrics": metrics(), "touched": touched, "at": int(time.time() * 1000)}
                if self._publish(after):
                    return after
                between, state = self._since(state["version"]), self.state()
                meets = touched is None or any(t is None or set(t) & set(touched) for t in between)
                if meets or state["bounds"] != bounds or (batch and state["batches"].get(batch[0], -1) >= batch[1]):
                    break  # worked out anew
        raise Conflict(f"{RETRIES} times others committed to the same buckets of {self.root}")

    def _since(self, version: int) -> list[list[int] | None]:
        return [self._read_version(v)["touched"] for v in range(version + 1, self.version() + 1)]

    def overwrite(self, rows: DataFrame, metrics: Callable[[], dict] = dict, batch: tuple[str, int] | None = None) -> dict | None:
        """All rows replaced, bounds chosen anew, in one commit."""

        def change(_: dict):
            bounds = self._bounds(rows)
            return None, self._write(rows, bounds), bounds

        return self._commit(change, batch, metrics)

    def apply(self, rows: DataFrame, gone: DataFrame, batch: tuple[str, int] | None = None, metrics: Callable[[], dict] = dict) -> dict | None:
        """Of the keys of rows and gone all rows go, and rows come in, in one commit. None: nothing to do."""
        keys = rows.select(self.key).union(gone.select(self.key)).distinct()

        def change(state: dict):
            bounds = state["bounds"] if state["bounds"] is not None else self._bounds(rows)
            touched = sorted(r[0] for r in keys.select(self._bucket(bounds).alias("b")).distinct().collect())  # a number a bucket
            if not touched:
                return None
            before = self._of([f["name"] for f in state["files"] if f["bucket"] in touched])
            after = before.join(keys, self.key, "left_anti").select(before.columns).unionByName(rows.select(before.columns))
            return touched, self._write(after, bounds), bounds

        return self._commit(change, batch, metrics)

    def upsert(self, rows: DataFrame, **more) -> dict | None:
        return self.apply(rows, rows.select(self.key).limit(0), **more)

    def delete(self, keys: DataFrame, **more) -> dict | None:
        return self.apply(self.spark.createDataFrame([], self.schema), keys, **more)

    def vacuum(self, keep: int = 1, seconds: float = 86_400) -> list[str]:
        """Clears all but the last `keep` versions, and data folders that these don't name. What is younger than `seconds`
        stays, as a writer may be about to name it."""
        last, cleared, old = self.version(), [], time.time() * 1000 - seconds * 1000
        kept = [v for v in (int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")) if v > last - keep]
        named = {f["name"].split("/")[1] for v in kept for f in self._read_version(v)["files"]}
        for folder, stays in (("data", named), ("versions", {f"{v:010d}.json" for v in kept})):
            for name in self._names(folder):
                path = self._path(f"{folder}/{name}")
                if name not in stays and self._system.getFileStatus(path).getModificationTime() <= old:
                    self._system.delete(path, True)
                    cleared.append(f"{folder}/{name}")
        return sorted(cleared)


def observed(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """rows, and what counts said of them when they were written (no pass of its own)."""
    seen = Observation(uuid.uuid4().hex)
    return rows.observe(seen, *(c.alias(name) for name, c in counts.items())), lambda: seen.get
