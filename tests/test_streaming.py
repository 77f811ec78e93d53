from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirebook.operators.store import Store
from quirebook.streaming import events as E

T0 = datetime(2024, 1, 1)
ROWS = [
    (0, "foo", "upsert"), (1, "foo", "upsert"), (2, "foo", "upsert"), (3, "bar", "upsert"), (3.5, "gone", "upsert"), (4, "gone", "delete"),
    (20, "foo", "upsert"), (26, "foo", "upsert"), (40, "baz", "delete"), (41, "baz", "upsert"), (200, "end", "upsert"), (400, "end", "delete"),
]


def frame(spark, rows=ROWS):
    made = [(T0 + timedelta(seconds=s), i, p, op) for i, (s, p, op) in enumerate(rows)]
    return spark.createDataFrame(made, "ts timestamp, seq long, path string, op string")


def write(spark, tmp_path, cuts):
    folder = tmp_path / "in"
    rows = frame(spark)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        rows.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return str(folder), rows.schema


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_debounce_in_a_batch(spark):
    got = {(r.path, r.seq, r.op): (r.due - T0).total_seconds() for r in E.debounce(frame(spark)).collect()}
    assert got == {("foo", 2, "upsert"): 7, ("bar", 3, "upsert"): 8, ("gone", 5, "delete"): 4, ("foo", 6, "upsert"): 25, ("foo", 7, "upsert"): 31, ("baz", 8, "delete"): 40, ("baz", 9, "upsert"): 46, ("end", 10, "upsert"): 205, ("end", 11, "delete"): 400}


def test_debounce_stream_equals_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, cuts in (("one", [0, 12]), ("many", [0, 2, 5, 9, 11, 12])):
        folder, schema = write(spark, tmp_path / name, cuts)
        out = E.debounce_stream(stream(spark, folder, schema)).writeStream.format("memory").queryName(f"due_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name / "ck")).trigger(availableNow=True).start()
        out.awaitTermination(180)
        got = sorted((r.path, r.seq, r.op, r.due) for r in spark.table(f"due_{name}").collect())
        assert got == sorted((r.path, r.seq, r.op, r.due) for r in E.debounce(frame(spark)).collect())


def test_session_windows_on_a_stream(spark, tmp_path):
    folder, schema = write(spark, tmp_path, [0, 6, 12])
    rows = stream(spark, folder, schema).withWatermark("ts", E.WATERMARK)
    out = E.debounce_sessions(rows).writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination(180)
    got = {(r.path, r.start, r.n) for r in spark.table("runs").collect()}
    batch = {(r.path, r.start, r.n) for r in E.debounce_sessions(frame(spark)).collect()}
    closed = {x for x in batch if x[1] < T0 + timedelta(seconds=390)}  # the last one is still open
    assert got == closed and batch - got


def test_rename_ignore_and_queue(spark):
    rows = spark.createDataFrame([(T0, 0, "b", "a", "rename"), (T0, 1, "skip", None, "create"), (T0, 2, "skip", None, "delete"), (T0, 3, "b", None, "modify"), (T0, 4, "b", None, "delete")], "ts timestamp, seq long, path string, old_path string, op string")
    found = E.normalize(rows, lambda p: p == "skip")
    assert sorted((r.seq, r.path, r.op) for r in found.collect()) == [(0, "a", "delete"), (0, "b", "upsert"), (2, "skip", "delete"), (3, "b", "upsert"), (4, "b", "delete")]
    assert {r.path: (r.op, r.first_seq) for r in E.last_ops(found).collect()}["b"] == ("delete", 0)


def test_due_events_reach_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "path string, content string", buckets=3)
    store.upsert(spark.createDataFrame([("gone", "old"), ("foo", "old"), ("kept", "old")], "path string, content string"))
    now = spark.createDataFrame([("foo", "new"), ("bar", "new")], "path string, content string")
    run = E.apply_to(store, lambda paths: now.join(paths, "path", "left_semi"), "events")
    run(E.debounce(frame(spark)), 0)
    run(E.debounce(frame(spark)), 0)  # the same batch again
    assert store.version() == 2
    assert {r.path: r.content for r in store.read().collect()} == {"foo": "new", "bar": "new", "kept": "old"}
