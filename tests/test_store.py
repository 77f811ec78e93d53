import random
import threading

import pytest

from quirebook.operators import indexing
from quirebook.operators.store import Conflict, Store

SCHEMA = "path string, part int, text string"


def rows(spark, keys, text="v1", parts=2):
    return spark.createDataFrame([(k, i, text) for k in keys for i in range(parts)], SCHEMA)


def held(store, **more):
    return sorted(tuple(r) for r in store.read(**more).collect())


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    made.overwrite(rows(spark, [f"n/{i:03d}" for i in range(80)]))
    return made


def test_a_key_owns_many_rows(spark, store):
    assert len(held(store)) == 160
    store.upsert(rows(spark, ["n/003", "m/1"], "v2", 3))
    store.delete(rows(spark, ["n/004", "missing"], parts=1).select("path"))
    found = held(store)
    assert len(found) == 160 + 1 + 3 - 2
    assert [r for r in found if r[0] == "n/003"] == [("n/003", i, "v2") for i in range(3)] == sorted(tuple(r) for r in store.get("n/003").collect())
    assert store.get("n/004").count() == 0 and store.get("zzz").count() == 0
    assert held(store, version=1) == sorted((f"n/{i:03d}", p, "v1") for i in range(80) for p in (0, 1))  # older versions stay
    assert store.upsert(rows(spark, [])) is None and store.version() == 3


def test_a_prefix_opens_only_files_that_can_hold_it(spark, store):
    assert len(store.state()["bounds"]) >= 5 and len(store.files()) >= 6
    assert {r.path for r in store.by_prefix("n/01").collect()} == {f"n/01{i}" for i in range(10)}
    assert len(store.files("n/01", "n/01\U0010ffff")) <= 3 and store.files("x", "y") == []
    assert len(store.files("n/050", "n/050")) == 1
    assert set(store.by_prefix("n/01").inputFiles()) < set(store.read().inputFiles())


def test_a_crash_before_publishing_leaves_the_version_before(spark, store, monkeypatch):
    before = held(store)

    def crash(state):
        hidden = store._path(f"versions/.crashed{random.random()}")
        store._system.create(hidden, False).close()  # half written
        raise OSError("crash")

    monkeypatch.setattr(store, "_publish", crash)
    for change in (lambda: store.upsert(rows(spark, ["n/001"], "v2")), lambda: store.overwrite(rows(spark, ["x"]))):
        with pytest.raises(OSError):
            change()
        assert held(store) == before and store.version() == 1
    monkeypatch.undo()
    monkeypatch.setattr(store, "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.upsert(rows(spark, ["n/001"], "v2"))
    monkeypatch.undo()
    store.upsert(rows(spark, ["n/001"], "v2"))
    assert store.version() == 2 and ("n/001", 0, "v2") in held(store)
    files = len(store.vacuum(seconds=0))
    assert files >= 3 and ("n/001", 0, "v2") in held(store) and len(held(store)) == 160 and store.vacuum(seconds=0) == []


def between(store, monkeypatch, change):
    """Runs change once, just before the store's next version is published."""
    publish, left = store._publish, [change]

    def first(state):
        if left:
            left.pop()()
        return publish(state)

    monkeypatch.setattr(store, "_publish", first)


def test_two_writers_on_different_buckets_both_commit(spark, store, monkeypatch):
    other, writes = Store(spark, store.root, SCHEMA, buckets=8), []
    write = store._write
    monkeypatch.setattr(store, "_write", lambda *a: writes.append(1) or write(*a))
    between(store, monkeypatch, lambda: other.upsert(rows(spark, ["n/079"], "theirs")))
    store.upsert(rows(spark, ["n/000"], "ours"))
    found = held(store)
    assert ("n/079", 0, "theirs") in found and ("n/000", 0, "ours") in found and len(found) == 160
    assert len(writes) == 1 and store.version() == 3  # published on top, not worked out anew


def test_two_writers_on_one_bucket_both_commit(spark, store, monkeypatch):
    other = Store(spark, store.root, SCHEMA, buckets=8)
    between(store, monkeypatch, lambda: other.upsert(rows(spark, ["n/001"], "theirs")))
    store.upsert(rows(spark, ["n/000"], "ours"))
    found = held(store)
    assert ("n/001", 0, "theirs") in found and ("n/000", 0, "ours") in found and len(found) == 160


def test_a_writer_that_always_loses_is_told(spark, store, monkeypatch):
    monkeypatch.setattr("quirebook.operators.store.RETRIES", 2)
    other, n = Store(spark, store.root, SCHEMA, buckets=8), [0]
    publish = store._publish

    def late(state):
        n[0] += 1
        other.upsert(rows(spark, ["n/000"], f"theirs {n[0]}"))
        return publish(state)

    monkeypatch.setattr(store, "_publish", late)
    with pytest.raises(Conflict):
        store.upsert(rows(spark, ["n/001"], "ours"))
    assert ("n/000", 0, "theirs 2") in held(store) and len(held(store)) == 160


def test_writers_at_the_same_time(spark, store):
    def run(i):
        Store(spark, store.root, SCHEMA, buckets=8).upsert(rows(spark, [f"n/{i * 11:03d}", f"new/{i}"], f"writer {i}"))

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = held(store)
    assert store.version() == 5 and len(found) == 160 + 8
    assert all((f"n/{i * 11:03d}", 0, f"writer {i}") in found for i in range(4))


def test_a_batch_is_committed_once(spark, store):
    assert store.upsert(rows(spark, ["a"], "x"), batch=("s", 3))["batches"] == {"s": 3}
    assert store.upsert(rows(spark, ["a"], "y"), batch=("s", 3)) is None
    store.upsert(rows(spark, ["a"], "z"), batch=("t", 0))
    assert ("a", 0, "z") in held(store) and store.state()["batches"] == {"s": 3, "t": 0}


def test_random_changes_against_a_dictionary(spark, tmp_path):
    store, pick, want = Store(spark, str(tmp_path / "r"), SCHEMA, buckets=5), random.Random(3), {}
    for step in range(6):
        put = {f"{pick.choice('abc')}{pick.randrange(12)}": pick.randrange(1, 4) for _ in range(6)}
        gone = [f"{pick.choice('abc')}{pick.randrange(12)}" for _ in range(4)]
        store.apply(spark.createDataFrame([(k, i, str(step)) for k, n in put.items() for i in range(n)], SCHEMA), spark.createDataFrame([(k,) for k in gone], "path string"))
        want = {k: v for k, v in want.items() if k not in gone} | {k: [(k, i, str(step)) for i in range(n)] for k, n in put.items()}
        assert held(store) == sorted(r for v in want.values() for r in v)


def test_an_index_that_is_kept(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), float(t.count("x"))] for t in texts]

    notes = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    kept = indexing.NoteIndex(spark, str(tmp_path / "i"), model, 2, buckets=3)
    assert kept.status() == {"chunks": 0, "last_index_time": None, "ready": False}
    assert kept.reindex(notes(("a", "one"), ("b", "two"), ("c", "word. " * 400), ("d", " "), ("e", "bad"))) == {"indexed": 4, "errors": 1, "chunks": kept.status()["chunks"]}
    assert calls.value == 4  # once a note that has text
    chunks = kept.store.get("c").count()
    assert chunks > 2 and kept.status()["chunks"] == chunks + 2 and kept.status()["ready"]
    assert kept.update(notes(("a", "bad now"), ("b", "two more"), ("c", "short"), ("f", "xxx")), notes(("gone", "")).select("path"))["errors"] == 1
    assert {r.path: r.chunk for r in kept.store.read().collect()} == {"a": "one", "b": "two more", "c": "short", "f": "xxx"}
    kept.reindex(notes(("a", "bad"), ("b", "again")))  # c and f were removed
    assert {r.path: r.chunk for r in kept.store.read().collect()} == {"a": "one", "b": "again"}
    found = kept.search(spark.createDataFrame([(1, [3.0, 3.0]), (2, [5.0, 0.0])], "q int, vector array<double>"), 1).collect()
    assert sorted((r.q, r["path"], r["rank"]) for r in found) == [(1, "a", 1), (2, "a", 1)]
    kept.delete(notes(("a", "")).select("path"))
    assert [r.path for r in kept.store.read().collect()] == ["b"]


def test_a_model_that_fails_at_random_loses_no_note(spark, tmp_path):
    def model(texts):
        if random.random() < 0.3:
            raise ValueError("now and then")
        return [[1.0] for _ in texts]

    notes = spark.createDataFrame([(f"n{i}", "text") for i in range(200)], "path string, content string")
    kept = indexing.NoteIndex(spark, str(tmp_path / "i"), lambda texts: [[0.0] for _ in texts], 1, buckets=3)
    kept.reindex(notes)
    kept.model = model
    counts = kept.update(notes)
    after = kept.store.read().collect()
    assert len(after) == 200 and sum(r.vector == [0.0] for r in after) == counts["errors"] > 0
