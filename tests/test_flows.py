import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirebook.operators import indexing, sessions
from quirebook.operators.store import Store
from quirebook.streaming import events as E
from quirebook.streaming import flows

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def states(spark):
    flows.rocks(spark)


def files(spark, folder, schema, *parts):
    """A stream that reads each of parts as a micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{len(list(folder.glob('p*')) if folder.exists() else ())}-{i}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, tmp_path, name):
    out = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(str(tmp_path / f"{name}-out"))
    out.awaitTermination(180)
    return stream.sparkSession.read.parquet(str(tmp_path / f"{name}-out"))


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_requests_and_responses_of_two_streams(spark, tmp_path):
    asked = [[(1, at(0)), (2, at(1))], [(3, at(30))], [(4, at(1000))], [(5, at(3)), (9, at(9000))]]  # 5 comes too late
    answers = [[(2, at(5), "b")], [(1, at(9), "a"), (3, at(95), "after its time")], [(8, at(1000), "nobody asked")], [(1, at(4), "late"), (9, at(9000), "z")]]
    a = files(spark, tmp_path / "a", "id long, ts timestamp", *asked)
    b = files(spark, tmp_path / "b", "id long, ts timestamp, answer string", *answers)
    got = sorted(map(tuple, run(flows.answered_stream(a, b, 60), tmp_path, "joined").collect()))
    assert got == [(1, "a"), (2, "b"), (3, "timeout"), (4, "timeout"), (9, "z")]


def log(n, seed):
    pick = random.Random(seed)
    return [(i % 7, i, pick.choice(("event", "event", "event", "pause", "resume")), pick.choice("abc"), pick.choice(("upsert", "delete"))) for i in range(n)]


LOG = "index long, seq long, kind string, path string, op string"


def test_a_queue_that_is_paused_equals_its_batch_twin_over_restarts(spark, tmp_path):
    rows = log(400, 2)
    for cut in (0, 90, 91, 250, 330):  # each time the query starts anew from its checkpoint, slots still held
        stop = {0: 90, 90: 91, 91: 250, 250: 330, 330: 400}[cut]
        stream = files(spark, tmp_path / "in", LOG, rows[cut : (cut + stop) // 2 + 1], rows[(cut + stop) // 2 + 1 : stop])
        got = run(flows.queue_stream(stream), tmp_path, "queue")
    want = indexing.held(spark.createDataFrame(rows, LOG)).where("due is not null")
    assert sorted(map(tuple, got.select("index", "due", "path", "op").collect())) == sorted(map(tuple, want.select("index", "due", "path", "op").collect()))
    assert {tuple(r) for r in got.where("due > seq").select("index").collect()} == {(i,) for i in range(7)}


def test_a_batch_that_is_run_again_is_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "path string, op string", buckets=2)
    stream = flows.queue_stream(files(spark, tmp_path / "in", LOG, log(60, 4), [(i, 100 + s, k, p, o) for i, s, k, p, o in log(60, 5)]))
    commit, fails = E.apply_to(store, lambda paths: paths.withColumn("op", F.lit("upsert")), "queue"), [True]

    def each(batch, number):
        commit(batch, number)
        if fails:
            fails.pop()
            raise OSError("lost after the commit, before the stream's own")

    def start():
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after"):
        start().awaitTermination(180)
    assert store.version() == 1
    start().awaitTermination(180)
    assert store.state()["batches"] == {"queue": store.version() - 1} and store.version() == 2


@pytest.mark.parametrize("most", [1, 7, 40])
def test_frames_cut_at_any_byte(spark, tmp_path, most):
    frame = lambda text: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text
    raws = [(1, "\n\n".join([frame("naïve 漢字 🎉"), ": comment", "data: {bad", frame("b"), "data: [DONE]"])), (2, frame("no end")), (3, ""), (4, "\n\n" + frame("x") + "\n")]
    streams = spark.createDataFrame(raws, "stream_id long, raw string")
    chunks = [tuple(r) for r in flows.chunked(streams, most).collect()]
    assert max(len(c[2]) for c in chunks) <= most
    parts = [[c for c in chunks if low <= c[1] < high] for low, high in ((0, 2), (2, 9), (9, 10**6))]
    got = run(sessions.parsed_lines(flows.sse_lines(files(spark, tmp_path / "in", "stream_id long, seq long, chunk binary, last boolean", *parts))), tmp_path, "sse")
    want = sessions.parse_sse(streams)
    columns = ("stream_id", "ord", "content", "finish")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert want.count() == 4


def test_chunks_are_those_of_a_plain_loop(spark):
    raws = [(0, "abc" * 700), (1, ""), (2, None), (13, "é漢" * 41), (39, "x"), (5, "y" * 820)]
    got = flows.chunked(spark.createDataFrame(raws, "stream_id long, raw string")).collect()
    want = []
    for stream, raw in raws:
        data, at, seq = (raw or "").encode(), 0, 0
        while at < len(data) or not seq:
            size = 1 + (seq * 7 + stream) % 40
            want.append((stream, seq, data[at : at + size], at + size >= len(data)))
            at, seq = at + size, seq + 1
    assert sorted((r.stream_id, r.seq, bytes(r.chunk), r.last) for r in got) == sorted(want)


def test_a_part_of_many_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """No task writes a part alone, also where a part's rows are in few of the table's files."""
    monkeypatch.setattr(flows, "ROWS", 20)
    rows = log(400, 6)
    stream = flows.replayed(spark.createDataFrame(rows, LOG).repartitionByRange(4, "seq").union(spark.createDataFrame([], LOG)), "seq")
    counts = []
    stream.writeStream.foreachBatch(lambda b, i: counts.append([r.seq for r in b.select("seq").collect()])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    assert [len(c) > 80 for c in counts] == [True] * 4 and sorted(sum(counts, [])) == list(range(400))
    assert all(max(a) < min(b) for a, b in zip(counts, counts[1:]))
    got = run(flows.queue_stream(flows.replayed(spark.createDataFrame(rows, LOG), "seq")), tmp_path, "queue")
    want = indexing.held(spark.createDataFrame(rows, LOG)).where("due is not null")
    assert sorted(map(tuple, got.select("index", "due", "path", "op").collect())) == sorted(map(tuple, want.select("index", "due", "path", "op").collect()))
