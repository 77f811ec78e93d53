import random

from quirebook.operators import indexing, sessions

NOTES = "path string, content string"


def model(texts):
    if any("bad" in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), 1.0] for t in texts]


def test_a_note_that_fails_keeps_its_older_rows(spark):
    old = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], NOTES)
    table = indexing.index(old, model, 2).select("path", "chunk", "vector")
    new = spark.createDataFrame([("a", "more"), ("b", "bad"), ("c", " "), ("d", "x. " * 400), ("e", None)], NOTES)
    made = indexing.index(new, model, 2)
    assert {r.path: (r.indexed, r.errors) for r in indexing.outcomes(new, made).collect()} == {"a": (1, 0), "b": (0, 1), "c": (0, 0), "d": (1, 0), "e": (0, 0)}
    after = {}
    for r in indexing.refresh(table, new, made).collect():
        after.setdefault(r.path, []).append(r.chunk)
    assert after["a"] == ["more"] and after["b"] == ["two"] and "c" not in after and len(after["d"]) > 1


def test_vectors_of_another_length_are_an_error(spark):
    notes = spark.createDataFrame([("a", "one")], NOTES)
    assert "3 numbers" in indexing.index(notes, model, 3).first()["error"]
    assert indexing.index(notes.limit(0), model, 2).count() == 0


def folded(deltas):
    out = []
    for kind, name, text in deltas:
        calling = [s for s in out if s[0] == "tool" and s[1] == name and s[3] == "calling"]
        if kind in ("text", "think"):
            if out and out[-1][0] == kind:
                out[-1][2] += text
            else:
                out.append([kind, None, text, None, None])
        elif kind == "call":
            out.append(["tool", name, text, "calling", None])
        elif calling:
            calling[-1][3:] = ["done" if kind == "result" else "failed", text]
        elif kind == "result":
            out.append(["tool", name, None, "done", text])
    return [tuple(s) for s in out]


def test_folding_equals_a_walk_over_the_deltas(spark):
    pick = random.Random(5)
    streams = {s: [(pick.choice(("text", "think", "call", "call", "result", "failed")), pick.choice("ab"), f"{i}.") for i in range(pick.randrange(1, 40))] for s in range(40)}
    rows = spark.createDataFrame([(s, i, *x) for s, d in streams.items() for i, x in enumerate(d)], "session_id int, ord int, kind string, name string, text string")
    got = {}
    for r in sorted(sessions.fold_deltas(rows).collect(), key=lambda r: (r.session_id, r.segment)):
        got.setdefault(r.session_id, []).append((r.kind, r.name, r.text, r.status, r.result))
    assert got == {s: f for s, d in streams.items() if (f := folded(d))}


def walked(steps):
    state, paused, held, out = "Idle", False, "Idle", []
    for step, pending in steps:
        if step == "pause" and not paused:
            held, paused, state = (state if state in ("Ready", "Idle", "Failed") else "Ready"), True, "Paused"
        elif step == "resume" and paused:
            paused, state = False, "Queueing" if pending else held
        elif step in ("ready", "failed"):
            state = step.title()
        elif step == "enqueue":
            state = "Paused" if paused else "Queueing"
        out.append(state)
    return out


def test_states_equal_a_walk_over_the_log(spark):
    pick = random.Random(9)
    logs = {i: [(pick.choice(("ready", "failed", "enqueue", "pause", "resume")), pick.randrange(2)) for _ in range(30)] for i in range(40)}
    rows = spark.createDataFrame([(i, n, *x) for i, steps in logs.items() for n, x in enumerate(steps)], "index int, seq int, step string, pending int")
    got = {}
    for r in sorted(indexing.states(rows).collect(), key=lambda r: (r["index"], r.seq)):
        got.setdefault(r["index"], []).append(r.state)
    assert got == {i: walked(steps) for i, steps in logs.items()}


def test_a_paused_queue_is_handed_on_at_the_resume(spark):
    rows = [(1, 1, "event", "a", "upsert"), (1, 2, "pause", None, None), (1, 3, "event", "a", "upsert"), (1, 4, "event", "a", "delete"), (1, 5, "resume", None, None), (1, 6, "pause", None, None), (1, 7, "event", "b", "upsert")]
    log = spark.createDataFrame(rows, "index int, seq int, kind string, path string, op string")
    assert {(r.due, r.path, r.op) for r in indexing.held(log).collect()} == {(1, "a", "upsert"), (5, "a", "delete"), (None, "b", "upsert")}


def test_messages_for_sessions_that_are_not_open_are_refused(spark):
    stored = spark.createDataFrame([(1, "t", 5, 6)], "session_id int, title string, created_at long, updated_at long")
    open_ = sessions.opened(stored, spark.createDataFrame([(1,), (2,)], "session_id int"), 9)
    had = spark.createDataFrame([(1, 3, "user", "x")], "session_id int, ord int, role string, content string")
    new = spark.createDataFrame([(1, 20, "user", "y"), (2, 21, "user", "z"), (3, 22, "user", "w")], "session_id int, ts long, role string, content string")
    after, messages, refused = sessions.append_messages(open_, had, new)
    assert {tuple(r) for r in after.collect()} == {(1, "t", 5, 20), (2, "", 9, 21)}
    assert {tuple(r) for r in messages.collect()} == {(1, 3, "user", "x"), (1, 4, "user", "y"), (2, 0, "user", "z")}
    assert [r.content for r in refused.collect()] == ["w"]
