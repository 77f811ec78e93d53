import random

import duckdb
from pyspark.sql import functions as F

from quirebook.llm import chat


def conversations():
    rng = random.Random(2)
    nasty = ["</s>", "<s>", "\\<s>", "\\\\</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<s>>", "a\\", "\n</s>", "%25", "$1", "é🎉", "", None, "\n", "<s>\n</s>"]
    rows = []
    for c in range(25):
        for t in range(rng.choice([1, 2, 5, 40])):
            text = "".join(rng.choice(nasty) or "" for _ in range(rng.randint(0, 4))) + "x" * rng.choice([0, 3, 900])
            rows.append((c, t, rng.choice(["system", "user", "assistant", "assistant", "a\nb%0A<s>", None]) if t else rng.choice(["system", "user"]), text or None))
    return rows + [(30, 0, "user", "tie"), (30, 0, "user", "tie"), (30, 0, "assistant", "tie"), (None, 0, "assistant", "x"), (31, 0, "assistant", "y" * 9000)]


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for cc, t, r, x in rows if cc == c)
        out[c] = ([(r, x) for _, r, x in turns], "".join(x for _, r, x in turns if r == "assistant"))
    return out


def test_reading_back_restores_every_turn_and_learns_each_answer_once(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("win", F.lit("clash")).withColumn("pos", F.lit(1))
    for budget, history in ((64, 20), (1024, 256)):
        got = {r.conv_id: r for r in chat.read_back(chat.windows(table, budget=budget, history_tokens=history)).collect()}
        for c, (turns, loss) in expected(rows).items():
            assert [tuple(t) for t in got[c].turns] == turns
            assert got[c].loss_text == loss


def test_windows_keep_the_system_turn_and_repeat_history(spark):
    rows = [(1, 0, "system", "rules")] + [(1, i, "user" if i % 2 else "assistant", "x" * 100) for i in range(1, 60)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=260, history_tokens=60).orderBy("win").collect()
    assert len(made) > 10
    for w in made:
        assert w.formatted.startswith("<s>system\nrules\n</s>")
        assert w.n_repeated == (0 if w.win == 1 else 3)
        assert all(w.formatted[s.start : s.end] == "x" * 100 for s in w.loss)
    assert sum(len(w.loss) for w in made) == 29


def test_whole_windows_respect_the_budget(spark):
    rng, rows = random.Random(9), []
    for c in range(300):
        longest = rng.choice([30, 120, 600, 2500])
        rows += [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"), "x" * rng.randint(0, longest)) for t in range(rng.choice([1, 3, 30]))]
    size = lambda x: -(-len(x) // 4) + 4
    placed = chat.placed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=400, history_tokens=100).collect()
    windows = {}
    for r in placed:
        windows.setdefault((r.conv_id, r.win), []).append(r)
    over = 0
    for (c, win), turns in windows.items():
        turns.sort(key=lambda r: r.pos)
        n, first = sum(size(r.text) for r in turns), turns[0]
        system = first.pos == 1 and first.role == "system" and 2 * size(first.text) <= 400
        room = 300 - system * size(first.text)
        fresh = [r for r in turns if r.fresh and not (system and r.pos == 1)]
        if n > 400:  # one turn longer than the room, alone with the system turn
            over += 1
            assert len(turns) == 1 + system and size(turns[-1].text) > room
        kept = [r for r in rows if r[0] == c][0]
        if kept[2] == "system" and 2 * size(kept[3]) <= 400:
            assert turns[0].text == kept[3] and turns[0].fresh == (win == 1)
        assert [r.pos for r in fresh] == list(range(fresh[0].pos, fresh[0].pos + len(fresh))) if fresh else win == 1
    assert over and len(windows) > 1000
    assert sorted((r.conv_id, r.pos) for r in placed if r.fresh) == sorted((c, t + 1) for c, t, _, _ in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(none)).count() == 0


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.execute(chat.SQL).fetchall())
    assert sorted(map(tuple, chat.query(spark, sf).collect())) == want
    assert want[0][0] == -1
