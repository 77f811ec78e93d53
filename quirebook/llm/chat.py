"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns are measured in tokens. Of a window's budget, the system turn that opens the conversation and the repeated history
are set aside; what is left is the room. Prefix sums over the conversation cut it into turn-aligned spans: a turn belongs
to the span in which its last token falls, spans being half the room wide, so that a span's turns, none longer than that,
fit into the room. A longer turn is a span of its own. Each span becomes a window: the system turn is kept in every
window, the last turns of the previous span are repeated up to a limit, then come the span's own turns. So no window
exceeds the budget but for one turn longer than the room, which stands alone with the system turn and without history. A
system turn longer than half the budget is a span of its own and isn't repeated.
The loss mask holds the texts of assistant turns in the window to which they belong; repeated ones are masked, so each
is learned once.

Template: a turn is <s>, the role, a new line, the text, a new line, </s>. Control strings inside a role or text get a
backslash in front, which reading back removes; a template's own control strings never follow a backslash. In a role,
per cent signs and new lines are written as %25 and %0A.

Defined cases: a null role or text counts as empty; turns with equal numbers follow in the order of role and text;
repeated rows are turns of their own; a null conversation id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirebook.llm.common import let, read

BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 1024, 2, 256
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>)"
OPEN, CLOSE = "<s>", "\n</s>"


def tokens(text: Column) -> Column:
    """An estimate by length: four characters a token, and four tokens for the turn's frame."""
    return F.ceil(F.length(text) / 4) + 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def placed(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, measure: Callable[[Column], Column] = tokens) -> DataFrame:
    """(conv_id, win, pos, fresh, role, text): every turn in each window that holds it; fresh in its own. measure gives
    a text's tokens, frame included; history_tokens has to be less than half the budget."""
    if not 0 <= 2 * history_tokens < budget:
        raise ValueError("the history takes less than half of the budget")
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("pos", F.row_number().over(conv)).withColumn("n", measure(F.col("text")))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system") & (2 * F.col("n") <= budget))
    whole, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("pos")
    rows = rows.withColumn("room", budget - history_tokens - F.max(F.when(F.col("system"), F.col("n")).otherwise(0)).over(whole))
    rows = rows.withColumn("big", ~F.col("system") & (2 * F.col("n") > F.col("room")))
    after_big, after_turn = (F.coalesce(F.lag(c).over(order), F.lit(False)) for c in (F.col("big"), ~F.col("system")))
    rows = rows.withColumn("opens", after_big | (F.col("big") & after_turn))
    rows = rows.withColumn("part", F.sum(F.col("opens").cast("int")).over(order))
    end = F.sum(F.when(F.col("system"), 0).otherwise(F.col("n"))).over(Window.partitionBy("conv_id", "part").orderBy("pos"))
    rows = rows.withColumn("span", F.greatest(F.floor(2 * (end - 1) / F.col("room")), F.lit(0)))
    rows = rows.withColumn("win", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("part", "span"))).withColumn("next", F.lead("n").over(order))
    back = Window.partitionBy("conv_id", "win").orderBy(F.desc("pos"))
    tail = (F.row_number().over(back) <= history_turns) & (F.sum("n").over(back.rowsBetween(Window.unboundedPreceding, 0)) <= history_tokens)
    fits = F.coalesce(F.first("next").over(back), F.lit(0)) <= F.col("room")
    rows = rows.withColumn("tail", tail & fits & ~F.col("system")).withColumn("last", F.max("win").over(whole))
    again = F.when(F.col("system") & (F.col("last") > 1), F.sequence(F.lit(2), F.col("last"))).when(F.col("tail") & (F.col("win") < F.col("last")), F.array(F.col("win") + 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(F.array(F.struct("win", F.lit(True).alias("fresh"))), F.transform(again, lambda w: F.struct(w.alias("win"), F.lit(False).alias("fresh"))))
    return rows.select("conv_id", F.explode(places).alias("place"), "pos", "role", "text").select("conv_id", "place.*", "pos", "role", "text")


def windows(turns: DataFrame, **limits) -> DataFrame:
    """(conv_id, win, formatted, n_repeated, loss): loss holds the spans [start, end) of formatted, in characters, that
    are learned; the first n_repeated turns of a window stand in an earlier one, too."""
    piece = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE))
    head = F.length(escape_role(F.col("role"))) + len(OPEN) + 1
    turn = F.struct("pos", "fresh", "role", piece.alias("piece"), head.alias("head"))
    grouped = placed(turns, **limits).groupBy("conv_id", "win").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = "array<struct<start:int,end:int>>"

    def step(s: Column, t: Column) -> Column:
        end = s["end"] + F.length(t["piece"])
        learned = F.when(t["fresh"] & (t["role"] == "assistant"), F.array(F.struct((s["end"] + t["head"]).alias("start"), (end - len(CLOSE)).alias("end")))).otherwise(F.array().cast(spans))
        return F.struct(end.alias("end"), F.concat(s["loss"], learned).alias("loss"))

    loss = F.aggregate("turns", F.struct(F.lit(0).alias("end"), F.array().cast(spans).alias("loss")), step, lambda s: s["loss"])
    return grouped.select("conv_id", "win", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_repeated"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) for each conversation, from nothing but its windows."""

    def turn(piece: Column) -> Column:
        line = F.length(F.substring_index(piece, "\n", 1))
        return F.struct(unescape_role(F.substr(piece, F.lit(len(OPEN) + 1), line - len(OPEN))).alias("role"), unescape(F.substr(piece, line + 2, F.length(piece) - line - 2)).alias("text"))

    pieces = F.slice(F.split("formatted", r"(?<!\\)</s>", -1), F.col("n_repeated") + 1, F.lit(1 << 30))
    turns = F.transform(F.filter(pieces, lambda p: p != ""), turn)
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    rows = formatted.select("conv_id", F.struct("win", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.col("w.loss"), "").alias("loss_text"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_chat: see the README for its columns."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = read_back(windows(table.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


#: The query's rows in DuckDB SQL.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, ceil(length(text) / 4)::BIGINT + 4 AS n,
  8 + 1 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '(</?s>|\[/?INST\]|<</?SYS>>)', '\\\1', 'g')) + length(regexp_replace(text, '(</?s>|\[/?INST\]|<</?SYS>>)', '\\\1', 'g')) AS chars FROM t),
b AS (SELECT *, pos = 1 AND role = 'system' AND 2 * n <= 1024 AS system FROM a),
r AS (SELECT *, 768 - max(CASE WHEN system THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS room FROM b),
g AS (SELECT *, NOT system AND 2 * n > room AS big FROM r),
o AS (SELECT *, coalesce(lag(big) OVER w, false) OR (big AND coalesce(lag(NOT system) OVER w, false)) AS opens, lead(n) OVER w AS next FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
q AS (SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY pos) AS part FROM o),
c AS (SELECT *, greatest(floor(2 * (sum(CASE WHEN system THEN 0 ELSE n END) OVER (PARTITION BY conv_id, part ORDER BY pos) - 1) / room), 0) AS span FROM q),
f AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY part, span) AS win FROM c),
d AS (SELECT *, row_number() OVER w <= 2 AND sum(n) OVER w <= 256 AND coalesce(first(next) OVER w, 0) <= room AND NOT system AS tail FROM f WINDOW w AS (PARTITION BY conv_id, win ORDER BY pos DESC)),
e AS (SELECT *, max(win) OVER (PARTITION BY conv_id) AS last FROM d)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * (1 + CASE WHEN system THEN last - 1 WHEN tail AND win < last THEN 1 ELSE 0 END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
