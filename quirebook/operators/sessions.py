"""Sessions: context under a token budget, message segments, streamed answers and tool permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirebook.functions import text as T

BUDGET = 8000


def trim_history(messages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """messages (session_id, ord, content, ...) without the oldest of each session, so that the rest fits into the
    budget; the last one always stays. The estimate is that of the joined text, so the classes of characters are summed
    from the end, and rounded up once."""
    ascii_, cjk = F.regexp_count("content", F.lit(r"[\x00-\x7F]")), F.regexp_count("content", F.lit(r"[\x{4E00}-\x{9FFF}]"))
    back = Window.partitionBy("session_id").orderBy(F.desc("ord"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(x).over(upto) for x in (ascii_, cjk, F.length("content") - ascii_ - cjk)]
    tokens = F.ceil(F.round(sums[0] / 4 + sums[1] / 1.5 + sums[2] / 3, 9))
    kept = messages.withColumn("_fits", (tokens <= budget) | (F.row_number().over(back) == 1))
    return kept.where("_fits").drop("_fits")


def context_usage(messages: DataFrame, most: int) -> DataFrame:
    """(session_id, used, max, percentage)"""
    used = messages.groupBy("session_id").agg(F.sum(T.estimate_tokens(F.col("content"))).alias("used"))
    return used.select("session_id", "used", F.lit(most).cast("long").alias("max"), T.percentage(F.col("used"), F.lit(most)).alias("percentage"))


def recent(sessions: DataFrame, by: str, limit: int | None = None, key: str = "session_id") -> DataFrame:
    """The latest first, equal ones by id; no limit, or 0, means all."""
    rows = sessions.orderBy(F.desc(by), key)
    return rows.limit(limit) if limit else rows


def last_messages(messages: DataFrame, k: int = 2) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.desc("ord"))
    return messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def merge_segments(deltas: DataFrame) -> DataFrame:
    """(session_id, segment, kind, text, n) from deltas (session_id, ord, kind, text): neighbours of one kind joined."""
    order = Window.partitionBy("session_id").orderBy("ord")
    starts = F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("long"), F.lit(1))
    numbered = deltas.withColumn("segment", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return numbered.groupBy("session_id", "segment", "kind").agg(text.alias("text"), F.count("*").alias("n"))


def pair_tools(events: DataFrame) -> DataFrame:
    """Each result (session_id, ord, kind = 'result', name) with the latest call of its name before it: call_ord, null
    if there is none."""
    order = Window.partitionBy("session_id", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    call = F.max(F.when(F.col("kind") == "call", F.col("ord"))).over(order)
    return events.withColumn("call_ord", call).where("kind = 'result'").drop("kind")


def pair_by_id(calls: DataFrame, results: DataFrame) -> DataFrame:
    return calls.join(results, "call_id", "left")


def join_deltas(deltas: DataFrame) -> DataFrame:
    """(session_id, text): all parts in order."""
    return deltas.groupBy("session_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY ord)").alias("text"))


def context_block(results: DataFrame) -> DataFrame:
    """(q, block): cited results (q, index, path, content) as numbered blocks with a blank line between."""
    piece = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), "path", F.lit("\n"), "content")
    return results.withColumn("piece", piece).groupBy("q").agg(F.expr("listagg(piece, '\n\n') WITHIN GROUP (ORDER BY index)").alias("block"))


def assemble(system: DataFrame, blocks: DataFrame, history: DataFrame) -> DataFrame:
    """(session_id, part, ord, role, content): system prompt, search blocks and trimmed history, in this order."""
    parts = [(system, 0), (blocks, 1), (trim_history(history), 2)]
    rows = [df.select("session_id", F.lit(i).alias("part"), "ord", "role", "content") for df, i in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SSE = "choices array<struct<delta:struct<content:string,reasoning_content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>,finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"


def parse_sse(streams: DataFrame) -> DataFrame:
    """(stream_id, ord, content, reasoning, tool_calls, finish, usage) for each data line of streams (stream_id, raw):
    frames are parted by blank lines; what isn't JSON is skipped, and [DONE] ends a frame."""
    lines = F.filter(F.split("raw", "\n"), lambda x: x.startswith("data: ") & (T.trim(x) != "data: [DONE]"))
    return parsed_lines(streams.select("stream_id", F.posexplode(F.transform(lines, lambda x: F.substr(x, F.lit(7)))).alias("ord", "line")))


def parsed_lines(each: DataFrame) -> DataFrame:
    """The same for the lines of data themselves (stream_id, ord, line), in a batch or a stream."""
    parsed = each.where(F.try_parse_json("line").isNotNull()).withColumn("e", F.from_json("line", SSE))
    first = F.get(F.col("e.choices"), F.lit(0))
    return parsed.select("stream_id", F.col("ord").cast("long").alias("ord"), first["delta"]["content"].alias("content"), first["delta"]["reasoning_content"].alias("reasoning"), first["delta"]["tool_calls"].alias("tool_calls"), first["finish_reason"].alias("finish"), F.col("e.usage").alias("usage"))


def tool_calls(events: DataFrame) -> DataFrame:
    """(stream_id, index, id, name, args): fragments of each call joined; args that aren't JSON are wrapped."""
    parts = events.select("stream_id", "ord", F.explode("tool_calls").alias("c")).select("stream_id", "ord", F.col("c.index").alias("index"), F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.coalesce("c.function.arguments", F.lit("")).alias("part"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("stream_id", "index").agg(first("id"), first("name"), T.parse_args(joined).alias("args"))


def decide(calls: DataFrame, settings: DataFrame, grants: DataFrame, trust: bool = False) -> DataFrame:
    """calls (session_id, tool, path) with `decision`: trust, then a grant of the session for the tool or the tool and
    path, then the setting (tool, permission), else ask."""
    key = F.concat_ws(":", "tool", F.when(F.col("path") != "", F.col("path")))
    met = calls.join(settings, "tool", "left").withColumn("_key", key)
    given = grants.select("session_id", F.col("grant").alias("_key"), F.lit(True).alias("granted")).distinct()
    met = met.join(given, ["session_id", "_key"], "left")
    decision = F.when(F.lit(trust) | F.coalesce("granted", F.lit(False)), "allow").otherwise(F.coalesce("permission", F.lit("ask")))
    return met.select(*calls.columns, decision.alias("decision"))


def first_denial(verdicts: DataFrame) -> DataFrame:
    """(call_id, allowed, reason) from hooks' verdicts (call_id, ord, allow, reason): the first that denies stops. A hook
    that failed (allow is null) is passed over."""
    denial = F.min_by("reason", F.when(~F.col("allow"), F.col("ord")))
    denied = F.bool_or(F.coalesce(~F.col("allow"), F.lit(False)))
    return verdicts.groupBy("call_id").agg((~denied).alias("allowed"), F.when(denied, denial).alias("reason"))


def model_context(models: DataFrame, known: DataFrame) -> DataFrame:
    """(model, context): of known (ord, name, context) the same name, else the first that the model starts with."""
    names = models.select("model").distinct()
    starts = names.select("model", F.explode(F.transform(F.sequence(F.lit(0), F.length("model")), lambda n: F.substr("model", F.lit(1), n))).alias("name"))
    met = starts.join(known, "name").groupBy("model").agg(F.min_by("context", F.struct(F.col("model") != F.col("name"), "ord")).cast("long").alias("context"))
    return models.select("model").join(met, "model", "left")


def any_reranked(results: DataFrame) -> DataFrame:
    return results.groupBy("q").agg(F.bool_or("reranked").alias("any_reranked"))


#: What a tool does to a note: with its path ({}), and without. Fixed values.
SUMMARIES = {
    "write_note": ("创建或覆盖笔记 {}", "写入笔记"),
    "append_note": ("追加内容到 {}", "追加笔记"),
    "edit_note": ("精确替换 {} 中的文本", "编辑笔记"),
    "delete_note": ("将 {} 移到回收站", "删除笔记"),
}


def summary(tool: Column, path: Column) -> Column:
    """One line on a tool call; other tools show their name."""
    lines = {t: F.when(F.coalesce(path, F.lit("")) == "", without).otherwise(F.concat(*(F.lit(x) for x in with_.split("{}")[:1]), path, F.lit(with_.split("{}")[1]))) for t, (with_, without) in SUMMARIES.items()}
    other = F.when(F.coalesce(path, F.lit("")) == "", tool).otherwise(F.concat(tool, F.lit(" → "), path))
    return F.coalesce(*(F.when(tool == t, line) for t, line in lines.items()), other)


def opened(stored: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Sessions (session_id, title, created_at, updated_at) of ids; those not stored are new, without a title."""
    met = ids.select("session_id").distinct().join(stored, "session_id", "left")
    return met.select("session_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.coalesce("updated_at", F.lit(now)).alias("updated_at"))


def append_messages(sessions: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and refusals after new messages (session_id, ts, role, content) were put at the end of messages
    (session_id, ord, role, content), in the order of ts. updated_at becomes the last ts; messages for sessions that
    aren't open are refused."""
    known = sessions.select("session_id")
    taken, refused = new.join(known, "session_id", "left_semi"), new.join(known, "session_id", "left_anti")
    ends = messages.groupBy("session_id").agg(F.max("ord").alias("_end"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "role", "content"))
    added = taken.withColumn("_n", place).join(ends, "session_id", "left").select("session_id", (F.coalesce("_end", F.lit(-1)) + F.col("_n")).alias("ord"), "role", "content")
    last = taken.groupBy("session_id").agg(F.max("ts").alias("_last"))
    bumped = sessions.join(last, "session_id", "left").withColumn("updated_at", F.coalesce("_last", "updated_at")).select(sessions.columns)
    return bumped, messages.select("session_id", "ord", "role", "content").unionByName(added), refused


def request_body(messages: DataFrame, model: str, options: dict[str, float] | None = None) -> DataFrame:
    """(session_id, body): the JSON of a streamed chat request from messages (session_id, ord, role, content, call_id, tool,
    args). A call's text is null where it is empty, its arguments are JSON text; a tool's answer names its call."""
    nulls = {"ignoreNullFields": "false"}
    call = F.struct(F.col("call_id").alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce("tool", F.lit("")).alias("name"), F.coalesce("args", F.lit("{}")).alias("arguments")).alias("function"))
    said = F.when(F.col("content") != "", F.col("content"))
    one = (
        F.when((F.col("role") == "assistant") & F.col("call_id").isNotNull(), F.to_json(F.struct("role", said.alias("content"), F.array(call).alias("tool_calls")), nulls))
        .when((F.col("role") == "tool") & F.col("call_id").isNotNull(), F.to_json(F.struct("role", "content", F.col("call_id").alias("tool_call_id")), nulls))
        .otherwise(F.to_json(F.struct("role", "content"), nulls))
    )
    joined = messages.withColumn("_one", one).groupBy("session_id").agg(F.expr("listagg(_one, ',') WITHIN GROUP (ORDER BY ord)").alias("_all"))
    head = F.to_json(F.struct(F.lit(model).alias("model")))
    tail = F.to_json(F.struct(F.lit(True).alias("stream"), *(F.lit(v).alias(k) for k, v in (options or {}).items())))
    body = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"messages":['), "_all", F.lit("],"), F.substr(tail, F.lit(2)))
    return joined.select("session_id", body.alias("body"))


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """(session_id, segment, kind, name, text, status, result) from deltas (session_id, ord, kind, name, text). Neighbours of
    kind text or think are joined. A call is a segment of kind tool; a result or failure closes the latest open call of its
    name. A result without one is a segment of its own, a failure without one is left out.

    Calls and closings nest like brackets, so a closing meets the call of the same depth before it: within a depth the two
    take turns."""
    order = "ORDER BY ord ROWS UNBOUNDED PRECEDING"
    tools = deltas.where("kind IN ('call', 'result', 'failed')")
    step = tools.withColumn("_sum", F.expr(f"sum(CASE kind WHEN 'call' THEN 1 ELSE -1 END) OVER (PARTITION BY session_id, name {order})"))
    low = step.withColumn("_low", F.expr(f"least(0, min(_sum) OVER (PARTITION BY session_id, name {order}))"))
    low = low.withColumn("_lone", F.expr("kind <> 'call' AND _sum = _low AND _sum < coalesce(least(0, min(_sum) OVER (PARTITION BY session_id, name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)"))
    depth = F.col("_sum") - F.col("_low") + F.when(F.col("kind") == "call", 0).otherwise(1)
    by = Window.partitionBy("session_id", "name", "_depth").orderBy("ord")
    met = low.where("NOT _lone").withColumn("_depth", depth).withColumn("_kind", F.lead("kind").over(by)).withColumn("_text", F.lead("text").over(by))
    status = F.when(F.col("_kind") == "result", "done").when(F.col("_kind") == "failed", "failed").otherwise("calling")
    none = F.lit(None).cast("string")
    calls = met.where("kind = 'call'").select("session_id", "ord", F.lit("tool").alias("kind"), "name", "text", status.alias("status"), F.col("_text").alias("result"))
    lone = low.where("_lone AND kind = 'result'").select("session_id", "ord", F.lit("tool").alias("kind"), "name", none.alias("text"), F.lit("done").alias("status"), F.col("text").alias("result"))
    said = deltas.where("kind IN ('text', 'think')").select("session_id", "ord", "kind", none.alias("name"), "text", none.alias("status"), none.alias("result"))
    rows = said.unionByName(calls).unionByName(lone)
    along = Window.partitionBy("session_id").orderBy("ord")
    starts = F.when((F.col("kind") != "tool") & (F.lag("kind").over(along) == F.col("kind")), 0).otherwise(1)
    numbered = rows.withColumn("segment", F.sum(starts).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    only = lambda c: F.max(c).alias(c)  # noqa: E731  a tool's segment is one row
    return numbered.groupBy("session_id", "segment", "kind").agg(only("name"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY ord)").alias("text"), only("status"), only("result"))


def attachment_sums(attached: DataFrame) -> DataFrame:
    """(session_id, size, n) of attachments (session_id, size): their size in all, and how many aren't empty."""
    return attached.groupBy("session_id").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n"))
