"""More queries for the catalogue: indexing and its states, sessions and requests, and functions on single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.functions import text as T
from quirebook.operators import grep, indexing, mutation, sessions, tokenizer, vault, vectors
from quirebook.plans.catalog import CHUNKS, ORACLE_SQL, query
from quirebook.sources import files, scratch
from quirebook.sources import tables as S
from quirebook.streaming import events as E
from quirebook.streaming import flows

# --- notes -----------------------------------------------------------------------------------------------------------


@query(f"{S.sql('notes')} SELECT path, length(content)::BIGINT AS n, sha256(content) AS hash FROM notes WHERE path = (SELECT path FROM notes WHERE doc_id = 7)")
def read_file(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    path = notes.where("doc_id = 7").first()["path"]
    return vault.read(notes, path).select("path", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("hash"))


@query("SELECT event_id, 0 <= user_id AND user_id < (SELECT count(*) FROM documents) AS found FROM events")
def file_exists(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d).select("path", "doc_id")
    asked = S.table(spark, d, "events").select("event_id", "user_id").join(notes.select(F.col("doc_id").alias("user_id"), "path"), "user_id", "left")
    return vault.existing(asked.select("event_id", "path"), notes).select("event_id", "found")


@query(f"{S.sql('notes')} SELECT path || '#chunk-0' AS uri, length(content)::BIGINT AS n FROM notes UNION ALL SELECT 'none-' || doc_id, NULL FROM notes")
def text_by_uri(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    stored = notes.select(F.concat("path", F.lit("#chunk-0")).alias("uri"), "content")
    asked = stored.select("uri").union(notes.select(F.concat(F.lit("none-"), F.col("doc_id").cast("string"))))
    return mutation.contents(stored, asked, "uri").select("uri", F.length("content").cast("long").alias("n"))


@query("""WITH n AS (SELECT conv_id, turn, '---' || chr(10) || 'role: ' || role || chr(10) || '---' || chr(10) || '#t' || turn || ' [[c' || conv_id || '|x]] #t' || turn AS content FROM conversations)
SELECT conv_id || '/' || turn AS path, regexp_extract(content, 'role: ([^' || chr(10) || ']*)', 1) AS role, 't' || turn AS tags, 'c' || conv_id AS links FROM n""")
def note_metadata(spark: SparkSession, d: str) -> DataFrame:
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    content = F.concat(F.lit("---\nrole: "), "role", F.lit("\n---\n#t"), turn, F.lit(" [[c"), conv, F.lit("|x]] #t"), turn)
    notes = S.table(spark, d, "conversations").select(F.concat_ws("/", conv, turn).alias("path"), content.alias("content"))
    found = vault.metadata(notes)
    return found.select("path", F.col("frontmatter")["role"].alias("role"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'invalid' END AS error FROM documents")
def grep_invalid(spark: SparkSession, d: str) -> DataFrame:
    """The pattern is compiled before any plan is made, so a bad one is an error of the call."""
    bad = set()
    for pattern in ("(", "[a-z]+"):
        try:
            grep.compiled(pattern)
        except ValueError:
            bad.add(pattern)
    pattern = F.when(F.col("doc_id") % 2 == 0, "(").otherwise("[a-z]+")
    return S.table(spark, d, "documents").select("doc_id", F.when(pattern.isin(*bad), "invalid").alias("error"))


# --- index -----------------------------------------------------------------------------------------------------------


def measures(texts: list[str]) -> list[list[float]]:
    """In the place of an embedding model: lengths and counts. It refuses texts of certain lengths."""
    if any(len(t) % 97 == 0 for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("a"))] for t in texts]


INDEXED = f"{CHUNKS}, bad AS (SELECT DISTINCT path FROM chunked WHERE length(chunk) % 97 = 0)"


@query(f"{INDEXED} SELECT chunk_id, length::DOUBLE AS length, (length - length(replace(chunk, 'a', '')))::DOUBLE AS a FROM (SELECT path || '#chunk-' || chunk_index AS chunk_id, chunk, length(chunk) AS length FROM chunked WHERE path NOT IN (SELECT path FROM bad))")
def full_index(spark: SparkSession, d: str) -> DataFrame:
    kept = indexing.NoteIndex(spark, scratch.folder(spark), measures, 2)
    kept.reindex(S.notes(spark, d))
    return kept.store.read().select("chunk_id", F.col("vector")[0].alias("length"), F.col("vector")[1].alias("a"))


@query(f"{INDEXED} SELECT path, (path IN (SELECT path FROM chunked) AND path NOT IN (SELECT path FROM bad))::BIGINT AS indexed, (path IN (SELECT path FROM bad))::BIGINT AS errors FROM notes")
def incremental_counts(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    return indexing.outcomes(notes, indexing.index(notes, measures, 2))


CHANGED = "notes AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.md' AS path, text || CASE WHEN lang = 'de' THEN ' and more.' ELSE '' END AS content, lang AS tag FROM documents)"


@query(f"{CHUNKS.replace(S.SQL['notes'], CHANGED)} SELECT path || '#chunk-' || chunk_index AS chunk_id, sha256(chunk) AS hash FROM chunked")
def reindex_changed(spark: SparkSession, d: str) -> DataFrame:
    notes = S.notes(spark, d)
    kept = indexing.NoteIndex(spark, scratch.folder(spark), lengths, 1)
    kept.reindex(notes)
    kept.update(notes.where("tag = 'de'").withColumn("content", F.concat("content", F.lit(" and more."))))
    return kept.store.read().select("chunk_id", F.sha2("chunk", 256).alias("hash"))


def lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t))] for t in texts]


#: What is left when the French notes were removed and those in German grew; notes that the model refuses then keep the
#: rows of before.
LATER = S.SQL["notes"].replace("AS content", "|| CASE WHEN lang = 'de' THEN ' and more.' ELSE '' END AS content").replace("FROM documents", "FROM documents WHERE lang <> 'fr'")


@query(f"""WITH a AS ({INDEXED} SELECT path, path || '#chunk-' || chunk_index AS chunk_id, sha256(chunk) AS hash FROM chunked WHERE path NOT IN (SELECT path FROM bad)),
b AS ({INDEXED.replace(S.SQL['notes'], LATER)} SELECT path, path || '#chunk-' || chunk_index AS chunk_id, sha256(chunk) AS hash, path IN (SELECT path FROM bad) AS failed FROM chunked),
c AS (SELECT count(DISTINCT path) AS errors FROM b WHERE failed)
SELECT chunk_id, hash, (SELECT count(*) FROM documents WHERE lang <> 'fr') - errors AS indexed, errors FROM (
  SELECT chunk_id, hash FROM b WHERE NOT failed UNION ALL SELECT chunk_id, hash FROM a WHERE path IN (SELECT path FROM b WHERE failed)), c""")
def reindex_all(spark: SparkSession, d: str) -> DataFrame:
    kept, notes = indexing.NoteIndex(spark, scratch.folder(spark), measures, 2), S.notes(spark, d)
    kept.reindex(notes)
    later = notes.where("tag <> 'fr'").withColumn("content", F.concat("content", F.when(F.col("tag") == "de", " and more.").otherwise("")))
    counts = kept.reindex(later)
    return kept.store.read().select("chunk_id", F.sha2("chunk", 256).alias("hash"), F.lit(counts["indexed"]).cast("long").alias("indexed"), F.lit(counts["errors"]).cast("long").alias("errors"))


#: An index's steps from events: (index, seq, step, pending)
LOG = "log AS (SELECT user_id AS index, event_id AS seq, CASE event_type WHEN 'error' THEN 'pause' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ready' END WHEN 'view' THEN 'enqueue' ELSE 'resume' END AS step, event_id % 2 AS pending FROM events)"


def log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    step = F.when(kind == "error", "pause").when(kind == "click", F.when(F.col("event_id") % 3 == 0, "failed").otherwise("ready")).when(kind == "view", "enqueue").otherwise("resume")
    return S.table(spark, d, "events").select(F.col("user_id").alias("index"), F.col("event_id").alias("seq"), step.alias("step"), (F.col("event_id") % 2).alias("pending"))


@query(f"""WITH {LOG}, p AS (SELECT *, coalesce(last_value(CASE WHEN step IN ('pause', 'resume') THEN step END IGNORE NULLS) OVER (PARTITION BY index ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'pause', false) AS paused FROM log),
s AS (SELECT *, coalesce(last_value(CASE WHEN step = 'resume' AND paused AND pending > 0 THEN 'Ready' WHEN step IN ('pause', 'resume') OR paused THEN NULL WHEN step = 'failed' THEN 'Failed' ELSE 'Ready' END IGNORE NULLS) OVER (PARTITION BY index ORDER BY seq ROWS UNBOUNDED PRECEDING), 'Idle') AS settled FROM p)
SELECT index, seq, coalesce(last_value(CASE WHEN step = 'pause' THEN CASE WHEN NOT paused THEN 'Paused' END WHEN step = 'resume' THEN CASE WHEN paused AND pending > 0 THEN 'Queueing' WHEN paused THEN settled END
  WHEN step = 'enqueue' THEN CASE WHEN paused THEN 'Paused' ELSE 'Queueing' END WHEN step = 'ready' THEN 'Ready' ELSE 'Failed' END IGNORE NULLS) OVER (PARTITION BY index ORDER BY seq ROWS UNBOUNDED PRECEDING), 'Idle') AS state FROM s""")
def index_states(spark: SparkSession, d: str) -> DataFrame:
    return indexing.states(log(spark, d))


@query(f"""WITH {LOG}, q AS (SELECT index, seq, CASE WHEN step IN ('pause', 'resume') THEN step ELSE 'event' END AS kind, 'n-' || seq % 5 AS path, CASE step WHEN 'failed' THEN 'delete' ELSE 'upsert' END AS op FROM log),
w AS (SELECT *, CASE WHEN (SELECT max_by(b.kind, b.seq) FROM q b WHERE b.index = q.index AND b.kind <> 'event' AND b.seq < q.seq) = 'pause' THEN (SELECT min(a.seq) FROM q a WHERE a.index = q.index AND a.kind = 'resume' AND a.seq > q.seq) ELSE seq END AS due FROM q WHERE kind = 'event')
SELECT index, due, path, max_by(op, seq) AS op FROM w GROUP BY index, due, path""")
def queue_paused(spark: SparkSession, d: str) -> DataFrame:
    return indexing.held(queue_log(spark, d))


@query(f"SELECT * FROM ({ORACLE_SQL['queue_paused']}) WHERE due IS NOT NULL")
def queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream in several micro-batches; what waits for a resume at its end isn't given."""
    flows.rocks(spark)
    return E.drained(flows.queue_stream(flows.replayed(queue_log(spark, d), "seq")), spark).select("index", "due", "path", "op")


def queue_log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("step").isin("pause", "resume"), F.col("step")).otherwise("event")
    rows = log(spark, d).select("index", "seq", kind.alias("kind"), F.concat(F.lit("n-"), (F.col("seq") % 5).cast("string")).alias("path"), F.when(F.col("step") == "failed", "delete").otherwise("upsert").alias("op"))
    return rows


@query("SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN NULL ELSE 'INDEX_NOT_READY' END AS error FROM events")
def search_gate(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("event_type") == "view", "ready").otherwise("loading")
    index = F.when(F.col("user_id") % 2 == 0, "ready").otherwise("indexing")
    return S.table(spark, d, "events").select("event_id", indexing.search_error(model, index).alias("error"))


@query("SELECT doc_id, round((doc_id + 1) * 100 / (SELECT count(*) FROM documents))::BIGINT AS percent FROM documents")
def index_progress(spark: SparkSession, d: str) -> DataFrame:
    files = S.table(spark, d, "documents").select("doc_id", (F.col("doc_id") + 1).alias("ord"))
    return indexing.percent_done(files, files.count()).select("doc_id", "percent")


@query("""WITH e AS (SELECT ts, event_id AS seq, 'user-' || user_id || '.md' AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
SELECT path, seq, op FROM e WHERE op = 'delete' OR (following IS NULL OR following > ts + INTERVAL 1 HOUR) AND ts + INTERVAL 1 HOUR + INTERVAL 10 SECONDS < (SELECT max(ts) FROM events)""")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """The stateful stream over the events' file, run to its end; upserts not yet due at the last watermark still wait."""
    flows.rocks(spark)
    events = spark.readStream.schema(S.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    ops = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return E.drained(E.debounce_stream(ops, 3600), spark).select("path", "seq", "op")


# --- sessions --------------------------------------------------------------------------------------------------------

NEW = "new AS (SELECT conv_id AS session_id, 1000 + turn AS ts, 'user' AS role, 'more ' || turn AS content FROM conversations WHERE turn < 2 AND conv_id % 3 <> 0)"


def grown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    messages = S.messages(spark, d)
    stored = messages.where("session_id % 2 = 0").groupBy("session_id").agg(F.lit("t").alias("title"), F.lit(1).cast("long").alias("created_at"), F.max("ord").cast("long").alias("updated_at"))
    open_ = sessions.opened(stored, messages.where("session_id % 5 <> 0").select("session_id"), 7)
    new = messages.where("ord < 2 AND session_id % 3 <> 0").select("session_id", (F.col("ord") + 1000).cast("long").alias("ts"), F.lit("user").alias("role"), F.concat(F.lit("more "), F.col("ord").cast("string")).alias("content"))
    return sessions.append_messages(open_, messages, new)


@query(f"""{S.sql('messages')}, {NEW}, m AS (SELECT session_id, max(ord) AS last FROM messages GROUP BY session_id)
SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 't' ELSE '' END AS title, CASE WHEN session_id % 2 = 0 THEN 1 ELSE 7 END::BIGINT AS created_at,
  coalesce((SELECT max(ts) FROM new WHERE new.session_id = m.session_id), CASE WHEN session_id % 2 = 0 THEN last ELSE 7 END)::BIGINT AS updated_at FROM m WHERE session_id % 5 <> 0""")
def session_update(spark: SparkSession, d: str) -> DataFrame:
    return grown(spark, d)[0]


@query(f"""{S.sql('messages')}, {NEW}, m AS (SELECT session_id, max(ord) AS last FROM messages GROUP BY session_id)
SELECT session_id, ord::BIGINT AS ord, role, content FROM messages UNION ALL
SELECT session_id, (last + row_number() OVER (PARTITION BY session_id ORDER BY ts))::BIGINT, role, content FROM new JOIN m USING (session_id) WHERE session_id % 5 <> 0""")
def session_append(spark: SparkSession, d: str) -> DataFrame:
    return grown(spark, d)[1].select("session_id", F.col("ord").cast("long").alias("ord"), "role", "content")


PARTS = """SELECT session_id, 0 AS part, 0::BIGINT AS ord, 'system' AS role, 'You help.' AS content FROM (SELECT DISTINCT session_id FROM messages)
UNION ALL SELECT session_id, 1, 0, 'system', 'found for ' || session_id FROM (SELECT DISTINCT session_id FROM messages WHERE session_id % 2 = 0)
UNION ALL SELECT session_id, 2, ord, role, content FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) = 1"""


@query(f"{S.sql('messages')} {PARTS}")
def assemble_context(spark: SparkSession, d: str) -> DataFrame:
    messages = S.messages(spark, d).withColumn("ord", F.col("ord").cast("long"))
    ids = messages.select("session_id").distinct()
    system = ids.select("session_id", F.lit(0).cast("long").alias("ord"), F.lit("system").alias("role"), F.lit("You help.").alias("content"))
    blocks = ids.where("session_id % 2 = 0").select("session_id", F.lit(0).cast("long").alias("ord"), F.lit("system").alias("role"), F.concat(F.lit("found for "), F.col("session_id").cast("string")).alias("content"))
    return sessions.assemble(system, blocks, sessions.last_messages(messages, 1))


@query(f"""{S.sql('messages')}, j AS (SELECT *, CASE WHEN role = 'assistant' AND ord % 4 = 1 THEN to_json({{'role': role, 'content': nullif(content, ''), 'tool_calls': [{{'id': 'c' || ord, 'type': 'function', 'function': {{'name': 'grep', 'arguments': '{{}}'}}}}]}})
  ELSE to_json({{'role': role, 'content': content}}) END::VARCHAR AS one FROM messages)
SELECT session_id, sha256('{{"model":"m","messages":[' || string_agg(one, ',' ORDER BY ord) || '],"stream":true,"max_tokens":100}}') AS hash FROM j GROUP BY session_id""")
def request_body(spark: SparkSession, d: str) -> DataFrame:
    called = (F.col("role") == "assistant") & (F.col("ord") % 4 == 1)
    rows = S.messages(spark, d).withColumn("call_id", F.when(called, F.concat(F.lit("c"), F.col("ord").cast("string")))).withColumn("tool", F.when(called, "grep")).withColumn("args", F.lit(None).cast("string"))
    return sessions.request_body(rows, "m", {"max_tokens": 100}).select("session_id", F.sha2("body", 256).alias("hash"))


DELTAS = "d AS (SELECT user_id AS session_id, event_id AS ord, ['text', 'think', 'call', 'result', 'failed', 'call', 'result'][(event_id * 5 + user_id) % 7 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN 'grep' ELSE 'read' END AS name, 'x' || event_id AS text FROM events)"


@query(f"""WITH {DELTAS}, t AS (SELECT *, sum(CASE kind WHEN 'call' THEN 1 ELSE -1 END) OVER w AS s FROM d WHERE kind IN ('call', 'result', 'failed') WINDOW w AS (PARTITION BY session_id, name ORDER BY ord)),
l AS (SELECT *, least(0, min(s) OVER (PARTITION BY session_id, name ORDER BY ord)) AS low, least(0, min(s) OVER (PARTITION BY session_id, name ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low0 FROM t),
c AS (SELECT *, (SELECT min(r.ord) FROM l r WHERE r.session_id = l.session_id AND r.name = l.name AND r.kind <> 'call' AND r.ord > l.ord AND r.s < l.s) AS at FROM l WHERE kind = 'call'),
rows AS (SELECT session_id, ord, kind, NULL AS name, text, NULL AS status, NULL AS result FROM d WHERE kind IN ('text', 'think')
  UNION ALL SELECT c.session_id, c.ord, 'tool', c.name, c.text, CASE r.kind WHEN 'result' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'calling' END, r.text FROM c LEFT JOIN d r ON r.session_id = c.session_id AND r.ord = c.at
  UNION ALL SELECT session_id, ord, 'tool', name, NULL, 'done', text FROM l WHERE kind = 'result' AND s < low0),
n AS (SELECT *, CASE WHEN kind <> 'tool' AND lag(kind) OVER (PARTITION BY session_id ORDER BY ord) = kind THEN 0 ELSE 1 END AS b FROM rows), g AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY ord) AS segment FROM n)
SELECT session_id, segment::BIGINT AS segment, kind, max(name) AS name, string_agg(text, '' ORDER BY ord) AS text, max(status) AS status, max(result) AS result FROM g GROUP BY session_id, segment, kind""")
def fold_deltas(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("text", "think", "call", "result", "failed", "call", "result")))
    kind = F.get(kinds, ((F.col("event_id") * 5 + F.col("user_id")) % 7).cast("int"))
    name = F.when(F.col("event_id") % 3 == 0, "grep").otherwise("read")
    return sessions.fold_deltas(S.table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), kind.alias("kind"), name.alias("name"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("text")))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['创建或覆盖笔记 n.md', '追加内容到 n.md', '精确替换 n.md 中的文本', '将 n.md 移到回收站', 'grep → n.md'][doc_id % 5 + 1] ELSE ['写入笔记', '追加笔记', '编辑笔记', '删除笔记', 'grep'][doc_id % 5 + 1] END AS line FROM documents""")
def call_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 5
    tool = F.when(n == 0, "write_note").when(n == 1, "append_note").when(n == 2, "edit_note").when(n == 3, "delete_note").otherwise("grep")
    return S.table(spark, d, "documents").select("doc_id", sessions.summary(tool, F.when(F.col("doc_id") % 2 == 0, "n.md")).alias("line"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'runtime' WHEN event_type = 'error' THEN 'model' ELSE 'network' END AS type FROM events")
def chat_error(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("user_id") % 3 == 0, "CANCELLED").when(F.col("event_type") == "error", "INDEX_NOT_READY").otherwise("LLM_ERROR")
    return S.table(spark, d, "events").select("event_id", T.chat_error(code, F.lit("Failed to fetch")).alias("type"))


# --- values ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN user_id - 5 > 0 AND event_id > 0 THEN ceil((user_id - 5) * event_id / 750)::BIGINT ELSE 0 END AS tokens FROM events")
def image_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "events").select("event_id", T.image_tokens(F.col("user_id") - 5, F.col("event_id")).alias("tokens"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'type' WHEN event_id * 1000 > 5242880 THEN 'size' WHEN event_id % 7 > 4 THEN 'count' END AS error FROM events")
def attachment_check(spark: SparkSession, d: str) -> DataFrame:
    mime = F.when(F.col("event_type") == "error", "text/plain").otherwise("image/png")
    return S.table(spark, d, "events").select("event_id", T.attachment_error(mime, F.col("event_id") * 1000, F.col("event_id") % 7).alias("error"))


@query("""SELECT doc_id, replace(replace(text, '&quot;', '"'), '&#39;', '''') AS source FROM documents""")
def mermaid_sources(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<p>x</p><pre><code class="code language-mermaid" id="x">'), T.escape_html(F.col("text")), F.lit("</code></pre>"))
    return S.table(spark, d, "documents").select("doc_id", F.explode(T.mermaid_blocks(html)).alias("source"))


STATES = ("Idle", "Init", "Scanning", "Queueing", "Processing", "Ready", "Paused", "Failed", "Unloaded")


@query(f"""WITH {LOG}, s AS (SELECT index, seq, pending, {list(STATES)}[1 + (seq % 9)::INTEGER] AS state FROM log)
SELECT index, seq, CASE WHEN state = 'Unloaded' THEN 'idle' ELSE lower(state) END AS name, CASE state WHEN 'Scanning' THEN seq || '/' || index WHEN 'Queueing' THEN pending || ' 待索引' WHEN 'Paused' THEN pending || ' 待处理'
  WHEN 'Processing' THEN 'n-' || index WHEN 'Failed' THEN 'reason ' || seq END AS detail, CASE WHEN state = 'Ready' THEN index END AS docs FROM s""")
def status_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d).withColumn("state", F.get(F.array(*map(F.lit, STATES)), (F.col("seq") % 9).cast("int")))
    row = T.index_row(F.col("state"), F.col("seq"), F.col("index"), F.col("pending"), F.concat(F.lit("n-"), F.col("index").cast("string")), F.concat(F.lit("reason "), F.col("seq").cast("string")), F.col("index"))
    return rows.select("index", "seq", row.alias("row")).select("index", "seq", F.col("row.index").alias("name"), "row.detail", "row.docs")


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def accent_strip(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"raw":"{broken ' || event_id || '"}' ELSE '{"path":"n-' || event_id || '"}' END AS args, CASE WHEN event_id % 4 <> 0 THEN 'n-' || event_id END AS path FROM events""")
def tool_arguments(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    args = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{broken "), n)).otherwise(F.concat(F.lit('{"path":"n-'), n, F.lit('"}')))
    return S.table(spark, d, "events").select("event_id", T.parse_args(args).alias("args"), T.tool_path(args).alias("path"))


@query("SELECT event_id, round(CASE WHEN user_id % 4 > 0 THEN event_id / (user_id % 4) ELSE 0 END, 6)::DOUBLE AS speed, round(CASE WHEN user_id % 4 > 0 AND event_id > 0 THEN (1000000 - event_id) / (event_id / (user_id % 4)) ELSE 0 END, 6)::DOUBLE AS eta FROM events")
def transfer_eta(spark: SparkSession, d: str) -> DataFrame:
    found = S.table(spark, d, "events").select("event_id", T.transfer_eta(F.col("event_id"), F.lit(1000000), F.col("user_id") % 4).alias("t"))
    return found.select("event_id", F.round("t.speed", 6).alias("speed"), F.round("t.eta", 6).alias("eta"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'indexing' WHEN event_type = 'error' THEN 'error' WHEN user_id % 7 = 0 THEN 'unconfigured' WHEN event_type = 'view' THEN 'thinking' ELSE 'ready' END AS tone FROM events")
def status_tones(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return S.table(spark, d, "events").select("event_id", T.status_tone(F.col("event_id") % 5 == 0, kind == "error", F.col("user_id") % 7 != 0, kind == "view").alias("tone"))


@query("SELECT event_id, starts_with(lower(event_type), lower(left(event_type, 2))) AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS shown FROM events")
def slash_commands(spark: SparkSession, d: str) -> DataFrame:
    start = F.upper(F.substr("event_type", F.lit(1), F.lit(2)))
    typed = F.concat(F.when(F.col("event_id") % 3 == 0, "").otherwise("/"), start, F.when(F.col("event_id") % 5 == 0, " x").otherwise(""))
    return S.table(spark, d, "events").select("event_id", T.command_matches(typed, F.concat(F.lit("/"), "event_type")).alias("shown"))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'allow' END AS grep FROM events)
SELECT event_id, 'ask' AS write_note, coalesce(grep, 'ask') AS grep, true AS dropped FROM s""")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    defaults = F.create_map(F.lit("write_note"), F.lit("ask"), F.lit("grep"), F.lit("ask"))
    saved = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("grep"), F.lit("allow"), F.lit("oldKey"), F.lit("x")))
    merged = T.merge_settings(defaults, saved, ("oldKey",))
    rows = S.table(spark, d, "events").select("event_id", merged.alias("m"))
    return rows.select("event_id", F.col("m.write_note").alias("write_note"), F.col("m.grep").alias("grep"), F.col("m.oldKey").isNull().alias("dropped"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 5 ELSE greatest(1, least(50, user_id - 3)) END::BIGINT AS k FROM events")
def diagnostic_k(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 11 != 0, F.col("user_id") - 3)
    return S.table(spark, d, "events").select("event_id", T.diagnostic_k(asked).cast("long").alias("k"))


@query(r"SELECT doc_id, i - 1 AS id, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, ' ', chr(10)), chr(10)) AS w FROM documents)) WHERE w[i] <> ''")
def vocab_index(spark: SparkSession, d: str) -> DataFrame:
    lines = tokenizer.vocabulary_table(F.replace("text", F.lit(" "), F.lit("\n")))
    return S.table(spark, d, "documents").select("doc_id", F.explode(lines).alias("t")).select("doc_id", "t.id", "t.token")


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: x * x + vec_id % 3) AS b FROM embeddings),
m AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN list_transform(list_zip(a, b), lambda t: (t[1] + t[2]) / 2) ELSE a END AS v FROM p),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM m)
SELECT vec_id, round(v[1] / n, 6) AS first, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total FROM u""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    states = F.array(v, F.transform(v, lambda x: x * x + F.col("vec_id") % 3), F.transform(v, lambda x: x * 9))
    mask = F.array(F.lit(1), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0), F.lit(0))
    rows = S.table(spark, d, "embeddings").select("vec_id", vectors.mean_pool(states, mask).alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- word pieces, link suggestions and rules as tables -----------------------------------------------------------------

#: A vocabulary of the words' starts and of the runs of up to three letters that benchmark texts go on with.
VOCABULARY = """runs AS (SELECT DISTINCT w, unnest(range(1, 4)) AS n FROM (SELECT unnest(regexp_extract_all(strip_accents(text), '[A-Za-z0-9_]+')) AS w FROM benchmark)),
vocabulary AS (SELECT token, (row_number() OVER (ORDER BY encode(token)))::INTEGER AS id FROM (
  SELECT DISTINCT substr(w, 1, n) AS token FROM runs UNION SELECT DISTINCT '##' || substr(w, i, n) FROM (SELECT w, n, unnest(range(2, length(w) + 1)) AS i FROM runs)))"""


@query(f"""WITH RECURSIVE {VOCABULARY}, words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, regexp_extract_all(strip_accents(text), '[㐀-䶿一-龥]|[A-Za-z0-9_]+') AS ws FROM documents)),
cut(w, pos, ids) AS (SELECT DISTINCT w, 1, []::INTEGER[] FROM words UNION ALL
  SELECT w, coalesce(pos + least(n, length(w) - pos + 1), length(w) + 1)::INTEGER, list_append(ids, coalesce(id, 0)) FROM (
    SELECT c.w, c.pos, c.ids, v.id, CASE WHEN v.id IS NOT NULL THEN l.n END AS n FROM cut c, (SELECT unnest(range(1, 4)) AS n) l
    LEFT JOIN vocabulary v ON v.token = CASE WHEN c.pos > 1 THEN '##' ELSE '' END || substr(c.w, c.pos, l.n) AND length(substr(c.w, c.pos, l.n)) = l.n
    WHERE c.pos <= length(c.w) QUALIFY row_number() OVER (PARTITION BY c.w, c.pos ORDER BY v.id IS NULL, l.n DESC) = 1))
SELECT doc_id, sum(len(ids))::BIGINT AS n, sum(len(list_filter(ids, lambda x: x = 0)))::BIGINT AS unknown, sha256(string_agg(array_to_string(ids, ','), ',' ORDER BY place)) AS hash
FROM words JOIN (SELECT w, ids FROM cut WHERE pos > length(w)) USING (w) GROUP BY doc_id""")
def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    words = S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(T.strip_accents(F.col("text")), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("w")).distinct()
    starts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr("w", F.lit(1), n))).alias("token"))
    later = words.where("length(w) > 1").select("w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("i")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.concat(F.lit("##"), F.substr("w", F.col("i"), n)))).alias("token"))
    # a model's vocabulary: of bounded size, as no token has more than three characters
    tokens = sorted((r["token"] for r in starts.union(later).distinct().collect()), key=str.encode)
    vocabulary = {"[UNK]": 0} | {t: i for i, t in enumerate(tokens, 1)}
    found = tokenizer.tokenize(S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content")), vocabulary).where("size(ids) > 0")
    return found.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("unknown"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("hash"))


@query("""WITH s AS (SELECT a.vec_id AS path, b.vec_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS confidence FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND NOT (b.vec_id = a.vec_id + 1))
SELECT path, other, confidence, row_number() OVER (PARTITION BY path ORDER BY confidence DESC, other) AS rank FROM s WHERE confidence >= 0.3 QUALIFY rank <= 5""")
def suggest_links(spark: SparkSession, d: str) -> DataFrame:
    """Of each item up to five others, but for the next one, which it has a link to."""
    items = S.items(spark, d)
    return vault.suggest_links(items.select(F.col("id").alias("path"), "vector"), items.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), 5, 0.3)


@query(f"""{S.sql('notes')} SELECT path, CASE WHEN doc_id % 14 = 0 THEN false WHEN doc_id % 7 = 0 THEN true ELSE path LIKE 'src1/%' OR regexp_full_match(path, 'src2/[^/]*/doc-[^/]*5[.]md') END AS ignored FROM notes""")
def ignore_table(spark: SparkSession, d: str) -> DataFrame:
    """A rule for every seventh note, and for every fourteenth another one against it."""
    notes = S.notes(spark, d)
    lines = notes.where("doc_id % 7 = 0").select((F.col("doc_id") * 2 + 2).alias("ord"), F.concat(F.lit("/"), "path").alias("line"))
    back = notes.where("doc_id % 14 = 0").select((F.col("doc_id") * 2 + 3).alias("ord"), F.concat(F.lit("!doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("line"))
    wide = spark.createDataFrame([(0, "src1/"), (1, "src2/*/doc-*5.md")], "ord long, line string")
    return files.ignored_by(notes.select("path"), files.rule_table(wide.union(lines).union(back))).select("path", "ignored")
