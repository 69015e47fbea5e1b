"""Queries that run whole steps of the library: listing, replies, mining, topics, files and state.

Models answer by rule, so that SQL can say what comes out. The driver's
conversations are the sessions: an assistant message calls a tool, every third
session has a patch, and the message with index 5 fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import jsontext as J
from .functions import text as T
from .joins import shuffled
from .operators import sessions as S
from .operators import topics as P
from .plans.analysis import FieldClusters, ModelClusters, distil
from .plans.merging import model_merge
from .plans.mining import Models, block_summaries, intent_blocks, mine
from .providers import RuleProvider
from .queries import ORACLE_SQL, query
from .scratch import Scratch
from .sinks import files
from .sinks.report import Report
from .sinks.state import StateStore
from .sources.exports import SessionExports
from .sources.session_files import SessionFiles
from .sources.tables import conversation_messages, event_parts, read
from .storage import Store, WorkerStore


def _tables(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and parts made of the conversations."""
    c = conversation_messages(spark, sf)
    assistant = F.col("role") == "assistant"
    messages = c.select(
        "session_id", "msg_idx", "role", (F.col("msg_idx").cast("long") * 60000).alias("created_ms"), F.when(assistant, "stop").otherwise("").alias("finish"),
        F.when(F.col("msg_idx") == 5, F.lit('{"data": {"message": "m5"}}')).alias("error"), F.lit(1).cast("long").alias("tokens_total"))
    number = F.col("session_id").cast("long")
    part = lambda rows, idx, kind, said: rows.select(
        "session_id", "msg_idx", F.lit(idx).alias("part_idx"), F.lit(kind).alias("type"), said.alias("text"), F.lit("bash" if kind == "tool" else "").alias("tool"), F.lit('{"command": "ls"}').alias("input_json"),
        F.lit("ok").alias("output"), F.lit("abcdef123456").alias("hash"), F.array(F.lit("f.py")).alias("files"), F.lit("").alias("description"))
    empty = F.lit("")
    parts = part(c, 0, "text", F.col("text")).unionByName(part(c.where(assistant), 1, "tool", empty)).unionByName(part(c.where((number % 3 == 0) & (F.col("msg_idx") == 1)), 2, "patch", empty))
    sessions = c.groupBy("session_id").agg(F.max("msg_idx").cast("long").alias("timestamp")).select(
        "session_id", F.concat(F.lit("T"), "session_id").alias("title"), F.concat(F.lit("p"), (number % 4).cast("string")).alias("project"), "timestamp")
    return sessions, messages, parts


def _models(spark) -> Models:
    return Models(RuleProvider, RuleProvider, f"{Scratch(spark, 'replies').root}/cache", 4)


def _mined(spark, sf, models: Models) -> DataFrame:
    return mine(*_tables(spark, sf), models, 3, 1)


# --- listing and sources -------------------------------------------------------

def _session_listing(spark, sf):
    sessions, messages, _ = _tables(spark, sf)
    rows = sessions.select("session_id", "title", F.concat(F.lit("/w/"), "project", F.lit("/")).alias("directory"), F.col("timestamp").alias("updated_ms"))
    return P.aliased(S.listing(rows, messages, None, until_ms=6), [F.desc("timestamp"), F.col("session_id")])


@query("session_listing", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, 'p' || conv_id % 4 AS project, count(*) AS msg_count, CAST(max(turn) AS BIGINT) AS timestamp,
  row_number() OVER (ORDER BY max(turn) DESC, CAST(conv_id AS VARCHAR)) AS place
FROM conversations GROUP BY conv_id HAVING max(turn) <= 6
""")
def session_listing(spark, sf):
    return _session_listing(spark, sf).select("session_id", "project", "msg_count", "timestamp", (F.col("pos") + 1).alias("place"))


@query("noise_filtered_tools", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'error') GROUP BY 1")
def noise_filtered_tools(spark, sf):
    """Views and clicks are called by the names of noise tools."""
    tool = F.when(F.col("tool") == "view", "todowrite").when(F.col("tool") == "click", "profile_update").otherwise(F.col("tool"))
    e = event_parts(spark, sf).where("type = 'tool'").withColumns({"tool": tool, "output": F.lit("x"), "text": F.lit(""), "hash": F.lit(""), "files": F.array().cast("array<string>"), "description": F.lit("")})
    return S.compress_parts(e).groupBy("session_id").agg(F.count("*").alias("n"))


def _one_file_each(rows: DataFrame, name: str) -> str:
    """A folder of files, one for each row (session_id, value) under the session's id.

    Tasks put them where they stay, and a task that is run again writes the
    same: a job of Spark's writers would have the driver rename each of them.
    """
    spark = rows.sparkSession
    folder = Store(spark, Scratch(spark, name).path("files")).root

    def put(batches):
        store = WorkerStore(folder)
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.put(f"{key}.json", value.encode())
        yield from ()

    rows.select("session_id", "value").repartition(spark.sparkContext.defaultParallelism, "session_id").mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()
    return folder


def _session_file_rows(spark, sf) -> DataFrame:
    """Conversations as session files: an assistant's message calls a tool, the next message holds the result."""
    c = conversation_messages(spark, sf)
    call, number = F.col("msg_idx").cast("string"), F.col("session_id").cast("int")
    content = lambda kind, **fields: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in fields.items()])
    text = F.to_json(content("text", text=F.col("text")))
    calls = F.to_json(content("function_call", call_id=call, name=F.lit("bash"), arguments=F.lit('{"command": "ls"}')))
    result = F.to_json(content("function_result", call_id=(F.col("msg_idx") - 1).cast("string"), result=F.concat(F.lit("out "), F.length("text").cast("string"))))
    held = F.concat_ws(", ", text, F.when(F.col("role") == "assistant", calls), F.when(number % 2 == 0, result))
    message = F.concat(F.lit('{"role": "'), "role", F.lit('", "contents": ['), held, F.lit("]}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", message.alias("m")))), lambda x: x["m"]), ", ")
    rows = c.groupBy("session_id").agg(listed.alias("messages"))
    return rows.select("session_id", F.concat(
        F.lit('{"meta": {"session_id": "'), "session_id", F.lit('", "title": "T", "primary_cwd": "/w/p", "updated_at": "2024-01-02T00:00:00Z"}, "state": {"messages": ['), "messages", F.lit("]}}")).alias("value"))


@query("session_file_tools", """
SELECT CAST(c.conv_id AS VARCHAR) AS session_id, CAST(c.turn AS INT) AS msg_idx, CAST(c.turn AS VARCHAR) AS call_id, '{"command": "ls"}' AS input_json,
  CASE WHEN n.turn IS NULL OR c.conv_id % 2 = 1 THEN '' ELSE 'out ' || length(coalesce(n.text, '')) END AS output,
  CASE WHEN n.turn IS NULL OR c.conv_id % 2 = 1 THEN 'pending' ELSE 'completed' END AS status
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.role = 'assistant'
""")
def session_file_tools(spark, sf):
    source = SessionFiles(spark, _one_file_each(_session_file_rows(spark, sf), "session_files"), "*")
    return source.table("parts").where("type = 'tool'").select("session_id", "msg_idx", "call_id", "input_json", "output", "status")


@query("session_file_texts", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS msg_idx, coalesce(text, '') AS text FROM conversations")
def session_file_texts(spark, sf):
    source = SessionFiles(spark, _one_file_each(_session_file_rows(spark, sf), "session_files"), "*")
    return source.table("parts").where("type = 'text'").select("session_id", "msg_idx", "text")


@query("session_file_listing", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, 'T' AS title, 'p' AS project, count(*) AS msg_count, 1704153600000 AS timestamp, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS tool_count
FROM conversations GROUP BY 1
""")
def session_file_listing(spark, sf):
    """Three tables of one parse."""
    source = SessionFiles(spark, _one_file_each(_session_file_rows(spark, sf), "session_files"), "*")
    listed = S.listing(source.table("sessions"), source.table("messages"), source)
    return S.candidates(listed, source.table("parts"), 0, 0)


@query("iso_millis", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN 0 WHEN 1 THEN epoch_us(CAST(ts AS TIMESTAMP)) // 1000 ELSE epoch_ms(date_trunc('second', CAST(ts AS TIMESTAMP))) END AS ms FROM events
""")
def iso_millis(spark, sf):
    """Times in UTC, in another zone, without a zone, and what is no time."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ahead = F.concat(F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    given = F.when(kind == 0, F.concat(plain, F.lit("Z"))).when(kind == 1, ahead).when(kind == 2, plain).otherwise(F.concat(F.lit("no time "), F.col("event_id").cast("string")))
    return read(spark, sf, "events").select("event_id", T.iso_to_ms(given).alias("ms"))


@query("thought_lines", f"""
WITH r AS ({ORACLE_SQL["reasoning_conclusion"]}) SELECT CAST(doc_id AS VARCHAR) AS session_id, '[THOUGHT] ' || line AS line FROM r WHERE doc_id % 3 <> 0 AND line <> ''
""")
def thought_lines(spark, sf):
    """Documents as thoughts; those without a conclusion go."""
    empty = F.lit("")
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"), F.lit(0).alias("msg_idx"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("").alias("text"))
    parts = d.select(
        "*", F.lit(0).alias("part_idx"), F.lit("reasoning").alias("type"), *[empty.alias(x) for x in ("tool", "input_json", "output", "hash", "description")], F.array().cast("array<string>").alias("files"))
    messages = d.select("session_id", "msg_idx", F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("error"))
    return S.block_lines(messages, S.compress_parts(parts)).select("session_id", "line")


@query("exported_sessions", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n_messages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS stops
FROM conversations GROUP BY 1
""")
def exported_sessions(spark, sf):
    c = conversation_messages(spark, sf)
    message = F.to_json(F.struct(
        F.struct("role", F.when(F.col("role") == "assistant", "stop").otherwise("").alias("finish"), F.struct(F.col("msg_idx").alias("created")).alias("time")).alias("info"),
        F.array(F.struct(F.lit("text").alias("type"), "text")).alias("parts")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", message.alias("m")))), lambda x: x["m"]), ", ")
    rows = c.groupBy("session_id").agg(listed.alias("m")).select("session_id", F.concat(F.lit('{"info": {"id": "'), "session_id", F.lit('"}, "messages": ['), "m", F.lit("]}")).alias("value"))
    source = SessionExports(spark, _one_file_each(rows, "exports"), "*")
    m = source.table("messages").groupBy("session_id").agg(F.count("*").alias("n_messages"), F.count_if(F.col("finish") == "stop").alias("stops"))
    p = source.table("parts").groupBy("session_id").agg(F.sum(F.length("text")).alias("chars"))
    return m.join(shuffled(p), "session_id")


# --- replies ---------------------------------------------------------------------

@query("reply_json", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"id": ' || event_id || ', "kind": "' || event_type || '"}' WHEN 1 THEN '{"id": ' || event_id || ', "kind": "' || event_type || '"}'
  WHEN 2 THEN '{"items": [' || event_id || ', "' || event_type || '"]}' WHEN 3 THEN '{"id": ' || event_id || ', "list": [1]}' ELSE '{"raw_response": "none ' || event_id || '", "_parse_error": true}' END AS value
FROM events
""")
def reply_json(spark, sf):
    """Fenced, plain, listed, cut-off and missing JSON."""
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    whole = F.concat(F.lit('{"id": '), i, F.lit(', "kind": "'), kind, F.lit('"}'))
    reply = (
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("So:\n```json\n"), whole, F.lit("\n```\n"))).when(F.col("event_id") % 5 == 1, F.concat(F.lit("here "), whole, F.lit(" done")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("as ["), i, F.lit(', "'), kind, F.lit('"] says'))).when(F.col("event_id") % 5 == 3, F.concat(F.lit('{"id": '), i, F.lit(', "list": [1, {"cut": "of}')))
        .otherwise(F.concat(F.lit("none "), i)))
    return read(spark, sf, "events").select("event_id", J.extract_json(reply).alias("value"))


@query("python_repr", "SELECT event_id, '{''k'': ' || json_extract_string(props, '$.k') || ', ''t'': [True, None, ''' || event_type || ''']}' AS shown FROM events WHERE props IS NOT NULL")
def python_repr(spark, sf):
    e = read(spark, sf, "events").where("props is not null")
    value = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": [true, null, "'), "event_type", F.lit('"]}'))
    return e.select("event_id", J.pyrepr(value).alias("shown"))


@query("label_reasons", """
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN '' ELSE left(coalesce(d.text, ''), 80) || '；' || left(d.lang || ' ' || d.source, 80) END AS reason FROM documents d JOIN labels l USING (doc_id)
""")
def label_reasons(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("quality") == 1, "success").otherwise("failure")
    return d.select("doc_id", S.label_reason(label, F.array(F.coalesce("text", F.lit("")), F.lit("second")), F.array(F.concat("lang", F.lit(" "), "source"))).alias("reason"))


@query("duration_texts", """
SELECT event_id, CASE WHEN value < 60 THEN printf('%.1f', value) || ' 秒' ELSE CAST(floor(value / 60) AS BIGINT) || ' 分 ' || CAST(round_even(value % 60, 0) AS INT) || ' 秒' END AS duration
FROM (SELECT event_id, (event_id % 4000) / 8.0::DOUBLE AS value FROM events)
""")
def duration_texts(spark, sf):
    e = read(spark, sf, "events").select("event_id", ((F.col("event_id") % 4000) / F.lit(8.0)).alias("value"))
    return e.select("event_id", T.duration_text(F.col("value")).alias("duration"))


@query("markdown_html", r"""
SELECT doc_id, '<h4>' || lang || '</h4>' || chr(10) || '<li>a <strong>' || source || '</strong> b</li>' || chr(10) || '# ' || lang AS html FROM documents
""")
def markdown_html(spark, sf):
    source = F.concat(F.lit("## "), "lang", F.lit("\n- a **"), "source", F.lit("** b\n# "), "lang")
    return read(spark, sf, "documents").select("doc_id", T.markdown_to_html(T.html_escape(source)).alias("html"))


# --- mining and topics -----------------------------------------------------------

_SESSIONS = """
WITH s AS (
  SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS tools,
    conv_id % 3 = 0 AND bool_or(turn = 1) AS patch, bool_or(turn = 5) AS error, min(turn) FILTER (WHERE role = 'user') AS first, max(turn) FILTER (WHERE role = 'user') AS last
  FROM conversations GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE role = 'assistant') >= 1 AND count(*) FILTER (WHERE role = 'user') > 0
), b AS (
  SELECT conv_id, 1 AS block_id, 0 AS a, last AS z FROM s WHERE users <= 2
  UNION ALL
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn), turn, coalesce(lead(turn) OVER (PARTITION BY c.conv_id ORDER BY turn) - 1, turn + 1)
  FROM conversations c JOIN s ON c.conv_id = s.conv_id WHERE role = 'user' AND users > 2
), p AS (
  SELECT s.*, EXISTS (SELECT 1 FROM b WHERE b.conv_id = s.conv_id AND 5 BETWEEN a AND z) AND error AS problem FROM s
), w AS (
  SELECT *, CASE WHEN problem THEN 'debugging' ELSE 'feature_development' END AS session_type,
    0::DOUBLE + (CASE WHEN patch THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN NOT patch AND tools >= 5 THEN 0.8::DOUBLE ELSE 0 END) + 0.7::DOUBLE
    + (CASE WHEN error AND NOT patch THEN -0.3::DOUBLE WHEN error THEN -0.8::DOUBLE ELSE 0 END) + (CASE WHEN problem THEN -0.3::DOUBLE ELSE 0.5::DOUBLE END)
    + (CASE WHEN problem THEN 0.3::DOUBLE ELSE 0 END) + 0::DOUBLE AS label_score
  FROM p
), t AS (
  SELECT 'p' || conv_id % 4 || '-' || replace(session_type, '_', '-') AS topic_id, 'p' || conv_id % 4 || ' ' || session_type AS topic_name, * FROM w
)
"""


@query("intent_blocks", _SESSIONS + "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(block_id AS INT) AS block_id, CAST(a AS INT) AS start, CAST(z AS INT) AS stop FROM b")
def _intent_blocks(spark, sf):
    return _blocks(spark, sf, _models(spark))[0].select("session_id", "block_id", "start", F.col("end").alias("stop"))


def _blocks(spark, sf, models: Models) -> tuple[DataFrame, DataFrame]:
    sessions, messages, parts = _tables(spark, sf)
    cleaned = S.processable(S.rollup(messages, parts).join(shuffled(sessions), "session_id"), 3, 1)
    kept = messages.join(shuffled(cleaned.select("session_id")), "session_id", "left_semi")
    blocks = intent_blocks(S.anchor_texts(S.user_anchors(S.message_texts(kept, parts))), models)
    return blocks, S.block_texts(blocks, S.block_lines(kept, S.compress_parts(parts)), cleaned)


@query("block_contents", _SESSIONS + """
, lines AS (
  SELECT conv_id, turn, 0 AS k, CASE role WHEN 'user' THEN '[USER] ' ELSE '[ASSISTANT] ' END || coalesce(text, '') AS line FROM conversations
  UNION ALL SELECT conv_id, turn, 2, '[TOOL] $ ls  [OK]' || chr(10) || 'ok' FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 3, '[PATCH] abcdef12 [''f.py'']' FROM conversations WHERE conv_id % 3 = 0 AND turn = 1
  UNION ALL SELECT conv_id, turn, 4, '[ERROR] m5' FROM conversations WHERE turn = 5
)
SELECT CAST(b.conv_id AS VARCHAR) AS session_id, CAST(block_id AS INT) AS block_id, coalesce(string_agg(line, chr(10) ORDER BY turn, k), '') AS content
FROM b LEFT JOIN lines l ON l.conv_id = b.conv_id AND l.turn BETWEEN a AND z GROUP BY 1, 2
""")
def block_contents(spark, sf):
    return _blocks(spark, sf, _models(spark))[1].select("session_id", "block_id", "content")


@query("block_notes", _SESSIONS + """
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(block_id AS INT) AS block_id, CAST(a AS VARCHAR) AS start, CAST(z AS VARCHAR) AS stop,
  CASE WHEN EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = b.conv_id AND turn = 5 AND 5 BETWEEN a AND z) THEN 'failure' ELSE 'success' END AS outcome FROM b
""")
def block_notes(spark, sf):
    models = _models(spark)
    notes = block_summaries(_blocks(spark, sf, models)[1], models)
    at = lambda path: F.get_json_object("summary", path)
    return notes.select("session_id", "block_id", at("$.message_range[0]").alias("start"), at("$.message_range[1]").alias("stop"), at("$.outcome").alias("outcome"))


@query("mined_sessions", _SESSIONS + """
SELECT CAST(conv_id AS VARCHAR) AS session_id, session_type, CAST(problem AS INT) AS problems, label_score,
  CASE WHEN label_score >= 0.7::DOUBLE THEN 'success' WHEN label_score >= 0.2::DOUBLE THEN 'partial' ELSE 'failure' END AS label, 'ok' AS status FROM t
""")
def mined_sessions(spark, sf):
    return _mined(spark, sf, _models(spark)).select("session_id", "session_type", F.size("problems_encountered").alias("problems"), "label_score", "label", "status")


def _topics(spark, sf, models: Models, strategy) -> tuple[DataFrame, DataFrame]:
    mined = Scratch(spark, "mined").save(P.aliased(_mined(spark, sf, models), [F.desc("timestamp"), F.col("session_id")]), "mined")
    return mined, strategy.cluster(mined, spark.createDataFrame([], "topic_id string, summary string"), [])[0]


_TOPICS = _SESSIONS + "SELECT topic_id, min(topic_name) AS topic_name, CAST(count(*) AS INT) AS sessions, 'p' || min(conv_id % 4) AS primary_project FROM t GROUP BY 1"


@query("model_clusters", _TOPICS)
def model_clusters(spark, sf):
    models = _models(spark)
    return _topics(spark, sf, models, ModelClusters(models))[1].select("topic_id", "topic_name", F.size("session_ids").alias("sessions"), "primary_project")


@query("joined_topics", _TOPICS)
def joined_topics(spark, sf):
    """Prompts of ten sessions each, whose topics are joined by prompts over topics."""
    models = _models(spark)
    return _topics(spark, sf, models, ModelClusters(models, most_chars=5000))[1].select("topic_id", "topic_name", F.size("session_ids").alias("sessions"), "primary_project")


@query("trajectory_texts", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, '### Session: ' || conv_id || chr(10) || 'Type: config | Label: partial' || chr(10) || 'Intent: ' || count(*) || ' messages' || chr(10)
  || 'Phases:' || chr(10) || string_agg('  - ' || role || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn)
  || coalesce('Problems:' || chr(10) || string_agg('  - ' || coalesce(text, '') || ' -> ' || turn || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'user'), '')
  || coalesce('Decisions:' || chr(10) || string_agg('  - ' || turn || ' (reason: ' || coalesce(text, '') || ')' || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')
  || 'Lessons: ' || string_agg(CAST(turn AS VARCHAR), '; ' ORDER BY turn) || chr(10)
  || coalesce('Discoveries:' || chr(10) || string_agg('  - ' || role || chr(10), '' ORDER BY turn) FILTER (WHERE turn % 2 = 1), '') AS content
FROM conversations GROUP BY conv_id
""")
def trajectory_texts(spark, sf):
    """Messages as phases, questions as problems, answers as decisions."""
    all_of = F.array_sort(F.collect_list(F.struct("msg_idx", "role", "text")))
    c = conversation_messages(spark, sf).groupBy("session_id").agg(all_of.alias("m"))
    said = lambda role: F.filter("m", lambda x: x["role"] == role)
    number = lambda x: x["msg_idx"].cast("string")
    t = c.select(
        "session_id", F.lit("config").alias("session_type"), F.lit("partial").alias("label"), F.concat(F.size("m").cast("string"), F.lit(" messages")).alias("intent"),
        F.transform("m", lambda x: F.struct(x["role"].alias("phase"), x["text"].alias("summary"))).alias("what_happened"),
        F.transform(said("user"), lambda x: F.struct(x["text"].alias("problem"), number(x).alias("how_resolved"))).alias("problems_encountered"),
        F.transform(said("assistant"), lambda x: F.struct(number(x).alias("decision"), x["text"].alias("rationale"))).alias("key_decisions"),
        F.transform("m", number).alias("lessons_learned"), F.transform(F.filter("m", lambda x: x["msg_idx"] % 2 == 1), lambda x: x["role"]).alias("discoveries"))
    return t.select("session_id", P.trajectory_text().alias("content"))


@query("field_clusters", _TOPICS)
def field_clusters(spark, sf):
    return _topics(spark, sf, _models(spark), FieldClusters())[1].select("topic_id", "topic_name", F.size("session_ids").alias("sessions"), "primary_project")


@query("distilled_topics", _SESSIONS + """
SELECT topic_id, min(topic_name) AS skill_title, CAST(max(CAST(problem AS INT)) AS INT) AS rules, CAST(count(*) AS INT) AS sessions FROM t GROUP BY 1
""")
def distilled_topics(spark, sf):
    models = _models(spark)
    mined, clusters = _topics(spark, sf, models, ModelClusters(models))
    return distil(mined, clusters, models).where("error is null").select("topic_id", "skill_title", F.size("rules").alias("rules"), F.size("source_sessions").alias("sessions"))


@query("run_labels", _SESSIONS + """
SELECT CASE WHEN label_score >= 0.7::DOUBLE THEN 'success' WHEN label_score >= 0.2::DOUBLE THEN 'partial' ELSE 'failure' END AS label, count(*) AS n FROM t GROUP BY 1
""")
def run_labels(spark, sf):
    report = Report("all", "2024-01-01")
    report.sessions(P.aliased(_mined(spark, sf, _models(spark)), [F.col("session_id")]))
    return spark.createDataFrame(list(report.labels.items()), "label string, n long")


@query("run_usage", _SESSIONS + """
SELECT 'extract' AS task, count(*) AS calls FROM (SELECT DISTINCT conv_id, block_id FROM b) UNION ALL SELECT 'segment', count(*) FROM s WHERE users > 2 UNION ALL SELECT 'aggregate', count(*) FROM s
""")
def run_usage(spark, sf):
    """Each session's texts differ, so no two prompts are equal."""
    models, report = _models(spark), Report("all", "2024-01-01")
    _mined(spark, sf, models)
    report.used(models.used)
    return spark.createDataFrame([(r["task"], r["calls"]) for r in report.usage], "task string, calls long")


# The templates of written files, within the SQL too.
# --- files and state ---------------------------------------------------------------

def _skills(spark, sf) -> DataFrame:
    """A skill for each source of documents, with two rules."""
    rule = lambda kind, action, confidence, scope, when: F.struct(
        F.lit("r").alias("id"), F.lit(kind).alias("type"), F.lit(when).alias("condition"), action.alias("action"), F.array().cast("array<string>").alias("evidence_from_success"),
        F.array(F.lit("e1")).alias("evidence_from_failure"), F.lit(confidence).alias("confidence"), F.lit(scope).alias("scope"))
    d = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("lang").alias("lang"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("source_sessions"))
    return d.select(
        F.col("source").alias("topic_id"), F.upper("source").alias("skill_title"), F.concat(F.lit("about "), "lang").alias("description"), F.lit("checklist").alias("skill_type"), F.concat(F.lit("sum "), "lang").alias("summary"),
        F.array(rule("must_do", F.concat(F.lit("keep "), "lang"), 0.125, "general", ""), rule("avoid", F.lit("loss"), 2.0, "project", "late")).alias("rules"), F.lit("body").alias("body"), "source_sessions")


_BY_SOURCE = "WITH k AS (SELECT source, min(lang) AS lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)"


@query("skill_index", _BY_SOURCE + """
SELECT '# all — 技能索引' || chr(10) || chr(10) || '共 ' || count(*) || ' 个技能主题 | 更新时间: 2024-01-01' || chr(10) || chr(10)
  || string_agg('## [' || upper(source) || '](' || source || '/SKILL.md)' || chr(10) || chr(10) || 'about ' || lang || chr(10) || chr(10) || '- 类型: checklist' || chr(10) || '- 规则数: 2' || chr(10) || '- 来源会话: ' || n || ' 个' || chr(10), chr(10) ORDER BY source)
  || chr(10) || '---' || chr(10) || '由 sessionloom 自动生成' AS content FROM k
""")
def skill_index(spark, sf):
    folder = Scratch(spark, "index").root
    files.write_index(_skills(spark, sf), folder, "all", "2024-01-01")
    # Spark's readers pass over files whose names begin so.
    return spark.createDataFrame([(Store(spark, folder).read("all/_index.md"),)], "content string")


@query("knowledge_file", _BY_SOURCE + """
SELECT '# Knowledge — all' || chr(10) || chr(10) || '> 2024-01-01 | ' || count(*) || ' topics | ' || 2 * count(*) || ' points | ' || CAST(sum(n) AS BIGINT) || ' sessions' || chr(10) || chr(10)
  || string_agg(place || '. **' || upper(source) || '** (2 points)', chr(10) ORDER BY source) || chr(10) || chr(10)
  || string_agg('---' || chr(10) || chr(10) || '## ' || upper(source) || chr(10) || chr(10) || 'sum ' || lang || chr(10) || chr(10) || '- **[must_do]** keep ' || lang || ' — 12% ✗ e1' || chr(10)
     || '- **[avoid]** loss — 100% | project (when: late) ✗ e1' || chr(10) || chr(10) || 'body' || chr(10), chr(10) ORDER BY source) || chr(10) || '---' AS content
FROM (SELECT *, row_number() OVER (ORDER BY source) AS place FROM k)
""")
def knowledge_file(spark, sf):
    path = files.write_knowledge(_skills(spark, sf), Scratch(spark, "knowledge").root, "all", "2024-01-01")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


@query("written_skills", "SELECT source AS topic_id, 'about ' || min(lang) AS summary FROM documents GROUP BY 1")
def written_skills(spark, sf):
    """Skill files are written, found again, and give their descriptions."""
    folder = Scratch(spark, "skills").root
    files.write_skills(_skills(spark, sf), folder, "all")
    return files.existing_topics(spark, folder, "all")


@query("merged_skills", """
SELECT source || '-' || lang AS topic_id, source || chr(10) || lang || chr(10) || count(*) || ' documents' AS merged_body, CAST(NULL AS VARCHAR) AS merged_description FROM documents GROUP BY source, lang
""")
def merged_skills(spark, sf):
    """What is written of a topic names its source and language, what is new its language and size."""
    lines = lambda *cols: F.concat_ws("\n", *cols)
    d = read(spark, sf, "documents").groupBy("source", "lang").agg(F.concat(F.count("*").cast("string"), F.lit(" documents")).alias("n"))
    both = d.select(F.concat_ws("-", "source", "lang").alias("topic_id"), lines("source", "lang").alias("current_body"), lines("lang", "n").alias("new_body"))
    return model_merge(both, _models(spark)).select("topic_id", "merged_body", "merged_description")


@query("written_trajectories", _SESSIONS + """
SELECT CAST(conv_id AS VARCHAR) AS session_id, session_type, CAST(problem AS INT) AS problems, label_score, '2024-01-01' AS day, CASE WHEN problem THEN 'second' ELSE 'first' END AS run FROM t
""")
def written_trajectories(spark, sf):
    """Two runs of a day, the second of sessions with problems only: the last one of each session is found."""
    mined = Scratch(spark, "mined").save(_mined(spark, sf, _models(spark)), "mined")
    folder = Scratch(spark, "trajectories").root
    files.write_trajectories(mined, folder, "all", "2024-01-01", "first")
    files.write_trajectories(mined.where("size(problems_encountered) > 0"), folder, "all", "2024-01-01", "second")
    return files.read_trajectories(spark, folder).select("session_id", "session_type", F.size("problems_encountered").alias("problems"), "label_score", "day", "run")


@query("processed_union", "SELECT CAST(conv_id AS VARCHAR) AS session_id FROM conversations UNION SELECT CAST(user_id AS VARCHAR) FROM events")
def processed_union(spark, sf):
    """Two runs' sessions in the state's table."""
    state = StateStore(spark, Scratch(spark, "state").root)
    for rows in (conversation_messages(spark, sf), event_parts(spark, sf)):
        state.save(rows.select("session_id"), 1, 1)
    return state.processed()

