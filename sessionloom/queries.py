"""Queries over the driver's tables, one or more for each operator, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import sessions as S
from .operators import topics as P
from .sources.sqlite import SqliteSource
from .sources.tables import conversation_messages, event_parts, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- listing, filters, rollups ---------------------------------------------

_TRIAGE = """
WITH m AS (SELECT conv_id, count(*) AS msg_count FROM conversations GROUP BY 1),
     t AS (SELECT user_id, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS tool_count FROM events GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS session_id, msg_count, coalesce(tool_count, 0) AS tool_count
FROM m LEFT JOIN t ON conv_id = user_id WHERE msg_count >= 5 AND coalesce(tool_count, 0) >= 3
"""


@query("session_triage", _TRIAGE)
def session_triage(spark, sf):
    m = conversation_messages(spark, sf).groupBy("session_id").agg(F.count("*").alias("msg_count"))
    return S.candidates(m, event_parts(spark, sf)).select("session_id", "msg_count", "tool_count")


def _messages(spark, sf) -> DataFrame:
    c = conversation_messages(spark, sf)
    return c.withColumns({"texts": F.array("text"), "created_ms": F.col("msg_idx").cast("long") * 60000, "finish": F.when(F.col("role") == "assistant", "stop").otherwise(""),
                          "error": F.when(F.contains("text", F.lit("error")), F.lit("{}")), "tokens_total": T.estimate_tokens(F.col("text"))})


@query("session_rollup", """
WITH m AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS message_count, count(*) FILTER (WHERE role = 'user') AS n_user,
    bool_or(contains(text, 'error')) AS has_errors,
    CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'stop' ELSE '' END AS last_finish,
    CAST(coalesce(sum(CASE WHEN text = '' THEN 0 ELSE floor(length(text) / 4.0::DOUBLE) + 1 END) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS total_tokens
  FROM conversations GROUP BY 1
), p AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS tool_count, bool_or(event_type = 'purchase') AS has_patches
  FROM events GROUP BY 1
)
SELECT session_id, message_count, n_user, has_errors, last_finish, total_tokens, coalesce(tool_count, 0) AS tool_count, coalesce(has_patches, false) AS has_patches
FROM m LEFT JOIN p USING (session_id)
""")
def session_rollup(spark, sf):
    return S.rollup(_messages(spark, sf), event_parts(spark, sf))


@query("session_labels", """
WITH s AS (
  SELECT user_id, bool_or(event_type = 'purchase') AS patch, bool_or(event_type = 'error') AS error,
    count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS tools,
    arg_max(event_type, row(ts, event_id)) = 'view' AS stopped, count(*) FILTER (WHERE event_type = 'signup') % 3 AS lessons
  FROM events GROUP BY 1
), q AS (
  SELECT s.*, CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' ELSE '' END AS outcome FROM s LEFT JOIN labels ON doc_id = user_id
), w AS (
  SELECT user_id, 0::DOUBLE + (CASE WHEN patch THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN NOT patch AND tools >= 5 THEN 0.8::DOUBLE ELSE 0 END)
    + (CASE WHEN stopped THEN 0.7::DOUBLE ELSE 0 END) + (CASE WHEN error AND NOT patch THEN -0.3::DOUBLE WHEN error THEN -0.8::DOUBLE ELSE 0 END)
    + (CASE outcome WHEN 'success' THEN 0.5::DOUBLE WHEN 'failure' THEN -0.3::DOUBLE ELSE 0 END)
    + (CASE WHEN lessons > 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN patch AND lessons = 2 THEN 0.4::DOUBLE ELSE 0 END) AS label_score
  FROM q
)
SELECT CAST(user_id AS VARCHAR) AS session_id, label_score,
  CASE WHEN label_score >= 0.7::DOUBLE THEN 'success' WHEN label_score >= 0.2::DOUBLE THEN 'partial' ELSE 'failure' END AS label
FROM w
""")
def session_labels(spark, sf):
    """Quality labels stand in for outcomes, signups for lessons."""
    e = event_parts(spark, sf)
    s = e.groupBy("session_id").agg(
        F.bool_or(F.col("type") == "patch").alias("patch"), F.bool_or(F.col("type") == "error").alias("error"), F.count_if(F.col("type") == "tool").alias("tools"),
        F.max_by("tool", F.struct("ts", "event_id")).alias("last"), (F.count_if(F.col("tool") == "signup") % 3).alias("lessons"))
    outcome = read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("session_id"), F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure").otherwise("").alias("outcome"))
    q = s.join(outcome, "session_id", "left")
    score = S.label_score(F.col("patch"), F.col("error"), F.col("tools"), F.when(F.col("last") == "view", "stop").otherwise(""), F.coalesce("outcome", F.lit("")), F.col("lessons"), F.when(F.col("patch") & (F.col("lessons") == 2), 1).otherwise(0))
    return q.select("session_id", score.alias("label_score")).withColumn("label", S.label_of(F.col("label_score")))


@query("tool_histogram", "SELECT event_type AS tool, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1")
def tool_histogram(spark, sf):
    return event_parts(spark, sf).groupBy("tool").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("project_substring", "SELECT doc_id, source FROM documents WHERE contains(lower(source), lower('SRC1'))")
def project_substring(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("directory"))
    return SqliteSource.project_filter(None, d, "SRC1").select("doc_id", F.col("directory").alias("source"))


def _since(spark, sf, strict):
    """Listed with a source of either kind of bound."""
    e = event_parts(spark, sf)
    s = e.groupBy("session_id").agg(F.max("ts_ms").alias("updated_ms")).select("session_id", F.lit("").alias("title"), F.lit("").alias("directory"), "updated_ms")
    listed = S.listing(s, e, SimpleNamespace(strict_since=strict), since_ms=1706616000000)
    return listed.select("session_id", F.col("timestamp").alias("updated_ms"))


_SINCE = "SELECT CAST(user_id AS VARCHAR) AS session_id, max(epoch_us(ts)) // 1000 AS updated_ms FROM events GROUP BY 1 HAVING max(epoch_us(ts)) // 1000 {} epoch_ms(TIMESTAMP '2024-01-30 12:00:00')"


QUERIES["sessions_since_strict"] = lambda spark, sf: _since(spark, sf, True)
ORACLE_SQL["sessions_since_strict"] = _SINCE.format(">")
QUERIES["sessions_since_inclusive"] = lambda spark, sf: _since(spark, sf, False)
ORACLE_SQL["sessions_since_inclusive"] = _SINCE.format(">=")


@query("project_names", r"""
SELECT page_id, CASE WHEN url = '' THEN 'unknown' ELSE string_split(regexp_replace(replace(url, '\', '/'), '/+$', ''), '/')[-1] END AS project FROM pages
""")
def project_names(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.project_name(F.col("url")).alias("project"))


@query("json_path_input", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_input(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# --- anchors and blocks ------------------------------------------------------

@query("user_anchors", """
SELECT session_id, msg_idx, text, prev_assistant FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INT) AS msg_idx, role, left(text, 500) AS text,
    coalesce(last_value(CASE WHEN role = 'assistant' THEN left(text, 200) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev_assistant
  FROM conversations) WHERE role = 'user'
""")
def user_anchors(spark, sf):
    return S.user_anchors(_messages(spark, sf)).select("session_id", "msg_idx", "text", "prev_assistant")


@query("anchor_lines", """
WITH a AS (
  SELECT conv_id, turn, role, left(text, 500) AS text,
    coalesce(last_value(CASE WHEN role = 'assistant' THEN left(text, 200) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev
  FROM conversations
)
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg('#' || turn || ' [' || CASE WHEN turn = 0 THEN '' ELSE strftime(make_timestamp(turn * 60000000), '%H:%M') END || '] ' || text
  || CASE WHEN prev <> '' THEN '  (after: ' || prev || ')' ELSE '' END, chr(10) ORDER BY turn) AS anchors, count(*) AS n_anchors
FROM a WHERE role = 'user' GROUP BY 1
""")
def anchor_lines(spark, sf):
    return S.anchor_texts(S.user_anchors(_messages(spark, sf))).select("session_id", "anchors", "n_anchors")


def _blocks(spark, sf) -> DataFrame:
    """A block from each user turn to two turns on."""
    u = conversation_messages(spark, sf).where("role = 'user'")
    return u.select("session_id", F.col("msg_idx").alias("block_id"), F.col("msg_idx").alias("start"), (F.col("msg_idx") + 2).alias("end"), F.lit("").alias("intent"))


@query("block_range_join", """
SELECT CAST(b.conv_id AS VARCHAR) AS session_id, CAST(b.turn AS INT) AS block_id, count(*) AS n, CAST(sum(length(c.text)) AS BIGINT) AS chars
FROM conversations b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn BETWEEN b.turn AND b.turn + 2 WHERE b.role = 'user' GROUP BY 1, 2
""")
def block_range_join(spark, sf):
    b, c = _blocks(spark, sf), conversation_messages(spark, sf)
    inside = b.join(c, "session_id").where("msg_idx between start and end")
    return inside.groupBy("session_id", "block_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("block_texts", """
SELECT CAST(b.conv_id AS VARCHAR) AS session_id, CAST(b.turn AS INT) AS block_id,
  string_agg(CASE WHEN c.role = 'user' THEN '[USER] ' ELSE '[ASSISTANT] ' END || c.text, chr(10) ORDER BY c.turn) AS content
FROM conversations b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn BETWEEN b.turn AND b.turn + 2 WHERE b.role = 'user' GROUP BY 1, 2
""")
def block_texts(spark, sf):
    m = _messages(spark, sf).withColumn("error", F.lit(None).cast("string"))
    parts = m.select("session_id", "msg_idx", F.lit(0).alias("part_idx"), F.lit("text").alias("type"), F.col("text").alias("line"))
    counts = m.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return S.block_texts(_blocks(spark, sf), S.block_lines(m, parts), counts).select("session_id", "block_id", "content")


# --- text functions ----------------------------------------------------------

def documents(name: str, sql: str, **columns) -> None:
    """A query that computes columns of every document."""
    QUERIES[name] = lambda spark, sf: read(spark, sf, "documents").select("doc_id", *[f().alias(k) for k, f in columns.items()])
    ORACLE_SQL[name] = sql


_CJK = "length(text) - length(regexp_replace(text, '[一-鿿㐀-䶿豈-﫿]', '', 'g'))"
_TOKENS = f"CASE WHEN text = '' THEN 0 ELSE CAST(floor((length(text) - ({_CJK})) / 4.0::DOUBLE + ({_CJK}) / 1.5::DOUBLE) + 1 AS BIGINT) END"
text = lambda: F.col("text")
tag = lambda: F.col("source")

documents("token_estimate", f"SELECT doc_id, {_TOKENS} AS tokens FROM documents", tokens=lambda: T.estimate_tokens(text()))
documents("token_truncate", f"""
SELECT doc_id, CASE WHEN {_TOKENS} > 500 AND length(text) > 750 THEN left(text, 750) || chr(10) || '...[truncated to fit token budget]' ELSE text END AS cut FROM documents
""", cut=lambda: T.truncate_to_budget(text(), 500))

_L = "WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, "
_ERR = "CASE WHEN regexp_matches(left(lower(text), 500), 'error|failed|not found|denied|fatal') THEN 'ERR' ELSE 'OK' END"
documents("compress_bash", _L + f"""
CASE WHEN text = '' THEN '$ ' || source ELSE '$ ' || left(source, 200) || '  [' || {_ERR} || ']' || chr(10) || left(CASE WHEN len(l) <= 6 THEN left(text, 300)
  ELSE array_to_string(l[1:3], chr(10)) || chr(10) || '  ... (' || (len(l) - 5) || ' more lines) ...' || chr(10) || array_to_string(l[-2:], chr(10)) END, 300) END AS line FROM d
""", line=lambda: T.compress_bash(tag(), text()))
documents("compress_read", _L + """
'Read(' || source || ') → ' || CASE WHEN text = '' THEN 'empty/no file' ELSE len(list_filter(l, lambda x: trim(x) <> '')) || ' lines. Starts with: '
  || coalesce(left(list_filter(list_transform(l[1:5], lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '<'))[1], 80), '') END AS line FROM d
""", line=lambda: T.compress_read(tag(), text()))
documents("compress_write", _L + """
'Write(' || source || ', ' || len(l) || ' lines)' || chr(10) || CASE WHEN len(l) <= 5 THEN left(text, 150)
  ELSE array_to_string(l[1:2], chr(10)) || chr(10) || '  ... (' || (len(l) - 4) || ' lines omitted) ...' || chr(10) || array_to_string(l[-2:], chr(10)) END AS line FROM d
""", line=lambda: T.compress_write(tag(), text()))
documents("compress_edit", r"""
WITH d AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS o, regexp_replace(lang, '^\s+|\s+$', '', 'g') AS n FROM documents)
SELECT doc_id, 'Edit(' || source || ') -' || len(string_split(o, chr(10))) || '/+' || len(string_split(n, chr(10))) || ' lines' || chr(10) || '  - '
  || CASE WHEN o = '' THEN '(empty)' ELSE left(string_split(o, chr(10))[1], 60) END || chr(10) || '  + ' || CASE WHEN n = '' THEN '(empty)' ELSE left(string_split(n, chr(10))[1], 60) END AS line FROM d
""", line=lambda: T.compress_edit(tag(), text(), F.col("lang")))
_S = r"WITH d AS (SELECT doc_id, source, s, string_split(s, chr(10)) AS l FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)) SELECT doc_id, "


def _found(name: str, k: int) -> str:
    return _S + f"""
'{name}(' || source || ') → ' || CASE WHEN s = '' THEN '0 matches' ELSE len(l) || ' matches:' || chr(10) || '  ' || array_to_string(l[1:{k}], chr(10) || '  ')
  || CASE WHEN len(l) > {k} THEN chr(10) || '  ... and ' || (len(l) - {k}) || ' more' ELSE '' END END AS line FROM d
"""


documents("compress_glob", _found("Glob", 5), line=lambda: T.compress_glob(tag(), text()))
documents("compress_grep", _found("Grep", 3), line=lambda: T.compress_grep(tag(), text()))
documents("compress_task", """
SELECT doc_id, 'Agent(' || lang || '): ' || left(source, 100) || CASE WHEN text = '' THEN '' ELSE chr(10) || '  → ' || left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END END AS line FROM documents
""", line=lambda: T.compress_task(F.col("lang"), tag(), text()))
documents("compress_default", "SELECT doc_id, lang || '(' || left(source, 100) || ') → ' || left(text, 200) AS line FROM documents", line=lambda: T.compress_default(F.col("lang"), tag(), text()))
documents("reasoning_conclusion", r"""
WITH d AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[。.!?！？]\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CASE WHEN text = '' THEN '' WHEN len(a) = 0 THEN left(text, 150) WHEN length(text) <= 200 THEN text ELSE left(a[1], 80) || ' ... → ' || a[-1] END AS line FROM d
""", line=lambda: T.reasoning_conclusion(text()))
documents("error_flag", "SELECT doc_id, regexp_matches(left(lower(text), 500), 'error|failed|not found|denied|fatal') AS failed FROM documents", failed=lambda: T.has_error_words(text()))
documents("skill_markdown", r"""
SELECT doc_id, '---' || chr(10) || 'name: ' || coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(source), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), ''), 'unnamed-skill')
  || chr(10) || 'description: ' || left(text, 1024) || chr(10) || '---' || chr(10) || chr(10) || '# ' || lang || chr(10) || chr(10) || text AS content FROM documents
""", content=lambda: T.skill_markdown(tag(), F.col("lang"), text(), F.lit(""), text()))
documents("extract_body", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents", body=lambda: T.extract_body(T.skill_markdown(tag(), F.col("lang"), F.lit("x"), F.lit("y"), text())))
documents("frontmatter_description", r"SELECT doc_id, source AS description FROM documents", description=lambda: T.frontmatter_description(T.skill_markdown(tag(), F.col("lang"), tag(), F.lit(""), text())))


@query("topic_slug", r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type || '!')), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 40), '-+$', ''), ''), 'unnamed-topic') AS slug FROM part
""")
def topic_slug(spark, sf):
    name = F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))
    return read(spark, sf, "part").select("p_partkey", T.topic_slug(name).alias("slug"))


@query("secret_mask", "SELECT c_custkey, CASE WHEN c_name = '' THEN '(not set)' WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 4) END AS masked FROM customer")
def secret_mask(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.mask_secret(F.col("c_name")).alias("masked"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def html_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.html_escape(F.col("html")).alias("safe"))


@query("confidence_percent", "SELECT event_id, CAST(round_even(least(greatest(value / 100, 0), 1) * 100, 0) AS INT) AS pct, CASE WHEN value / 100 >= 0.7 THEN 'green' WHEN value / 100 >= 0.4 THEN 'amber' ELSE 'red' END AS colour FROM events")
def confidence_percent(spark, sf):
    share = F.col("value") / 100
    return read(spark, sf, "events").select("event_id", T.percent(share).alias("pct"), T.score_colour(share).alias("colour"))


# --- topics ------------------------------------------------------------------

@query("alias_numbering", "SELECT CAST(conv_id AS VARCHAR) AS session_id, 's' || (row_number() OVER (ORDER BY max(turn) DESC, conv_id) - 1) AS alias FROM conversations GROUP BY conv_id")
def alias_numbering(spark, sf):
    s = read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("ts"))
    return P.aliased(s, [F.desc("ts"), F.col("conv_id")]).select(F.col("conv_id").cast("string").alias("session_id"), "alias")


_TRAJ = """
WITH t AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS session_id, source AS project, lang AS session_type, text AS intent,
    CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failure' ELSE '' END AS label, string_split(text, '. ') AS lessons
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""


def _trajectories(spark, sf) -> DataFrame:
    d, q = read(spark, sf, "documents"), read(spark, sf, "labels").select("doc_id", "quality")
    none = F.array()
    return d.join(q, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("session_id"), F.col("source").alias("project"), F.col("lang").alias("session_type"), text().alias("intent"),
        F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure").otherwise("").alias("label"),
        none.cast("array<struct<phase:string,summary:string>>").alias("what_happened"), none.cast("array<struct<problem:string,how_resolved:string,lessons:string>>").alias("problems_encountered"),
        none.cast("array<struct<decision:string,rationale:string,outcome:string>>").alias("key_decisions"), F.split(text(), r"\. ", -1).alias("lessons_learned"), none.cast("array<string>").alias("discoveries"))


@query("trajectory_descriptor", _TRAJ + """
SELECT session_id, 's' || doc_id || ': ' || session_id || ' | project=' || project || ' | type=' || session_type || ' | intent=' || left(intent, 80) || ' | result=' || label
  || CASE WHEN array_to_string(lessons[1:3], '; ') <> '' THEN ' | lessons=' || left(array_to_string(lessons[1:3], '; '), 100) ELSE '' END AS line FROM t
""")
def trajectory_descriptor(spark, sf):
    return _trajectories(spark, sf).select("session_id", P.descriptor(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("line"))


@query("topic_inputs", _TRAJ + """
, e AS (SELECT *, '### Session: ' || session_id || chr(10) || 'Type: ' || session_type || ' | Label: ' || label || chr(10) || 'Intent: ' || intent || chr(10)
    || CASE WHEN len(lessons) > 0 THEN 'Lessons: ' || array_to_string(lessons, '; ') || chr(10) ELSE '' END AS body FROM t)
SELECT project AS topic_id, coalesce(string_agg(body, chr(10) || '---' || chr(10) ORDER BY doc_id) FILTER (WHERE label = 'success'), '') AS good,
  coalesce(string_agg(body, chr(10) || '---' || chr(10) ORDER BY doc_id) FILTER (WHERE label = 'failure'), '') AS bad
FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE label <> '') > 0
""")
def topic_inputs(spark, sf):
    t = _trajectories(spark, sf).withColumn("pos", F.col("doc_id"))
    c = t.groupBy(F.col("project").alias("topic_id")).agg(F.collect_list("session_id").alias("session_ids"))
    return P.topic_inputs(P.topic_members(t, c))


@query("alias_resolution", """
WITH t AS (SELECT 's' || (row_number() OVER (ORDER BY conv_id) - 1) AS alias, CAST(conv_id AS VARCHAR) AS session_id FROM (SELECT DISTINCT conv_id FROM conversations)),
     g AS (SELECT CAST(user_id % 7 AS VARCHAR) AS topic, CASE WHEN user_id % 2 = 0 THEN 's' || user_id ELSE CAST(user_id AS VARCHAR) END AS given, min(event_id) AS i FROM events GROUP BY user_id)
SELECT 't-' || topic AS topic_id, string_agg(coalesce(a.session_id, b.session_id), ',' ORDER BY g.i) AS ids
FROM g LEFT JOIN t a ON a.alias = given LEFT JOIN t b ON b.session_id = given WHERE coalesce(a.session_id, b.session_id) IS NOT NULL GROUP BY 1
""")
def alias_resolution(spark, sf):
    t = P.aliased(read(spark, sf, "conversations").select("conv_id").distinct(), [F.col("conv_id")]).select("alias", F.col("conv_id").cast("string").alias("session_id"))
    u = F.col("user_id")
    g = read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("i"))
    g = g.select((u % 7).alias("topic"), F.when(u % 2 == 0, F.concat(F.lit("s"), u.cast("string"))).otherwise(u.cast("string")).alias("given"), "i")
    raw = g.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "given"))), lambda x: x["given"]).alias("session_ids"))
    raw = raw.select(F.col("topic").alias("cluster_pos"), F.concat(F.lit("T "), F.col("topic").cast("string")).alias("topic_id"), F.lit("").alias("topic_name"), F.lit("").alias("topic_summary"), F.lit("").alias("primary_project"), "session_ids")
    return P.resolved(raw, t).select("topic_id", F.array_join("session_ids", ",").alias("ids"))


@query("topic_semi_join", "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def topic_semi_join(spark, sf):
    good = read(spark, sf, "labels").where("quality = 1")
    return read(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("unclustered_anti_join", "SELECT CAST(doc_id AS VARCHAR) AS session_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unclustered_anti_join(spark, sf):
    t = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"))
    c = read(spark, sf, "labels").groupBy("quality").agg(F.collect_list(F.col("doc_id").cast("string")).alias("session_ids"))
    return P.unclustered(t, c)


@query("protected_topics", """
SELECT DISTINCT source AS topic_id, CAST(0 AS INT) AS n FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')
UNION ALL SELECT source, CAST(count(*) AS INT) FROM documents WHERE lang = 'es' GROUP BY 1
""")
def protected_topics(spark, sf):
    d = read(spark, sf, "documents")
    clusters = d.where("lang = 'es'").groupBy(F.col("source").alias("topic_id")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("session_ids"))
    clusters = clusters.select("topic_id", F.col("topic_id").alias("topic_name"), F.lit("").alias("topic_summary"), "session_ids", F.lit("").alias("primary_project"))
    protected = d.select(F.col("source").alias("topic_id")).distinct()
    return P.with_protected(clusters, protected, protected.withColumn("summary", F.lit("kept"))).select("topic_id", F.size("session_ids").alias("n"))


@query("session_gaps", """
WITH e AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
     s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT CAST(user_id AS VARCHAR) AS session_id, min(epoch_us(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_gaps(spark, sf):
    """Stretches of a user's events with gaps of under two hours."""
    from .streaming.sessions import session_windows

    return session_windows(event_parts(spark, sf), "2 hours").select("session_id", F.unix_millis("start").alias("start_ms"), "n")
