"""Sessions as DataFrames: listing, filters, compression, anchors, blocks, labels.

Each function takes DataFrames of the schemas in ``schemas`` and returns one.
Per-session work is grouped or windowed by session_id, so sessions spread over
all tasks; nothing is ordered globally but a listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.jsontext import pyrepr
from ..functions.text import prefix, project_name, reasoning_conclusion, text_or_empty, tool_summary
from ..joins import shuffled
from ..schemas import NOISE_TOOLS

MIN_MESSAGES, MIN_TOOLS = 5, 3
# The signals of a label, in the order in which they are added.
PATCH, EXPLORATION, CLEAN_STOP = 1.0, 0.8, 0.7
ERROR_ALONE, ERROR = -0.3, -0.8
OUTCOME_SUCCESS, OUTCOME_FAILURE, LESSONS, DECISIONS = 0.5, -0.3, 0.3, 0.4
SUCCESS, PARTIAL = 0.7, 0.2
NO_REASON = "综合评分不足"


def listing(sessions: DataFrame, messages: DataFrame, source=None, project: str | None = None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """session_id, title, project, msg_count, timestamp, newest first (ties by id).

    ``since_ms`` 0 or None is no bound; whether it is strict is the source's.
    """
    rows = sessions
    if project and source is not None:
        rows = source.project_filter(rows, project)
    if since_ms:
        rows = rows.where(F.col("updated_ms") > since_ms if getattr(source, "strict_since", True) else F.col("updated_ms") >= since_ms)
    if until_ms:
        rows = rows.where(F.col("updated_ms") <= until_ms)
    counts = messages.groupBy("session_id").agg(F.count("*").alias("msg_count"))
    return (
        rows.join(shuffled(counts), "session_id", "left")
        .select("session_id", "title", project_name(F.col("directory")).alias("project"), F.coalesce("msg_count", F.lit(0)).alias("msg_count"), F.col("updated_ms").alias("timestamp"))
        .orderBy(F.desc("timestamp"), "session_id")
    )


def tool_counts(parts: DataFrame) -> DataFrame:
    """tool_count of every session that has parts, noise tools included."""
    return parts.groupBy("session_id").agg(F.count_if(F.col("type") == "tool").alias("tool_count"))


def candidates(sessions: DataFrame, parts: DataFrame, min_messages: int = MIN_MESSAGES, min_tools: int = MIN_TOOLS) -> DataFrame:
    """Listed sessions with enough messages and tools; parts are counted once for all."""
    kept = sessions.where(F.col("msg_count") >= min_messages)
    return kept.join(shuffled(tool_counts(parts)), "session_id", "left").withColumn("tool_count", F.coalesce("tool_count", F.lit(0))).where(F.col("tool_count") >= min_tools)


def processable(cleaned: DataFrame, min_messages: int = MIN_MESSAGES, min_tools: int = MIN_TOOLS) -> DataFrame:
    """Compressed sessions that are worth mining."""
    return cleaned.where((F.col("message_count") >= min_messages) & (F.col("tool_count") >= min_tools) & (F.col("n_user") > 0))


def compress_parts(parts: DataFrame) -> DataFrame:
    """Parts with ``line``, what is kept of each, and its ``kind``; steps and noise tools go.

    Only tools without a summary of their own need the Python form of their
    input, so only their rows go through Python.
    """
    tool = F.coalesce(F.col("type") == "tool", F.lit(False))
    other = tool & ~F.coalesce(F.col("tool").isin("bash", "read", "write", "edit", "glob", "grep", "task"), F.lit(False))
    rows = parts.where(~(tool & F.coalesce(F.col("tool").isin(*NOISE_TOOLS), F.lit(False))))
    rows = rows.where(~other).withColumn("input_repr", F.lit("")).unionByName(rows.where(other).withColumn("input_repr", pyrepr(F.coalesce("input_json", F.lit("{}")))))
    files = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("files", F.array().cast("array<string>")), _quoted), ", "), F.lit("]"))
    line = (
        F.when(F.col("type") == "text", text_or_empty(F.col("text")))
        .when(F.col("type") == "reasoning", reasoning_conclusion(text_or_empty(F.col("text"))))
        .when(F.col("type") == "tool", tool_summary(F.col("tool"), F.col("input_json"), F.col("output"), F.col("input_repr")))
        .when(F.col("type") == "patch", F.concat(prefix(text_or_empty(F.col("hash")), 8), F.lit(" "), files))
        .when(F.col("type") == "subtask", text_or_empty(F.col("description")))
    )
    return rows.withColumn("line", line).where("line is not null and not (type = 'reasoning' and line = '')").drop("input_repr")


def _quoted(c: Column) -> Column:
    """A string as Python prints it."""
    body = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def message_texts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Messages with ``texts``, their text parts in order."""
    texts = (
        parts.where("type = 'text'").groupBy("session_id", "msg_idx")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    )
    return messages.join(shuffled(texts), ["session_id", "msg_idx"], "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def user_anchors(messages: DataFrame) -> DataFrame:
    """User messages (``texts`` given) with what the last assistant text before them was.

    An assistant message without text parts is passed over; one with an empty
    text counts.
    """
    text = F.array_join("texts", " ")
    said = F.when((F.col("role") == "assistant") & (F.size("texts") > 0), prefix(text, 200))
    before = Window.partitionBy("session_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return (
        messages.withColumn("prev_assistant", F.coalesce(F.last(said, ignorenulls=True).over(before), F.lit("")))
        .where("role = 'user'")
        .select("session_id", "msg_idx", prefix(text, 500).alias("text"), "prev_assistant", "created_ms")
    )


def anchor_line(idx: Column, ms: Column, text: Column, prev: Column) -> Column:
    time = F.when(F.coalesce(ms, F.lit(0)) != 0, F.date_format(F.timestamp_millis(ms), "HH:mm")).otherwise("")
    after = F.when(prev != "", F.concat(F.lit("  (after: "), prev, F.lit(")"))).otherwise("")
    return F.concat(F.lit("#"), idx.cast("string"), F.lit(" ["), time, F.lit("] "), text, after)


def anchor_texts(anchors: DataFrame) -> DataFrame:
    """One text a session: its anchor lines in order."""
    line = anchor_line(F.col("msg_idx"), F.col("created_ms"), F.col("text"), F.col("prev_assistant"))
    return anchors.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("anchors"),
        F.count("*").alias("n_anchors"), F.max("msg_idx").alias("last_anchor"), F.min_by("text", "msg_idx").alias("first_text"),
    )


def rollup(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Attributes of every session that has messages: counts, patches, errors, last finish, tokens."""
    assistant = F.col("role") == "assistant"
    m = messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.count_if(F.col("role") == "user").alias("n_user"), F.bool_or(F.col("error").isNotNull()).alias("has_errors"),
        F.coalesce(F.max_by("finish", F.when(assistant, F.col("msg_idx"))), F.lit("")).alias("last_finish"),
        F.coalesce(F.sum(F.when(assistant, F.col("tokens_total"))), F.lit(0)).alias("total_tokens"),
    )
    p = parts.groupBy("session_id").agg(F.count_if(F.col("type") == "tool").alias("tool_count"), F.bool_or(F.col("type") == "patch").alias("has_patches"))
    return m.join(shuffled(p), "session_id", "left").withColumns({"tool_count": F.coalesce("tool_count", F.lit(0)), "has_patches": F.coalesce("has_patches", F.lit(False))})


def block_lines(messages: DataFrame, compressed: DataFrame) -> DataFrame:
    """Lines of a session for a reader: by message, then text, thought, tool, patch and error."""
    tag = F.when(F.col("role") == "user", "[USER] ").otherwise("[ASSISTANT] ")
    kinds = {"text": (0, tag), "reasoning": (1, F.lit("[THOUGHT] ")), "tool": (2, F.lit("[TOOL] ")), "patch": (3, F.lit("[PATCH] "))}
    rank, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for kind, (k, name) in kinds.items():
        rank, label = F.when(F.col("type") == kind, k).otherwise(rank), F.when(F.col("type") == kind, name).otherwise(label)
    said = (
        compressed.where(F.col("type").isin(*kinds)).join(shuffled(messages.select("session_id", "msg_idx", "role")), ["session_id", "msg_idx"])
        .select("session_id", "msg_idx", rank.alias("rank"), "part_idx", F.concat(label, "line").alias("line"))
    )
    reason = F.coalesce(F.get_json_object("error", "$.data.message"), pyrepr(F.col("error")))
    failed = messages.where("error is not null and error not in ('{}', '\"\"')").select("session_id", "msg_idx", F.lit(4).alias("rank"), F.lit(0).alias("part_idx"), F.concat(F.lit("[ERROR] "), reason).alias("line"))
    return said.unionByName(failed)


def sliced_range(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """First index and stop of Python's ``[start : end + 1]`` over n elements."""
    wrap = lambda x: F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))
    return wrap(start), wrap(end + 1)


def block_texts(blocks: DataFrame, lines: DataFrame, counts: DataFrame) -> DataFrame:
    """``content`` of every block: the lines of its messages.

    ``counts`` has message_count by session. Ranges may overlap, be negative or
    reach beyond the session; they mean what a Python slice would.
    """
    first, stop = sliced_range(F.col("start"), F.col("end"), F.col("message_count").cast("int"))
    ranged = blocks.join(shuffled(counts.select("session_id", "message_count")), "session_id").withColumn("lo", first).withColumn("hi", stop)
    # A row for each message of a block, so that lines meet their own blocks only.
    places = F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo"), F.col("hi") - 1)).otherwise(F.array().cast("array<int>"))
    inside = ranged.select("session_id", "block_id", F.explode(places).alias("msg_idx")).join(shuffled(lines), ["session_id", "msg_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("msg_idx", "rank", "part_idx", "line")))
    texts = inside.groupBy("session_id", "block_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
    return blocks.join(shuffled(texts), ["session_id", "block_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def label_score(has_patches: Column, has_errors: Column, tool_count: Column, last_finish: Column, outcome: Column, n_lessons: Column, n_decisions: Column) -> Column:
    """The sum of the signals that fire, in doubles and in a fixed order."""
    d = lambda x: F.lit(float(x))
    on = lambda c, w: F.when(c, d(w)).otherwise(d(0))
    terms = [
        on(has_patches, PATCH), on(~has_patches & (tool_count >= 5), EXPLORATION), on(last_finish == "stop", CLEAN_STOP),
        F.when(has_errors & ~has_patches, d(ERROR_ALONE)).when(has_errors, d(ERROR)).otherwise(d(0)),
        F.when(outcome == "success", d(OUTCOME_SUCCESS)).when(outcome == "failure", d(OUTCOME_FAILURE)).otherwise(d(0)),
        on(n_lessons > 0, LESSONS), on(n_decisions > 0, DECISIONS),
    ]
    out = d(0)
    for t in terms:
        out = out + t
    return out


def label_of(score: Column) -> Column:
    return F.when(score >= F.lit(SUCCESS), "success").when(score >= F.lit(PARTIAL), "partial").otherwise("failure")


def label_reason(label: Column, problems: Column, lessons: Column) -> Column:
    """Why a session is no success: its first problem and its first lesson."""
    first = lambda c: F.transform(F.slice(c, 1, 1), lambda x: prefix(x, 80))
    known = F.concat(first(problems), first(lessons))
    return F.when(label == "success", "").when(F.size(known) == 0, NO_REASON).otherwise(F.array_join(known, "；"))
