"""From sessions to summaries: segment, extract, aggregate, label."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import prefix, truncate_to_budget
from ..joins import shuffled
from ..operators import sessions as S
from ..providers import Provider, call_model
from ..scratch import Scratch
from . import prompts

#: Tokens of a prompt, and of its fixed part.
INPUT_BUDGET, OVERHEAD = 60_000, 500
BLOCKS_JSON = "blocks array<struct<block_id:int,message_range:array<int>,intent:string>>"
SUMMARY_JSON = (
    "session_type string, intent string, what_happened array<struct<phase:string,summary:string>>, "
    "problems_encountered array<struct<problem:string,how_resolved:string,lessons:string>>, "
    "key_decisions array<struct<decision:string,rationale:string,outcome:string>>, lessons_learned array<string>, discoveries array<string>, overall_outcome string"
)


@dataclass
class Models:
    """Providers for mining and for distilling, and where replies are kept."""

    fast: Callable[[], Provider]
    strong: Callable[[], Provider]
    cache: str
    concurrency: int = 8
    #: (task, model) -> calls, input_tokens and output_tokens of this run.
    used: dict[tuple[str, str], dict[str, int]] = field(default_factory=dict)

    def _count(self, task: str, model: str, sums: Row) -> None:
        held = self.used.setdefault((task, model), dict.fromkeys(sums.asDict(), 0))
        for k, v in sums.asDict().items():
            held[k] += v

    def ask(self, df: DataFrame, task: str, prompt: str, system: str, max_tokens: int, temperature: float = 0.2, strong: bool = False, reply: str | None = None) -> DataFrame:
        factory, used = self.strong if strong else self.fast, functools.partial(self._count, task)
        return call_model(df, system, prompt, factory, f"{self.cache}/{task}", temperature, max_tokens, self.concurrency, used, reply)


def _budget(c: Column, system: str) -> Column:
    return truncate_to_budget(c, INPUT_BUDGET - OVERHEAD - len(system) // 4 - 1)


def intent_blocks(anchors: DataFrame, models: Models) -> DataFrame:
    """Blocks of every session (anchor texts given); of up to two user messages there is one block, unasked."""
    one = lambda rows, intent: rows.select("session_id", F.lit(1).alias("block_id"), F.lit(0).alias("start"), F.col("last_anchor").alias("end"), intent.alias("intent"))
    few, many = anchors.where("n_anchors <= 2"), anchors.where("n_anchors > 2")
    asked = models.ask(many.withColumn("prompt", _budget(F.col("anchors"), prompts.SEGMENT)), "segment", "prompt", prompts.SEGMENT, 4096, reply=BLOCKS_JSON)
    got = asked.withColumn("blocks", F.from_json("response", BLOCKS_JSON)["blocks"])
    good = got.where("size(blocks) > 0 and forall(blocks, b -> size(b.message_range) >= 2)").select("session_id", F.posexplode("blocks").alias("i", "b"))
    good = good.select("session_id", F.coalesce("b.block_id", F.col("i") + 1).alias("block_id"), F.col("b.message_range")[0].alias("start"), F.col("b.message_range")[1].alias("end"), F.coalesce("b.intent", F.lit("")).alias("intent"))
    bad = one(got.where("not coalesce(size(blocks) > 0 and forall(blocks, b -> size(b.message_range) >= 2), false)"), F.lit("entire session"))
    return one(few, prefix(F.col("first_text"), 100)).unionByName(good).unionByName(bad)


def block_summaries(blocks: DataFrame, models: Models) -> DataFrame:
    """``summary`` (JSON with block_id, intent, message_range) of every block (content given)."""
    prompt = F.concat(F.lit("Intent: "), "intent", F.lit("\n\n"), _budget(F.col("content"), prompts.EXTRACT))
    asked = models.ask(blocks.withColumn("prompt", prompt), "extract", "prompt", prompts.EXTRACT, 2048)
    stamp = F.to_json(F.struct("block_id", "intent", F.array("start", "end").alias("message_range")))
    body = F.regexp_replace(F.coalesce("response", F.lit("{}")), r"\}\s*$", "")
    joined = F.concat(body, F.when(F.rlike(body, F.lit(r"^\s*\{\s*$")), "").otherwise(", "), F.substr(stamp, F.lit(2)))
    return asked.select("session_id", "block_id", joined.alias("summary"), "error", "input_tokens", "output_tokens", "calls")


def trajectories(cleaned: DataFrame, summaries: DataFrame, models: Models) -> DataFrame:
    """A summary and a label of every session, with ``status`` ok or error."""
    parts = summaries.groupBy("session_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "summary"))), lambda x: x["summary"]), ",\n"), F.lit("]")).alias("notes"),
        F.max("error").alias("block_error"))
    rows = cleaned.join(shuffled(parts), "session_id").withColumn(
        "prompt", F.concat(_budget(F.col("notes"), prompts.AGGREGATE), F.lit("\n\nProject: "), "project", F.lit("\nTitle: "), "title"))
    asked = models.ask(rows, "aggregate", "prompt", prompts.AGGREGATE, 3000).withColumn("r", F.from_json("response", SUMMARY_JSON))
    none = lambda name: F.coalesce(F.col(f"r.{name}"), F.array().cast(asked.select(f"r.{name}").schema[0].dataType))
    empty = lambda name: F.coalesce(f"r.{name}", F.lit(""))
    score = S.label_score(F.col("has_patches"), F.col("has_errors"), F.col("tool_count"), F.col("last_finish"), empty("overall_outcome"), F.size(none("lessons_learned")), F.size(none("key_decisions")))
    lists = ("what_happened", "problems_encountered", "key_decisions", "lessons_learned", "discoveries")
    out = asked.select(
        "session_id", empty("session_type").alias("session_type"), "project", empty("intent").alias("intent"), *[none(x).alias(x) for x in lists],
        score.alias("label_score"), "title", "message_count", "tool_count", "timestamp", "input_tokens", "output_tokens", "calls", F.coalesce("error", "block_error").alias("error"))
    return out.withColumn("label", S.label_of(F.col("label_score"))).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def mine(sessions: DataFrame, messages: DataFrame, parts: DataFrame, models: Models, min_messages: int = S.MIN_MESSAGES, min_tools: int = S.MIN_TOOLS) -> DataFrame:
    """Trajectories of the given sessions (session_id, title, project, timestamp) that are worth it."""
    chosen = shuffled(sessions.select("session_id"))
    m, p = messages.join(chosen, "session_id", "left_semi"), parts.join(chosen, "session_id", "left_semi")
    scratch = Scratch(sessions.sparkSession, "mining")
    cleaned = S.processable(S.rollup(m, p).join(shuffled(sessions.select("session_id", "title", "project", "timestamp")), "session_id"), min_messages, min_tools)
    cleaned = scratch.save(cleaned, "cleaned")
    kept = m.join(shuffled(cleaned.select("session_id")), "session_id", "left_semi")
    anchors = S.anchor_texts(S.user_anchors(S.message_texts(kept, p)))
    blocks = intent_blocks(anchors, models)
    lines = S.block_lines(kept, S.compress_parts(p))
    texts = S.block_texts(blocks, lines, cleaned)
    return trajectories(cleaned, block_summaries(texts, models), models)


