"""Exported sessions, one JSON file each: ``{info, messages: [{info, parts}]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(v: str, path: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(default))


def _number(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0).cast("long"))


class SessionExports:
    """All ``*.json`` files of a folder, none of those below it; what is no session is passed over."""

    strict_since = True

    def __init__(self, spark: SparkSession, folder: str, pattern: str = "*.json"):
        self.spark, self.folder, self.pattern = spark, folder.rstrip("/"), pattern

    def _raw(self) -> DataFrame:
        # A filter of names lists the folder once; a glob is a job of a task for each file it finds.
        files = self.spark.read.text(self.folder, wholetext=True, pathGlobFilter=self.pattern)
        return files.select(F.try_parse_json("value").alias("v")).select(F.try_variant_get("v", "$.info.id", "string").alias("session_id"), "v").where("session_id is not null")

    def _each(self) -> DataFrame:
        return self._raw().select("session_id", F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("msg_idx", "m"))

    def table(self, name: str) -> DataFrame:
        return {"sessions": self._sessions, "messages": self._messages, "parts": self._parts}[name]()

    def _sessions(self) -> DataFrame:
        return self._raw().select("session_id", _text("v", "$.info.title").alias("title"), _text("v", "$.info.directory").alias("directory"), _number("v", "$.info.time.created").alias("created_ms"), _number("v", "$.info.time.updated").alias("updated_ms"))

    def _messages(self) -> DataFrame:
        return self._each().select(
            "session_id", "msg_idx", _text("m", "$.info.role").alias("role"), _number("m", "$.info.time.created").alias("created_ms"), _text("m", "$.info.finish").alias("finish"),
            F.try_variant_get("m", "$.info.error", "string").alias("error"), _number("m", "$.info.tokens.total").alias("tokens_total"))

    def _parts(self) -> DataFrame:
        p = self._each().select("session_id", "msg_idx", F.posexplode(F.coalesce(F.try_variant_get("m", "$.parts", "array<variant>"), F.array().cast("array<variant>"))).alias("part_idx", "p"))
        plain = {"type": "type", "text": "text", "tool": "tool", "call_id": "callID"}
        return p.select(
            "session_id", "msg_idx", "part_idx", *[_text("p", f"$.{v}").alias(k) for k, v in plain.items()], _text("p", "$.state.status", "completed").alias("status"),
            _text("p", "$.state.input", "{}").alias("input_json"), F.try_variant_get("p", "$.state.output", "string").alias("output"), _text("p", "$.hash").alias("hash"),
            F.coalesce(F.try_variant_get("p", "$.files", "array<string>"), F.array().cast("array<string>")).alias("files"), *[_text("p", f"$.{x}").alias(x) for x in ("prompt", "description", "agent")])

    def project_filter(self, df: DataFrame, project: str) -> DataFrame:
        """The whole directory contains ``project``, whatever the case of ASCII letters."""
        return df.where(F.contains(F.lower("directory"), F.lit(project.lower())))

    def full_id(self, given: str) -> str:
        return given
