"""The driver's relational tables as sessions, messages and parts.

``conversations`` are sessions of messages with one text part each. ``events``
of a user are the parts of a session: errors mark it, purchases stand for
patches, all others for tool calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("msg_idx"), "role", F.coalesce("text", F.lit("")).alias("text"))


def event_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "patch").when(F.col("event_type") == "error", "error").otherwise("tool")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        kind.alias("type"), F.col("event_type").alias("tool"), F.col("props").alias("input_json"), "value",
    )
