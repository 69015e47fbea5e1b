"""Merging a new skill into the written one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prompts
from .mining import Models

MERGED_JSON = "body string, description string"


def model_merge(skills: DataFrame, models: Models) -> DataFrame:
    """Adds merged_body and merged_description, null where the model gave none."""
    prompt = F.concat(F.lit("=== CURRENT ===\n"), "current_body", F.lit("\n=== NEW ===\n"), "new_body")
    usage = [c for c in ("input_tokens", "output_tokens", "calls", "error") if c in skills.columns]
    asked = models.ask(skills.drop(*usage).withColumn("prompt", prompt), "merge", "prompt", prompts.MERGE, 8192, reply=MERGED_JSON)
    r = F.from_json(F.when(F.col("error").isNull(), F.col("response")), MERGED_JSON)
    return asked.withColumns({"merged_body": r["body"], "merged_description": r["description"]}).drop("prompt", "response")
