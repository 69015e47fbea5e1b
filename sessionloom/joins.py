"""Joins of tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt out by key, and never goes whole through the driver to all executors.

    Spark sends a side around that it takes for small. It knows packed files by
    their bytes and grouped lists by a fixed width, so it takes tables of
    repeated texts for a small part of what they are.
    """
    return df.hint("merge")
