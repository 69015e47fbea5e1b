"""Where sessions come from. A source gives the tables sessions, messages and parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .exports import SessionExports
from .session_files import SessionFiles
from .sqlite import SqliteSource


class SessionSource(Protocol):
    """``strict_since``: whether a session updated exactly at ``since`` is left out."""

    strict_since: bool

    def table(self, name: str) -> DataFrame: ...

    def project_filter(self, df: DataFrame, project: str) -> DataFrame: ...

    def full_id(self, given: str) -> str:
        """The session id that a given one, which may be short, stands for."""
        ...


def create_source(spark: SparkSession, kind: str, path: str, kept: str | None = None) -> SessionSource:
    """``sqlite``, ``files`` or ``exports``, in either case of letters. ``kept`` is where ``files`` keep what they parsed."""
    kinds = {"sqlite": SqliteSource, "files": SessionFiles, "exports": SessionExports}
    if kind.lower() not in kinds:
        raise ValueError(f"unknown source {kind!r}; known are {', '.join(sorted(kinds))}")
    more = {"kept": kept} if kind.lower() == "files" else {}
    return kinds[kind.lower()](spark, path, **more)


def bounded(source: SessionSource, name: str, from_ms: int | None = None, session: str | None = None) -> DataFrame:
    """A table of a source, of which no more need be right than one session, or than sessions updated from ``from_ms`` on.

    Sources that can read less do so; callers filter all the same.
    """
    narrow = getattr(source, "bounded", None)
    return narrow(name, from_ms, session) if narrow else source.table(name)
