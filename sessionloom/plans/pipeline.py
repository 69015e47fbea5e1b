"""A whole run: list, filter, mine, cluster, distil, write."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators.topics import aliased
from ..sinks import files
from ..sinks.report import Report
from ..sinks.state import StateStore
from ..sources import SessionSource, bounded
from ..storage import Store
from ..streaming.sessions import run_new
from .analysis import ClusterStrategy, ModelClusters, distil
from .mining import Models, mine


@dataclass
class Settings:
    output: str
    work: str
    project: str | None = None
    since_ms: int | None = None
    until_ms: int | None = None
    session_id: str | None = None
    projects: list[str] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    min_messages: int = S.MIN_MESSAGES
    min_tools: int = S.MIN_TOOLS
    step: int | None = None
    dry_run: bool = False
    form: str = "skill_md"
    max_rules: int | None = None
    today: str = ""


class Distiller(Protocol):
    """Skills of topics: a row for each, with ``error`` null where it has one."""

    def __call__(self, trajectories: DataFrame, clusters: DataFrame) -> DataFrame: ...


class Formatter(Protocol):
    """Writes skills and gives the paths of what it wrote by name."""

    def __call__(self, skills: DataFrame, output: str, project: str, date: str, merge: Callable | None) -> dict[str, str]: ...


class Presenter(Protocol):
    """Writes a report and gives its path."""

    def __call__(self, report: Report, output: str) -> str: ...


def skill_files(skills: DataFrame, output: str, project: str, date: str, merge: Callable | None) -> dict[str, str]:
    """A file for each skill, and their index."""
    paths = files.write_skills(skills, output, project, merge)
    return paths | {"index": files.write_index(skills, output, project, date)}


def knowledge_file(skills: DataFrame, output: str, project: str, date: str, merge: Callable | None) -> dict[str, str]:
    """One file of all topics; nothing is merged."""
    return {"knowledge": files.write_knowledge(skills, output, project, date)}


FORMATS: dict[str, Formatter] = {"skill_md": skill_files, "knowledge_md": knowledge_file}


class Pipeline:
    """Stages are tables under ``work``; each is computed once, and later ones read its files.

    How sessions are clustered, topics distilled, skills formatted and reports
    presented can be exchanged.
    """

    def __init__(
        self, spark: SparkSession, source: SessionSource, models: Models, settings: Settings, strategy: ClusterStrategy | None = None, merge: Callable | None = None,
        distiller: Distiller | None = None, formats: dict[str, Formatter] | None = None, presenter: Presenter = Report.write_html,
    ):
        self.spark, self.source, self.models, self.settings = spark, source, models, settings
        self.strategy = strategy or ModelClusters(models, settings.project or "")
        self.distil = distiller or functools.partial(distil, models=models, max_rules=settings.max_rules)
        known = FORMATS | (formats or {})
        if settings.form not in known:
            raise ValueError(f"unknown format {settings.form!r}; known are {', '.join(sorted(known))}")
        self.format, self.present = known[settings.form], presenter
        self.state = StateStore(spark, f"{settings.output}/state")
        self.merge = merge
        self.run_id = uuid.uuid4().hex

    def _stage(self, report: Report, name: str, df: DataFrame) -> DataFrame:
        begun, path = time.monotonic(), f"{self.settings.work}/{self.run_id}/{name}"
        df.write.parquet(path)
        report.step(name, time.monotonic() - begun)
        return self.spark.read.schema(df.schema).parquet(path)

    def run_changes(self) -> list[Report]:
        """A run over the sessions that are new or changed since the last one.

        The source's stream keeps its place in ``state/stream``. A run that was
        killed is repeated over the same sessions: its model calls are in the
        cache, its trajectories are written over, and if it had come to save its
        state nothing is done again.
        """
        reports: list[Report] = []
        checkpoint = f"{self.settings.output}/state/stream"

        def handle(batch: DataFrame, number: int) -> None:
            stream = json.loads(Store(self.spark, checkpoint).read("metadata") or "{}").get("id", "")
            if not self.state.has_batch(stream, number):
                reports.append(self.run(batch, (stream, number)))

        # A run without a stream's place, the first one, starts where earlier runs ended.
        run_new(self.source.changes(self.state.since_ms()), handle, checkpoint).awaitTermination()
        return reports

    def run(self, sessions: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Report:
        """A run over all sessions of the source, or over those given, a stream's ``batch``."""
        s = self.settings
        project = s.project or "all"
        self.run_id = f"{batch[0]}-{batch[1]}-{uuid.uuid4().hex}" if batch else uuid.uuid4().hex
        name = f"{batch[0]}-{batch[1]}" if batch else self.run_id
        report = Report(project, s.today or datetime.now(UTC).strftime("%Y-%m-%d"))
        wanted = self.source.full_id(s.session_id) if s.session_id else None
        if sessions is None:
            sessions = bounded(self.source, "sessions", None if wanted else s.since_ms or None, wanted)
        messages, parts = (bounded(self.source, x, session=wanted) for x in ("messages", "parts"))
        if wanted is not None:
            # A named session skips the listing's filter on messages; its tools still count.
            listed = S.listing(sessions.where(F.col("session_id") == wanted), messages, self.source)
            listed = listed.withColumn("msg_count", F.greatest("msg_count", F.lit(s.min_messages)))
        else:
            listed = S.listing(sessions, messages, self.source, s.project, s.since_ms, s.until_ms)
        if s.projects:
            listed = listed.where(F.col("project").isin(s.projects))
        listed = self._stage(report, "listed", listed)
        if listed.isEmpty():
            return self._end(report, "no sessions")
        chosen = self._stage(report, "candidates", S.candidates(listed, parts, s.min_messages, s.min_tools))
        if chosen.isEmpty():
            return self._end(report, "no candidates")
        mined = mine(chosen, messages, parts, self.models, s.min_messages, s.min_tools)
        mined = self._stage(report, "trajectories", aliased(mined, [F.desc("timestamp"), F.col("session_id")]))
        good = mined.where("status = 'ok'")
        report.sessions(mined)
        if good.isEmpty():
            return self._end(report, "no trajectories")
        if s.step == 1:
            if not s.dry_run:
                report.paths["trajectories"] = files.write_trajectories(good, s.output, project, report.date, name)
            return self._end(report, "")
        existing = files.existing_topics(self.spark, s.output, project)
        clusters, _ = self.strategy.cluster(good, existing, s.protected)
        clusters = self._stage(report, "clusters", clusters)
        distilled = self._stage(report, "skills", self.distil(good, clusters))
        report.failed_topics(distilled.where("error is not null"))
        skills = distilled.where("error is null")
        report.skills(skills)
        if skills.isEmpty():
            return self._end(report, "no skills")
        if s.step == 2 or s.dry_run:
            return self._end(report, "")
        report.paths |= self.format(skills, s.output, project, report.date, self.merge)
        report.paths["trajectories"] = files.write_trajectories(good, s.output, project, report.date, name)
        # What was read, not when the run ended, bounds the next run.
        mark = listed.agg(F.max("timestamp")).first()[0]
        self.state.save(good.select("session_id"), mark, good.count(), batch)
        return self._end(report, "")

    def _end(self, report: Report, why: str) -> Report:
        report.note = why
        report.used(self.models.used)
        if not self.settings.dry_run:
            report.paths["report"] = self.present(report, self.settings.output)
        return report
