"""From summaries to skills: cluster into topics, distil each."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_to_budget
from ..joins import shuffled
from ..operators import topics as P
from ..schemas import RULE
from ..scratch import Scratch
from . import prompts
from .mining import Models

DISTIL_BUDGET = 50_000
CLUSTER_JSON = "clusters array<struct<topic_id:string,topic_name:string,topic_summary:string,session_ids:array<string>,primary_project:string>>"
SKILL_JSON = f"struct<skill_title:string,skill_type:string,description:string,summary:string,rules:array<{RULE}>,body:string>"


class ClusterStrategy(Protocol):
    """(clusters, unclustered) of trajectories with ``alias`` and ``pos``."""

    def cluster(self, trajectories: DataFrame, existing: DataFrame, protected: list[str]) -> tuple[DataFrame, DataFrame]: ...


class ModelClusters:
    """Topics by a model that reads the descriptors of all sessions.

    ``most_chars`` bounds a prompt. Where one cannot hold all sessions, several
    prompts of consecutive ones find topics, and prompts over the topics found
    join those, until one prompt has held all of them: so the topic limit is
    put to the model for all sessions together. A topic that a prompt leaves
    out stays as it is. It ends early only if several prompts join nothing.
    """

    def __init__(self, models: Models, project: str = "", min_size: int = 1, max_topics: int = 8, most_chars: int = 90_000):
        self.models, self.project, self.min_size, self.max_topics, self.most_chars = models, project, min_size, max_topics, most_chars

    @property
    def _each(self) -> int:
        """Lines of a prompt; two at least, or joining would never end."""
        return max(2, self.most_chars // 500)

    def cluster(self, trajectories: DataFrame, existing: DataFrame, protected: list[str]) -> tuple[DataFrame, DataFrame]:
        spark = trajectories.sparkSession
        scratch = Scratch(spark, "clusters")
        # Topics are few: they are folders of written skills.
        known = existing.orderBy("topic_id").collect()
        old = "\n".join(f"- {r['topic_id']}: {r['summary']}{' [protected]' if r['topic_id'] in protected else ''}" for r in known) or "(none)"
        about = f"at most {self.max_topics} topics.\nExisting topics:\n{old}\nProtected: {', '.join(protected) or '(none)'}\n\n"
        lines = trajectories.select("pos", P.descriptor(F.col("alias")).alias("line"))
        clusters = P.resolved(self._asked(lines, self.min_size, about), trajectories)
        if self._prompts(trajectories) > 1:
            clusters = self._joined(scratch.save(clusters, "found"), about, scratch)
        if protected:
            clusters = P.with_protected(clusters, spark.createDataFrame([(p,) for p in protected], "topic_id string"), existing, self.project)
        return clusters, P.unclustered(trajectories, clusters)

    def _prompts(self, rows: DataFrame) -> int:
        return -(-rows.count() // self._each)

    def _asked(self, lines: DataFrame, min_size: int, about: str) -> DataFrame:
        """The clusters that the model makes of ``lines`` (pos, line), with session_ids as it gave them."""
        batches = lines.groupBy(F.floor(F.col("pos") / self._each).alias("batch")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n"))
        prompt = F.concat(F.lit("At least "), F.least(F.lit(min_size), F.col("n")).cast("string"), F.lit(f" sessions a topic, {about}"), "text")
        asked = self.models.ask(batches.withColumn("prompt", prompt), "cluster", "prompt", prompts.CLUSTER, 4096, reply=CLUSTER_JSON)
        return asked.select("batch", F.posexplode(F.from_json("response", CLUSTER_JSON)["clusters"]).alias("i", "c")).select(
            (F.col("batch") * 1000 + F.col("i")).alias("cluster_pos"), "c.topic_id", "c.topic_name", "c.topic_summary", F.coalesce("c.primary_project", F.lit(self.project)).alias("primary_project"), "c.session_ids")

    def _joined(self, found: DataFrame, about: str, scratch: Scratch) -> DataFrame:
        """Topics of several prompts, joined level by level; only their descriptions go to the model, sessions follow by join."""
        while True:
            topics = P.aliased(found.withColumn("n", F.size("session_ids")).drop("session_ids"), [F.col("topic_id")], scratch)
            before = topics.count()
            lines = topics.select("pos", P.topic_descriptor(F.col("alias")).alias("line"))
            above = P.resolved(self._asked(lines, 1, f"{about}Each line is a topic of several sessions.\n"), topics.select("alias", F.col("topic_id").alias("session_id")))
            found = scratch.save(P.lifted(found, scratch.save(above, "above")), "joined")
            if before <= self._each or found.count() >= before:
                return found


class FieldClusters:
    """Topics by columns of the sessions, without a model."""

    def __init__(self, *fields: str):
        self.fields = fields or ("project", "session_type")

    def cluster(self, trajectories: DataFrame, existing: DataFrame, protected: list[str]) -> tuple[DataFrame, DataFrame]:
        name = F.concat_ws(" ", *self.fields)
        ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "session_id"))), lambda x: x["session_id"])
        groups = trajectories.groupBy(name.alias("topic_name")).agg(ids.alias("session_ids"), F.min("project").alias("primary_project"), F.min("pos").alias("cluster_pos"))
        raw = groups.select("cluster_pos", F.col("topic_name").alias("topic_id"), "topic_name", F.lit("").alias("topic_summary"), "primary_project", "session_ids")
        clusters = P.resolved(raw, trajectories)
        if protected:
            clusters = P.with_protected(clusters, trajectories.sparkSession.createDataFrame([(p,) for p in protected], "topic_id string"), existing)
        return clusters, P.unclustered(trajectories, clusters)


def distil(trajectories: DataFrame, clusters: DataFrame, models: Models, max_rules: int | None = None) -> DataFrame:
    """A row for each topic that has labelled sessions. ``error`` says why one has no skill: the call's, or that it gave no rule and no body."""
    system = prompts.DISTIL
    half = (DISTIL_BUDGET - len(system) // 4 - 1) // 2
    some = lambda c: F.when(c == "", "(none)").otherwise(truncate_to_budget(c, half))
    # A text of four characters a token is over the budget whatever its characters are, and is cut to less than that.
    topics = clusters.join(shuffled(P.topic_inputs(P.topic_members(trajectories, clusters), 4 * half + 8)), "topic_id")
    about = F.when(F.coalesce("topic_summary", F.lit("")) == "", F.col("topic_name")).otherwise(F.col("topic_summary"))
    prompt = F.concat(F.lit("Topic: "), "topic_name", F.lit("\nAbout: "), about, F.lit("\n\nWent well:\n"), some(F.col("good")), F.lit("\n\nDid not:\n"), some(F.col("bad")))
    asked = models.ask(topics.withColumn("prompt", prompt), "distil", "prompt", system, 8192, 0.3, strong=True).withColumn("r", F.from_json("response", SKILL_JSON))
    none = F.array().cast("array<string>")
    rules = F.transform(F.coalesce("r.rules", F.array().cast(f"array<{RULE}>")), lambda x, i: F.struct(
        F.coalesce(x["id"], F.concat(F.lit("rule_"), i.cast("string"))).alias("id"), *[F.coalesce(x[k], F.lit("")).alias(k) for k in ("type", "condition", "action")],
        none.alias("evidence_from_success"), none.alias("evidence_from_failure"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(x["scope"], F.lit("general")).alias("scope")))
    if max_rules:
        best = F.array_sort(rules, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
        rules = F.slice(best, 1, max_rules)
    text = lambda name, default: F.coalesce(f"r.{name}", default).alias(name)
    skills = asked.select(
        "topic_id", "topic_name", text("skill_title", F.col("topic_name")), text("skill_type", F.lit("checklist")), text("description", F.lit("")),
        F.coalesce("r.summary", "topic_summary", F.lit("")).alias("summary"), rules.alias("rules"), text("body", F.lit("")), F.col("session_ids").alias("source_sessions"),
        "primary_project", "error", "input_tokens", "output_tokens", "calls")
    return skills.withColumn("error", F.coalesce("error", F.when((F.size("rules") == 0) & (F.col("body") == ""), "the reply has no rules and no body")))
