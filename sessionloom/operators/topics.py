"""Topics of sessions: descriptors, aliases, clusters and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import prefix, topic_slug
from ..joins import shuffled
from ..scratch import Scratch


def aliased(trajectories: DataFrame, order: list, scratch: Scratch | None = None) -> DataFrame:
    """Trajectories with ``pos``, their place in ``order``, and ``alias`` s0, s1, ….

    Places are counted in two steps, by range of the order and then within it,
    so that no task sorts all rows. The sorted rows are written down first:
    range bounds are sampled and partitions merged anew whenever a plan runs, so
    only a table gives both steps the same partitions.
    """
    scratch = scratch or Scratch(trajectories.sparkSession, "aliased")
    spread = trajectories.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids grow with the partition and, from 0, within it.
    spread = scratch.save(spread.withColumn("_mono", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_mono", 33)
    counts = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row for each partition of the table.
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    placed = spread.withColumn("_part", part).join(F.broadcast(before), "_part")
    pos = F.col("_before") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("pos", pos).withColumn("alias", F.concat(F.lit("s"), pos.cast("string"))).drop("_mono", "_part", "_before")


def descriptor(alias: Column) -> Column:
    """One line on a session for a reader that groups sessions."""
    first = lambda c: F.slice(c, 1, 3)
    joined = lambda c: F.array_join(c, "; ")
    some = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}="), prefix(c, 100)))
    empty = F.lit("")
    return F.concat_ws(
        " | ", F.concat(alias, F.lit(": "), F.col("session_id")), F.when(F.col("project") != "", F.concat(F.lit("project="), F.col("project"))),
        F.concat(F.lit("type="), F.coalesce("session_type", empty)), F.concat(F.lit("intent="), prefix(F.coalesce("intent", empty), 80)),
        F.concat(F.lit("result="), F.coalesce("label", empty)),
        some("problems", joined(F.transform(first("problems_encountered"), lambda x: x["problem"]))),
        some("decisions", joined(F.transform(first("key_decisions"), lambda x: x["decision"]))),
        some("lessons", joined(first("lessons_learned"))),
    )


def trajectory_text() -> Column:
    """All that is known of a session, as text."""
    lines = lambda head, c, each: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, each), ""))).otherwise("")
    t = F.lit
    return F.concat(
        t("### Session: "), "session_id", t("\nType: "), "session_type", t(" | Label: "), "label", t("\nIntent: "), "intent", t("\n"),
        lines("Phases:\n", F.col("what_happened"), lambda x: F.concat(t("  - "), x["phase"], t(": "), x["summary"], t("\n"))),
        lines("Problems:\n", F.col("problems_encountered"), lambda x: F.concat(t("  - "), x["problem"], t(" -> "), x["how_resolved"], t("\n"))),
        lines("Decisions:\n", F.col("key_decisions"), lambda x: F.concat(t("  - "), x["decision"], t(" (reason: "), x["rationale"], t(")\n"))),
        F.when(F.size("lessons_learned") > 0, F.concat(t("Lessons: "), F.array_join("lessons_learned", "; "), t("\n"))).otherwise(""),
        lines("Discoveries:\n", F.col("discoveries"), lambda x: F.concat(t("  - "), x, t("\n"))),
    )


def resolved(raw: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Cluster rows (topic_id, session_ids of aliases or ids) with ids resolved.

    An alias wins over an equal id; unknown ones go, repeats and order stay.
    Topic ids become slugs; clusters of one slug are one, the first one's names
    are kept. Clusters without an id or a session go.
    """
    known = trajectories.select("alias", "session_id")
    items = (
        raw.where("coalesce(topic_id, '') <> ''").withColumn("topic_id", topic_slug(F.col("topic_id")))
        .select("cluster_pos", "topic_id", "topic_name", "topic_summary", "primary_project", F.posexplode("session_ids").alias("i", "given"))
    )
    found = (
        items.join(shuffled(known.select(F.col("alias").alias("given"), F.col("session_id").alias("by_alias"))), "given", "left")
        .join(shuffled(known.select(F.col("session_id").alias("given"), F.col("session_id").alias("by_id"))), "given", "left")
        .withColumn("sid", F.coalesce("by_alias", "by_id")).where("sid is not null")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cluster_pos", "i", "sid"))), lambda x: x["sid"])
    first = lambda c: F.min_by(c, "cluster_pos").alias(c)
    return found.groupBy("topic_id").agg(F.coalesce(F.min_by("topic_name", "cluster_pos"), F.first("topic_id")).alias("topic_name"), first("topic_summary"), ordered.alias("session_ids"), first("primary_project"))


def topic_descriptor(alias: Column) -> Column:
    """One line on a topic (topic_id, topic_name, topic_summary, primary_project, n sessions) for a reader that joins topics."""
    empty = F.lit("")
    said = lambda name, c, n: F.concat(F.lit(f"{name}="), prefix(F.translate(F.coalesce(c, empty), "\n|", "  "), n))
    return F.concat_ws(
        " | ", F.concat(alias, F.lit(": "), F.col("topic_id")), said("project", F.col("primary_project"), 80), said("topic", F.col("topic_name"), 100),
        F.concat(F.lit("sessions="), F.col("n").cast("string")), said("about", F.col("topic_summary"), 200))


def lifted(topics: DataFrame, above: DataFrame) -> DataFrame:
    """Topics joined as ``above`` says, whose session_ids are topic ids; those it does not name stay.

    Sessions of a joined topic are in the order of its topics, once each. A
    topic that stays and has the id of a joined one goes into that.
    """
    pairs = above.select("topic_id", F.posexplode("session_ids").alias("i", "below"))
    stays = topics.join(shuffled(pairs.select(F.col("below").alias("topic_id")).distinct()), "topic_id", "left_anti")
    named = above.select(F.lit(0).alias("rank"), "topic_id", "topic_name", "topic_summary", "primary_project").unionByName(
        stays.select(F.lit(1).alias("rank"), "topic_id", "topic_name", "topic_summary", "primary_project"))
    first = lambda c: F.min_by(c, "rank").alias(c)
    names = named.groupBy("topic_id").agg(first("topic_name"), first("topic_summary"), first("primary_project"))
    held = topics.select(F.col("topic_id").alias("below"), "session_ids")
    members = pairs.join(shuffled(held), "below").unionByName(stays.select(F.col("topic_id").alias("below"), "topic_id", F.lit(1 << 30).alias("i"), "session_ids"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "below", "session_ids"))), lambda x: x["session_ids"]))
    return names.join(shuffled(members.groupBy("topic_id").agg(F.array_distinct(ordered).alias("session_ids"))), "topic_id").select(
        "topic_id", "topic_name", "topic_summary", "session_ids", "primary_project")


def with_protected(clusters: DataFrame, protected: DataFrame, existing: DataFrame, project: str = "") -> DataFrame:
    """Protected topics (topic_id) that no cluster has but that exist (topic_id, summary), as clusters without sessions."""
    lost = protected.select("topic_id").distinct().join(clusters.select("topic_id"), "topic_id", "left_anti").join(existing, "topic_id")
    return clusters.unionByName(lost.select(
        "topic_id", F.col("topic_id").alias("topic_name"), F.col("summary").alias("topic_summary"), F.array().cast("array<string>").alias("session_ids"), F.lit(project).alias("primary_project")))


def unclustered(trajectories: DataFrame, clusters: DataFrame) -> DataFrame:
    return trajectories.join(shuffled(clusters.select(F.explode("session_ids").alias("session_id")).distinct()), "session_id", "left_anti")


def topic_members(trajectories: DataFrame, clusters: DataFrame) -> DataFrame:
    """(topic_id, trajectory) pairs; a session may be in several topics, once in each."""
    ids = clusters.select("topic_id", F.explode(F.array_distinct("session_ids")).alias("session_id"))
    return trajectories.join(shuffled(ids), "session_id")


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over those of the group that come earlier in ``order``.

    In two steps, by range of (group, order) and then within it: sums of whole
    partitions are added to those within one, so a group is never in one task.
    """
    scratch = scratch or Scratch(rows.sparkSession, "sums")
    by = [*group, *order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # Range bounds are sampled anew whenever a plan runs: only a table gives both steps the same partitions.
    spread = scratch.save(spread.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    spread = spread.withColumn("_part", F.shiftright("_at", 33))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition of each group.
    sums = spread.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*group).orderBy("_part"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_part", *group).orderBy("_at"))), F.lit(0))
    placed = spread.withColumn("_inside", inside).join(shuffled(sums), [*group, "_part"])
    return placed.withColumn("before", F.col("_before") + F.col("_inside")).drop("_at", "_part", "_before", "_inside")


def topic_inputs(members: DataFrame, most_chars: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``good`` and ``bad`` texts of every topic: of successes, and of failures and partial ones, in order of ``pos``.

    Topics without any labelled session are left out. With ``most_chars`` the
    texts of either kind end after the first one that reaches so many
    characters: the prompt they are for is cut there in any case, so a topic of
    very many sessions never meets whole. Where to end is found from the texts'
    lengths alone.
    """
    good, bad = F.col("label") == "success", F.col("label").isin("failure", "partial")
    rows = members.withColumn("good", F.when(good, True).when(bad, False)).where("good is not null").withColumn("t", trajectory_text())
    rows = rows.select("topic_id", "good", "pos", "t")
    if most_chars:
        scratch = scratch or Scratch(members.sparkSession, "topics")
        rows = scratch.save(rows, "texts")
        lengths = rows.select("topic_id", "good", "pos", (F.length("t") + 5).alias("n"))
        read = running_sums(lengths, ["topic_id", "good"], ["pos"], "n", scratch).where(F.col("before") <= most_chars)
        rows = rows.join(shuffled(read.select("topic_id", "good", "pos")), ["topic_id", "good", "pos"], "left_semi")

    def text(keep: Column) -> Column:
        found = F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "t"))))
        return F.array_join(F.transform(found, lambda x: x["t"]), "\n---\n")

    return rows.groupBy("topic_id").agg(text(F.col("good")).alias("good"), text(~F.col("good")).alias("bad"))
