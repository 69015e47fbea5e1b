"""Skills, index, knowledge and trajectories as files.

Texts are rendered by Spark. Skills are few, one row a topic: the driver takes
one after the other and writes its file, to the store that Spark reads them
from. One-row documents are put together by ordered aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_body, frontmatter_description, percent, skill_markdown
from ..joins import shuffled
from ..schemas import TRAJECTORIES
from ..storage import Store


def _safe(name: str) -> str:
    """A name as one path segment."""
    return name.replace("/", "-").replace("\\", "-") or "all"


def put(path: str, content: str) -> str:
    """Write a file to the store of its path; a reader sees the old one or the new one."""
    folder, name = path.rsplit("/", 1)
    Store(SparkSession.active(), folder).replace(name, content)
    return path


def rendered(skills: DataFrame) -> DataFrame:
    return skills.select("topic_id", skill_markdown(*[F.col(c) for c in ("topic_id", "skill_title", "description", "summary", "body")]).alias("content"))


def read_skills(spark: SparkSession, output: str, project: str) -> DataFrame:
    """topic_id and content of the written skills of a project."""
    folder = Store(spark, f"{output}/{_safe(project)}")
    if not any(folder.exists(f"{x}/SKILL.md") for x in folder.names()):
        return spark.createDataFrame([], "topic_id string, content string")
    rows = spark.read.text(f"{folder.root}/*/SKILL.md", wholetext=True)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("topic_id"), F.col("value").alias("content"))


def existing_topics(spark: SparkSession, output: str, project: str) -> DataFrame:
    """topic_id and summary of the written skills; the id where a skill has no description."""
    found = frontmatter_description(F.col("content"))
    return read_skills(spark, output, project).select("topic_id", F.when(found == "", F.col("topic_id")).otherwise(found).alias("summary"))


def write_skills(skills: DataFrame, output: str, project: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str]:
    """A SKILL.md for each topic. With ``merge`` those that exist are joined with the new body.

    ``merge`` takes rows with current_body and new_body and adds merged_body and
    merged_description, null where it failed.
    """
    if merge:
        old = read_skills(skills.sparkSession, output, project).select("topic_id", extract_body(F.col("content")).alias("current_body"))
        both = skills.join(old, "topic_id", "left")
        new = F.when(F.length("body") > 8000, F.concat(F.substring("body", 1, 8000), F.lit("\n...[truncated]"))).otherwise(F.col("body"))
        done = merge(both.where("current_body is not null").withColumn("new_body", new))
        done = done.select(*[c for c in skills.columns if c not in ("body", "description")], F.coalesce("merged_body", "current_body").alias("body"), F.coalesce("merged_description", "description").alias("description"))
        skills = both.where("current_body is null").select(skills.columns).unionByName(done)
    root = f"{output}/{_safe(project)}"
    return {r["topic_id"]: put(f"{root}/{_safe(r['topic_id'])}/SKILL.md", r["content"]) for r in rendered(skills).toLocalIterator()}


def _listed(df: DataFrame, line: Column) -> str:
    """One text of a line for each row, by topic_id."""
    rows = F.array_sort(F.collect_list(F.struct("topic_id", line.alias("l"))))
    return df.agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n")).first()[0]


def write_index(skills: DataFrame, output: str, project: str, date: str) -> str:
    entry = F.concat(
        F.lit("## ["), "skill_title", F.lit("]("), "topic_id", F.lit("/SKILL.md)\n\n"), "description", F.lit("\n\n- 类型: "), "skill_type",
        F.lit("\n- 规则数: "), F.size("rules").cast("string"), F.lit("\n- 来源会话: "), F.size("source_sessions").cast("string"), F.lit(" 个\n"))
    head = f"# {project} — 技能索引\n\n共 {skills.count()} 个技能主题 | 更新时间: {date}\n\n"
    return put(f"{output}/{_safe(project)}/_index.md", f"{head}{_listed(skills, entry)}\n---\n由 sessionloom 自动生成")


def rule_line(r: Column) -> Column:
    extra = lambda c, before, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    return F.concat(
        F.lit("- **["), r["type"], F.lit("]** "), r["action"], F.lit(" — "), percent(r["confidence"]).cast("string"), F.lit("%"),
        F.when(r["scope"] != "general", extra(r["scope"], " | ")).otherwise(""), extra(r["condition"], " (when: ", ")"),
        extra(F.get(r["evidence_from_success"], 0), " ← "), extra(F.get(r["evidence_from_failure"], 0), " ✗ "))


def write_knowledge(skills: DataFrame, output: str, project: str, date: str) -> str:
    """All topics and their rules in one file."""
    sums = skills.agg(F.count("*").alias("n"), F.sum(F.size("rules")).alias("r"), F.sum(F.size("source_sessions")).alias("s")).first()
    toc = _listed(skills, F.concat(F.lit("**"), "skill_title", F.lit("** ("), F.size("rules").cast("string"), F.lit(" points)"))).split("\n")
    some = lambda c, after: F.when(F.col(c) != "", F.concat(F.col(c), F.lit(after))).otherwise("")
    rules = F.array_join(F.transform("rules", rule_line), "\n")
    body = F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise("")
    entry = F.concat(F.lit("---\n\n## "), "skill_title", F.lit("\n\n"), some("summary", "\n\n"), F.when(F.size("rules") == 0, "*(no knowledge points)*").otherwise(F.concat(rules, body)), F.lit("\n"))
    head = f"# Knowledge — {project}\n\n> {date} | {sums['n']} topics | {sums['r'] or 0} points | {sums['s'] or 0} sessions\n\n"
    numbered = "\n".join(f"{i}. {x}" for i, x in enumerate(toc, 1))
    return put(f"{output}/{_safe(project)}_knowledge.md", f"{head}{numbered}\n\n{_listed(skills, entry)}\n---")


def write_trajectories(trajectories: DataFrame, output: str, project: str, date: str, run: str) -> str:
    """JSON lines under the project, the day and the run: runs of a day stay beside each other, a repeated run replaces its own."""
    path = f"{output}/trajectories/project={_safe(project)}/day={date}/run={_safe(run)}"
    trajectories.withColumn("mined_ms", F.unix_millis(F.current_timestamp())).write.mode("overwrite").json(path)
    return path


def read_trajectories(spark: SparkSession, output: str) -> DataFrame:
    """The written trajectories with project, day and run: of a session that several runs mined, the last one's."""
    if not Store(spark, f"{output}/trajectories").names():
        return spark.createDataFrame([], f"{TRAJECTORIES}, mined_ms long, day string, run string")
    # Folder names would be read as dates and numbers: the schema says that they are text.
    rows = spark.read.schema(f"{TRAJECTORIES}, mined_ms long, day string, run string").json(f"{output}/trajectories")
    last = rows.groupBy("session_id").agg(F.max(F.struct("mined_ms", "run")).alias("last"))
    return rows.join(shuffled(last), "session_id").where((F.col("mined_ms") == F.col("last.mined_ms")) & (F.col("run") == F.col("last.run"))).drop("last")
