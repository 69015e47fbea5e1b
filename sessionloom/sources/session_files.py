"""Sessions in JSON files, ``<folder>/<short id>/session.json``.

Files are read whole and parsed by Spark as VARIANT, once for each state of a
file: what was parsed is kept in a table by path and time of change, and only
files that are new or changed are read again. A corrupt file gives a row whose
``data`` is null and which no table below shows.
"""

from __future__ import annotations

import fnmatch
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_to_ms
from ..joins import shuffled
from ..scratch import Scratch
from ..storage import Store, local

# Fixed values of the file format.
KIND_KEY = "_chrys_kind"
FINISH = {"turn": "stop", "interrupted": "error"}
SHORT_ID = 12

#: Bytes of files that a worker hands to Spark at a time; one file may have more.
BATCH_BYTES = 8 << 20
#: Files that a task reads.
TASK_FILES = 2000
#: Names that a task hands to Spark at a time.
LIST_ROWS = 10_000

LISTED = "path string, modified timestamp, batch string"
PARSED = "path string, modified timestamp, dir_name string, session_id string, updated_ms long, data variant"


def _text(v: Column | str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _file_system(path: str):
    """The store of a full path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + local(path) if path.startswith("file:") else path)


def _entries(pattern: str, last: bool):
    """Of listed folders (path) what matches a segment of the pattern: files with their times, or folders."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        plain = not any(x in pattern for x in "*?[")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _file_system(path)
                found = store.get_file_info([f"{name}/{pattern}"] if plain else fs.FileSelector(name, allow_not_found=True))
                kind = fs.FileType.File if last else fs.FileType.Directory
                # As Spark's readers, pass over files whose names begin so.
                found = [x for x in found if x.type == kind and fnmatch.fnmatchcase(x.base_name, pattern) and not (last and x.base_name[0] in "._")]
                for lo in range(0, len(found), LIST_ROWS):
                    some = found[lo : lo + LIST_ROWS]
                    times = pa.array([x.mtime_ns // 1_000_000 for x in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{x.base_name}" for x in some], pa.string()), times], names=["path", "ms"])

    return entries


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of listed files; one that is gone by now gives no row."""
    names = ["path", "modified", "value"]
    for batch in batches:
        rows, size = [], 0
        for path, modified in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            try:
                store, name = _file_system(path)
                with store.open_input_stream(name) as f:
                    raw = f.read()
            except FileNotFoundError:
                continue
            rows.append((path, modified, raw.decode("utf-8", "replace")))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield _batch(rows, names, batch.schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, names, batch.schema)


def _batch(rows: list[tuple], names: list[str], given: pa.Schema) -> pa.RecordBatch:
    kinds = [given.field(0).type, given.field(1).type, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class SessionFiles:
    """Sessions of one folder. ``kept`` is the folder of what was parsed, for later runs; by default this object's own.

    In ``kept`` lie the parsed files of each time that some were new, and
    listings, tables of which files there were and in which of those parts each
    is. A reader goes by one listing, whatever others add meanwhile; two that
    read the same new files at once both parse them, and the later listing stands.
    """

    strict_since = False

    def __init__(self, spark: SparkSession, folder: str, pattern: str = "*/session.json", kept: str | None = None):
        self.spark, self.folder, self.pattern, self._kept = spark, folder.rstrip("/"), pattern, kept

    @property
    def kept(self) -> Store:
        self._kept = self._kept or Scratch(self.spark, "session_files").root
        return Store(self.spark, self._kept)

    def _listed(self) -> DataFrame:
        """path and modified of the files that are there now; none is opened. A folder without any gives no row, a missing one is an error.

        Tasks list them, one for the folder itself and several for those below
        it: a glob of Spark's readers is a job of a task for each file, whose
        results all go to the driver.
        """
        store = Store(self.spark, self.folder)
        if not store.exists():
            self.spark.read.text(self.folder)  # the error of Spark's readers
        rows = self.spark.range(1, numPartitions=1).select(F.lit(store.root).alias("path"))
        *folders, name = self.pattern.split("/")
        for folder in folders:
            rows = rows.mapInArrow(_entries(folder, False), "path string, ms long").select("path").repartition(self.spark.sparkContext.defaultParallelism, "path")
        return rows.mapInArrow(_entries(name, True), "path string, ms long").select("path", F.timestamp_millis("ms").alias("modified"))

    def refresh(self) -> dict:
        """Parse what is new or changed since the latest listing: {"listing": its path, "parts": {part: its rows}}."""
        kept = self.kept
        held = json.loads(kept.read("latest") or '{"listing": null, "parts": {}}')
        before = self.spark.read.schema(LISTED).parquet(kept.path(held["listing"])) if held["listing"] else self.spark.createDataFrame([], LISTED)
        name = uuid.uuid4().hex
        listing = f"listings/{name}"
        self._listed().join(shuffled(before), ["path", "modified"], "left").select("path", "modified", F.coalesce("batch", F.lit(name)).alias("batch")).write.parquet(kept.path(listing))
        listed = self.spark.read.schema(LISTED).parquet(kept.path(listing))
        alive = {r["batch"]: r["count"] for r in listed.groupBy("batch").count().collect()}
        if new := alive.get(name):
            rows = listed.where(F.col("batch") == name).select("path", "modified").repartition(-(-new // TASK_FILES), "path")
            texts = rows.mapInArrow(_read, "path string, modified timestamp, value string")
            data = texts.select("path", "modified", F.element_at(F.split("path", "/"), -2).alias("dir_name"), F.try_parse_json("value").alias("data"))
            found = _text("data", "$.meta.session_id")
            data.select(
                "path", "modified", "dir_name", F.when(found != "", found).otherwise(F.col("dir_name")).alias("session_id"),
                iso_to_ms(_text("data", "$.meta.updated_at")).alias("updated_ms"), "data").write.parquet(kept.path(f"parts/{name}"))
        elif held["listing"] and alive == held["alive"]:
            kept.delete(listing)
            return held
        now = {"listing": listing, "alive": alive, "parts": {p: held["parts"].get(p, n) for p, n in alive.items()}}
        kept.replace("latest", json.dumps(now))
        return now

    def raw(self) -> DataFrame:
        """path, modified, dir_name, session_id, updated_ms and the file as VARIANT.

        Parts all of whose files are still as they were are read as they are; of
        others the files that changed or went are left out by a join.
        """
        now, kept = self.refresh(), self.kept
        if not now["parts"]:
            return self.spark.createDataFrame([], PARSED)
        read = lambda names: self.spark.read.schema(PARSED).parquet(*[kept.path(f"parts/{p}") for p in names])
        whole = [p for p, n in now["parts"].items() if now["alive"][p] == n]
        rest = [p for p in now["parts"] if p not in whole]
        rows = read(whole) if whole else None
        if rest:
            listed = self.spark.read.schema(LISTED).parquet(kept.path(now["listing"])).where(F.col("batch").isin(rest)).select("path", "modified")
            some = read(rest).join(shuffled(listed), ["path", "modified"], "left_semi")
            rows = rows.unionByName(some) if rows else some
        return rows

    def resolve(self, session_id: str) -> DataFrame:
        """The one file of an id: that in the folder of its short id, else that which names it."""
        both = self.raw().where((F.col("dir_name") == session_id[:SHORT_ID]) | (F.col("session_id") == session_id)).where("data is not null")
        return both.orderBy((F.col("dir_name") != session_id[:SHORT_ID]).cast("int"), "dir_name").limit(1)

    def full_id(self, given: str) -> str:
        found = self.resolve(given).select("session_id").first()
        return found["session_id"] if found else given

    def _meta(self) -> DataFrame:
        return self.raw().where(F.try_variant_get("data", "$.meta", "variant").isNotNull())

    def _contents(self) -> DataFrame:
        """A row for each content of each message."""
        messages = self._meta().select("session_id", F.posexplode_outer(F.try_variant_get("data", "$.state.messages", "array<variant>")).alias("msg_idx", "m")).where("m is not null")
        return messages.select("session_id", "msg_idx", F.posexplode(F.coalesce(F.try_variant_get("m", "$.contents", "array<variant>"), F.array().cast("array<variant>"))).alias("part_idx", "c"))

    def results(self, contents: DataFrame | None = None) -> DataFrame:
        """The last result of every call id; with ``contents`` of those, without another listing."""
        c = (self._contents() if contents is None else contents).where(F.try_variant_get("c", "$.type", "string") == "function_result")
        c = c.select("session_id", "msg_idx", "part_idx", _text("c", "$.call_id").alias("call_id"), _result(F.col("c")).alias("r")).where("call_id <> ''")
        return c.groupBy("session_id", "call_id").agg(F.max_by("r", F.struct("msg_idx", "part_idx")).alias("r"))

    def table(self, name: str) -> DataFrame:
        return {"sessions": self._sessions, "messages": self._messages, "parts": self._parts}[name]()

    def _sessions(self) -> DataFrame:
        return self._meta().select(
            "session_id", _text("data", "$.meta.title").alias("title"), _text("data", "$.meta.primary_cwd").alias("directory"),
            iso_to_ms(_text("data", "$.meta.created_at")).alias("created_ms"), "updated_ms")

    def _messages(self) -> DataFrame:
        rows = self._meta().select("session_id", iso_to_ms(_text("data", "$.meta.created_at")).alias("created_ms"), F.posexplode(F.try_variant_get("data", "$.state.messages", "array<variant>")).alias("msg_idx", "m"))
        return rows.select(
            "session_id", "msg_idx", _text("m", "$.role").alias("role"), "created_ms", finish_of(_text("m", f"$.additional_properties.{KIND_KEY}")).alias("finish"),
            F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("tokens_total"))

    def _parts(self) -> DataFrame:
        contents = self._contents()
        c = contents.withColumn("kind", _text("c", "$.type")).where(F.col("kind").isin("text", "function_call")).withColumn("call_id", _text("c", "$.call_id"))
        paired = c.join(shuffled(self.results(contents)), ["session_id", "call_id"], "left")
        call = F.col("kind") == "function_call"
        empty, none = F.lit(""), F.array().cast("array<string>")
        return paired.select(
            "session_id", "msg_idx", "part_idx", F.when(call, "tool").otherwise("text").alias("type"), F.when(call, empty).otherwise(_text("c", "$.text")).alias("text"),
            F.when(call, _text("c", "$.name")).otherwise(empty).alias("tool"), "call_id",
            F.when(F.col("r.present"), "completed").when(call, "pending").otherwise(empty).alias("status"),
            F.when(call, arguments(F.col("c"))).alias("input_json"), F.when(call, F.coalesce(F.col("r.value"), empty)).alias("output"),
            empty.alias("hash"), none.alias("files"), empty.alias("prompt"), empty.alias("description"), empty.alias("agent"))

    def project_filter(self, df: DataFrame, project: str) -> DataFrame:
        """The last segment of the directory contains ``project``, whatever the case."""
        from ..functions.text import project_name

        return df.where(F.contains(F.lower(project_name(F.col("directory"), "")), F.lit(project.lower())))


def _result(c: Column) -> Column:
    """(present, value): a missing result is an empty one, an explicit null is none."""
    text = F.try_variant_get(c, "$.result", "string")
    shape = F.schema_of_variant(c)
    missing = ~F.contains(shape, F.lit("result:"))
    return F.struct((missing | text.isNotNull()).alias("present"), F.when(missing, "").otherwise(text).alias("value"))


def arguments(c: Column) -> Column:
    """A call's arguments as JSON text: strings are parsed, and wrapped as ``raw`` if they are no JSON."""
    as_text = F.try_variant_get(c, "$.arguments", "string")
    is_text = F.schema_of_variant(F.try_variant_get(c, "$.arguments", "variant")) == "STRING"
    parsed = F.when(F.try_parse_json(as_text).isNotNull(), as_text).otherwise(F.to_json(F.struct(as_text.alias("raw"))))
    return F.when(is_text, parsed).otherwise(F.coalesce(as_text, F.lit("{}")))


def finish_of(kind: Column) -> Column:
    out = F.lit("")
    for value, finish in FINISH.items():
        out = F.when(kind == value, finish).otherwise(out)
    return out

