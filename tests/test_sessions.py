"""Sources, pairing, blocks, labels, topics and whole runs on small stores."""

import hashlib
import itertools
import json
import os
import re
import shutil
import sqlite3
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom import run_queries, scratch
from sessionloom.operators import sessions as S
from sessionloom.operators import topics as P
from sessionloom.plans.analysis import FieldClusters, ModelClusters, distil
from sessionloom.plans.merging import model_merge
from sessionloom.plans.mining import Models
from sessionloom.plans.pipeline import Pipeline, Settings
from sessionloom.providers import ContextOverflow, Reply, RuleProvider, call_model
from sessionloom.providers.calls import ask, identity
from sessionloom.providers.http import HttpProvider, bypass_patterns, parse_reply
from sessionloom.providers.log import PromptLog
from sessionloom.scratch import Scratch
from sessionloom.sinks import files
from sessionloom.sinks import report as reports
from sessionloom.sinks import state as states
from sessionloom.sinks.state import StateStore
from sessionloom.sources import create_source
from sessionloom.schemas import SESSIONS
from sessionloom.sources import sqlite
from sessionloom.sources.session_files import SessionFiles
from sessionloom.sources.sqlite import _Changes, _Reader
from sessionloom.storage import Store, WorkerStore

# Workers cannot import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DDL = """
CREATE TABLE session(id TEXT PRIMARY KEY, title TEXT, directory TEXT, time_created INT, time_updated INT);
CREATE TABLE message(id TEXT PRIMARY KEY, session_id TEXT, time_created INT, data TEXT);
CREATE TABLE part(id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INT, data TEXT);
"""


def text(t):
    return {"type": "text", "text": t}


def tool(name, inp, out, status="completed"):
    return {"type": "tool", "tool": name, "callID": "c", "state": {"status": status, "input": inp, "output": out}}


TALK = [
    ("user", [text("add a parser")]),
    ("assistant", [{"type": "reasoning", "text": "First. Second."}, text("on it"), tool("bash", {"command": "ls"}, "a\nb"), tool("todowrite", {}, "x")]),
    ("user", [text("now test it")]),
    ("assistant", [text("done"), tool("read", {"filePath": "p"}, "one\ntwo"), tool("other", {"k": True}, "o"), {"type": "patch", "hash": "abcdef123456", "files": ["f.py"]}]),
    ("user", [text("and ship")]),
    ("assistant", [text("shipped"), tool("bash", {"command": "x"}, "fatal error")]),
]


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s.db")
    db = sqlite3.connect(path)
    db.executescript(DDL)
    for k, sid in enumerate(("s-one", "s-two", "s-three")):
        db.execute("INSERT INTO session VALUES (?,?,?,?,?)", (sid, f"Title {k}", ["/w/My_Project/", "C:\\w\\my_project", "/w/other%"][k], 1000, 2000 + k))
        for i, (role, parts) in enumerate(TALK if k < 2 else TALK[:2]):
            info = {"role": role, "time": {"created": 60000 * i}, "finish": "stop" if role == "assistant" else "", "tokens": {"total": 10}}
            if k == 1 and i == 5:
                info["error"] = {"data": {"message": "boom"}}
            db.execute("INSERT INTO message VALUES (?,?,?,?)", (f"{sid}-{i}", sid, i, json.dumps(info)))
            for j, p in enumerate(parts):
                db.execute("INSERT INTO part VALUES (?,?,?,?,?)", (f"{sid}-{i}-{j}", f"{sid}-{i}", sid, j, json.dumps(p)))
    db.commit()
    db.close()
    return path


def test_sqlite_source(spark, store):
    src = create_source(spark, "SQLite", store)
    listed = S.listing(src.table("sessions"), src.table("messages"), src).collect()
    assert [(r["session_id"], r["project"], r["msg_count"]) for r in listed] == [("s-three", "other%", 2), ("s-two", "my_project", 6), ("s-one", "My_Project", 6)]
    ids = lambda **k: {r["session_id"] for r in S.listing(src.table("sessions"), src.table("messages"), src, **k).collect()}
    assert ids(project="MY_project") == {"s-one", "s-two"} and ids(project="%") == {"s-three"} and ids(project="w\\my") == {"s-two"}
    assert ids(since_ms=2001) == {"s-three"} and ids(since_ms=0) == {"s-one", "s-two", "s-three"} and ids(until_ms=2000) == {"s-one"}
    counts = {r["session_id"]: r["tool_count"] for r in S.tool_counts(src.table("parts")).collect()}
    assert counts == {"s-one": 5, "s-two": 5, "s-three": 2}
    with pytest.raises(Exception, match="no session store"):
        create_source(spark, "sqlite", store + ".none").table("sessions").count()
    with pytest.raises(ValueError, match="unknown source"):
        create_source(spark, "csv", store)


def test_what_sqlite_reads(spark, store):
    src = create_source(spark, "sqlite", store)
    sessions = src.table("sessions")
    rows = {r["session_id"]: r["updated_ms"] for r in sessions.collect()}
    last = max(rows.values())
    # A filter is of its own query only.
    assert sessions.where(F.col("updated_ms") >= last).count() == 1 and sessions.count() == len(rows) == sessions.where("updated_ms > 0").count()
    assert [r["session_id"] for r in src.bounded("sessions", last).collect()] == [k for k, v in rows.items() if v == last]
    for name in ("sessions", "messages", "parts"):
        one = src.bounded(name, session="s-two")
        assert {r["session_id"] for r in one.collect()} == {"s-two"} and one.exceptAll(src.table(name).where("session_id = 's-two'")).isEmpty()
        assert one.count() == src.table(name).where("session_id = 's-two'").count() and src.bounded(name, session="none").isEmpty()
    reader = _Reader({"path": store, "table": "parts", "session": "s-two"})
    assert {x for p in reader.partitions() for b in reader.read(p) for x in b.column("session_id").to_pylist()} == {"s-two"}


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(sqlite, "BATCH_CHARS", 100)
    rows = [(f"{i:010d}", "x" * 20, None, i, 0) for i in range(10)]
    got = list(sqlite._batches(iter(rows), SESSIONS))
    assert [b.num_rows for b in got] == [4, 4, 2] and [tuple(r.values()) for b in got for r in b.to_pylist()] == rows and not list(sqlite._batches(iter([]), SESSIONS))


def test_compression(spark, store):
    src = create_source(spark, "sqlite", store)
    m, p = src.table("messages"), src.table("parts")
    lines = S.block_lines(m.where("session_id = 's-two'"), S.compress_parts(p.where("session_id = 's-two'")))
    got = [r["line"] for r in lines.orderBy("msg_idx", "rank", "part_idx").collect()]
    assert got == [
        "[USER] add a parser", "[ASSISTANT] on it", "[THOUGHT] First. Second.", "[TOOL] $ ls  [OK]\na\nb", "[USER] now test it", "[ASSISTANT] done",
        "[TOOL] Read(p) → 2 lines. Starts with: one", "[TOOL] other({'k': True}) → o", "[PATCH] abcdef12 ['f.py']", "[USER] and ship", "[ASSISTANT] shipped", "[TOOL] $ x  [ERR]\nfatal error", "[ERROR] boom"]
    r = {x["session_id"]: x for x in S.rollup(m, p).collect()}
    assert (r["s-two"]["has_errors"], r["s-two"]["has_patches"], r["s-two"]["last_finish"], r["s-two"]["total_tokens"], r["s-one"]["has_errors"]) == (True, True, "stop", 30, False)


def test_session_files(spark, tmp_path):
    call = lambda i, args: {"type": "function_call", "call_id": i, "name": "bash", "arguments": args}
    result = lambda i, **k: {"type": "function_result", "call_id": i, **k}
    messages = [
        {"role": "user", "contents": [text("go")]},
        {"role": "assistant", "additional_properties": {"_chrys_kind": "turn"}, "contents": [call("a", '{"command": "ls"}'), call("b", "not json"), call("c", {"command": "x"}), call("d", "{}"), {"type": "image"}]},
        {"role": "tool", "contents": [result("a", result="one"), result("a", result="two"), result("b"), result("c", result=None), result("", result="lost")]},
    ]
    meta = {"session_id": "abcdefghijkl-long", "title": "T", "primary_cwd": "/x/proj", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-02T00:00:00Z"}
    for name, body in (("abcdefghijkl", json.dumps({"meta": meta, "state": {"messages": messages}})), ("bad", "{oops"), ("bare", json.dumps({"meta": {"title": "no id"}}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(body.replace('", "', '",\n "'))
    (tmp_path / "empty").mkdir()
    src = create_source(spark, "files", str(tmp_path))
    assert {(r["session_id"], r["updated_ms"]) for r in src.table("sessions").collect()} == {("abcdefghijkl-long", 1704153600000), ("bare", 0)}
    got = {r["call_id"]: (r["status"], r["output"], r["input_json"]) for r in src.table("parts").where("type = 'tool'").collect()}
    assert got == {"a": ("completed", "two", '{"command": "ls"}'), "b": ("completed", "", '{"raw":"not json"}'), "c": ("pending", "", '{"command":"x"}'), "d": ("pending", "", "{}")}
    assert [r["finish"] for r in src.table("messages").orderBy("msg_idx").collect()] == ["", "stop", ""]
    assert [src.full_id(x) for x in ("abcdefghijkl", "abcdefghijkl-long", "nothing")] == ["abcdefghijkl-long", "abcdefghijkl-long", "nothing"]
    assert src.resolve("abcdefghijkl-long").count() == 1 and src.resolve("nothing").count() == 0
    assert S.listing(src.table("sessions"), src.table("messages"), src, project="PROJ", since_ms=1704153600000).count() == 1


def test_session_files_are_parsed_once(spark, tmp_path):
    folder, kept = tmp_path / "files", str(tmp_path / "kept")

    def put(name, title, at):
        (folder / name).mkdir(parents=True, exist_ok=True)
        path = folder / name / "session.json"
        path.write_text(json.dumps({"meta": {"session_id": f"id {name}", "title": title, "updated_at": "2024-01-02T00:00:00Z"}}))
        os.utime(path, (at, at))

    def titles(source):
        return sorted((r["session_id"], r["title"]) for r in source.table("sessions").collect())

    parts = lambda: {p: n for p, n in source.refresh()["parts"].items()}
    for i in range(5):
        put(f"s{i}", "first", 1000 + i)
    source = create_source(spark, "files", str(folder), kept)
    assert titles(source) == [(f"id s{i}", "first") for i in range(5)]
    for name in ("sessions", "messages", "parts"):
        source.table(name).count()
    assert list(parts().values()) == [5] and len(os.listdir(f"{kept}/parts")) == 1
    before = source.table("sessions")
    put("s1", "second", 2000)
    put("older", "late", 10)  # came with an old time of change
    shutil.rmtree(folder / "s2")
    later = create_source(spark, "files", str(folder), kept)
    assert titles(later) == [("id older", "late"), ("id s0", "first"), ("id s1", "second"), ("id s3", "first"), ("id s4", "first")]
    assert sorted(parts().values()) == [2, 5] and len(os.listdir(f"{kept}/parts")) == 2
    # A table that was begun goes by its own listing.
    assert before.count() == 5
    plan = later.table("sessions").where("updated_ms >= 5")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*updated_ms", plan)


def test_a_folder_without_session_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "session.json").write_text("{}")
    source = create_source(spark, "files", str(tmp_path))
    assert [source.table(x).count() for x in ("sessions", "messages", "parts")] == [0, 0, 0]
    (tmp_path / "a" / "session.json").unlink()
    assert [source.table(x).count() for x in ("sessions", "messages", "parts")] == [0, 0, 0]


def test_many_session_files_are_few_tasks(spark, tmp_path):
    """Listing and reading take tasks by what is read, not one for each file; hidden files and folders of the name are none."""
    (tmp_path / "x").mkdir()
    for i in range(300):
        (tmp_path / f"f/d{i}").mkdir(parents=True)
        (tmp_path / f"f/d{i}/session.json").write_text(json.dumps({"meta": {"session_id": f"s{i}"}}))
        (tmp_path / f"x/x{i}.json").write_text(json.dumps({"info": {"id": f"s{i}"}, "messages": []}))
    (tmp_path / "f/d0/_session.json").write_text("{}")
    (tmp_path / "f/e/session.json").mkdir(parents=True)
    (tmp_path / "x/deep").mkdir()
    (tmp_path / "x/deep/y.json").write_text(json.dumps({"info": {"id": "deep"}, "messages": []}))
    (tmp_path / "x/_z.json").write_text(json.dumps({"info": {"id": "hidden"}, "messages": []}))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-tasks", "")
    try:
        source = create_source(spark, "files", str(tmp_path / "f"), str(tmp_path / "kept"))
        listed = {r["path"]: r["modified"] for r in source._listed().collect()}
        assert source.table("sessions").count() == 300 and create_source(spark, "exports", str(tmp_path / "x")).table("sessions").count() == 300
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) < 100
    # Paths and times are those of Spark's own readers, which earlier listings hold.
    theirs = spark.read.format("binaryFile").load(str(tmp_path / "f/d*/session.json")).select("path", "modificationTime").collect()
    assert listed == {r["path"]: r["modificationTime"] for r in theirs} and len(listed) == 300


def test_parts_take_one_listing(spark, tmp_path, monkeypatch):
    """Parts and their results come of one snapshot, and a folder is made once, not for each file."""
    listings, made = [], []
    listed = SessionFiles._listed
    monkeypatch.setattr(SessionFiles, "_listed", lambda self: listings.append(1) or listed(self))
    contents = [{"type": "function_call", "call_id": "1", "name": "bash", "arguments": "{}"}, {"type": "function_result", "call_id": "1", "result": "r"}]
    store = WorkerStore(str(tmp_path))
    fs = store._fs
    store._fs = SimpleNamespace(open_output_stream=fs.open_output_stream, create_dir=lambda path, recursive: made.append(path) or fs.create_dir(path, recursive=recursive))
    for name in "ab":
        store.put(f"new/{name}.json", json.dumps({"meta": {"session_id": name}, "state": {"messages": [{"role": "assistant", "contents": contents}]}}).encode())
    parts = SessionFiles(spark, str(tmp_path / "new"), "*").table("parts")
    assert sorted((r["session_id"], r["output"], r["status"]) for r in parts.collect()) == [("a", "r", "completed"), ("b", "r", "completed")]
    assert len(listings) == 1 and made == [str(tmp_path / "new")]


def test_exports(spark, tmp_path):
    messages = [{"info": {"role": r, "time": {"created": i}, "finish": "stop", "tokens": {"total": 4}} | ({"error": {"data": {"message": "boom"}}} if i == 5 else {}), "parts": p} for i, (r, p) in enumerate(TALK)]
    (tmp_path / "a.json").write_text(json.dumps({"info": {"id": "x", "title": "T", "directory": "/w/p", "time": {"created": 1, "updated": 2}}, "messages": messages}))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text("[]")
    src = create_source(spark, "exports", str(tmp_path))
    r = S.rollup(src.table("messages"), src.table("parts")).collect()
    assert [(x["session_id"], x["message_count"], x["tool_count"], x["has_patches"], x["has_errors"], x["total_tokens"]) for x in r] == [("x", 6, 5, True, True, 12)]
    lines = [x["line"] for x in S.block_lines(src.table("messages"), S.compress_parts(src.table("parts"))).orderBy("msg_idx", "rank", "part_idx").collect()]
    assert "[TOOL] other({'k': True}) → o" in lines and lines[-1] == "[ERROR] boom"
    assert S.listing(src.table("sessions"), src.table("messages"), src, project="W/P").first()["timestamp"] == 2


def test_blocks_are_slices(spark):
    n = 4
    m = spark.createDataFrame([("s", i, "user", None) for i in range(n)], "session_id string, msg_idx int, role string, error string")
    lines = S.block_lines(m, m.select("session_id", "msg_idx", F.lit(0).alias("part_idx"), F.lit("text").alias("type"), F.col("msg_idx").cast("string").alias("line")))
    ranges = list(itertools.product(range(-6, 7), repeat=2))
    blocks = spark.createDataFrame([("s", k, a, z, "") for k, (a, z) in enumerate(ranges)], "session_id string, block_id int, start int, end int, intent string")
    counts = spark.createDataFrame([("s", n)], "session_id string, message_count long")
    got = {r["block_id"]: r["content"] for r in S.block_texts(blocks, lines, counts).collect()}
    for k, (a, z) in enumerate(ranges):
        assert got[k] == "\n".join(f"[USER] {i}" for i in list(range(n))[a : z + 1]), (a, z)


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    """Small here, so Spark would send each of them around whole if it chose."""
    m = spark.createDataFrame([("s", i, "user", None, 1, "", 1) for i in range(4)], "session_id string, msg_idx int, role string, error string, created_ms long, finish string, tokens_total long")
    parts = m.select("session_id", "msg_idx", F.lit(0).alias("part_idx"), F.lit("text").alias("type"), F.lit("t").alias("text"), F.lit("t").alias("line"))
    blocks = spark.createDataFrame([("s", 1, 0, 3, "")], "session_id string, block_id int, start int, end int, intent string")
    lines, rolled, texts = S.block_lines(m, parts), S.rollup(m, parts), S.message_texts(m, parts)
    contents = S.block_texts(blocks, lines, rolled)
    mined = P.aliased(spark.createDataFrame([("a", 0), ("b", 1)], "session_id string, ts int"), [F.col("ts")])
    raw = spark.createDataFrame([(0, "x", "N", "", "p", ["s0", "b"])], "cluster_pos int, topic_id string, topic_name string, topic_summary string, primary_project string, session_ids array<string>")
    # The placing of aliases broadcasts a row for each partition.
    known = Scratch(spark, "known").save(mined, "known")
    clusters = P.resolved(raw, known)
    asked = call_model(contents.select("content"), "segment\n", "content", RuleProvider, str(tmp_path / "c"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f/session.json").write_text(json.dumps({"meta": {"session_id": "s"}, "state": {"messages": [{"role": "user", "contents": [text("t")]}]}}))
    files_parts = create_source(spark, "files", str(tmp_path), str(tmp_path / "kept")).table("parts")
    for df in (lines, rolled, texts, contents, clusters, P.unclustered(known, clusters), P.topic_members(known, clusters), asked, files_parts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert contents.first()["content"] == "\n".join(["[USER] t"] * 4) and clusters.first()["session_ids"] == ["a", "b"] and asked.count() == files_parts.count() == 1


def test_labels(spark):
    rows = []
    for patch, error, tools, stop, outcome, lessons, decisions in itertools.product((0, 1), (0, 1), (4, 5), (0, 1), ("success", "failure", ""), (0, 1), (0, 1)):
        score = 0.0
        for on, w in ((patch, 1.0), (not patch and tools >= 5, 0.8), (stop, 0.7), (error and not patch, -0.3), (error and patch, -0.8), (outcome == "success", 0.5), (outcome == "failure", -0.3), (lessons, 0.3), (decisions, 0.4)):
            score += w if on else 0.0
        rows.append((bool(patch), bool(error), tools, "stop" if stop else "", outcome, lessons, decisions, score, "success" if score >= 0.7 else "partial" if score >= 0.2 else "failure"))
    df = spark.createDataFrame(rows, "p boolean, e boolean, t int, f string, o string, l int, d int, score double, label string")
    got = df.withColumn("s", S.label_score(*[F.col(c) for c in "petfold"])).withColumn("x", S.label_of(F.col("s")))
    assert got.where("s <> score or x <> label").count() == 0
    assert got.where("p and e and t = 4 and f = '' and o = '' and l = 0 and d = 0").first()["x"] == "failure"


def test_label_reasons(spark):
    df = spark.createDataFrame([("success", ["p"], []), ("partial", ["p" * 99, "q"], ["l", "m"]), ("failure", [], ["l"]), ("failure", [], [])], "label string, p array<string>, l array<string>")
    assert [r[0] for r in df.select(S.label_reason(F.col("label"), F.col("p"), F.col("l"))).collect()] == ["", "p" * 80 + "；l", "l", S.NO_REASON]


def test_topics(spark):
    t = P.aliased(spark.createDataFrame([(x, i) for i, x in enumerate(["a", "s2", "c", "d"])], "session_id string, ts int"), [F.col("ts")])
    assert [r["alias"] for r in t.orderBy("ts").collect()] == ["s0", "s1", "s2", "s3"]
    raw = spark.createDataFrame([(0, "My Topic", "N", "", "p", ["s0", "s2", "nobody", "s0"]), (1, "my-topic", "M", "", "p", ["d"]), (2, "", "x", "", "", ["a"]), (3, "none", "x", "", "", ["nobody"])],
                                "cluster_pos int, topic_id string, topic_name string, topic_summary string, primary_project string, session_ids array<string>")
    c = P.resolved(raw, t)
    row = c.collect()
    assert len(row) == 1 and (row[0]["topic_id"], row[0]["topic_name"], row[0]["session_ids"]) == ("my-topic", "N", ["a", "c", "a", "d"])
    assert [r["session_id"] for r in P.unclustered(t, c).collect()] == ["s2"]
    kept = P.with_protected(c, spark.createDataFrame([("my-topic",), ("old",), ("lost",)], "topic_id string"), spark.createDataFrame([("old", "sum")], "topic_id string, summary string"))
    assert sorted((r["topic_id"], len(r["session_ids"])) for r in kept.collect()) == [("my-topic", 4), ("old", 0)]


def test_aliases_number_every_row(spark):
    """Wide rows at the engine's own settings: none is lost and every place is right."""
    n = 100_000
    rows = spark.range(n, numPartitions=7).selectExpr("pmod(id * 7919, 100000) as ts", "concat('s', id) as session_id", "repeat(sha2(cast(id as string), 256), 8) as wide")
    t = P.aliased(rows, [F.desc("ts"), F.col("session_id")])
    got = t.select("pos", "alias", "ts", F.length("wide").alias("w")).toPandas()
    assert len(got) == n and (got.pos == n - 1 - got.ts).all() and (got.alias == "s" + got.pos.astype(str)).all() and (got.w == 512).all()


def test_texts_of_a_topic_end_where_the_prompt_does(spark):
    members = spark.range(30).selectExpr(
        "'t' as topic_id", "id as pos", "concat('s', id) as session_id", "'k' as session_type", "if(id % 3 = 0, 'failure', 'success') as label", "repeat('w', 50) as intent",
        *[f"cast(array() as array<struct<{a}:string,{b}:string>>) as {c}" for a, b, c in (("phase", "summary", "what_happened"), ("problem", "how_resolved", "problems_encountered"), ("decision", "rationale", "key_decisions"))],
        "cast(array() as array<string>) as lessons_learned", "cast(array() as array<string>) as discoveries")
    (whole,), (some,) = P.topic_inputs(members).collect(), P.topic_inputs(members, 400).collect()
    for kind in ("good", "bad"):
        assert whole[kind].startswith(some[kind]) and 400 <= len(some[kind]) < 700
    assert whole["good"].count("### Session") == 20 and whole["bad"].count("### Session") == 10


class Flaky:
    model_name = "flaky"

    def __init__(self, *replies):
        self.replies = list(replies)

    def complete(self, *a):
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return Reply(r, 1, 1)

    def close(self):
        pass


def test_ask():
    waits = []
    assert ask(Flaky(OSError("x"), '{"a": 1}'), "s", "p", 0.2, 9, waits.append) == ('{"a": 1}', 1, 1, 2, None) and waits == [1.0]
    assert ask(Flaky("no", '{"a": 1}'), "s", "p", 0.2, 9)[0] == '{"a": 1}'
    assert ask(Flaky(ContextOverflow("long")), "s", "p", 0.2, 9)[3:] == (1, "context overflow: long")
    assert ask(Flaky("[1]", "[1]"), "s", "p", 0.2, 9)[4] == "the reply is no JSON object"
    assert "OSError" in ask(Flaky(*[OSError("x")] * 3), "s", "p", 0.2, 9, waits.append)[4]


def test_http_provider():
    with pytest.raises(ValueError, match="key"):
        HttpProvider("m", "", "http://u")
    with pytest.raises(ValueError, match="no choices"):
        parse_reply({"choices": [], "usage": {}})
    assert parse_reply({"choices": [{"message": {"content": "", "reasoning_content": "r"}}], "usage": {"prompt_tokens": 3}}) == Reply("r", 3, 0)
    assert [len(bypass_patterns(x)) for x in (r"localhost,127\.0\.0\.1", "", "localhost, , ,")] == [2, 0, 1]
    with pytest.raises(ValueError, match="invalid"):
        bypass_patterns("[invalid")


def test_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, p string")
    for _ in range(2):
        out = {r["i"]: r["calls"] for r in call_model(df, "segment\n", "p", RuleProvider, str(tmp_path / "c")).collect()}
        assert out == {1: 1, 2: 1, 3: None}
    assert spark.read.parquet(str(tmp_path / "c/replies")).count() == 1 and os.listdir(tmp_path / "c/log") == []


class Named(RuleProvider):
    model_name = "another"

    def complete(self, *a):
        return Reply('{"by": "another"}', 5, 7)


def test_models_do_not_share_replies(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "p string")
    used = []
    first, second = (call_model(df, "cluster\n", "p", f, str(tmp_path / "c"), used=lambda m, r: used.append((m, *r))).first()["response"] for f in (RuleProvider, Named))
    assert "by" not in first and second == '{"by": "another"}'
    assert [u[1] for u in used] == [1, 1] and used[0][0] != used[1][0] and used[1][2:] == (5, 7)
    call_model(df, "cluster\n", "p", Named, str(tmp_path / "c"), used=lambda m, r: used.append((m, *r)))
    assert used[2][1:] == (0, 0, 0)


class Counted(RuleProvider):
    """Writes down every call; a worker dies once at the sixth, and a first reply to ``odd`` is no JSON."""

    model_name = "counted"

    def __init__(self, folder, dies=True):
        self.folder, self.dies = folder, dies

    def complete(self, system, prompt, temperature, max_tokens):
        with open(f"{self.folder}/{len(os.listdir(self.folder)):04d}", "w") as f:
            f.write(prompt)
        if self.dies and len(os.listdir(self.folder)) == 6:
            os._exit(1)
        return Reply("no" if prompt == "p3" and "Reply with one" not in system else '{"a": 1}', 2, 3)


def test_calls_of_a_lost_worker_are_kept_and_counted(spark, tmp_path):
    folder, used = tmp_path / "calls", []
    folder.mkdir()
    df = spark.createDataFrame([(f"p{i}",) for i in range(10)], "p string")
    script = f"""
import sys; sys.path[:0] = {[os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]!r}
from sessionloom.session import get_session
from tests.test_sessions import Counted
from sessionloom.providers import call_model
spark = get_session("lost", **{{"spark.master": "local[1,4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.task.maxFailures": "4"}})
df = spark.createDataFrame([(f"p{{i}}",) for i in range(10)], "p string")
used = []
got = call_model(df, "s", "p", lambda: Counted({str(folder)!r}), {str(tmp_path / "cache")!r}, concurrency=1, used=lambda m, r: used.append(r)).collect()
assert [r["response"] for r in got] == ['{{"a": 1}}'] * 10, got
assert {{r["p"]: r["calls"] for r in got}} == {{f"p{{i}}": 2 if i == 3 else 1 for i in range(10)}}
print("USED", used[0]["calls"], used[0]["input_tokens"], used[0]["output_tokens"])
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    # Ten prompts, one of them asked again for JSON, and the call that the lost worker did not live to log.
    assert len(os.listdir(folder)) == 12 and "USED 12 22 33" in out.stdout
    # Replies that a run left in its log serve the next one, which asks and counts nothing.
    os.rename(tmp_path / "cache/replies", tmp_path / "gone")
    log = PromptLog(WorkerStore(f"file://{tmp_path}/cache/log"), "dead", (), call_key(df, "p1", lambda: Counted(str(folder))))
    log.call(0, 0, lambda: Reply('{"kept": 1}', 1, 1))
    one = call_model(df.where("p = 'p1'"), "s", "p", lambda: Counted(str(folder), False), str(tmp_path / "cache"), used=lambda m, r: used.append(r)).first()
    assert one["response"] == '{"kept": 1}' and one["calls"] == 0 and used[-1]["calls"] == 0 and len(os.listdir(folder)) == 12


def call_key(df, prompt, factory):
    parts = [identity(factory), "s", "0.2", "4096", prompt]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def test_failed_calls_are_logged(tmp_path):
    store = WorkerStore(f"file://{tmp_path}")
    flaky = Flaky(OSError("x"), ContextOverflow("long"))
    for _ in range(2):  # the second time all comes from the log
        log = PromptLog(store, "r", (), "k")
        assert ask(flaky, "s", "p", 0.2, 9, lambda s: None, log) == (None, 0, 0, 2, "context overflow: long")
    (tmp_path / "r/k/0-5-x.reply").write_text('{"cut')
    assert len(PromptLog(store, "r", (), "k").own) == 2
    # Errors of a dead run are asked again.
    assert ask(Flaky('{"a": 1}'), "s", "p", 0.2, 9, log=PromptLog(store, "new", ("r",), "k"))[0] == '{"a": 1}'


def test_a_request_lists_few_files(spark, tmp_path, monkeypatch):
    """Calls of many prompts lie in one file for so many of them; what a lost attempt left is found there, and counts once."""
    from sessionloom.providers import log as L

    seen, usage = [], L.usage
    monkeypatch.setattr("sessionloom.providers.calls.usage", lambda s, log, store: seen.append((store.names(log.request), store.names(f"{log.request}/done"))) or usage(s, log, store))
    df = spark.createDataFrame([(f"p{i}",) for i in range(300)], "p string")
    used = []
    got = call_model(df, "cluster", "p", RuleProvider, str(tmp_path / "cache"), concurrency=3, used=lambda m, r: used.append(r)).collect()
    assert len(got) == 300 and used[0]["calls"] == 300 == sum(r["calls"] for r in got)
    assert seen[0][0] == ["done"] and len(seen[0][1]) == 3
    store = WorkerStore(f"file://{tmp_path}/log")
    monkeypatch.setattr(L, "GATHERED", 2)
    reply = lambda text: (lambda: Reply(text, 1, 2))
    first = L.CallLog(f"file://{tmp_path}/log", "r").task(7)
    for k in "abcde":
        p = first.prompt(k)
        assert p.call(0, 0, reply(k))[1]
        first.close(p)
    assert len(store.names("r/done")) == 2 and store.names("r") == ["done", "e"]
    again = L.CallLog(f"file://{tmp_path}/log", "r").task(7)
    for k in "abcde":  # nothing is asked again, in whatever form it lies there
        p = again.prompt(k)
        assert p.call(0, 0, reply("no"))[0].text == k and p.made == 1
        again.close(p)
    again.gather()
    assert store.names("r") == ["done"]
    # A folder that was gathered but not yet deleted, a call that never ended, and a cut line.
    store.write("r/e/0-0-twice.begun", {"name": "0-0"})
    e = next(x for n in store.names("r/done") for x in store.read_lines(f"r/done/{n}") if x["key"] == "e")
    store.write(f"r/e/{e['at']}.begun", {"name": "0-0"})
    (tmp_path / "log/r/done/7-f-f-x.json").write_text('{"key": "f", "at"')
    sums = usage(spark, L.CallLog(f"file://{tmp_path}/log", "r"), Store(spark, f"file://{tmp_path}/log"))
    assert (sums["calls"], sums["input_tokens"], sums["output_tokens"]) == (6, 5, 10)
    later = L.CallLog(f"file://{tmp_path}/log", "s", ("r",)).task(0)
    assert later.prompt("c").call(0, 0, reply("no"))[0].text == "c" and later.prompt("x").call(0, 0, reply("new"))[0].text == "new"


class NoSkill(RuleProvider):
    model_name = "mute"

    @staticmethod
    def _distil(prompt):
        return {}


def test_usage_and_failed_topics(spark, store, tmp_path):
    src = create_source(spark, "sqlite", store)
    models = Models(RuleProvider, NoSkill, str(tmp_path / "cache"), 2)
    run = Pipeline(spark, src, models, Settings(str(tmp_path / "o"), str(tmp_path / "w"), today="d"))
    report = run.run()
    calls = {r["task"]: r["calls"] for r in report.usage}
    # Two sessions of three user messages each: a segmenting call, three blocks and an aggregating one; equal prompts are asked once.
    assert set(calls) == {"segment", "extract", "aggregate", "cluster", "distil"} and calls["segment"] == 1 and calls["cluster"] == 1 and calls["distil"] >= 1
    assert {r["model"].rsplit(":")[-1]: r["calls"] for r in report.by_model()} == {"rules": sum(calls.values()) - calls["distil"], "mute": calls["distil"]}
    assert report.note == "no skills" and any("no rules and no body" in e for e in report.errors)
    assert "no rules and no body" in report.html() and "mute" in report.html()


def test_whole_run(spark, store, tmp_path):
    src = create_source(spark, "sqlite", store)
    models = Models(RuleProvider, RuleProvider, str(tmp_path / "cache"), 2)
    out = str(tmp_path / "out")

    def run(**k):
        settings = Settings(out, str(tmp_path / "work"), today="2024-01-01", **k)
        return Pipeline(spark, src, models, settings, k.pop("strategy", None), lambda df: model_merge(df, models))

    report = run().run()
    assert report.note == "" and sum(report.labels.values()) == 2 and report.topic_rows
    topics = files.existing_topics(spark, out, "all").collect()
    assert {(r["topic_id"], r["summary"]) for r in topics} == {(r["topic_id"], r["description"]) for r in report.topic_rows}
    assert all("path" not in p or p for p in report.paths.values()) and (tmp_path / "out/all/_index.md").read_text().startswith("# all")
    page = report.html()
    assert "class=card" in page and "class='bar green'" in page and "aggregate" in page
    assert "Title 1" in (tmp_path / "out/reports/all_2024-01-01.html").read_text()
    state = StateStore(spark, f"{out}/state")
    assert state.since_ms() == 2002 and {r[0] for r in state.processed().collect()} == {"s-one", "s-two"}
    assert run(since_ms=state.since_ms()).run().note == "no sessions"
    again = run(form="knowledge_md").run()
    assert "points" in open(again.paths["knowledge"]).read()
    run().run()  # merges into what is written
    assert run(step=1).run().topic_rows == []
    shown = run(session_id="s-one", step=1, dry_run=True).run()
    assert len(shown.session_rows) == 1 and not shown.paths and not shown.topic_rows
    assert len(run(session_id="s-one", dry_run=True, step=2).run().session_rows) == 1
    kept = files.read_trajectories(spark, out).collect()
    assert sorted(r["session_id"] for r in kept) == ["s-one", "s-two"] and {r["day"] for r in kept} == {"2024-01-01"}
    # Every run of the day has its own rows still.
    assert len(os.listdir(tmp_path / "out/trajectories/project=all/day=2024-01-01")) == 4


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "session_id string")


def test_state_of_runs_that_end_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(states, "MERGED_TABLES", 3)
    monkeypatch.setattr(states, "KEPT_VERSIONS", 4)
    folder = str(tmp_path / "state")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: StateStore(spark, folder).save(ids(spark, f"s{k}", "all"), k, 1), range(8)))
    state = StateStore(spark, folder)
    assert {r[0] for r in state.processed().collect()} == {"all", *(f"s{k}" for k in range(8))} and state.processed().count() == 9
    assert state.since_ms() == 7 and state.load()["stats"] == {"runs": 8, "sessions": 8}
    assert len(state.versions()) <= 5 and len(state.load()["ids"]) < 8
    # A reader's snapshot outlives later saves.
    before = state.processed()
    state.save(ids(spark, "late"), 1, 1)
    assert before.count() == 9 and state.processed().count() == 10 and state.since_ms() == 7
    # A batch counts once.
    assert state.save(ids(spark, "b"), 20, 1, ("q", 3)) and not state.save(ids(spark, "b"), 20, 1, ("q", 3)) and not state.save(ids(spark, "c"), 20, 1, ("q", 2))
    assert state.has_batch("q", 3) and not state.has_batch("q", 4) and not state.has_batch("other", 0)
    # A version that is not whole is passed over, and not overwritten.
    last = state.versions()[-1]
    (tmp_path / f"state/v{last + 1:09d}.json").write_text("{broken")
    assert state.since_ms() == 20
    state.save(ids(spark, "d"), 30, 1)
    assert state.versions()[-1] >= last + 2 and state.since_ms() == 30 and state.processed().count() == 12
    assert StateStore(spark, str(tmp_path / "none")).since_ms() is None


def test_runs_over_changes(spark, store, tmp_path):
    path = str(tmp_path / "s.db")
    shutil.copy(store, path)
    src = create_source(spark, "sqlite", path)
    models = Models(RuleProvider, RuleProvider, str(tmp_path / "cache"), 2)
    out = str(tmp_path / "out")

    def run(state=None):
        p = Pipeline(spark, src, models, Settings(out, str(tmp_path / "work"), today="2024-01-01"))
        p.state = state or p.state
        return p.run_changes()

    class Killed(StateStore):
        def save(self, *a):
            super().save(*a) if self.saves else None
            raise RuntimeError("killed")

    # Killed before its state is saved, then after it.
    for saves in (False, True):
        killed = Killed(spark, f"{out}/state")
        killed.saves = saves
        with pytest.raises(StreamingQueryException, match="killed"):
            run(killed)
        models.used.clear()
    assert run() == []
    state = StateStore(spark, f"{out}/state")
    assert sorted(r[0] for r in state.processed().collect()) == ["s-one", "s-two"] and state.load()["stats"]["runs"] == 1
    # Two sessions change, one of them to something worth while; a third comes with the time of the last one.
    db = sqlite3.connect(path)
    db.execute("UPDATE session SET time_updated = 3000 WHERE id = 's-one'")
    db.execute("INSERT INTO session VALUES ('s-aaa', 'new', '/w/new', 1, 3000)")
    db.execute("INSERT INTO message SELECT 'n' || id, 's-aaa', time_created, data FROM message WHERE session_id = 's-two'")
    db.execute("INSERT INTO part SELECT 'n' || id, 'n' || message_id, 's-aaa', time_created, data FROM part WHERE session_id = 's-two'")
    db.commit()
    (report,) = run()
    assert sorted(r["session_id"] for r in report.session_rows) == ["s-aaa", "s-one"]
    assert sorted(r["session_id"] for r in files.read_trajectories(spark, out).collect()) == ["s-aaa", "s-one", "s-two"]
    db.execute("INSERT INTO session VALUES ('s-zzz', 'small', '/w/new', 1, 3000)")
    db.commit()
    db.close()
    assert [r.note for r in run()] == ["no candidates"] and run() == []


def test_changes_are_ranges(spark, store):
    reader = _Changes({"path": store, "partitions": "2"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"updated": 2002, "id": "s-three"}
    parts = reader.partitions(start, end)
    assert len(parts) == 2 and [r[0] for p in parts for r in reader.read(p)] == ["s-one", "s-two", "s-three"]
    assert [r[0] for p in reader.partitions({"updated": 2000, "id": "s-one"}, end) for r in reader.read(p)] == ["s-two", "s-three"]
    assert [list(reader.read(p)) for p in reader.partitions(end, end)] == [[]]
    later = _Changes({"path": store, "since": "2002"})
    assert later.latestOffset() == later.initialOffset()


def test_layers_can_be_exchanged(spark, store, tmp_path):
    src = create_source(spark, "sqlite", store)
    models = Models(RuleProvider, RuleProvider, str(tmp_path / "cache"), 2)
    settings = Settings(str(tmp_path / "o"), str(tmp_path / "w"), today="d", form="titles")

    def fixed(trajectories, clusters):
        return distil(trajectories, clusters, models).withColumn("skill_title", F.concat(F.lit("mine: "), "topic_id"))

    def titles(skills, output, project, date, merge):
        return {r["topic_id"]: r["skill_title"] for r in skills.collect()}

    shown = []
    run = Pipeline(spark, src, models, settings, FieldClusters("project"), distiller=fixed, formats={"titles": titles}, presenter=lambda report, output: shown.append(report.topic_rows) or "shown")
    report = run.run()
    assert report.paths["my-project"] == "mine: my-project" and report.paths["report"] == "shown" and len(shown[0]) == 1
    with pytest.raises(ValueError, match="unknown format"):
        Pipeline(spark, src, models, settings)


def test_field_clusters(spark, store, tmp_path):
    src = create_source(spark, "sqlite", store)
    models = Models(RuleProvider, RuleProvider, str(tmp_path / "cache"), 2)
    p = Pipeline(spark, src, models, Settings(str(tmp_path / "o"), str(tmp_path / "w"), today="d"), FieldClusters("project"))
    assert {r["topic_id"] for r in p.run().topic_rows} == {"my-project"}


def test_report_tells_of_rows_that_are_not_shown(spark, monkeypatch):
    monkeypatch.setattr(reports, "SHOWN", 2)
    mined = spark.range(5).selectExpr(
        "id as pos", "concat('s', id) as session_id", "'t' as title", "'p' as project", "1 as message_count", "1 as tool_count", "'success' as label", "1.0 as label_score", "'i' as intent", "'ok' as status",
        "array(named_struct('problem', 'x')) as problems_encountered", "array('y') as lessons_learned", "if(id = 4, 'late', null) as error", "1 as calls", "1 as input_tokens", "1 as output_tokens")
    report = reports.Report("p", "2024-01-01")
    report.sessions(mined)
    assert len(report.session_rows) == 2 and report.errors == ["s4: late"] and "3 more rows are not shown" in report.html()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="checkpoint"):
        Scratch(SimpleNamespace(sparkContext=context), "x")
    assert Scratch(SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getConf=lambda: {"spark.checkpoint.dir": "hdfs://n/c/"})), "x").root.startswith("hdfs://n/c/x-")


def test_scratch_is_emptied(spark):
    one = Scratch(spark, "one")
    a, b = (one.save(spark.range(3), x) for x in "ab")
    one.keep_only(b)
    assert len(os.listdir(scratch.local(one.root))) == 1 and b.count() == 3


def test_only_own_folders_are_swept(spark):
    """Two threads at once, one of them in the middle of what the other sweeps."""
    held, made, swept_ = Scratch(spark, "held").save(spark.range(2), "t"), threading.Event(), threading.Event()

    def other():
        with scratch.swept(spark, "other"):
            t = Scratch(spark, "inner").save(spark.range(5), "t")
            made.set()
            assert swept_.wait(60)
            return t.count()

    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(other)
        assert made.wait(60)
        with scratch.swept(spark, "mine"):
            inner = Scratch(spark, "inner")
            inner.save(spark.range(3), "t")
        swept_.set()
        assert running.result() == 5
    assert held.count() == 2 and not os.path.exists(scratch.local(inner.root)) and Scratch(spark, "x").root.count("/other") == 0


def test_running_sums(spark):
    """A group of most rows, whose sums are put together from many partitions."""
    rows = spark.range(20_000).selectExpr("if(id % 10 < 7, 'hot', concat('t', id % 5)) as g", "pmod(id * 7919, 20000) as pos", "cast(id % 13 as int) as n")
    got = P.running_sums(rows.repartition(9), ["g"], ["pos"], "n").collect()
    want, before = {}, {}
    for g, pos, n in sorted(map(tuple, rows.collect())):
        want[g, pos] = before.get(g, 0)
        before[g] = want[g, pos] + n
    assert {(r["g"], r["pos"]): r["before"] for r in got} == want and len(got) == 20_000
    assert P.running_sums(rows.limit(0), ["g"], ["pos"], "n").count() == 0


def test_replies_of_other_types_are_asked_for_again():
    declared = StructType.fromDDL("a int not null, b array<struct<c:string,d:double>>, e boolean")
    ask_for = lambda *replies: ask(Flaky(*replies), "s", "p", 0.2, 9, declared=declared)
    good = '{"a": 1, "b": [{"c": "x", "d": 2}, null], "e": false, "more": []}'
    assert ask_for('{"a": "1"}', good)[0] == good and ask_for(good)[3:] == (1, None)
    assert "_parse_error" in ask_for('{"a": "1"}', "no")[0]
    assert ask_for(*['{"a": 1, "b": [{"c": 5}]}'] * 2)[3:] == (2, "b[0].c must be a text, not int")
    for reply, why in (('{"b": []}', "a is missing"), ('{"a": true}', "a must be a whole number, not bool"), ('{"a": 4294967296}', "a must be a whole number, not int"), ('{"a": 1, "b": {}}', "b must be a list, not dict"), ('{"a": 1, "e": 0}', "e must be true or false, not int")):
        assert ask_for(reply, reply)[4] == why


class Strict(RuleProvider):
    """Gives a whole number as text until it is told of it."""

    model_name = "strict"

    def complete(self, system, prompt, temperature, max_tokens):
        told = "A must be a whole number" in system and prompt != "never"
        return Reply('{"a": 1}' if told else '{"a": "1"}', 1, 1)


def test_declared_replies_of_rows(spark, tmp_path):
    df = spark.createDataFrame([("once",), ("never",)], "p string")
    asked = lambda **k: {r["p"]: (r["response"], r["calls"], r["error"]) for r in call_model(df, "s", "p", Strict, str(tmp_path / "c"), **k).collect()}
    assert asked(reply="a int") == {"once": ('{"a": 1}', 2, None), "never": ('{"a": "1"}', 2, "a must be a whole number, not str")}
    assert asked() == {p: ('{"a": "1"}', 1, None) for p in ("once", "never")}  # kept apart by what is declared


class Limited(RuleProvider):
    """Topics by the first letter of what a line is on, at most three; a session in none otherwise."""

    model_name = "limited"

    def complete(self, system, prompt, temperature, max_tokens):
        lines = re.findall(r"(?m)^(s\d+): (\S+)", prompt)
        groups = {}
        for alias, name in lines:
            if name != "lonely":
                groups.setdefault(f"t{int(re.findall(r'[0-9]+', name)[0]) % 3}", []).append(alias)
        return Reply(json.dumps({"clusters": [{"topic_id": k, "topic_name": k, "session_ids": v} for k, v in groups.items()]}), 1, 1)


class Numbered(Limited):
    """Every prompt's topics have names of their own."""

    model_name = "numbered"

    def complete(self, system, prompt, temperature, max_tokens):
        reply = json.loads(super().complete(system, prompt, temperature, max_tokens).text)
        if "a topic of several" not in prompt:
            first = re.search(r"(?m)^s(\d+):", prompt)[1]
            for c in reply["clusters"]:
                c["topic_id"] += f"-from-{first}"
        return Reply(json.dumps(reply), 1, 1)


def test_topics_of_many_prompts_keep_the_limit(spark, tmp_path):
    rows = [(f"x{i}", f"s{i}", i) for i in range(2000)] + [("lonely", "s2000", 2000)]
    kinds = "what_happened array<struct<phase:string,summary:string>>, problems_encountered array<struct<problem:string>>, key_decisions array<struct<decision:string>>, lessons_learned array<string>"
    sessions = spark.createDataFrame([(*r, "", "", "", "success", [], [], [], []) for r in rows], f"session_id string, alias string, pos long, project string, session_type string, intent string, label string, {kinds}")
    models = Models(Numbered, Numbered, str(tmp_path / "cache"), 4)
    clusters, rest = ModelClusters(models, max_topics=3, most_chars=10_000).cluster(sessions, spark.createDataFrame([], "topic_id string, summary string"), [])
    found = {r["topic_id"]: r["session_ids"] for r in clusters.collect()}
    # 101 prompts of 20 sessions find 300 topics, 15 prompts join those to 3, one more sees them all.
    assert set(found) == {"t0", "t1", "t2"}
    assert all(sorted(int(x[1:]) for x in found[f"t{k}"]) == list(range(k, 2000, 3)) for k in range(3)) and [r["session_id"] for r in rest.collect()] == ["lonely"]
    assert next(iter(models.used.values()))["calls"] == 101 + 15 + 1


def test_topics_that_are_left_out_stay(spark):
    topics = spark.createDataFrame([("a", "A", "", ["x", "y"], "p"), ("b", "B", "", ["y", "z"], "p"), ("c", "C", "", ["w"], "q"), ("d", "D", "", ["v"], "q")], "topic_id string, topic_name string, topic_summary string, session_ids array<string>, primary_project string")
    above = spark.createDataFrame([("c", "Both", "s", ["b", "a"], "r")], topics.schema)
    assert {tuple(map(str, r)) for r in P.lifted(topics, above).collect()} == {("c", "Both", "s", "['y', 'z', 'x', 'w']", "r"), ("d", "D", "", "['v']", "q")}


def test_topics_that_are_joined_are_not_broadcast(spark):
    """Small here, so Spark would send each side around whole if it chose."""
    topics = spark.createDataFrame([("a", "A", "", ["x"], "p"), ("b", "B", "", ["y"], "p")], "topic_id string, topic_name string, topic_summary string, session_ids array<string>, primary_project string")
    members = spark.createDataFrame(
        [("t", 0, "s", "k", "success", "i", [], [], [], [], [])],
        "topic_id string, pos long, session_id string, session_type string, label string, intent string, what_happened array<struct<phase:string,summary:string>>, "
        "problems_encountered array<struct<problem:string,how_resolved:string>>, key_decisions array<struct<decision:string,rationale:string>>, lessons_learned array<string>, discoveries array<string>")
    for df in (P.lifted(topics, topics.where("topic_id = 'a'")), P.running_sums(members, ["topic_id"], ["pos"], "pos"), P.topic_inputs(members, 10)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_field_clusters_are_not_broadcast(spark):
    """Neither the topics nor what is left, though small here; the counts are whole."""
    rows = [(f"x{i}", f"s{i}", i, f"p{i % 4}", "debugging" if i % 3 else "config") for i in range(240)]
    # Spark knows the size of files.
    sessions = Scratch(spark, "known").save(spark.createDataFrame(rows, "session_id string, alias string, pos long, project string, session_type string"), "known")
    clusters, rest = FieldClusters().cluster(sessions, spark.createDataFrame([], "topic_id string, summary string"), [])
    for df in (clusters, rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = {r["topic_id"]: r["session_ids"] for r in clusters.collect()}
    assert len(found) == 8 and found["p1-config"] == [f"x{i}" for i in range(9, 240, 12)] and sum(map(len, found.values())) == 240 and rest.count() == 0


def test_blocks_of_the_tables_are_not_broadcast(spark, tmp_path):
    rows = [(0, i, "assistant" if i % 2 else "user", "t") for i in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for df in run_queries._blocks(spark, str(tmp_path), run_queries._models(spark)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
