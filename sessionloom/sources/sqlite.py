"""A session store in SQLite as a Spark data source.

``spark.read.format("session_sqlite").option("path", …).option("table", …)``
with table ``sessions``, ``messages`` or ``parts``. Each read is split by
session id over ``partitions`` tasks and comes as Arrow batches. With the
options ``from_ms`` and ``session`` SQLite reads only sessions updated from then
on, and only the rows of one session. Filters of a plan are not taken: Spark
keeps a Python reader with what was pushed into it, so that a later query on the
same DataFrame without the filter would read too little.

``spark.readStream`` with the same options gives the sessions that are new or
changed: its offsets are (time of the update, id), so each batch is a range of
the store in that order, read again alike if the batch is repeated.
"""

from __future__ import annotations

import itertools
import json
import os
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import MESSAGES, PARTS, SESSIONS

_TABLES = {"sessions": SESSIONS, "messages": MESSAGES, "parts": PARTS}

#: Rows and letters that a batch has about at most; one row may have more.
BATCH_ROWS, BATCH_CHARS = 1000, 4 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def _batches(rows: Iterator[tuple], declared: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in declared.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no session store at {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Slice(InputPartition):
    """Session ids from ``lo`` up to ``hi``, which is not one of them; None is no bound."""

    def __init__(self, lo: str | None, hi: str | None):
        self.lo, self.hi = lo, hi

    def where(self, column: str, more: list[tuple[str, list]]) -> tuple[str, list]:
        """A condition on the column, which an index can serve, and ``more`` of them, with their values."""
        bounds = [(f"{column} >= ?", self.lo), (f"{column} < ?", self.hi)]
        found = [(c, [v]) for c, v in bounds if v is not None] + more
        return " AND ".join(c for c, _ in found) or "TRUE", [v for _, vs in found for v in vs]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "sessions")
        self.slices = int(options.get("partitions", 8))
        self.from_ms, self.session = options.get("from_ms"), options.get("session")
        _connect(self.path).close()

    def _where(self, part: _Slice, column: str) -> tuple[str, list]:
        more = [] if self.session is None else [(f"{column} = ?", [self.session])]
        if self.table == "sessions" and self.from_ms is not None:
            more.append(("time_updated >= ?", [int(self.from_ms)]))
        return part.where(column, more)

    def partitions(self) -> list[InputPartition]:
        if self.session is not None:
            return [_Slice(None, None)]
        db = _connect(self.path)
        try:
            # The least id of each of so many equal shares; the first share is open below, the last above.
            starts = [r[0] for r in db.execute("SELECT min(id) FROM (SELECT id, ntile(?) OVER (ORDER BY id) AS share FROM session) GROUP BY share ORDER BY share", (self.slices,))]
        finally:
            db.close()
        return [_Slice(a, b) for a, b in itertools.pairwise([None, *starts[1:], None])]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        db = _connect(self.path)
        try:
            rows = {"sessions": self._sessions, "messages": self._messages, "parts": self._parts}[self.table]
            yield from _batches(rows(db, part), _TABLES[self.table])
        finally:
            db.close()

    def _sessions(self, db: sqlite3.Connection, part: _Slice) -> Iterator[tuple]:
        where, values = self._where(part, "id")
        yield from db.execute(f"SELECT id, title, directory, time_created, time_updated FROM session WHERE {where}", values)

    def _messages(self, db: sqlite3.Connection, part: _Slice) -> Iterator[tuple]:
        last, idx = None, 0
        where, values = self._where(part, "session_id")
        for session, data in db.execute(f"SELECT session_id, data FROM message WHERE {where} ORDER BY session_id, time_created, id", values):
            last, idx = session, idx + 1 if session == last else 0
            yield message_row(session, idx, json.loads(data))

    def _parts(self, db: sqlite3.Connection, part: _Slice) -> Iterator[tuple]:
        place: dict[str, int] = {}
        last, idx = None, 0
        where, values = self._where(part, "session_id")
        for session, message in db.execute(f"SELECT session_id, id FROM message WHERE {where} ORDER BY session_id, time_created, id", values):
            last, idx = session, idx + 1 if session == last else 0
            place[message] = idx
        last, idx = None, 0
        for session, message, data in db.execute(f"SELECT session_id, message_id, data FROM part WHERE {where} ORDER BY session_id, message_id, time_created, id", values):
            last, idx = message, idx + 1 if message == last else 0
            if message in place:
                yield part_row(session, place[message], idx, json.loads(data))


def message_row(session: str, idx: int, info: dict) -> tuple:
    error, tokens = info.get("error"), info.get("tokens") or {}
    return (
        session, idx, info.get("role", ""), int((info.get("time") or {}).get("created", 0)), info.get("finish") or "",
        None if error is None else json.dumps(error, ensure_ascii=False), int(tokens.get("total", 0) or 0),
    )


def part_row(session: str, msg_idx: int, part_idx: int, p: dict) -> tuple:
    state = p.get("state") or {}
    out = state.get("output", "")
    return (
        session, msg_idx, part_idx, p.get("type", ""), p.get("text", ""), p.get("tool", ""), p.get("callID", ""), state.get("status", "completed"),
        json.dumps(state.get("input") or {}, ensure_ascii=False), out if out is None or isinstance(out, str) else str(out),
        p.get("hash", ""), p.get("files") or [], p.get("prompt", ""), p.get("description", ""), p.get("agent", ""),
    )


class _Range(InputPartition):
    """Sessions after ``start`` up to and with ``end``, both (updated, id)."""

    def __init__(self, start: tuple[int, str], end: tuple[int, str]):
        self.start, self.end = start, end


class _Changes(DataSourceStreamReader):
    _COLUMNS = "id, title, directory, time_created, time_updated"

    def __init__(self, options: dict):
        self.path, self.slices = options["path"], int(options.get("partitions", 8))
        # Sessions updated at ``since`` or before are known.
        self.since = int(options.get("since", -1))
        _connect(self.path).close()

    def initialOffset(self) -> dict:
        return {"updated": self.since, "id": _LAST if self.since >= 0 else ""}

    def latestOffset(self) -> dict:
        db = _connect(self.path)
        try:
            found = db.execute("SELECT time_updated, id FROM session ORDER BY time_updated DESC, id DESC LIMIT 1").fetchone()
        finally:
            db.close()
        first = self.initialOffset()
        return max({"updated": found[0], "id": found[1]}, first, key=_place) if found else first

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        db = _connect(self.path)
        try:
            # The last of each of so many equal shares.
            rows = db.execute(
                "SELECT time_updated, id FROM (SELECT time_updated, id, share, row_number() OVER (PARTITION BY share ORDER BY time_updated DESC, id DESC) AS k FROM "
                "(SELECT time_updated, id, ntile(?) OVER (ORDER BY time_updated, id) AS share FROM session WHERE (time_updated, id) > (?, ?) AND (time_updated, id) <= (?, ?))) WHERE k = 1 ORDER BY 1, 2",
                (self.slices, *_place(start), *_place(end))).fetchall()
        finally:
            db.close()
        bounds = [_place(start), *map(tuple, rows[:-1]), _place(end)]
        return [_Range(a, b) for a, b in itertools.pairwise(bounds)]

    def read(self, part: _Range) -> Iterator[tuple]:
        db = _connect(self.path)
        try:
            yield from db.execute(f"SELECT {self._COLUMNS} FROM session WHERE (time_updated, id) > (?, ?) AND (time_updated, id) <= (?, ?)", (*part.start, *part.end))
        finally:
            db.close()


#: After every id.
_LAST = "\U0010ffff"


def _place(offset: dict) -> tuple[int, str]:
    return offset["updated"], offset["id"]


class SessionStore(DataSource):
    """The data source behind ``session_sqlite``."""

    @classmethod
    def name(cls) -> str:
        return "session_sqlite"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "sessions")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self.options.get("table", "sessions") != "sessions":
            raise ValueError("only the table of sessions has an order of changes")
        return _Changes(dict(self.options))


class SqliteSource:
    """Sessions of one SQLite store."""

    strict_since = True

    def __init__(self, spark: SparkSession, path: str, partitions: int = 8):
        self.spark, self.path, self.slices = spark, path, partitions
        spark.dataSource.register(SessionStore)

    def table(self, name: str) -> DataFrame:
        return self.bounded(name)

    def bounded(self, name: str, from_ms: int | None = None, session: str | None = None) -> DataFrame:
        """A table of which SQLite reads only one session, or, of ``sessions``, those updated from ``from_ms`` on."""
        reader = self.spark.read.format("session_sqlite").option("path", self.path).option("table", name).option("partitions", str(self.slices))
        for option, value in (("from_ms", from_ms), ("session", session)):
            reader = reader if value is None else reader.option(option, str(value))
        return reader.load()

    def changes(self, since_ms: int | None = None) -> DataFrame:
        """A stream of sessions that are new or were updated after ``since_ms``."""
        reader = self.spark.readStream.format("session_sqlite").option("path", self.path).option("partitions", str(self.slices))
        return (reader if since_ms is None else reader.option("since", str(since_ms))).load()

    def project_filter(self, df: DataFrame, project: str) -> DataFrame:
        """The whole directory contains ``project``, whatever the case of ASCII letters."""
        return df.where(F.contains(F.lower("directory"), F.lit(project.lower())))

    def full_id(self, given: str) -> str:
        return given
