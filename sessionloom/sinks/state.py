"""What earlier runs have done: the next run's lower bound and the sessions processed.

Every save is a version of its own, a small JSON file that names the tables of
ids it is made of. A version is created only if no other run has created it, so
of two runs that end at once the second builds on the first. Nothing that a
reader may have open is changed: tables are replaced by new ones, and old
versions go after a while.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..storage import Store

#: Versions that stay, tables of ids after which they are merged into one, and hours for which a table that no version names stays.
KEPT_VERSIONS, MERGED_TABLES, KEPT_HOURS = 10, 16, 24
_FRESH = {"last_run": "", "last_session_id": "", "high_mark_ms": 0, "cost_accumulated": 0.0, "stats": {}, "ids": [], "batches": {}}


class StateStore:
    """State in a folder of any store that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def versions(self) -> list[int]:
        return [int(name[1:-5]) for name in self.store.names() if re.fullmatch(r"v\d{9}\.json", name)]

    def _read(self, version: int) -> dict | None:
        try:
            found = json.loads(self.store.read(_file(version)) or "")
        except ValueError:
            return None
        return _FRESH | found if isinstance(found, dict) else None

    def _latest(self) -> tuple[int, dict]:
        """The last version's number and the values of the last that can be read; those of a fresh store if there is none."""
        numbers = self.versions()
        for version in reversed(numbers):
            if found := self._read(version):
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), dict(_FRESH)

    def load(self) -> dict:
        return self._latest()[1]

    def processed(self) -> DataFrame:
        """The distinct session ids of the last version: a snapshot, whatever is saved meanwhile."""
        tables = [self.store.path(x) for x in self.load()["ids"]]
        if not tables:
            return self.spark.createDataFrame([], "session_id string")
        return self.spark.read.schema("session_id string").parquet(*tables).distinct()

    def since_ms(self) -> int | None:
        return self.load()["high_mark_ms"] or None

    def has_batch(self, stream: str, batch: int) -> bool:
        return self.load()["batches"].get(stream, -1) >= batch

    def save(self, done: DataFrame, high_mark_ms: int | None, count: int, batch: tuple[str, int] | None = None) -> bool:
        """Add sessions as a new version. A stream's batch that a version has already is not added again: False."""
        table = f"ids/{uuid.uuid4().hex}"
        done.select("session_id").distinct().write.parquet(self.store.path(table))
        while True:
            version, old = self._latest()
            if batch and old["batches"].get(batch[0], -1) >= batch[1]:
                self.store.delete(table)
                return False
            stats = dict(old["stats"]) | {"runs": old["stats"].get("runs", 0) + 1, "sessions": old["stats"].get("sessions", 0) + count}
            new = old | {"last_run": datetime.now(UTC).isoformat(), "high_mark_ms": max(old["high_mark_ms"], high_mark_ms or 0), "stats": stats, "ids": [*old["ids"], table]}
            if batch:
                new["batches"] = old["batches"] | {batch[0]: batch[1]}
            if self._create(version + 1, new):
                break
        if len(new["ids"]) > MERGED_TABLES:
            self._merge(new["ids"])
        self._expire()
        return True

    def _create(self, version: int, values: dict) -> bool:
        return self.store.create(_file(version), json.dumps(values, ensure_ascii=False, indent=2))

    def _merge(self, tables: list[str]) -> None:
        """One table in place of several; tables that came meanwhile stay beside it."""
        whole = f"ids/{uuid.uuid4().hex}"
        rows = self.spark.read.schema("session_id string").parquet(*[self.store.path(x) for x in tables]).distinct()
        rows.write.parquet(self.store.path(whole))
        while True:
            version, old = self._latest()
            if not set(tables) <= set(old["ids"]):  # another run has merged them
                return
            if self._create(version + 1, old | {"ids": [whole, *(x for x in old["ids"] if x not in tables)]}):
                return

    def _expire(self) -> None:
        numbers = self.versions()
        for version in numbers[:-KEPT_VERSIONS]:
            self.store.delete(_file(version))
        named = {x for v in numbers[-KEPT_VERSIONS:] for x in (self._read(v) or _FRESH)["ids"]}
        for name in self.store.names("ids"):
            # A run writes its table first and names it then: a young one may be such.
            if f"ids/{name}" not in named and self.store.modified_ms(f"ids/{name}") < (time.time() - KEPT_HOURS * 3600) * 1000:
                self.store.delete(f"ids/{name}")


def _file(version: int) -> str:
    return f"v{version:09d}.json"
