"""Tables written in the shared folder, in place of cached lineage.

An executor can be lost at any time, so what is read more than once is written
as Parquet under ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .storage import local

__all__ = ["Scratch", "local", "shared_dir", "swept"]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where none is set a temporary one serves a local master, as in tests; on a
    cluster that is an error, for executors and driver share no local folder.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    held = spark.conf.get("sessionloom.scratch", None)
    if not held:
        held = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("sessionloom.scratch", held)
    return held


#: The folder that new ones are made in, where a ``swept`` one is open in this thread.
_within: ContextVar[str | None] = ContextVar("sessionloom_scratch", default=None)


@contextmanager
def swept(spark: SparkSession, label: str) -> Iterator[None]:
    """Folders made in here go at the end, and no others: what they are read for must be written by then, elsewhere."""
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = _within.set(root)
    try:
        yield
    finally:
        _within.reset(before)
        _remove(spark, root)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of its own within the shared one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_within.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: the plan starts from the files."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        self._saved.append(path)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Remove the files of saved tables that no later plan reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                self._remove(path)

    def keep_only(self, *frames: DataFrame) -> None:
        """Remove all saved tables but these."""
        kept = {getattr(df, "_scratch_path", None) for df in frames}
        for path in [p for p in self._saved if p not in kept]:
            self._remove(path)

    def _remove(self, path: str) -> None:
        if path in self._saved:
            self._saved.remove(path)
            _remove(self.spark, path)
