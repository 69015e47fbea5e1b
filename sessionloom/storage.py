"""Small files in whatever store Spark writes to, from the driver and from workers.

The driver goes through Hadoop's file systems, as Spark does; workers, which have
no JVM of their own to ask, through those of pyarrow.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Store:
    """Files below one folder, for the driver. Paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        given = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = given.getFileSystem(self._conf)
        self._root = self._fs.makeQualified(given)
        self.root = self._root.toString()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name) if name else self._root

    def path(self, name: str) -> str:
        return self._path(name).toString()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, sorted; nothing if there is no such folder."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def modified_ms(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getModificationTime()

    def read(self, name: str) -> str | None:
        """A file's text, None if it is missing."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def _write_new(self, name: str, text: str) -> str:
        beside = f"{name}.{uuid.uuid4().hex}.new"
        stream = self._fs.create(self._path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return beside

    def _rename(self, old: str, new: str, how: str) -> None:
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self._conf).rename(self._path(old), self._path(new), options)

    def replace(self, name: str, text: str) -> str:
        """Write beside, then rename: a reader sees the old file or the new one."""
        self._rename(self._write_new(name, text), name, "OVERWRITE")
        return self.path(name)

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does, also when another writer was faster.

        Renaming onto a missing name is one step on HDFS. On a local disk a link
        is. Stores that copy in place of renaming give no such promise.
        """
        beside = self._write_new(name, text)
        try:
            if self._root.toUri().getScheme() == "file":
                os.link(local(self.path(beside)), local(self.path(name)))
            elif self.exists(name):
                return False
            else:
                self._rename(beside, name, "NONE")
            return True
        except FileExistsError:
            return False
        except Exception:
            if self.exists(name):
                return False
            raise
        finally:
            self.delete(beside)


def local(path: str) -> str:
    """The path of a ``file:`` URL."""
    return path.removeprefix("file://").removeprefix("file:")


class WorkerStore:
    """JSON files of a folder, for workers; ``root`` is a full URL, as ``Store.root`` gives it."""

    def __init__(self, root: str):
        from pyarrow import fs

        self._fs, self._root = fs.FileSystem.from_uri("file://" + local(root) if root.startswith("file:") else root)

    def write(self, name: str, value: dict) -> None:
        self.put(name, json.dumps(value, ensure_ascii=False).encode())

    def read_all(self, folder: str, suffix: str) -> dict[str, dict]:
        """The files of a folder by name; those that are not whole are passed over."""
        from pyarrow import fs

        out = {}
        for info in self._fs.get_file_info(fs.FileSelector(f"{self._root}/{folder}", allow_not_found=True)):
            if info.base_name.endswith(suffix):
                with self._fs.open_input_stream(info.path) as f:
                    raw = f.read()
                try:
                    out[info.base_name] = json.loads(raw)
                except ValueError:
                    continue
        return out

    def names(self, folder: str) -> list[str]:
        """What a folder holds, sorted; nothing if there is no such folder."""
        from pyarrow import fs

        return sorted(x.base_name for x in self._fs.get_file_info(fs.FileSelector(f"{self._root}/{folder}", allow_not_found=True)))

    def put(self, name: str, raw: bytes) -> None:
        path = f"{self._root}/{name}"
        try:
            f = self._fs.open_output_stream(path)
        except FileNotFoundError:  # the first file of its folder: asking for the folder each time costs more than the file
            self._fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            f = self._fs.open_output_stream(path)
        with f:
            f.write(raw)

    def write_lines(self, name: str, values: list[dict]) -> None:
        self.put(name, "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in values).encode())

    def read_lines(self, name: str) -> list[dict]:
        """The lines of a file; one that is not whole is passed over."""
        with self._fs.open_input_stream(f"{self._root}/{name}") as f:
            raw = f.read()
        out = []
        for line in raw.split(b"\n"):
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
        return out

    def delete(self, folder: str) -> None:
        try:
            self._fs.delete_dir(f"{self._root}/{folder}")
        except FileNotFoundError:
            pass
