"""A write-ahead log of calls, so that a lost worker's calls are neither lost nor made again.

Before a call a worker writes a ``begun`` file, after it the ``reply``, in the
folder of the request and prompt, in the store that all workers share. A task
that is run again reads the folder first and goes on where the lost one stopped:
what is asked twice is the one call that was on its way. ``begun`` files are the
calls made, so they are the usage, whatever became of the tasks.

Folders of prompts that a task is done with are gathered into one file of
``done`` each GATHERED prompts, so at any time a request has few of them, and
what is listed at its end grows with one file for so many prompts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..storage import Store, WorkerStore
from .base import ContextOverflow, Reply

#: Days after which the folder of a run that never ended goes.
KEPT_DAYS = 7
#: Prompts whose calls one file holds.
GATHERED = 1000
DONE = "done"


class CallFailed(Exception):
    """A failed call as it was logged; its text is that of the error."""


class CallLog:
    """The log of one request; what earlier requests left behind is read, not written."""

    def __init__(self, root: str, request: str, earlier: tuple[str, ...] = ()):
        self.root, self.request, self.earlier = root, request, earlier

    def task(self, part: int) -> TaskLog:
        return TaskLog(WorkerStore(self.root), self.request, self.earlier, part)


class TaskLog:
    """The log of one task, whose prompts come in the order of their keys.

    A gathered file's name says which task's it is and from which key to which
    it goes, so of those that lost attempts and earlier requests left only the
    ones around the present key are held.
    """

    def __init__(self, store: WorkerStore, request: str, earlier: tuple[str, ...], part: int):
        self.store, self.request, self.earlier, self.part = store, request, earlier, part
        self.done: list[PromptLog] = []
        # (first key, last key, whether of this request, path)
        self.files: list[tuple[str, str, bool, str]] = []
        for folder in (request, *earlier):
            for name in store.names(f"{folder}/{DONE}"):
                of, first, last = name.split("-")[:3]
                if folder != request or int(of) == part:
                    self.files.append((first, last, folder == request, f"{folder}/{DONE}/{name}"))
        self.files.sort(reverse=True)
        self.near: list[tuple[str, bool, dict[str, dict[str, dict]]]] = []

    def prompt(self, key: str) -> PromptLog:
        while self.files and self.files[-1][0] <= key:
            _, last, own, path = self.files.pop()
            if last >= key:
                held: dict[str, dict[str, dict]] = {}
                for x in self.store.read_lines(path):
                    if "text" in x:
                        held.setdefault(x["key"], {})[x["at"]] = x
                self.near.append((last, own, held))
        self.near = [x for x in self.near if x[0] >= key]
        gathered = lambda mine: {at: r for _, own, held in self.near if own == mine for at, r in held.get(key, {}).items()}
        return PromptLog(self.store, self.request, self.earlier, key, gathered(True), gathered(False))

    def close(self, prompt: PromptLog) -> None:
        """No more calls for a prompt."""
        self.done.append(prompt)
        if len(self.done) >= GATHERED:
            self.gather()

    def gather(self) -> None:
        """One file of the calls of prompts that are done, then their folders go: what is in both counts once."""
        lines = [{"key": p.key, "at": at, **r} for p in self.done for at, r in p.entries.items()]
        if lines:
            self.store.write_lines(f"{self.request}/{DONE}/{self.part}-{self.done[0].key}-{self.done[-1].key}-{uuid.uuid4().hex}.json", lines)
            for p in self.done:
                if p.entries:
                    self.store.delete(p.folder)
        self.done = []


def entries_of(files: dict[str, dict]) -> dict[str, dict]:
    """Of a prompt's files the calls begun, each with its reply if that came, by the name they share."""
    begun = {name.removesuffix(".begun"): {} for name in files if name.endswith(".begun")}
    return begun | {name.removesuffix(".reply"): r for name, r in files.items() if name.endswith(".reply")}


class PromptLog:
    """The calls for one prompt. ``made`` counts those of this request, ``spent`` their tokens; ``entries`` are those in its folder."""

    def __init__(self, store: WorkerStore, request: str, earlier: tuple[str, ...], key: str, own: dict[str, dict] | None = None, found: dict[str, dict] | None = None):
        self.store, self.key, self.folder = store, key, f"{request}/{key}"
        self.entries = entries_of(store.read_all(self.folder, ""))
        self.own = {name.rsplit("-", 1)[0]: r for name, r in sorted(((own or {}) | self.entries).items()) if r}
        # Of a run that died only good replies count, whichever attempt gave them.
        self.found: dict[str, dict] = {}
        for old in ({f"{name}.reply": r for name, r in (found or {}).items()}, *(store.read_all(f"{x}/{key}", ".reply") for x in earlier)):
            for name, r in old.items():
                if r["error"] is None:
                    self.found[name.split("-")[0]] = r
        self.made, self.spent = 0, [0, 0]

    def call(self, step: int, attempt: int, complete: Callable[[], Reply]) -> tuple[Reply, bool]:
        """The reply of an attempt and whether it was asked for now; a logged error is raised again."""
        name, now = f"{step}-{attempt}", False
        r = self.found.get(str(step))
        if r is None:
            self.made += 1
            r = self.own.get(name)
            if r is None:
                r, now = self._live(name, complete), True
            self.spent = [self.spent[0] + r["input_tokens"], self.spent[1] + r["output_tokens"]]
        if r["error"] is None:
            return Reply(r["text"], r["input_tokens"], r["output_tokens"]), now
        raise (ContextOverflow if r["kind"] == "ContextOverflow" else CallFailed)(r["error"])

    def _live(self, name: str, complete: Callable[[], Reply]) -> dict:
        call = f"{name}-{uuid.uuid4().hex}"
        at = f"{self.folder}/{call}"
        self.store.write(f"{at}.begun", {"name": name})
        self.entries[call] = {}
        try:
            reply = complete()
            r = {"text": reply.text, "input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens, "error": None, "kind": ""}
        except ContextOverflow as e:
            r = {"text": "", "input_tokens": 0, "output_tokens": 0, "error": str(e), "kind": "ContextOverflow"}
        except Exception as e:  # noqa: BLE001 - a failed call is a row's error, not the job's
            r = {"text": "", "input_tokens": 0, "output_tokens": 0, "error": f"{type(e).__name__}: {e}", "kind": "failed"}
        self.store.write(f"{at}.reply", r)
        self.entries[call] = r
        return r


def opened(spark: SparkSession, folder: str) -> tuple[CallLog, Store]:
    """A new request's log in ``folder``; folders of requests that ended without clearing theirs are its earlier ones."""
    import time

    store = Store(spark, folder)
    earlier = []
    for name in store.names():
        # A store without times for folders says 0.
        modified = store.modified_ms(name)
        if modified and modified < (time.time() - KEPT_DAYS * 86_400) * 1000:
            store.delete(name)
        else:
            earlier.append(name)
    return CallLog(store.root, uuid.uuid4().hex, tuple(earlier)), store


def usage(spark: SparkSession, log: CallLog, store: Store) -> Row:
    """calls, input_tokens and output_tokens of a request."""
    if not store.exists(log.request):
        return Row(calls=0, input_tokens=0, output_tokens=0)
    kind = "key string, at string, input_tokens long, output_tokens long"
    calls = spark.read.schema(kind).json(store.path(f"{log.request}/{DONE}")) if store.exists(f"{log.request}/{DONE}") else spark.createDataFrame([], kind)
    # Only an attempt that was lost, or went on beside another, leaves folders: what it had not gathered.
    left, worker = [], WorkerStore(log.root)
    for key in store.names(log.request):
        if key != DONE:
            left += [(key, at, r.get("input_tokens"), r.get("output_tokens")) for at, r in entries_of(worker.read_all(f"{log.request}/{key}", "")).items()]
    if left:
        calls = calls.unionByName(spark.createDataFrame(left, kind))
    each = calls.where("at is not null").groupBy("key", "at").agg(*[F.max(c).alias(c) for c in ("input_tokens", "output_tokens")])
    return each.agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]).first()
