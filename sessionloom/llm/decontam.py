"""Benchmark decontamination: a prefix-filtered join of windows and documents.

A window is WINDOW consecutive words of an item, or all words of a shorter one.
To hold a window a document must hold every one of its shingles, so a prefix of
one shingle is enough to find it; the join uses the window's rarest one, by
counts over all documents. A match of that shingle fixes where the window would
stand: it must start at or after the document's first word and end by its last
(positional and length bounds), and then all of its words are compared, first by
their numbers and then letter by letter.

The items are the stated query set. Their distinct windows go to the executors
in blocks of BLOCK_WINDOWS windows and about BLOCK_BYTES bytes, so what is
broadcast is bounded whatever their number; each block is a pass over the
documents, and hits of several blocks are merged per document. Which items have
a window stays in a table that the hits are joined with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALNUM, Words, bound_batches, grams, released, sliced, utf8

WINDOW = 13
SHINGLE = 5
#: Distinct windows of a block, and bytes that they take in a task: their text, and 700 more each for numbers, shingles and index.
BLOCK_WINDOWS, BLOCK_BYTES, WINDOW_BYTES = 100_000, 96 << 20, 700

_HITS = "doc_id long, row long, n_words long, hits array<struct<a:int,b:int>>, keys array<binary>"


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words, A-Z lower-cased, with a space between them."""
    return b" ".join(_LOWER[data[a:b]].tobytes() for a, b in zip(starts, ends, strict=True))


def window_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Item rows -> a row for every window: its words' numbers, its text, the text's key and its item."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        data, at = utf8(batch.column(1))
        for lo, hi in sliced(data, at):
            w = Words(data, at[lo : hi + 1], ALNUM)
            keys, words, texts, items = [], [], [], []
            for i in range(hi - lo):
                first, stop = int(w.rows[i]), int(w.rows[i + 1])
                for j in range(first, max(first + 1, stop - WINDOW + 1) if stop > first else first):
                    part = slice(j, min(j + WINDOW, stop))
                    text = plain(data[at[lo] :], w.starts[part], w.ends[part])
                    keys.append(hashlib.blake2b(text, digest_size=16).digest())
                    words.append(w.numbers[part].tobytes())
                    texts.append(text)
                    items.append(names[lo + i])
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(words, pa.binary()), pa.array(texts, pa.binary()), pa.array(items, pa.string())], names=["key", "words", "text", "item"])


class Block:
    """Some windows: their words, their shingles, and the prefix index."""

    def __init__(self, words: list[bytes], texts: list[bytes], keys: list[bytes]):
        self.words = [np.frombuffer(x, np.uint64) for x in words]
        self.texts, self.keys = texts, keys
        shingles, self.of = [], []
        for x in self.words:
            g = grams(x, min(SHINGLE, len(x)))
            self.of.append(g)
            shingles.append(g)
        self.shingles = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        #: Shingle lengths that occur: items of under five words have shorter ones.
        self.sizes = sorted({min(SHINGLE, len(x)) for x in self.words})

    def index(self, counts: np.ndarray) -> None:
        """Give each window its rarest shingle (ties: the first) as its prefix."""
        token, offset = [], []
        for g in self.of:
            c = counts[np.searchsorted(self.shingles, g)]
            k = int(np.argmin(c))
            token.append(g[k])
            offset.append(k)
        token, offset = np.array(token, np.uint64), np.array(offset, np.int64)
        order = np.argsort(token, kind="stable")
        self.token, first = np.unique(token[order], return_index=True)
        self.span = np.append(first, len(order))
        self.window, self.offset = order, offset[order]
        self.length = np.array([len(x) for x in self.words], np.int64)

    def hits(self, x: np.ndarray, text) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans of ``x`` within windows, and the windows found; ``text`` gives the words of a span."""
        spans, found = [], set()
        for size in self.sizes:
            g = grams(x, size)
            at = np.searchsorted(self.token, g)
            at[at == len(self.token)] = 0
            for p in np.flatnonzero(self.token[at] == g):
                for k in range(self.span[at[p]], self.span[at[p] + 1]):
                    win = int(self.window[k])
                    start, n = int(p - self.offset[k]), int(self.length[win])
                    if start < 0 or start + n > len(x) or min(SHINGLE, n) != size:
                        continue
                    if np.array_equal(x[start : start + n], self.words[win]) and text(start, start + n) == self.texts[win]:
                        spans.append((start, start + n))
                        found.add(win)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _counted(block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        total = np.zeros(len(b.shingles) + 1, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in sliced(data, at):
                w = Words(data, at[lo : hi + 1], ALNUM)
                for size in b.sizes:
                    g = grams(w.numbers, size)
                    if not len(g):
                        continue
                    # Shingles must not reach into the next row.
                    row_end = np.repeat(w.rows[1:], np.diff(w.rows))[: len(g)]
                    at_ = np.searchsorted(b.shingles, g)
                    ok = (at_ < len(b.shingles)) & (np.arange(len(g)) + size <= row_end)
                    at_, g = at_[ok], g[ok]
                    total += np.bincount(at_[b.shingles[at_] == g], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["shingle", "n"])

    return count


def _searched(block):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            n_words, hits, keys = [], [], []
            data, at = utf8(batch.column(2))
            for lo, hi in sliced(data, at):
                w = Words(data, at[lo : hi + 1], ALNUM)
                possible = np.zeros(len(w.numbers) + 1, np.int64)
                for size in b.sizes:
                    g = grams(w.numbers, size)
                    if len(g) and len(b.token):
                        at_ = np.searchsorted(b.token, g)
                        at_[at_ == len(b.token)] = 0
                        possible[: len(g)] += b.token[at_] == g
                held = np.append(0, np.cumsum(possible))
                for i in range(hi - lo):
                    s, e = int(w.rows[i]), int(w.rows[i + 1])
                    n_words.append(e - s)
                    if held[e] == held[s]:
                        hits.append([])
                        keys.append([])
                    else:
                        spans, found = b.hits(w.numbers[s:e], lambda i, j, s=s, own=data[at[lo] :], w=w: plain(own, w.starts[s + i : s + j], w.ends[s + i : s + j]))
                        hits.append([{"a": x, "b": y} for x, y in spans])
                        keys.append([b.keys[k] for k in sorted(found)])
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(keys, pa.list_(pa.binary())),
            ], names=["doc_id", "row", "n_words", "hits", "keys"])

    return search


def _blocks(windows: DataFrame, size: int) -> Iterator[Block]:
    """Windows in the order of their keys, ``size`` at a time."""
    after = None
    while True:
        left = windows if after is None else windows.where(F.col("key") > F.lit(bytearray(after)))
        rows = left.orderBy("key").limit(size).collect()
        if rows:
            after = bytes(rows[-1]["key"])
            yield Block([bytes(r["words"]) for r in rows], [bytes(r["text"]) for r in rows], [bytes(r["key"]) for r in rows])
        if len(rows) < size:
            return


def _windows(items: DataFrame, scratch: Scratch, block_windows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct windows, the items (without null ids) that have each, the number of windows and that of a block."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    every = scratch.save(rows.mapInArrow(released(window_table), "key binary, words binary, text binary, item string"), "every")
    windows = scratch.save(every.groupBy("key").agg(F.first("words").alias("words"), F.first("text").alias("text")), "windows")
    n, total = windows.agg(F.count("*"), F.sum(F.octet_length("text") + F.lit(WINDOW_BYTES))).first()
    # Blocks follow the order of the keys, which are hashes, so their texts are of about equal size.
    return windows, every.where("item is not null").select("key", "item").distinct(), n, max(1, min(block_windows, BLOCK_BYTES * n // (total or 1)))


def _shingle_counts(texts: DataFrame, block: Block) -> np.ndarray:
    """How often each of a block's shingles stands in all texts; one number per shingle comes back."""
    sent = texts.sparkSession.sparkContext.broadcast(block)
    counts = np.zeros(len(block.shingles), np.int64)
    for r in texts.mapInArrow(released(_counted(sent)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["shingle"]] = r["n"]
    sent.unpersist()
    return counts


def contamination(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, hits (merged word spans), item_ids, n_hit, contaminated for every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored. A document word inside any occurrence of a window is hit; a
    document is contaminated when at least one in twenty words is. Null and
    empty texts have no words and no hits; items without words have no windows;
    without items no document is hit. An item with a null item_id hits as any
    other, but is not among item_ids. Repeated rows each get their own result,
    repeated items count once by id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "decontam")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows, owners, n, size = _windows(items, scratch, block_windows)
    # Rows get a name beside doc_id, which may repeat; several passes must agree on it.
    rowed = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    if n > size:
        rowed = scratch.save(rowed, "rowed")
    parts = []
    for block in _blocks(windows, size):
        block.index(_shingle_counts(texts.select("text"), block))
        parts.append(scratch.save(rowed.mapInArrow(released(_searched(spark.sparkContext.broadcast(block))), _HITS), "part"))
    if not parts:
        empty = Block([], [], [])
        empty.index(np.zeros(0, np.int64))
        parts = [scratch.save(rowed.mapInArrow(released(_searched(spark.sparkContext.broadcast(empty))), _HITS), "part")]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("keys")).alias("keys"))
        found = found.withColumn("hits", _merged("hits"))
    named = found.select("row", F.explode("keys").alias("key")).join(owners, "key").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return (
        found.join(named, "row", "left").select("doc_id", "n_words", "hits", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
        .withColumn("n_hit", n_hit)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def _cleaned(block, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searched(block)
        for batch in batches:
            nothing = pa.nulls(batch.num_rows, pa.int64())
            for got in search(iter([pa.record_batch([nothing, nothing, batch.column(place)], names=["doc_id", "row", "text"])])):
                rows = zip(got.column(2).to_pylist(), got.column(3).to_pylist(), strict=True)
                hit = ((n, sum(h["b"] - h["a"] for h in hits)) for n, hits in rows)
                yield batch.filter(pa.array([not (h > 0 and 20 * h >= n) for n, h in hit], pa.bool_()))

    return clean


def uncontaminated(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated by ``items``.

    With one block of windows rows are filtered where they stand. With several
    the hits of a row must meet, so rows get a name that is written down first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "clean")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    windows, _, n, size = _windows(items, scratch, block_windows)
    if n <= size:
        block = next(_blocks(windows, size), None) or Block([], [], [])
        block.index(_shingle_counts(texts, block))
        sent = spark.sparkContext.broadcast(block)
        return docs.mapInArrow(released(_cleaned(sent, docs.columns.index("text"))), docs.schema)
    name = "_row_of_" + "_".join(docs.columns)
    rows = scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    hit = contamination(rows.select(F.col(name).alias("doc_id"), "text"), items, block_windows).where("contaminated")
    hit = scratch.save(hit.select(F.col("doc_id").alias(name)), "hit")
    return rows.join(hit, name, "left_anti").drop(name)


def _merged(hits: str):
    """Overlapping spans as one, within an expression."""
    kind = "array<struct<a:int,b:int>>"
    step = lambda s, x: F.when(
        (F.size(s) > 0) & (F.element_at(s, -1)["b"] >= x["a"]),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["a"].alias("a"), F.greatest(F.element_at(s, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(F.array_sort(F.col(hits)), F.array().cast(kind), step)
