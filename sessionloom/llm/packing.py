"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at every full window; full windows stand alone. What is
left of each document, less than a window, is dealt by hash into groups of about
GROUP_WINDOWS windows, so that a group fits one task whatever the corpus holds.

Within a group every remainder starts as a partition of its own: its length in
one window, nothing in all others. The two partitions of the largest spread are
merged time and again, the fullest window of one with the emptiest of the other,
until one partition is left, whose windows are nearly equal. If its fullest
window is over capacity the number of windows rises and differencing starts
anew. Remainders are never cut: a window over capacity is not repaired by cuts,
and documents shorter than a window stay whole.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import merges
from .scratch import Scratch
from .words import bound_batches, released, sliced, utf8

#: Windows of a group, about, and rows of a group at most, about.
GROUP_WINDOWS, GROUP_ROWS = 512, 100_000

def _pieces(path: str, end_id: int, capacity: int, full: bool):
    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merges(path)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in sliced(data, at):
                row, start, length, total, content = [], [], [], [], []
                for i, ids in enumerate(encoder.texts(data, at[lo : hi + 1])):
                    ids = np.append(ids, np.int32(end_id)).astype("<i4")
                    for x in range(0, len(ids), capacity):
                        part = ids[x : x + capacity]
                        row.append(i)
                        start.append(x)
                        length.append(len(part))
                        total.append(len(ids))
                        content.append(part if full else zlib.crc32(part.tobytes()))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)),
                     pa.array(content, pa.list_(pa.int32()) if full else pa.int64())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids" if full else "ids_crc32"],
                )

    return cut


def differencing(lengths: list[int], windows: int) -> tuple[list[int], list[int]]:
    """Window of every item, and the windows' sums, by Karmarkar-Karp multiway differencing.

    A partition is an int, an item by itself, or a sorted list of ``windows``
    (sum, node) pairs. A node is an item, or two nodes that share a window.
    """
    if windows == 1:
        return [0] * len(lengths), [sum(lengths)]
    joined: list[tuple[int, int]] = []
    n = len(lengths)

    def join(a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        joined.append((a, b))
        return n + len(joined) - 1

    def alone(item: int) -> list[tuple[int, int]]:
        return [(0, -1)] * (windows - 1) + [(lengths[item], item)]

    heap: list[tuple[int, int, int | list]] = [(-x, i, i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if isinstance(a, int):
            a, b = b, a
        if isinstance(a, int):
            a = alone(a)
        if isinstance(b, int):
            # One item: all but the emptiest window stay as they are.
            held, node = a[0]
            del a[0]
            insort(a, (held + lengths[b], join(node, b)))
        else:
            a = sorted((x + y, join(i, j)) for (x, i), (y, j) in zip(a, reversed(b), strict=True))
        heapq.heappush(heap, (a[0][0] - a[-1][0], turn, a))
    last = heap[0][2]
    last = alone(last) if isinstance(last, int) else last
    window = [-1] * (n + len(joined))
    for w, (_, node) in enumerate(last):
        if node >= 0:
            window[node] = w
    for node in range(len(joined) - 1, -1, -1):
        a, b = joined[node]
        window[a] = window[b] = window[n + node]
    return window[:n], [x for x, _ in last]


def balanced(lengths: list[int], capacity: int) -> list[int]:
    """Window of every item, none over ``capacity``: the number of windows rises until the fullest fits."""
    total = sum(lengths)
    windows = max(1, -(-total // capacity))
    while True:
        window, sums = differencing(lengths, windows)
        over = max(sums) - capacity
        if over <= 0:
            return window
        # The spread hardly depends on the number: so many windows lower the mean by what is over.
        spread = max(sums) - total / windows
        windows = max(windows + 1, int(total / (capacity - min(spread, capacity / 2))))


def _packed(capacity: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("_row")
        lengths = group["length"].to_numpy()
        # Items of one length are alike: those that come first in the table are the first in a window.
        window = np.array(balanced(lengths.tolist(), capacity), np.int64)
        by = np.argsort(window, kind="stable")
        ends = np.cumsum(lengths[by])
        begun = ends - lengths[by]
        firsts = np.unique(window[by], return_index=True)[1]
        offset = np.empty(len(by), np.int64)
        offset[by] = begun - np.repeat(begun[firsts], np.diff(np.append(firsts, len(by))))
        # Even numbers; a group has fewer than 2**24 windows, as each is more than half full or alone.
        sequence = (group["_group"].to_numpy() << 24 | window) * 2
        return group.drop_columns(["_group", "_row"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return pack


def packed(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, full: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A document is its ids followed by ``end_id``; a null or empty text is that
    id alone. ``full`` false gives ``ids_crc32``, the CRC-32 of the ids as
    little-endian 32-bit integers, in place of ``ids``. Sequences hold at most
    ``capacity`` ids; ``sequence_id`` is unique and says nothing else. Rows of
    one doc_id, equal rows, and rows with a null doc_id are documents each. An
    empty table gives an empty result. Other columns are ignored.

    ``path`` names the vocabulary file, which every executor must have.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    content = "ids array<int>" if full else "ids_crc32 long"
    kind = f"doc_id long, start long, length long, doc_tokens long, {content}"
    cut = rows.mapInArrow(_pieces(path, end_id, capacity, full), kind).withColumn("_row", F.monotonically_increasing_id())
    cut = scratch.save(cut, "pieces")
    rest = cut.where(F.col("length") < capacity)
    sums = rest.agg(F.sum("length").alias("t"), F.count("*").alias("n")).first()
    groups = max(-(-(sums["t"] or 0) // (GROUP_WINDOWS * capacity)), -(-sums["n"] // GROUP_ROWS), 1)
    # Rows are numbered, and the number is hashed: no document, text or source decides a group.
    grouped = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    placed = grouped.groupBy("_group").applyInArrow(_packed(capacity), f"{kind}, sequence_id long, offset long")
    alone = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("_row") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).drop("_row")
    return placed.unionByName(alone)
