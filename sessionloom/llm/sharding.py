"""Shards by fixed virtual slots.

Records are hashed by doc_id into SLOTS virtual slots. Bytes and rows are
summed by slot, and a versioned table maps every slot to a shard. Rebalancing
edits that map only: records never move between slots. What is gathered is one
row per slot, SLOTS rows whatever the input.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16

MAP = "version int, vslot int, shard int, rows long, bytes long, first_row long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every row; a null text has no bytes, a null doc_id goes to the slot of -1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1))), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_sums(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(rows, bytes) by slot."""
    return {r["vslot"]: (r["n"], r["b"]) for r in rows.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}


def assign(sums: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: the largest slots first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out: dict[int, int] = {}
    for v in sorted(range(slots), key=lambda v: (-sums.get(v, (0, 0))[1], v)):
        held, n, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (held + sums.get(v, (0, 0))[1], n + 1, s))
    return out


def rebalance(old: dict[int, int], sums: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards that moves few slots.

    Shards above the mean give their smallest slots that still help to the
    shard with the fewest bytes; slots of shards that are no more go first.
    """
    size = {v: sums.get(v, (0, 0))[1] for v in old}
    new = dict(old)
    load = [0] * shards
    loose = []
    for v, s in old.items():
        if s < shards:
            load[s] += size[v]
        else:
            loose.append(v)
    mean = sum(size.values()) / shards
    for v in sorted(old, key=lambda v: (size[v], v)):
        s = old[v]
        if s < shards and load[s] - size[v] >= mean and size[v]:
            load[s] -= size[v]
            loose.append(v)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for v in sorted(loose, key=lambda v: (-size[v], v)):
        b, s = heapq.heappop(heap)
        new[v] = s
        heapq.heappush(heap, (b + size[v], s))
    return new


def map_table(spark: SparkSession, chosen: dict[int, int], sums: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """The map as a table; ``first_row`` is where a slot's rows begin within their shard."""
    rows, begun = [], {}
    for v in sorted(chosen):
        n, b = sums.get(v, (0, 0))
        rows.append((version, v, chosen[v], n, b, begun.get(chosen[v], 0)))
        begun[chosen[v]] = begun.get(chosen[v], 0) + n
    return spark.createDataFrame(rows, MAP)


def latest_map(spark: SparkSession, maps: str) -> tuple[int, dict[int, int]] | None:
    """Version and shards by slot of the last map that was written whole in the folder; None if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(maps)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    whole = [f.getPath().getParent().getName() for f in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "v*/_SUCCESS"))]
    if not whole:
        return None
    version = max(int(name[1:]) for name in whole)
    return version, {r["vslot"]: r["shard"] for r in spark.read.schema(MAP).parquet(f"{maps}/v{version:06d}").collect()}


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, scratch: Scratch | None = None, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, vslot, version for every row of ``docs`` (doc_id, text).

    The law is ``bytes``: shards get nearly equal sizes. ``slot`` is a row's
    place in its shard, gapless from 0, by virtual slot and doc_id. Rows that
    repeat each have a place of their own. An empty table gives an empty
    result. A single record larger than a shard's share stands out, as no slot
    is split.

    ``maps`` is a folder of maps by version: the latest one is edited and stored
    as the next, the first run stores version 1. Without it the map is new.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    rows = scratch.save(records(docs, slots), "records")
    sums = slot_sums(rows)
    last = latest_map(docs.sparkSession, maps) if maps else None
    if last and len(last[1]) != slots:
        raise ValueError(f"the stored map has {len(last[1])} slots, not {slots}")
    version = last[0] + 1 if last else 1
    chosen = scratch.save(map_table(docs.sparkSession, rebalance(last[1], sums, shards) if last else assign(sums, shards, slots), sums, version), "map")
    if maps:
        chosen.write.parquet(f"{maps}/v{version:06d}")
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")))
    # The map has exactly ``slots`` rows.
    placed = placed.join(F.broadcast(chosen.select("vslot", "shard", "first_row", "version")), "vslot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first_row") + F.col("n") - 1).cast("long").alias("slot"), "vslot", "version",
    )
