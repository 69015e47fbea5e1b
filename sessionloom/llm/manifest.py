"""A Merkle manifest of a dataset, with proofs along stored parent preimages.

Every row is a leaf. Leaves of one source, in the order of doc_id, are the
lowest level of the source's tree: every RUN consecutive nodes have one parent,
whose preimage is its children's hashes in a row. Preimages are stored, one row
for each parent. What is left of each source is again the lowest level of a tree
over the sources.

A leaf's proof needs no tree walk: preimages are joined with their own ancestors
from the root downwards, the leaves join the result once, and from each ancestor
preimage a leaf cuts out the 64 characters that are its own to have its siblings,
or puts another hash in their place to fold a root.

Places within a source are counted in two steps, by range of the order and then
within it, so a source that holds most rows is not sorted by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Children of a parent, and characters of a digest.
RUN, DIGEST = 16, 64
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A source, null kept apart from the empty one and before it.
SEGMENT = ["named", "source_key"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row: each field ``-`` if null, else its length in UTF-8 bytes, a colon and the field."""
    def part(name: str) -> Column:
        x = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return digest(F.concat(*map(part, FIELDS)))


def numbered(rows: DataFrame, segment: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``idx``, the place within the segment from 0 by ``order``, and ``n``, the segment's rows.

    Rows equal in ``order`` are numbered in any one order. The sorted rows are a
    table, so that counts and places are of the same partitions.
    """
    by = [*segment, *order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    spread = scratch.save(spread.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    spread = spread.withColumn("_part", F.shiftright("_at", 33))
    # A row for each partition and segment in it: no more than partitions and segments together.
    held = spread.groupBy(*segment, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*segment)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(whole)).drop("_n")
    placed = spread.join(held, [*segment, "_part"])
    return placed.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


@dataclass
class Tree:
    """Levels of the trees of all segments: ``nodes[0]`` are the leaves, ``nodes[i]`` (segment, idx, n, preimage, hash) their parents."""

    segment: list[str]
    nodes: list[DataFrame]

    def tops(self) -> DataFrame:
        """(segment, hash) of what is left of every segment."""
        out = [x.where("n = 1").select(*self.segment, "hash") for x in self.nodes]
        whole = out[0]
        for x in out[1:]:
            whole = whole.unionByName(x)
        return whole


def grown(leaves: DataFrame, segment: list[str], scratch: Scratch) -> Tree:
    """The levels above ``leaves`` (segment, idx, n, hash), until every segment has one node left."""
    nodes, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // RUN)
        # RUN children at most.
        children = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        up = (
            nodes[-1].where("n > 1").groupBy(*segment, F.expr(f"idx div {RUN}").alias("parent"))
            .agg(F.expr(f"(max(n) + {RUN - 1}) div {RUN}").alias("n"), F.array_join(children, "").alias("preimage"))
        )
        nodes.append(scratch.save(up.select(*segment, F.col("parent").alias("idx"), "n", "preimage", digest(F.col("preimage")).alias("hash")), "parents"))
    return Tree(segment, nodes)


def with_path(tree: Tree, above: DataFrame) -> DataFrame:
    """The lowest nodes with ``path``, (preimage, slot) from the parent up to the root.

    ``above`` (segment, path, further columns) is what follows the last node of every segment.
    """
    extra = [c for c in above.columns if c not in (*tree.segment, "path")]
    ready = None
    for nodes in reversed(tree.nodes):
        last = nodes.where("n = 1").join(above, tree.segment)
        if ready is None:
            ready = last
            continue
        up = ready.select(*tree.segment, F.col("idx").alias("_parent"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *extra)
        own = F.struct(F.col("_preimage").alias("preimage"), F.expr(f"cast(idx % {RUN} as int)").alias("slot"))
        inner = nodes.where("n > 1").withColumn("_parent", F.expr(f"idx div {RUN}")).join(up, [*tree.segment, "_parent"])
        inner = inner.withColumn("path", F.concat(F.array(own), "_path")).drop("_parent", "_preimage", "_path")
        ready = inner.unionByName(last)
    return ready


def siblings(path: Column) -> Column:
    """The hashes of a leaf's siblings, level by level, left to right, in a row."""
    return F.array_join(F.transform(path, lambda p: F.concat(_left(p), _right(p))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's hash and its siblings."""
    return F.aggregate(path, leaf, lambda hash, p: digest(F.concat(_left(p), hash, _right(p))))


def _left(p: Column) -> Column:
    return F.substring(p["preimage"], F.lit(1), p["slot"] * DIGEST)


def _right(p: Column) -> Column:
    return F.substring(p["preimage"], (p["slot"] + 1) * DIGEST + 1, F.lit(RUN * DIGEST))


@dataclass
class Manifest:
    """The trees of the sources, the tree over them, and the root (None without rows)."""

    sources: Tree
    top: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with its columns, ``subroot``, ``root`` and ``path``."""
        start = F.array().cast("array<struct<preimage: string, slot: int>>")
        root = self.top.nodes[-1].where("n = 1").select(*self.top.segment, F.lit(self.root).alias("root"), start.alias("path"))
        subroots = with_path(self.top, root).select(*self.sources.segment, F.col("hash").alias("subroot"), "root", "path")
        return with_path(self.sources, subroots)


def build(docs: DataFrame, scratch: Scratch | None = None, **also: Column) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text).

    A leaf row has doc_id, its place and its hash, and what ``also`` names.
    Null sources are one source, before all others; null doc_ids come first
    within theirs; rows of one doc_id are ordered by their digest, and equal
    rows are leaves each. An empty table has no root.
    """
    scratch = scratch or Scratch(docs.sparkSession, "manifest")
    source = F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("source_key"),
        leaf_digest().alias("hash"), *[x.alias(name) for name, x in also.items()],
    )
    # Sorting samples its input first, which would read and hash the texts twice.
    leaves = scratch.save(numbered(scratch.save(rows, "hashes"), SEGMENT, ["doc_id", "hash"], scratch), "leaves")
    sources = grown(leaves, SEGMENT, scratch)
    subroots = sources.tops().withColumn("all", F.lit(0))
    top = grown(scratch.save(numbered(subroots, ["all"], SEGMENT, scratch), "subroots"), ["all"], scratch)
    root = top.nodes[-1].where("n = 1").select("hash").first()
    return Manifest(sources, top, root["hash"] if root else None)


def tampered() -> Column:
    """The digest of a row whose text was lower-cased, A-Z only, where 5 divides the CRC-32 of the decimal doc_id; else null."""
    struck = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    return F.when(struck, leaf_digest(text=F.translate(F.col("text").cast("string"), _UPPER, _LOWER)))


def audited(docs: DataFrame, claimed: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    ``claimed`` is the digest that each row presents, null where it is its own;
    the root is folded from it and from the siblings of the manifest. Rows with
    nulls in any column, empty texts and repeated rows are leaves like others;
    an empty table gives an empty result. Other columns are ignored.
    """
    rows = build(docs, scratch, claimed=tampered() if claimed is None else claimed).proofs()
    rows = rows.withColumn("folded_root", folded(F.coalesce("claimed", "hash"), F.col("path")))
    return rows.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
