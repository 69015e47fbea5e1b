"""Near-duplicate groups: MinHash, banding, verification, star components.

1. Every row becomes the set of its distinct five-word shingles, and the set
   becomes HASHES minima of universal hash functions. BANDS groups of ROWS
   minima are bucket keys. At a similarity of 0.75 a pair shares no bucket with
   a chance of (1 - 0.75**5)**40 = 2e-5, at 0.85 of 3e-11.
2. Rows with equal sets form a class, and every class is one node: copies never
   multiply. A doc_id that came with several sets ties their nodes together.
3. Each bucket links its members to its least member (a star). Candidate links
   are checked on signatures, then confirmed on the full sets: the partners of
   a node meet it in blocks of bounded size, so a node with very many partners
   is spread over tasks, and its text goes to each block once.
4. Components of the confirmed links come from alternating stars.
5. A bucket whose other members still lie in two components is not finished.
   Its members are dealt into blocks of bounded size, and blocks of those
   outside the component of its least member meet all of its blocks: pairs
   from different components are compared in the first bucket they share, on
   full sets, and only links come out. So no link that a bucket holds is lost,
   and pairs within a component are never listed.

Joins of tables that grow with the corpus ask for a sort-merge plan, so that
small and large inputs take the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import Scratch
from .words import bound_batches, mix, released, shingle_sets

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Minima that the signature check compares, by their low 16 bits.
CHECKED = 128
#: The similarity of a link, as a percentage.
PERCENT = 75
#: Below this share of equal minima a candidate is dropped: 5 standard deviations under 0.75.
SIGNATURE_LEAST = 0.55
#: Members of a block of a node's partners, and members and shingles of one of an unfinished bucket, on average at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 96, 30_000
#: Parts of a component that meet its least doc_id each by itself.
SALTS = 16
#: Bits of the filter that keeps most texts without candidates out of a shuffle: 4 MB at most.
FILTER_BITS = 1 << 25

_rng = np.random.default_rng(75)
_MUL = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
_BLOCK = 512

SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text_hash", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("class_key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("signature", T.BinaryType()),
])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every universal hash function over a set."""
    least = None
    for lo in range(0, len(shingles), _BLOCK):
        values = _MUL * shingles[lo : lo + _BLOCK]
        values += _ADD
        part = values.min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least >> np.uint64(32)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Sketches (documents, HASHES) -> bucket keys (documents, BANDS)."""
    parts = sketches.reshape(len(sketches), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


@released
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, keys, sketches, have = [], [], [], []
        for i, s in enumerate(shingle_sets(batch.column(2))):
            counts.append(len(s))
            if len(s):
                have.append(i)
                keys.append(_set_key(s))
                sketches.append(minima(s))
            else:
                keys.append(None)
        bands, signatures = [None] * len(counts), [None] * len(counts)
        if have:
            m = np.stack(sketches)
            b, low = band_keys(m).view(np.int64), (m[:, :CHECKED] & np.uint64(0xFFFF)).astype(np.uint16)
            for j, i in enumerate(have):
                bands[i], signatures[i] = b[j], low[j].tobytes()
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
            pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
        ], names=SKETCH.names)


def _set_key(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


@released
def _signatures_agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, CHECKED) for i in (2, 3))
            good = np.flatnonzero((left == right).mean(axis=1) >= SIGNATURE_LEAST)
            yield pa.record_batch([batch.column(i).take(pa.array(good)) for i in (0, 1)], names=["u", "v"])


def _sets_agree(percent: int):
    @released
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, part, is_u, node = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            # Rows come sorted: a block's own node stands before its partners.
            for i, x in enumerate(shingle_sets(batch.column(4))):
                if is_u[i]:
                    block, own = (u[i], part[i]), x
                elif block == (u[i], part[i]) and _linked(own, x, percent):
                    keep.append(i)
            yield pa.record_batch([pa.array([x[i] for i in keep], pa.int64()) for x in (u, node)], names=["u", "v"])

    return confirm


def _linked_blocks(percent: int):
    """Blocks of probes and of members -> links between different components."""

    def unpack(rows: list[dict]) -> tuple:
        ids, roots, main = ([r[k] for r in rows] for k in ("node", "root", "is_main"))
        bands = np.array([r["bands"] for r in rows], np.int64)
        low = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint16).reshape(-1, CHECKED)
        return np.array(ids), roots, np.array(main), bands, low, [np.frombuffer(r["shingles"], np.uint64) for r in rows]

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for bucket, probes, members in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, roots, _, bands, low, sets = unpack(probes.as_py())
                ids2, roots2, main2, bands2, low2, sets2 = unpack(members.as_py())
                up: dict = {}

                def find(x, up=up):
                    while x in up:
                        x = up[x]
                    return x

                n2 = np.array([len(x) for x in sets2])
                for i in range(len(ids)):
                    same = bands2 == bands[i]
                    first = np.where(same.any(axis=1), bands[i][same.argmax(axis=1)], 0)
                    n = len(sets[i])
                    good = (first == bucket) & (main2 | (ids2 > ids[i])) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2))
                    good = np.flatnonzero(good)
                    agree = (low2[good] == low[i]).mean(axis=1)
                    for j in good[np.argsort(-agree, kind="stable")][: int((agree >= SIGNATURE_LEAST).sum())]:
                        x, y = find(roots[i]), find(roots2[j])
                        if x != y and _linked(sets[i], sets2[j], percent):
                            up[max(x, y)] = min(x, y)
                            u.append(int(ids[i]))
                            v.append(int(ids2[j]))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return compare


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


@released
def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _with_texts(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted`` (node, more) with the text of each node.

    A bit filter of bounded size over the nodes' doc_ids goes to all tasks first;
    what it lets through by chance the join takes out. With very many ids it lets
    all through, and the join does the work alone.
    """
    page = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    page, bit = (page / 32768).cast("int"), (page % 32768).cast("int")
    placed = wanted.join(nodes.select("node", "doc_id", "text_hash"), "node")
    bits = placed.select(page.alias("page"), bit.cast("long").alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = (
        texts.where("doc_id is not null").withColumn("page", page).withColumn("bit", bit).join(F.broadcast(bits), "page")
        .withColumn("byte", byte).where(F.expr("shiftright(byte, bit % 8) & 1 = 1")).select("doc_id", "text_hash", "text")
    )
    # Repeated rows meet within their own task first. An inner join stays above the filter; a semi join would be moved below it.
    return placed.join(some.dropDuplicates(["doc_id", "text_hash"]), ["doc_id", "text_hash"]).drop("doc_id", "text_hash")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (u, v) whose sizes and signatures agree."""
    sig = nodes.select(F.col("node").alias("id"), "signature", "n_shingles").hint("merge")
    return (
        pairs.join(sig.select(F.col("id").alias("u"), F.col("signature").alias("a"), F.col("n_shingles").alias("na")), "u")
        .join(sig.select(F.col("id").alias("v"), F.col("signature").alias("b"), F.col("n_shingles").alias("nb")), "v")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .select("u", "v", "a", "b")
        .mapInArrow(_signatures_agree, "u long, v long")
    )


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (u, v) whose full sets agree. ``pairs`` is a table."""
    many = pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_MEMBERS)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK_MEMBERS), F.lit(1)).cast("long")
    dealt = pairs.join(many, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), blocks).cast("int").alias("block"))
    dealt = scratch.save(dealt, "dealt")
    wanted = dealt.select("u", "block", F.lit(False).alias("is_u"), F.col("v").alias("node")).union(
        dealt.select("u", "block").distinct().select("u", "block", F.lit(True), F.col("u")))
    met = _with_texts(scratch.save(wanted, "wanted"), nodes, texts).select("u", "block", "is_u", "node", "text")
    met = met.repartition("u", "block").sortWithinPartitions("u", "block", F.desc("is_u"))
    return scratch.save(met.mapInArrow(_sets_agree(percent), "u long, v long"), "links")


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    roots = stars.select(F.col("u").alias("x"), F.col("v").alias("r"))
    both = pairs.join(roots.toDF("u", "ru"), "u", "left").join(roots.toDF("v", "rv"), "v", "left")
    return both.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def _unfinished(shared: DataFrame, nodes: DataFrame, texts: DataFrame, stars: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links between members of buckets that lie in several components; None where there is no such bucket."""
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    pivots = stars.select(F.col("u").alias("pivot"), F.col("v").alias("main"))
    others = scratch.save(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "others")
    mixed = others.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
    rest = (
        others.join(mixed, "bucket").join(pivots, "pivot", "left")
        .select("bucket", "node", "root", (F.col("root") == F.coalesce("main", "pivot")).alias("is_main"))
    )
    rest = scratch.save(rest, "rest")
    scratch.drop(others)
    if rest.isEmpty():
        return None
    ids = scratch.save(rest.select("node").distinct(), "ids")
    sets = _with_texts(ids, nodes, texts).select("node", "text").mapInArrow(_shingled, "node long, shingles binary")
    sets = scratch.save(nodes.select("node", "n_shingles", "bands", "signature").join(sets, "node"), "sets")
    sizes = rest.join(sets.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n"))
    sizes = sizes.select("bucket", F.ceil(F.greatest(F.col("weight") / BLOCK_SHINGLES, F.col("n") / BLOCK_MEMBERS)).cast("int").alias("blocks"))
    dealt = rest.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    packed = scratch.save(
        dealt.join(sets, "node").groupBy("bucket", "block")
        .agg(F.collect_list(F.struct("node", "root", "is_main", "bands", "signature", "shingles")).alias("members")), "packed")
    scratch.drop(rest, ids, sets)
    probes = packed.select("bucket", F.filter("members", lambda m: ~m["is_main"]).alias("probes")).where("size(probes) > 0")
    links = scratch.save(probes.join(packed, "bucket").select("bucket", "probes", "members").mapInArrow(_linked_blocks(percent), "u long, v long"), "more")
    scratch.drop(packed)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id long, text string).

    ``component_id`` is the least doc_id reachable over links of at least
    ``percent`` % similarity; ``kept`` is true for that document. Null and
    word-less texts have an empty set and stand alone. A null doc_id stands
    alone too, with a null component_id, and is kept. Rows of one doc_id are
    one document: it has the links of all its texts, and its rows get equal
    components. Other columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketches = scratch.save(texts.mapInArrow(_sketch, SKETCH), "sketches")

    # A node's number is fixed by the table it is written to. Rows of a class have equal sets, so any one's will do.
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    first = real.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "signature")])
    nodes = scratch.save(first.select(F.monotonically_increasing_id().alias("node"), "class_key", "at.doc_id", "at.text_hash", "n_shingles", "bands", "signature"), "nodes")

    # The texts of a doc_id are one document: their classes are tied, and rows without words go with them.
    several = sketches.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("class_key").alias("a"), F.max("class_key").alias("b"), F.count("class_key").alias("c"), F.count("*").alias("n")).where("a <> b or (c > 0 and c < n)")
    several = scratch.save(several.select("doc_id", F.col("a").alias("main_key")), "several")
    known = nodes.select("class_key", "node")
    tied = (
        real.join(several, "doc_id").where("class_key <> main_key").select("class_key", "main_key").distinct()
        .join(known.toDF("class_key", "u"), "class_key").join(known.toDF("main_key", "v"), "main_key").select("u", "v")
    )

    members = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("bucket", "pivot")
    shared = scratch.save(members.join(buckets.hint("merge"), "bucket").where("node <> pivot"), "shared")

    near = scratch.save(_near(shared.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct(), nodes, percent), "near")
    # One pair for each node first: most others then lie within a component
    # and their texts need not be brought together.
    one = scratch.save(near.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "one")
    stars = components(_confirmed(one, nodes, texts, percent, scratch).union(tied), scratch)
    left = scratch.save(_apart(near, stars), "left")
    if not left.isEmpty():
        stars = components(stars.union(_confirmed(left, nodes, texts, percent, scratch)), scratch)
    scratch.drop(one, near, left)
    more = _unfinished(shared, nodes, texts, stars, percent, scratch)
    if more is not None:
        stars = components(stars.union(more), scratch)

    # Only nodes with links: all others are components of their own. A very large component is dealt into SALTS parts.
    linked = stars.toDF("node", "root").union(stars.select("v", "v").distinct())
    linked = scratch.save(linked.join(nodes.select("node", "doc_id"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = nodes.select("node", "class_key", "doc_id").join(linked.join(least, ["root", "salt"]).select("node", "component_id"), "node", "left")
    named = scratch.save(named.select("class_key", F.coalesce("component_id", "doc_id").alias("component_id")), "named")
    scratch.keep_only(sketches, several, named)
    rows = sketches.select("doc_id", "n_shingles", "class_key")
    if not several.isEmpty():
        rows = rows.join(several, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_key", "main_key")).alias("class_key"))
    return (
        rows.join(named, "class_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of the document that stays of each group.

    Of rows that repeat a doc_id the one of the least SHA-256 of its values, as
    JSON, stays, in whatever order they come; rows with a null doc_id all stay,
    and so do those without words (null or empty texts). An empty table stays
    empty.
    """
    scratch = Scratch(docs.sparkSession, "deduplicated")
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = docs.schema["doc_id"].dataType
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = scratch.save(kept, "kept").select(F.col("doc_id").cast(same).alias("doc_id"))
    named = docs.where("doc_id is not null")
    several = scratch.save(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    chosen = named.join(kept, "doc_id", "left_semi")
    if not several.isEmpty():
        again = chosen.join(several, "doc_id", "left_semi").withColumn("digest of the row", F.sha2(F.to_json(F.struct(*own)), 256))
        least = again.groupBy("doc_id").agg(F.min("digest of the row").alias("digest of the row"))
        # Rows of one id and digest are equal, so it doesn't matter which of them stays.
        again = again.join(least, ["doc_id", "digest of the row"], "left_semi").dropDuplicates(["doc_id"])
        chosen = chosen.join(several, "doc_id", "left_anti").unionByName(again.drop("digest of the row"))
    return chosen.select(own).unionByName(docs.where("doc_id is null"))
