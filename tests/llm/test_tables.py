"""Manifest, packing and centroid clustering against brute force, and on awkward tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from sessionloom.llm import centroids, manifest, merges, packing
from sessionloom.llm.queries import vocabulary
from sessionloom.llm.words import utf8

RNG = random.Random(11)
EXTRA = "n string, idx long, path string, named int, hash string, root string, cluster string, v string, length string, _row int"


def with_extra(df):
    return df.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in EXTRA.split(", ")])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 11 ----------------------------------------------------------------------------

DOC = "doc_id long, source string, lang string, n_chars long, text string"


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, by trees held whole."""
    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            lo = i // 16 * 16
            yield level[lo:i], level[i + 1 : lo + 16]
            i //= 16

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(by_source[s]):
            path = [*steps(trees[s], i), *steps(top, k)]
            now = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = leaf((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[s][-1][0], root, sha("".join("".join(x + y) for x, y in path)), now, now == root))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest(spark):
    def text():
        return "".join(RNG.choice("abcÄß XYZ\n") for _ in range(RNG.randint(0, 40)))

    # A source of three levels that holds most rows, one of exactly 16, one of 17, single ones.
    sizes = {"hot": 300, "sixteen": 16, "seventeen": 17, "one": 1, "": 2, None: 3, "é": 1, "z": 1, "Z": 2}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, source, RNG.choice(["en", None]), RNG.choice([1, None, -5]), RNG.choice([text(), text(), None, ""])))
            k += 7
    rows += [(3, "hot", "en", 1, "same"), (3, "hot", "en", 1, "same"), (3, "hot", "en", 1, "Other"), (None, "hot", None, None, None), (None, None, None, None, None), (5, "long", "en", 1, "Wörd " * 60000)]
    RNG.shuffle(rows)
    docs = with_extra(spark.createDataFrame(rows, DOC))
    found = rows_of(manifest.audited(docs))
    assert found == sorted(brute_manifest(rows), key=repr)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_small(spark):
    one = [(1, "a", "en", 3, "abc")]
    for rows in (one, [(i, str(i), None, None, "T") for i in range(20)], one * 33):
        assert rows_of(manifest.audited(spark.createDataFrame(rows, DOC))) == sorted(brute_manifest(rows), key=repr)
    assert manifest.audited(spark.createDataFrame([], DOC)).count() == 0
    assert manifest.build(spark.createDataFrame([], DOC)).root is None


# --- 12 ----------------------------------------------------------------------------

TEXTS = [
    None, "", " \n\t", "one", "The cat's hat, isn't it? I'm we've they'll you'd re're ''s 's's don''t 'stop x'y 'r 'v'e",
    "a1b22c333 --- !!! ... a.b.c 100,000.00", "Ünï Straße ÀÉÎ ½ ¼² naïve—dash “quoted” €5", "Ωmega ſ K İstanbul 漢字 é   nb\x0bsp\x00zero",
    "x" * 500, "ab" * 30 + " " + "q" * 47 + " " + "q" * 48, "<|endoftext|> and <|startoftext|>", "mixed\r\nlines\tand  spaces   ", "'", "''", "s't", "'tis 'twas o'clock' 'll 'l l'",
]


def random_texts(n):
    letters = "aaabcdeeefghilmnorstuüéßÀ'’ -.,!?0123\n\tQZ"
    return ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_merges(library, monkeypatch):
    import pyarrow as pa

    found = merges.Merges(vocabulary())
    column = pa.array(TEXTS + random_texts(400))
    for kept in (merges.KEPT, 100):
        monkeypatch.setattr(merges, "KEPT", kept)
        for lo in range(0, len(column), 37):
            part = column.slice(lo, 37)
            data, at = utf8(part)
            for text, ids in zip(part.to_pylist(), found.texts(data, at), strict=True):
                assert ids.tolist() == library(text), text


def test_differencing():
    for n, windows in ((1, 1), (1, 3), (2, 2), (5, 3), (40, 7), (300, 11)):
        lengths = [RNG.randint(1, 4095) for _ in range(n)]
        window, sums = packing.differencing(lengths, windows)
        assert sorted(np.bincount(window, weights=lengths, minlength=windows).astype(int).tolist()) == sums == sorted(sums)
        # Never a spread over the longest item.
        assert sums[-1] - sums[0] <= max(lengths)
    # Of two windows the classical differences: 8, 7, 6, 5, 4 leave 2.
    assert packing.differencing([8, 7, 6, 5, 4], 2)[1] == [14, 16]
    # Three and three, which one more window makes fit.
    assert max(np.bincount(packing.balanced([2500] * 6, 4096))) == 1


def test_packing(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_WINDOWS", 8)
    texts = TEXTS + random_texts(150) + ["Word salad " * 9000, "aé " * 8192, "hello " * 4095, "hello " * 4096]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = packing.packed(docs, vocabulary()).collect()
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append([*library(t), 2])
    # Pieces of one id put together: those of rows that share an id by their totals and places.
    for k, lists in want.items():
        pieces = [r for r in got if r["doc_id"] == k]
        assert sum(len(r["ids"]) for r in pieces) == sum(map(len, lists))
        assert all(len(r["ids"]) == r["length"] for r in pieces)
        for r in pieces:
            assert any(r["doc_tokens"] == len(x) and x[r["start"] : r["start"] + r["length"]] == r["ids"] for x in lists)
        assert sorted(r["start"] for r in pieces) == sorted(x for ids in lists for x in range(0, len(ids), 4096))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    digests = packing.packed(docs, vocabulary(), full=False).collect()
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in digests) == sorted((str(r["doc_id"]), r["start"], crc(r["ids"])) for r in got)
    assert packing.packed(docs.limit(0), vocabulary(), full=False).count() == 0


def test_packing_pads_little(spark):
    from sessionloom.llm.queries import op12_packing

    sums = op12_packing(spark, "/root/testdata/sf0.01").groupBy("sequence_id").sum("length").collect()
    total = [r["sum(length)"] for r in sums]
    assert max(total) <= 4096
    assert sum(4096 - t for t in total if t & (t - 1)) < 0.03 * 4096 * len(total)


# --- 13 ----------------------------------------------------------------------------

def brute_clusters(rows, k, dims, rounds, scale=256, seed=2):
    import math

    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    signed = [struct.pack(f"<{dims}i", *v) for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, sha(f"{seed}:{kept[j][0]}"), signed[j]))
    cs = [kept[j][1] for j in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        for n, vs in held.items():
            cs[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in found)
    by = {}
    for _, n, d in found:
        by[n] = by.get(n, 0) + d
    return sorted([(i, n, d, by[n], total, sha(",".join(map(str, cs[n])))) for i, n, d in found], key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_centroids(spark, kind):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(400)]
    # Far and near, equal vectors with ties between centroids, zeros, one vector very often.
    rows += [(1000 + i, [float(i % 3 - 1)] * 6) for i in range(60)] + [(2000 + i, [0.0] * 6) for i in range(5)] + [(3000 + i, rows[7][1]) for i in range(200)]
    rows += [(5, rows[5][1]), (5, [9.5] * 6), (None, [1.0] * 6), (None, None), (7000, None), (7001, []), (7002, [1.0] * 5), (7003, [1.0] * 7)]
    rows += [(7004, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (7005, [float("nan")] + [1.0] * 5), (7006, [float("inf")] * 6), (7007, [-0.001, 1e-9, -1e-9, 2000.5, 0.5, -0.5])]
    r2 = random.Random(1)
    r2.shuffle(rows)
    table = with_extra(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    for k in (1, 2, 12):
        assert rows_of(centroids.clusters(table, k=k, dims=6)) == brute_clusters(rows, k, 6, 5)
    few = table.where("vec_id in (3, 4, 9)")
    assert rows_of(centroids.clusters(few, k=40, dims=6)) == brute_clusters([x for x in rows if x[0] in (3, 4, 9)], 40, 6, 5)
    assert centroids.clusters(table.limit(0), dims=6).count() == 0
    assert centroids.clusters(table, dims=64).count() == 0


def test_annulus():
    r = np.random.default_rng(6)
    for scale in (3, 1000, 1 << 26):
        v, c = r.integers(-scale, scale, (500, 4)), r.integers(-scale, scale, (30, 4))
        c[7], v[:30], c[20] = c[3], c, -c[3]
        distance = ((v[:, None, :] - c) ** 2).sum(axis=2)
        found, best = centroids.nearest(v, c)
        assert (found == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()


def test_centroids_out_of_range(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.clusters(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()
