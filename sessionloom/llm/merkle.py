"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut, losing nothing, after blank lines into sections, after line ends
into paragraphs, and into pieces of up to four words, the leaves. A paragraph's
digest is SHA-256 of its text, a section's of its paragraphs' digests, the root
of the sections'. So equal roots mean equal texts, up to a collision of
SHA-256. The fingerprint writes the tree down: ``root|section(paragraph:leaves)``,
inner digests and leaves shortened; they serve to follow differing branches
only. Where roots differ, branches that both sides have are passed over by their
digests, and leaves are compared within the others. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Hexadecimal digits of a leaf's, a paragraph's and a section's digest.
LEAF, PARAGRAPH, SECTION = 8, 16, 16
#: Up to four words, of up to 64 characters each, with the space after them; or space alone.
_PIECES = r"(?s)(?:[^\x20\x09-\x0D]{1,64}[\x20\x09-\x0D]*+){1,4}|[\x20\x09-\x0D]+"
#: Paragraphs of fewer characters have leaves of up to four characters.
SHORT = 64
_PARAGRAPHS = r"(?<=\n)(?!\n)"
_SECTIONS = r"(?<=\n\n)(?!\n)"

#: Documents that a part of the id range holds about.
PART_ROWS = 4000
#: Above this many parts they get larger instead.
MOST_PARTS = 20_000


def _leaf(piece: Column) -> Column:
    return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(piece))), 16, "0"), 1, LEAF)


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    pieces = lambda p: F.when(F.length(p) < SHORT, F.regexp_extract_all(p, F.lit("(?s).{1,4}"), 0)).otherwise(F.regexp_extract_all(p, F.lit(_PIECES), 0))
    leaves = lambda p: F.array_join(F.transform(pieces(p), _leaf), "")
    paragraph = lambda p: F.struct(_digest(p).alias("d"), leaves(p).alias("t"))
    # A letter keeps the digests of inner nodes apart from those of texts.
    above = lambda name, nodes: _digest(F.concat(F.lit(name), F.array_join(F.transform(nodes, lambda x: x["d"]), "")))
    written = lambda nodes, n, before, after, sep: F.array_join(
        F.transform(nodes, lambda x: F.concat(F.substring(x["d"], 1, n), F.lit(before), x["t"], F.lit(after))), sep)
    paragraphs = F.transform(F.split(text, _SECTIONS, -1), lambda s: F.transform(F.split(s, _PARAGRAPHS, -1), paragraph))
    sections = F.transform(paragraphs, lambda ps: F.struct(above("S", ps).alias("d"), written(ps, PARAGRAPH, ":", "", ",").alias("t")))
    return _bound(sections, lambda ss: F.concat(above("R", ss), F.lit("|"), written(ss, SECTION, "(", ")", ";")))


def _sections(fp: Column) -> Column:
    return F.split(F.substring_index(fp, "|", -1), ";")


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.regexp_extract(s, r"\((.*)\)", 1), ",")))


def _leaves(paragraphs: Column) -> Column:
    """The leaves of paragraphs as a fingerprint writes them."""
    return F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring_index(F.substr(p, F.lit(PARAGRAPH + 2)), "#", 1), F.lit("[0-9a-f]{8}"), 0)))


def _weight(branches: Column) -> Column:
    """How many leaves there are in all under branches: sections, or paragraphs."""
    letters = lambda b: F.length(F.regexp_replace(b, f"^[0-9a-f]{{{SECTION}}}\\(|[0-9a-f]{{{PARAGRAPH}}}:|[,)]|#[0-9]+$", ""))
    return F.aggregate(branches, F.lit(0), lambda n, b: n + letters(b)) / F.lit(LEAF)


def _numbered(items: Column) -> Column:
    """Texts in their order, the second equal one with ``#1`` after it, the third with ``#2``: all differ, so sets of them count repeats.

    Sorting brings equal ones together; the place of a run's start is what is taken off.
    """
    def ran(s: Column, starts: Column) -> Column:
        last = lambda j: F.coalesce(F.get(starts, j + 1), F.size(s)) - 1
        key = lambda x, n: F.struct(x["i"].alias("i"), F.when(n == 0, x["x"]).otherwise(F.concat(x["x"], F.lit("#"), n.cast("string"))).alias("x"))
        runs = F.transform(starts, lambda at, j: F.transform(F.slice(s, at + 1, last(j) - at + 1), key))
        return F.transform(F.sort_array(F.flatten(runs)), lambda x: x["x"])

    def sorted_(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["x"] != F.get(s, i - 1)["x"]))
        return _bound(starts, lambda at: ran(s, at))

    placed = lambda xs: F.sort_array(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return _bound(items, lambda xs: F.when(F.size(F.array_distinct(xs)) == F.size(xs), xs).otherwise(_bound(placed(xs), sorted_)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: twice the shared leaves over all leaves; only equal ones give 1.

    The trees are walked from the top: sections that both have count whole, then
    paragraphs that both have within the other sections, then the leaves of what
    is left. What one side has more often is shared as often as the other has
    it. The same leaves in another order, n of them on both sides together, give n / (n + 1).
    """
    def from_leaves(shared: Column, x: Column, y: Column) -> Column:
        both = shared + F.size(F.array_intersect(x, y))
        n = 2 * shared + F.size(x) + F.size(y)
        return F.when(n == 0, F.lit(0.0)).otherwise(F.least(2.0 * both / n, n / (n + 1.0)))

    def from_paragraphs(shared: Column, x: Column, y: Column) -> Column:
        rest = F.struct(
            (shared + _weight(F.array_intersect(x, y))).alias("n"), _numbered(_leaves(F.array_except(x, y))).alias("x"), _numbered(_leaves(F.array_except(y, x))).alias("y"))
        return _bound(rest, lambda r: from_leaves(r["n"], r["x"], r["y"]))

    def from_sections(x: Column, y: Column) -> Column:
        rest = F.struct(
            _weight(F.array_intersect(x, y)).alias("n"), _numbered(_paragraphs(F.array_except(x, y))).alias("x"), _numbered(_paragraphs(F.array_except(y, x))).alias("y"))
        return _bound(rest, lambda r: from_paragraphs(r["n"], r["x"], r["y"]))

    tops = F.struct(_numbered(_sections(a)).alias("x"), _numbered(_sections(b)).alias("y"))
    return F.when(a == b, F.lit(1.0)).otherwise(_bound(tops, lambda s: from_sections(s["x"], s["y"])))


_NO_EDITS = "array<struct<kind:string,section:int,paragraph:int>>"


def edits(a: Column, b: Column) -> Column:
    """Where text ``b`` differs from ``a``, by their fingerprints: structs of kind, section and paragraph, places from 0.

    Sections that both have are passed over by their digests. Of the others'
    paragraphs those of ``a`` alone are ``deleted``, at their places there, and
    those of ``b`` alone ``added``; a changed one is both. Repeats count. What
    both have but what follows another one than before, both as far as they are
    shared, is ``moved``: sections (``paragraph`` null) and, within the sections
    that differ, paragraphs. Equal texts give an empty list; as fingerprints of
    different ones differ, so does at least one place.
    """
    def alone(items: Column) -> Column:
        """Of ``items`` with a key, which each side has once at most: (those of one side only, those of both)."""
        differs = lambda s, x, i: F.coalesce(F.get(s, i)["key"] != x["key"], F.lit(True))
        split = lambda s: F.transform(s, lambda x, i: F.struct((F.when(i == 0, True).otherwise(differs(s, x, i - 1)) & differs(s, x, i + 1)).alias("alone"), x.alias("x")))
        of = lambda s, which: F.transform(F.filter(s, lambda x: x["alone"] == which), lambda x: x["x"])
        return _bound(_bound(F.sort_array(items), split), lambda s: F.struct(of(s, F.lit(True)).alias("one"), of(s, F.lit(False)).alias("both")))

    def moved(both: Column) -> Column:
        """Items of ``b`` that come after another one than in ``a``."""
        side = lambda name: F.sort_array(F.transform(F.filter(both, lambda x: x["side"] == name), lambda x: F.struct(x["section"], x["paragraph"], x["key"])))
        after = lambda name: lambda s: F.transform(s, lambda x, i: F.struct(
            F.concat(F.when(i == 0, F.lit("")).otherwise(F.get(s, i - 1)["key"]), F.lit(">"), x["key"]).alias("key"), F.lit(name).alias("side"), x["section"].alias("section"), x["paragraph"].alias("paragraph")))
        pairs = F.concat(*[_bound(side(name), after(name)) for name in ("a", "b")])
        return F.filter(alone(pairs)["one"], lambda x: x["side"] == "b")

    def told(items: Column, kind: Column | None = None) -> Column:
        named = lambda x: F.when(x["side"] == "a", "deleted").otherwise("added") if kind is None else kind
        return F.transform(items, lambda x: F.struct(named(x).alias("kind"), x["section"].alias("section"), x["paragraph"].alias("paragraph")))

    def keyed(digests: Column, side: str, section, paragraph) -> Column:
        return F.transform(digests, lambda d, i: F.struct(d.alias("key"), F.lit(side).alias("side"), section(i).alias("section"), paragraph(i).alias("paragraph")))

    def within(sections: Column, one: Column, side: str) -> Column:
        """Paragraphs of the sections that only ``side`` has, with their places."""
        own = F.filter(one, lambda x: x["side"] == side)
        places = F.flatten(F.transform(own, lambda x: F.transform(
            _paragraphs(F.array(F.get(sections, x["section"]))), lambda p, j: F.struct(x["section"].alias("section"), j.alias("paragraph"), F.substring(p, 1, PARAGRAPH).alias("d")))))
        return _bound(F.sort_array(places), lambda ps: _bound(_numbered(F.transform(ps, lambda p: p["d"])), lambda keys: keyed(
            keys, side, lambda i: F.get(ps, i)["section"], lambda i: F.get(ps, i)["paragraph"])))

    def from_paragraphs(parts: Column) -> Column:
        return F.concat(told(parts["one"]), told(moved(parts["both"]), F.lit("moved")))

    def from_sections(x: Column, y: Column, parts: Column) -> Column:
        inner = alone(F.concat(within(x, parts["one"], "a"), within(y, parts["one"], "b")))
        return F.concat(told(moved(parts["both"]), F.lit("moved")), _bound(inner, from_paragraphs))

    def top(s: Column) -> Column:
        digests = lambda ss: _numbered(F.transform(ss, lambda x: F.substring(x, 1, SECTION)))
        at, none = (lambda i: i), (lambda i: F.lit(None).cast("int"))
        items = F.concat(keyed(digests(s["x"]), "a", at, none), keyed(digests(s["y"]), "b", at, none))
        return _bound(alone(items), lambda parts: F.sort_array(from_sections(s["x"], s["y"], parts)))

    sides = F.struct(_sections(a).alias("x"), _sections(b).alias("y"))
    return F.when(a == b, F.array().cast(_NO_EDITS)).otherwise(_bound(sides, top))


def _written(found: Column) -> Column:
    """Edits as text: ``kind:section:paragraph``, comma-joined; a whole section's paragraph is ``*``."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["section"].cast("string"), F.coalesce(x["paragraph"].cast("string"), F.lit("*")))), ",")


def _part(cuts: list[int]) -> Column:
    """The number of cuts that are at most doc_id, by halving the sorted cuts."""
    if not cuts:
        return F.lit(0)
    held = F.array(*[F.lit(c) for c in cuts])

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(held, mid) <= F.col("doc_id")
        return (
            F.when(s["lo"] >= s["hi"], s)
            .when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, start, step, lambda s: s["lo"])


#: Numbers of parts of one cut: more than any id is dealt into.
_WITHIN = 1 << 20


def _dealt(rows: DataFrame, part_rows: int) -> DataFrame:
    """``rows`` (doc_id, text_hash) with ``part``, which ascends with doc_id and then text_hash.

    The bounds are quantiles of all ids. An id that is several quantiles at
    once, or null, has so many rows that they are dealt further by their hash.
    """
    sizes = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    parts = max(1, min(MOST_PARTS, -(-sizes["n"] // part_rows)))
    at: list[int] = []
    if parts > 1:
        at = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] or []
    cuts = sorted(set(at))
    place = F.col("text_hash") / F.lit(2.0**64) + F.lit(0.5)
    within = lambda times: F.least(F.floor(place * times), times - 1)
    nulls = sizes["n"] - sizes["known"]
    # Columns of their own are evaluated once.
    rows = rows.withColumn("first", _part(cuts))
    last = F.lit(_WITHIN - 1)
    if len(at) > len(cuts):
        times, held = (F.array(*[F.lit(x) for x in xs]) for xs in ([at.count(c) for c in cuts], cuts))
        rows = rows.withColumn("own", F.when(F.get(held, F.col("first") - 1) == F.col("doc_id"), F.get(times, F.col("first") - 1)))
        # Rows of the cut's own id stand before all others of its part.
        last = F.coalesce(within(F.col("own")), last)
    part = F.col("first") * F.lit(_WITHIN) + last
    if nulls:
        part = F.when(F.col("doc_id").isNull(), within(F.lit(-(-nulls // part_rows))) - F.lit(_WITHIN)).otherwise(part)
    return rows.withColumn("part", part.cast("long")).drop("first", "own")


def with_next(docs: DataFrame, scratch: Scratch, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, text, fingerprint and next_text and next_fingerprint, those of the next row by ascending doc_id (after the last: the first).

    Rows are dealt by parts of the id range, and a row's next is found within
    its part. The last row of a part takes the first of the following part,
    from a table of one row per part.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    dealt = _dealt(rows, part_rows)
    firsts = dealt.groupBy("part").agg(F.min_by("text", F.struct("doc_id", "text_hash", "text")).alias("text"))
    firsts = scratch.save(firsts.withColumn("fingerprint", fingerprint(F.col("text"))), "firsts")
    present = sorted(r["part"] for r in firsts.select("part").collect())
    follows = spark.createDataFrame([(p, present[(i + 1) % len(present)]) for i, p in enumerate(present)], "part long, after long")
    heads = follows.join(firsts.select(F.col("part").alias("after"), F.col("text").alias("head"), F.col("fingerprint").alias("head_fingerprint")), "after").drop("after")
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash", "text")
    # Fingerprints are made before rows meet: each text's once.
    led = dealt.withColumn("fingerprint", fingerprint(F.col("text")))
    led = led.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    return led.join(heads, "part").select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "head").alias("next_text"), F.coalesce("next_fingerprint", "head_fingerprint").alias("next_fingerprint"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text and of the next document, and ``edits``, the places that were edited.

    The edited text has its last quarter of code points replaced by as many of
    the next document's first ones, or all it has. A null text is empty and an
    empty text has a fingerprint; of a single row the next one is itself. Rows
    that repeat a doc_id are ordered by a hash of their texts; a null doc_id
    comes before all others. An empty table gives an empty result.
    """
    rows = with_next(docs, Scratch(docs.sparkSession, "merkle"))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    made = made.select("doc_id", "n_chars", _digest(F.col("edited")).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        _written(edits(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("edits"),
    )
