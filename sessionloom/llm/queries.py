"""The thin queries over the operators of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded
from .centroids import clusters
from .decontam import contamination
from .lm import score_documents
from .manifest import audited
from .merkle import edited_documents
from .neardup import near_duplicates
from .packing import packed
from .secrets import find_secrets
from .sharding import sharded
from .toxicity import fit, score_toxicity
from .urlfilter import Rule, judge
from .warc import archived_pages


SHARDS = 40
RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary(), full=False)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary(), full=False)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_language_model": op8_language_model,
    "op9_url_filters": op9_url_filters,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_centroids": op13_centroids,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(rest: str) -> str:
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _rule(host: str, path: str, action: bool) -> str:
    whens = [
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.action if action else r.name}'"
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.action, r.name))
    ]
    return f"CASE {' '.join(whens)} END"


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256(concat({', '.join(parts)}))"


#: Unsigned CRC-32 of the decimal doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) // 2, 3988292384 * (xor(a, b) % 2))))"""


def _manifest_sql(source_levels: int = 5, top_levels: int = 3) -> str:
    """Levels are written out: sources of up to 16**5 rows, and 16**3 sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"a0 AS (SELECT *, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(lower)} ELSE {_leaf('text')} END AS claimed FROM documents)",
        "l0 AS (SELECT row_number() OVER () AS id, doc_id, source, leaf, claimed, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM a0)",
        "t0 AS (SELECT source AS g, i, leaf AS h FROM l0)",
    ]

    def levels(first: str, name: str, n: int) -> list[str]:
        out, last = [], first
        for k in range(1, n + 1):
            # A segment of one node stays as it is.
            out.append(f"""{name}{k} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
              CASE WHEN any_value(n) > 1 THEN string_agg(h, '' ORDER BY i) END AS pre FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {last}) GROUP BY g, i // 16)""")
            last = f"{name}{k}"
        return out

    steps += levels("t0", "t", source_levels)
    steps.append(f"r0 AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h FROM t{source_levels})")
    steps += levels("r0", "r", top_levels)
    joins = [f"JOIN t{k} ON t{k}.g IS NOT DISTINCT FROM l0.source AND t{k}.i = l0.i // {16**k}" for k in range(1, source_levels + 1)]
    joins += ["JOIN r0 ON r0.source IS NOT DISTINCT FROM l0.source", *[f"JOIN r{k} ON r{k}.i = r0.i // {16**k}" for k in range(1, top_levels + 1)]]
    path = [(f"t{k}.pre", f"l0.i // {16 ** (k - 1)} % 16") for k in range(1, source_levels + 1)] + [(f"r{k}.pre", f"r0.i // {16 ** (k - 1)} % 16") for k in range(1, top_levels + 1)]
    listed = ", ".join(f"{{'p': {p}, 's': CAST({s} AS BIGINT)}}" for p, s in path)
    steps.append(f"w AS (SELECT l0.*, t{source_levels}.h AS subroot, r{top_levels}.h AS root, list_filter([{listed}], lambda x: x.p IS NOT NULL) AS path FROM l0 {' '.join(joins)})")
    fold, last = [], "w"
    for k in range(1, source_levels + top_levels + 1):
        at = f"path[{k}]"
        now = "claimed" if k == 1 else "folded"
        keep = "* EXCLUDE (folded)" if k > 1 else "*"
        fold.append(f"""f{k} AS (SELECT {keep}, CASE WHEN len(path) < {k} THEN {now}
          ELSE sha256(substr({at}.p, 1, 64 * {at}.s) || {now} || substr({at}.p, 64 * {at}.s + 65)) END AS folded FROM {last})""")
        last = f"f{k}"
    return f"""WITH {", ".join(steps + fold)}
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: substr(x.p, 1, 64 * x.s) || substr(x.p, 64 * x.s + 65)), '')) AS proof_sha256,
  folded AS folded_root, folded = root AS verified FROM {last}"""


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    steps = [
        """v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    # Rows of one vector and centroid, their squared distance; the nearest, of equally near ones the least.
    pick = """SELECT v.id, min_by(c.c, (list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) :: BIGINT, c.c)) AS c,
      min(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) :: BIGINT) AS d FROM v, {0} c GROUP BY v.id"""
    for r in range(1, rounds + 1):
        steps.append(f"p{r} AS ({pick.format(f'c{r - 1}')})")
        steps.append(f"""m{r} AS (SELECT c, list(CAST(floor_sum AS BIGINT) ORDER BY j) AS v FROM (
          SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
          FROM (SELECT p.c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS j FROM p{r} p JOIN v USING (id)) GROUP BY c, j) GROUP BY c)""")
        steps.append(f"c{r} AS (SELECT a.c, coalesce(m.v, a.v) AS v FROM c{r - 1} a LEFT JOIN m{r} m ON a.c = m.c)")
    steps.append(f"p AS ({pick.format(f'c{rounds}')})")
    return f"""WITH {", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT vec_id, CAST(p.c AS INTEGER) AS cluster, p.d AS distance, CAST(sum(p.d) OVER (PARTITION BY p.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(p.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM p JOIN v USING (id) JOIN c{rounds} c ON c.c = p.c"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _manifest_sql(),
    "op13_centroids": _centroid_sql(),
    "op1_near_duplicates": rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM worded
), items AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
  HAVING 100 * count(*) >= 75 * ((SELECT len(s) FROM sets WHERE doc_id = a.doc_id) + (SELECT len(s) FROM sets WHERE doc_id = b.doc_id) - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM sets
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON u = doc_id
""",
    "op2_decontamination": rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g
  FROM (SELECT *, least(13, len(w)) AS n FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT p.doc_id, x.item_id, p.n, p.i FROM places p JOIN windows x ON p.n = x.n AND p.g = x.g
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op10_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
""",
    "op9_url_filters": rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style|textarea|title|template)\b.*?</(script|style|textarea|title|template)\s*>', '', 'g') AS html,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT *, coalesce({_host("rest")}, '') AS host, coalesce({_path("rest")}, '') AS path, {_host("rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node FROM p
), tags AS (
  SELECT node, host, split_part(url, '://', 1) AS scheme, unnest(string_split(html, '<')) AS tag FROM q WHERE rest IS NOT NULL
), found AS (
  SELECT node, host, scheme, replace(CASE
    WHEN lower(tag) LIKE 'link %rel="canonical"%' THEN split_part(split_part(tag, 'href="', 2), '"', 1)
    WHEN lower(tag) LIKE 'meta %"refresh"%' THEN split_part(split_part(tag, 'url=', 2), '"', 1) END, '&amp;', '&') AS link
  FROM tags
), target AS (
  SELECT node AS u, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || host || link END AS url
  FROM found WHERE link <> ''
), edges AS (
  SELECT u, {_host("rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS v FROM (SELECT u, substr(url, instr(url, '://') + 3) AS rest FROM target WHERE url IS NOT NULL)
), sides AS (
  SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v
), reach AS (
  SELECT u, u AS v FROM sides UNION SELECT r.u, s.v FROM reach r JOIN sides s ON r.v = s.u
), acts AS (
  SELECT u, min({_rule(_host("v"), _path("v"), True)}) AS action FROM reach GROUP BY u
)
SELECT page_id, host, path, {_rule("host", "path", False)} AS rule, coalesce({_rule("host", "path", True)}, action, 'allow') AS verdict
FROM q LEFT JOIN acts ON node = u
""",
}
