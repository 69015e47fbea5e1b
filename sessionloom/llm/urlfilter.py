"""URL rules that reach a page's aliases.

Pages name aliases by canonical links and by redirects (meta refresh), all that
they have, relative to the page's base. Those
edges join URLs to components, found by alternating star steps over tables, and
a component's decisions reach the members that no rule fits. Everything is
DataFrame expressions.

A page's verdict: that of its own rule, the longest that fits; else allow if a
rule allows any member of its component; else block if a rule blocks one; else
allow.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch


class Rule(NamedTuple):
    """``action`` (allow or block) for ``host`` and its subdomains, from ``path`` on."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _tags(name: str) -> str:
    """Whole tags of a name; a quoted value may hold ``>``, and quotes that do not close do not count."""
    return rf"""(?is)<{name}\b(?:(?:[^>"']++|"[^"]*+"|'[^']*+'){{0,200}}+>|[^>]*>)"""


def _attribute(name: str) -> str:
    """An attribute's value, as one of three groups."""
    return rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""


#: The target within a refresh's content: after the seconds, with or without ``url=``, with or without quotes of its own.
_TARGET = r"""(?is)^[\s\d.]*[;,\s]\s*(?:url\s*=\s*)?+(?:"([^"]*)|'([^']*)|([^\s"'][^\s]*))"""

#: Comments, and elements whose content is text or not part of the page, up to their end or the page's; or any other tag, as a group.
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp|iframe|noembed|noframes)\b.*?(?:</\1\s*>|\z)"
    r"""|(<[a-z/](?:(?:[^>"']++|"[^"]*+"|'[^']*+'){0,200}+>|[^>]*>))"""
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, lower_ascii(F.regexp_extract(F.substr(url, at + 3), r"(?s)^([^/?#]*)", 1))), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(name, action) of the longest rule that fits, null if none does; at a tie allow wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.action != "allow", r.name))
    fits = [F.when(_fits(r, host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<name:string,action:string>")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    # A dot segment at the end leaves the slash before it.
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))))
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def _node(url: Column) -> Column:
    """A URL as an alias: host lower-cased, without scheme, dot segments and fragment."""
    query = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), _bound(path_of(url), _without_dots), query)


def _absolute(link: Column, url: Column) -> Column:
    """A link as a URL, completed from the page's as RFC 3986 says; null for a fragment and for schemes without ``//``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.rlike(link, F.lit(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)")), F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def _value(tag: Column, name: str) -> Column:
    """An attribute of a tag; empty if it has none."""
    return _group(tag, _attribute(name))


def _group(text: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def unescaped(text: Column) -> Column:
    """Character references as characters: numbers of the basic plane, and the names of HTML's own signs."""
    code = lambda part: F.regexp_extract(part, r"(?i)^(x[0-9a-f]{1,4}|[0-9]{1,5});", 1)
    digits = lambda c: F.when(F.lower(F.substring(c, 1, 1)) == "x", F.substr(c, F.lit(2))).otherwise(F.conv(c, 10, 16))
    letter = lambda c: F.decode(F.unhex(F.lpad(digits(c), 4, "0")), "UTF-16BE")
    parts = F.transform(F.split(text, "&#", -1), lambda part, i: F.when(i == 0, part).when(code(part) == "", F.concat(F.lit("&#"), part)).otherwise(
        F.concat(letter(code(part)), F.substr(part, F.length(code(part)) + 2))))
    out = F.when(F.contains(text, F.lit("&#")), F.array_join(parts, "")).otherwise(text)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def page_links(html: Column) -> tuple[Column, Column]:
    """All canonical links and redirects of a page as its tags have them, and the first base that it names (null: none).

    Comments count for nothing, nor does what is within scripts, styles, text
    areas, titles, templates and frames.
    """
    return _links_of(F.regexp_replace(html, _HIDDEN, "$2"))


def _links_of(html: Column) -> tuple[Column, Column]:
    words = lambda c: F.split(F.lower(c), r"\s+", -1)
    canonical = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(_tags("link")), 0), lambda t: F.array_contains(words(_value(t, "rel")), "canonical")), lambda t: _value(t, "href"))
    moved = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(_tags("meta")), 0), lambda t: F.lower(F.trim(_value(t, "http-equiv"))) == "refresh"), lambda t: _group(_value(t, "content"), _TARGET))
    ready = lambda c: F.trim(unescaped(c))
    base = F.get(F.filter(F.transform(F.regexp_extract_all(html, F.lit(_tags("base")), 0), lambda t: ready(_value(t, "href"))), lambda x: x != ""), 0)
    return F.filter(F.transform(F.concat(canonical, moved), ready), lambda x: x != ""), base


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v) for every canonical link and redirect of a page with a URL to another URL."""
    low = F.lower("html")
    marked = F.col("html").isNotNull() & (F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh")))
    links, base = page_links(F.col("html"))
    edge = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    # Values that are named more than once are bound, and nothing is filtered above this step: Spark would
    # move the filter below and with it put these expressions into one another.
    edges = lambda own, from_: F.transform(links, lambda x: _bound(_absolute(x, from_), lambda target: edge(own, _node(target))))
    from_ = F.coalesce(_absolute(base, F.col("url")), F.col("url"))
    every = _bound(F.struct(_node(F.col("url")).alias("own"), from_.alias("from")), lambda b: edges(b["own"], b["from"]))
    found = pages.where(marked & F.contains("url", F.lit("://"))).select(F.explode(F.filter(every, lambda e: e["u"] != e["v"])).alias("e"))
    return found.select("e.u", "e.v").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, verdict, alias_of for every row of ``pages`` (page_id, url, html).

    ``alias_of`` is the least URL of the page's component, null for a page
    without aliases. A null URL, or one without ``://``, has empty host and
    path, no rule and no aliases, and is allowed. A null html has no links.
    Repeated rows get equal results; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sides = components(alias_edges(rows), scratch)
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if sides.isEmpty():
        named = judged.withColumn("alias_of", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    else:
        members = scratch.save(sides.union(sides.select("v", "v")).distinct().toDF("node", "root"), "members")
        # A member's rule is judged by its URL, whether or not it is a page.
        slash = F.concat(F.lit("x://"), F.col("node"))
        acts = members.withColumn("own", rule_of(host_of(slash), path_of(slash), rules)["action"])
        roots = scratch.save(acts.groupBy("root").agg(
            F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("action")), "roots")
        # Two joins on keys that tables hold once: a very common root or node can be split.
        known = scratch.save(members.join(roots, "root").select("node", F.col("root").alias("alias_of"), "action"), "known")
        named = judged.withColumn("node", F.when(F.contains("url", F.lit("://")), _node(F.col("url")))).join(known, "node", "left")
    return named.select(
        "page_id", "url", "host", "path", F.col("own.name").alias("rule"),
        F.coalesce("own.action", "action", F.lit("allow")).alias("verdict"), "alias_of",
    )
