"""Text functions as Column expressions: token estimates, slugs, tool summaries.

No function here is a Python UDF; each is an expression that Spark compiles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NOISE_TOOLS

# Results must agree on them.
CJK = "[一-鿿㐀-䶿豈-﫿]"
TRUNCATED = "\n...[truncated to fit token budget]"
ERROR_WORDS = "error|failed|not found|denied|fatal"
SENTENCE_ENDS = "。.!?！？"
#: White space at either end, as Python's strip() takes it off.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, ENDS, "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def prefix(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def joined(lines: Column, sep: str = "\n") -> Column:
    return F.array_join(lines, sep)


def estimate_tokens(c: Column) -> Column:
    """A quarter token a character, two thirds a CJK one, and one more; 0 for an empty text."""
    cjk = F.regexp_count(c, F.lit(CJK))
    n = F.floor((F.length(c) - cjk) / F.lit(4.0) + cjk / F.lit(1.5)) + 1
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0).cast("long")).otherwise(n.cast("long"))


def truncate_to_budget(c: Column, budget: int) -> Column:
    """Cut a text whose estimate is over the budget and that has over 1.5 characters a token of it."""
    most = int(budget * 1.5)
    return F.when((estimate_tokens(c) > budget) & (F.length(c) > most), F.concat(prefix(c, most), F.lit(TRUNCATED))).otherwise(c)


def _slugged(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")


def _or(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def topic_slug(c: Column) -> Column:
    """At most 40 of a-z, 0-9 and single inner hyphens."""
    return _or(F.regexp_replace(prefix(_slugged(c), 40), "-+$", ""), "unnamed-topic")


def skill_slug(c: Column) -> Column:
    return _or(_slugged(c), "unnamed-skill")


def mask_secret(c: Column, visible: int = 4) -> Column:
    n = F.length(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "(not set)")
        .when(n <= visible, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(prefix(c, visible), F.repeat(F.lit("*"), n - visible)))
    )


def project_name(directory: Column, default: str = "unknown") -> Column:
    """The last segment of a path with either kind of slash."""
    path = F.regexp_replace(F.replace(directory, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.when(F.coalesce(directory, F.lit("")) == "", F.lit(default)).otherwise(F.element_at(F.split(path, "/", -1), -1))


def has_error_words(output: Column) -> Column:
    return F.rlike(prefix(F.lower(output), 500), F.lit(ERROR_WORDS))


def _more(lines: Column, shown: int, sep: str) -> Column:
    """The first lines, and how many more there are."""
    n = F.size(lines)
    rest = F.when(n > shown, F.concat(F.lit(f"{sep}... and "), (n - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(joined(F.slice(lines, 1, shown), sep), rest)


def compress_bash(command: Column, output: Column) -> Column:
    lines = lines_of(output)
    n = F.size(lines)
    folded = F.concat(joined(F.slice(lines, 1, 3)), F.lit("\n  ... ("), (n - 5).cast("string"), F.lit(" more lines) ...\n"), joined(F.slice(lines, -2, 2)))
    body = prefix(F.when(n <= 6, prefix(output, 300)).otherwise(folded), 300)
    head = F.concat(F.lit("$ "), prefix(command, 200))
    mark = F.when(has_error_words(output), "ERR").otherwise("OK")
    return F.when(output == "", head).otherwise(F.concat(head, F.lit("  ["), mark, F.lit("]\n"), body))


def compress_read(path: Column, output: Column) -> Column:
    # From a line's first visible character to its end: one match for each line that has any.
    count = F.regexp_count(output, F.lit(r"(?U)[^\s\x1c-\x1f][^\n]*"))
    lines = F.transform(F.slice(F.split(output, "\n", 6), 1, 5), strip)
    first = F.get(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("<"))), 0)
    head = F.concat(F.lit("Read("), path, F.lit(") → "))
    return F.when(output == "", F.concat(head, F.lit("empty/no file"))).otherwise(
        F.concat(head, count.cast("string"), F.lit(" lines. Starts with: "), F.coalesce(prefix(first, 80), F.lit(""))))


def compress_write(path: Column, content: Column) -> Column:
    lines = lines_of(content)
    n = F.size(lines)
    folded = F.concat(joined(F.slice(lines, 1, 2)), F.lit("\n  ... ("), (n - 4).cast("string"), F.lit(" lines omitted) ...\n"), joined(F.slice(lines, -2, 2)))
    return F.concat(F.lit("Write("), path, F.lit(", "), n.cast("string"), F.lit(" lines)\n"), F.when(n <= 5, prefix(content, 150)).otherwise(folded))


def compress_edit(path: Column, old: Column, new: Column) -> Column:
    def side(c: Column) -> tuple[Column, Column]:
        lines = lines_of(strip(c))
        return F.size(lines).cast("string"), _or(prefix(F.element_at(lines, 1), 60), "(empty)")

    (old_n, old_first), (new_n, new_first) = side(old), side(new)
    return F.concat(F.lit("Edit("), path, F.lit(") -"), old_n, F.lit("/+"), new_n, F.lit(" lines\n  - "), old_first, F.lit("\n  + "), new_first)


def _matches(name: str, pattern: Column, output: Column, shown: int) -> Column:
    found = strip(output)
    lines = lines_of(found)
    head = F.concat(F.lit(f"{name}("), pattern, F.lit(") → "))
    return F.when(found == "", F.concat(head, F.lit("0 matches"))).otherwise(
        F.concat(head, F.size(lines).cast("string"), F.lit(" matches:\n  "), _more(lines, shown, "\n  ")))


def compress_glob(pattern: Column, output: Column) -> Column:
    return _matches("Glob", pattern, output, 5)


def compress_grep(pattern: Column, output: Column) -> Column:
    return _matches("Grep", pattern, output, 3)


def compress_task(agent: Column, description: Column, output: Column) -> Column:
    head = F.concat(F.lit("Agent("), agent, F.lit("): "), prefix(description, 100))
    dots = F.when(F.length(output) > 200, "...").otherwise("")
    return F.when(output == "", head).otherwise(F.concat(head, F.lit("\n  → "), prefix(output, 200), dots))


def compress_default(tool: Column, input_repr: Column, output: Column) -> Column:
    """``input_repr`` is the input as Python prints it, see ``pyrepr``."""
    return F.concat(tool, F.lit("("), prefix(input_repr, 100), F.lit(") → "), prefix(output, 200))


def tool_summary(tool: Column, input_json: Column, output: Column, input_repr: Column) -> Column:
    """One line to a few for a tool call; noise tools give an empty one."""
    output = text_or_empty(output)
    field = lambda name: F.coalesce(F.get_json_object(input_json, f"$.{name}"), F.lit(""))
    agent = F.coalesce(F.get_json_object(input_json, "$.subagent_type"), F.lit("?"))
    return (
        F.when(tool.isin(*NOISE_TOOLS), "")
        .when(tool == "bash", compress_bash(field("command"), output))
        .when(tool == "read", compress_read(field("filePath"), output))
        .when(tool == "write", compress_write(field("filePath"), field("content")))
        .when(tool == "edit", compress_edit(field("filePath"), field("oldString"), field("newString")))
        .when(tool == "glob", compress_glob(field("pattern"), output))
        .when(tool == "grep", compress_grep(field("pattern"), output))
        .when(tool == "task", compress_task(agent, field("description"), output))
        .otherwise(compress_default(tool, input_repr, output))
    )


def reasoning_conclusion(c: Column) -> Column:
    """A long thought as its first and its last sentence; the last is the first from behind."""
    sentence = lambda x: strip(F.regexp_extract(x, rf"(?U)^[{SENTENCE_ENDS}\s\x1c-\x1f]*([^{SENTENCE_ENDS}]+)", 1))
    first, last = sentence(c), F.reverse(sentence(F.reverse(c)))
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(first == "", prefix(c, 150))
        .when(F.length(c) <= 200, c)
        .otherwise(F.concat(prefix(first, 80), F.lit(" ... → "), last))
    )


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def markdown_to_html(c: Column) -> Column:
    """Headings, list items and bold of an escaped text."""
    c = F.regexp_replace(c, r"(?m)^#{2,3} (.+)$", "<h4>$1</h4>")
    c = F.regexp_replace(c, r"(?m)^[-*] (.+)$", "<li>$1</li>")
    return F.regexp_replace(c, r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def extract_body(content: Column) -> Column:
    """A skill file without front matter and title."""
    body = F.regexp_replace(content, r"\A---\n(?s:.*?)\n---\n*", "")
    return strip(F.regexp_replace(body, r"\A#[ \t\n\x0B\f\r]+[^\n]+\n*", ""))


def skill_markdown(topic_id: Column, title: Column, description: Column, summary: Column, body: Column) -> Column:
    filled = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    return F.concat(
        F.lit("---\nname: "), skill_slug(topic_id), F.lit("\ndescription: "), prefix(filled(description, summary, title), 1024),
        F.lit("\n---\n\n# "), title, F.lit("\n\n"), filled(body, summary))


def frontmatter_description(content: Column) -> Column:
    """The first ``description:`` of the front matter, 100 characters at most; empty if there is none."""
    front = F.regexp_extract(content, r"(?s)\A---(.*?)---", 1)
    found = F.get(F.filter(F.transform(lines_of(front), strip), lambda x: F.startswith(x, F.lit("description:"))), 0)
    return F.coalesce(prefix(strip(F.substr(found, F.lit(len("description:") + 1))), 100), F.lit(""))


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds / 60).cast("string")
    return F.when(seconds < 60, F.concat(F.format_string("%.1f", F.bround(seconds, 1)), F.lit(" 秒"))).otherwise(
        F.concat(whole, F.lit(" 分 "), F.rint(seconds % 60).cast("int").cast("string"), F.lit(" 秒")))


def percent(confidence: Column) -> Column:
    """Of a share clamped to 0..1, rounded half to even."""
    return F.rint(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def score_colour(score: Column) -> Column:
    return F.when(score >= 0.7, "green").when(score >= 0.4, "amber").otherwise("red")


def iso_to_ms(ts: Column) -> Column:
    """An ISO-8601 time in epoch milliseconds; 0 for what is none. Times without a zone are of the session's."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(ts)), F.lit(0).cast("long"))
