"""Text expressions: literal inputs and what comes out."""

import html

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import jsontext as J
from sessionloom.functions import text as T


def check(spark, f, *pairs):
    """Each input gives the text beside it."""
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(pairs)], "i int, t string")
    got = [r["x"] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [want for _, want in pairs]


def test_tokens(spark):
    check(spark, T.estimate_tokens, ("", 0), (None, 0), (" ", 1), ("abc", 1), ("abcd", 2), ("x" * 301, 76), ("你好", 2), ("你好世界这是中文测试", 7), ("emoji 😀 and 㐀 and 豈", 6))
    check(spark, lambda c: T.truncate_to_budget(c, 20), ("x" * 76, "x" * 76), ("x" * 80, "x" * 30 + "\n...[truncated to fit token budget]"), ("你" * 30, "你" * 30), ("你" * 31, "你" * 30 + "\n...[truncated to fit token budget]"))


def test_slugs(spark):
    check(spark, T.topic_slug, ("", "unnamed-topic"), ("--A__B--", "a-b"), ("A" * 60, "a" * 40), ("a" * 39 + " b", "a" * 39), ("中文", "unnamed-topic"), ("Straße 9", "stra-e-9"), ("  lead\n\ttail \u3000\x1c", "lead-tail"))
    check(spark, T.skill_slug, ("", "unnamed-skill"), ("A" * 60, "a" * 60), ("'q' & \"r\" <b>", "q-r-b"))


def test_bash(spark):
    check(
        spark, lambda c: T.compress_bash(F.lit("ls"), c), ("", "$ ls"), ("a", "$ ls  [OK]\na"), ("Error: FATAL thing", "$ ls  [ERR]\nError: FATAL thing"), ("\n", "$ ls  [OK]\n\n"),
        ("a\nb\nc\nd\ne\nf", "$ ls  [OK]\na\nb\nc\nd\ne\nf"), ("a\nb\nc\nd\ne\nf\ng", "$ ls  [OK]\na\nb\nc\n  ... (2 more lines) ...\nf\ng"),
        ("x" * 301, "$ ls  [OK]\n" + "x" * 300), ("y" * 500 + " denied", "$ ls  [OK]\n" + "y" * 300))


def test_read_and_write(spark):
    check(
        spark, lambda c: T.compress_read(F.lit("p"), c), ("", "Read(p) → empty/no file"), (" ", "Read(p) → 0 lines. Starts with: "), ("<x>\n\n real line \n", "Read(p) → 2 lines. Starts with: real line"),
        ("\n\n\n\n\nsixth", "Read(p) → 1 lines. Starts with: "), ("x" * 90 + "\r\n\x1c\u3000\nb", "Read(p) → 2 lines. Starts with: " + "x" * 80))
    check(
        spark, lambda c: T.compress_write(F.lit("p"), c), ("", "Write(p, 1 lines)\n"), ("a\nb", "Write(p, 2 lines)\na\nb"), ("z" * 200, "Write(p, 1 lines)\n" + "z" * 150),
        ("a\nb\nc\nd\ne\nf", "Write(p, 6 lines)\na\nb\n  ... (2 lines omitted) ...\ne\nf"))


def test_searches_edits_and_tasks(spark):
    check(spark, lambda c: T.compress_glob(F.lit("p"), c), (" \n", "Glob(p) → 0 matches"), ("a\nb\n", "Glob(p) → 2 matches:\n  a\n  b"), ("a\nb\nc\nd\ne\nf\ng", "Glob(p) → 7 matches:\n  a\n  b\n  c\n  d\n  e\n  ... and 2 more"))
    check(spark, lambda c: T.compress_grep(F.lit("p"), c), ("", "Grep(p) → 0 matches"), ("a\nb\nc\nd", "Grep(p) → 4 matches:\n  a\n  b\n  c\n  ... and 1 more"))
    check(spark, lambda c: T.compress_edit(F.lit("p"), c, F.lit(" ")), (" one\ntwo \n", "Edit(p) -2/+1 lines\n  - one\n  + (empty)"), ("", "Edit(p) -1/+1 lines\n  - (empty)\n  + (empty)"), ("w" * 70, "Edit(p) -1/+1 lines\n  - " + "w" * 60 + "\n  + (empty)"))
    check(spark, lambda c: T.compress_task(F.lit("?"), F.lit("d"), c), ("", "Agent(?): d"), ("o" * 200, "Agent(?): d\n  → " + "o" * 200), ("o" * 201, "Agent(?): d\n  → " + "o" * 200 + "..."))


def test_reasoning(spark):
    many = "First one. Second! Third？ " * 12
    check(
        spark, T.reasoning_conclusion, ("", ""), (None, ""), ("Short. Kept whole!", "Short. Kept whole!"), ("..." * 60, "..." * 50), (many, "First one ... → Third"),
        (" . " + "a" * 90 + "。" + "b" * 120 + "  \x1c", "a" * 80 + " ... → " + "b" * 120), ("n" * 201, "n" * 80 + " ... → " + "n" * 201), ("! \u3000 one.\n" + " 😀 two words \u3000?" * 20 + "  ...", "one ... → 😀 two words"))


def test_small_functions(spark):
    check(spark, T.mask_secret, ("", "(not set)"), ("abc", "***"), ("abcd", "****"), ("abcdef", "abcd**"), (None, "(not set)"))
    check(spark, T.project_name, ("", "unknown"), ("/", ""), ("/a/b/", "b"), ("C:\\x\\proj", "proj"), ("one", "one"), (None, "unknown"))
    check(spark, T.html_escape, *[(t, html.escape(t)) for t in ("'q' & \"r\" <b>", "", "a < b && c")])
    check(spark, T.markdown_to_html, ("## T\n### U\n# V\n- a\n* b **c** d **e**", "<h4>T</h4>\n<h4>U</h4>\n# V\n<li>a</li>\n<li>b <strong>c</strong> d <strong>e</strong></li>"))
    skill = "---\nname: x\ndescription:  d e f \n---\n\n# T\n\nbody\n"
    check(spark, T.extract_body, (skill, "body"), ("plain", "plain"))
    check(spark, T.frontmatter_description, (skill, "d e f"), ("plain", ""))
    check(spark, T.iso_to_ms, ("2024-01-01T00:00:01Z", 1704067201000), ("2024-01-01T00:00:00+01:00", 1704063600000), ("2024-01-01T00:00:00", 1704067200000), ("", 0), ("x", 0))
    number = lambda f: lambda c: f(c.cast("double"))
    check(spark, number(T.percent), ("0.125", 12), ("0.135", 14), ("2", 100), ("-1", 0))
    check(spark, number(T.duration_text), ("3.14", "3.1 秒"), ("125.5", "2 分 6 秒"), ("60", "1 分 0 秒"))
    check(spark, number(T.score_colour), ("0.7", "green"), ("0.4", "amber"), ("0.39", "red"))


@pytest.mark.parametrize(("text", "value"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 2}\n```', {"a": 2}), ('x\n```\n{"a":\n```\ny\n```\n 3}\n```', {"a": 3}), ('```json\n{"a": 4}', {"a": 4}), ('well: {"a": 3} so', {"a": 3}),
    ("[1, 2]", [1, 2]), ("see [1, 2] there", {"items": [1, 2]}), ("none", {"raw_response": "none", "_parse_error": True}), ("null", None),
    ('{"s": "a ``` b"}', {"raw_response": "", "_parse_error": True}), ('{"a": 1 "b"}', {"raw_response": '{"a": 1 "b"}', "_parse_error": True}),
    ('so {"a": {"b": 1}, "c": [2', {"a": {"b": 1}}),
])
def test_json_of_replies(text, value):
    assert J.extract(text) == value


@pytest.mark.parametrize(("text", "value"), [
    ('{"a": 1, "b":', {"a": 1}), ('{"a": 1', {"a": 1}), ('{"a": "x, y: [", "b": "cut of', {"a": "x, y: ["}), ('{"a": 1, "b": {"c": 2}, "d": [1, {"e": 5}', {"a": 1, "b": {"c": 2}, "d": [1, {"e": 5}]}),
    ('[{"a": 1, "x": 2}, {"b":', [{"a": 1, "x": 2}]), ('{"a": "q\\"uo, te", "b": [1, 2', {"a": 'q"uo, te', "b": [1]}), ("{", {}),
])
def test_cut_off_json(text, value):
    assert J.repaired(text) == (True, value)


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2]", "words", "", '{"a": 1 "b"', '{"a": "'])
def test_json_that_is_not_repaired(text):
    assert J.repaired(text) == (False, None)


def test_json_columns(spark):
    check(spark, J.extract_json, ('{"a": 1}', '{"a": 1}'), (None, None))
    check(spark, J.pyrepr, ('{"a": true, "b": [null, "x"]}', "{'a': True, 'b': [None, 'x']}"), ("no json", "no json"), (None, ""))
