"""JSON within model replies, and Python's way to print values.

Character automata that Spark has no expression for: Arrow-batched UDFs.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: What decides where a JSON text may end: strings (the last may be unfinished), brackets and commas.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[][{},]', re.S)
_CLOSED_BY = {"{": "}", "[": "]"}
_FENCED = re.compile(r"^[^\S\n]*```[^\n]*\n(.*?)(?:^[^\S\n]*```[^\n]*$|\Z)", re.M | re.S)


def _parsed(text: str):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def endings(text: str) -> tuple[list[tuple[int, str]], str]:
    """Places where a cut-off JSON text may end, each with what closes it there; and what closes the whole text.

    A value is complete before a comma and after a closing bracket. One scan
    keeps the brackets that are open, so every place knows its own depth.
    """
    places: list[tuple[int, str]] = []
    closing = ""
    for mark in _MARKS.finditer(text):
        c = mark[0]
        if c in _CLOSED_BY:
            closing = _CLOSED_BY[c] + closing
        elif c == ",":
            places.append((mark.start(), closing))
        elif closing and c == closing[0]:
            closing = closing[1:]
            places.append((mark.end(), closing))
    return places, closing


def repaired(text: str):
    """(found, value) of a cut-off JSON text: all of it up to the last complete value, with its brackets closed.

    A text whose brackets are all closed is not cut off and is not repaired.
    """
    places, closing = endings(text)
    if closing:
        for end, ending in (*reversed(places), (len(text), closing)):
            found, value = _parsed(text[:end] + ending)
            if found:
                return True, value
    return False, None


def extract(text: str):
    """The JSON value of a reply.

    Where there are code fences only what they hold counts. In turn: the text
    itself, from its first to its last brace, that repaired, and from its first
    to its last square bracket, as ``items``. What is none comes back as
    ``raw_response`` with ``_parse_error``.
    """
    if "```" in text:
        text = "".join(_FENCED.findall(text))
    text = text.strip()
    braces, brackets = (re.search(p, text, re.S) for p in (r"\{.*\}", r"\[.*\]"))
    ways = [(_parsed, text)]
    if braces:
        ways += [(_parsed, braces[0]), (repaired, braces[0])]
    for way, part in ways:
        found, value = way(part)
        if found:
            return value
    found, value = _parsed(brackets[0]) if brackets else (False, None)
    return {"items": value} if found else {"raw_response": text, "_parse_error": True}


@F.pandas_udf(StringType())
def _extract_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else json.dumps(extract(t), ensure_ascii=False))


def extract_json(c: Column) -> Column:
    """JSON text of what ``extract`` finds; null stays null."""
    return _extract_udf(c)


@F.pandas_udf(StringType())
def _repr_udf(texts: pd.Series) -> pd.Series:
    def shown(t):
        found, value = (False, None) if t is None else _parsed(t)
        return str(value) if found else (t or "")

    return texts.map(shown)


def pyrepr(c: Column) -> Column:
    """A JSON text as Python prints the value; what is no JSON stays, null is empty."""
    return _repr_udf(c)
