"""Secret scans: fixed patterns, and a battery of randomness tests.

Patterns give the base spans. Then every run of MIN_LENGTH or more letters,
digits, ``+``, ``/``, ``_`` and ``-`` is a candidate. Its encoding is inferred
(hexadecimal, letters of one or both cases, base32, base36, base62, base64) and
the battery asks whether it could be random text of that encoding: chi-squared uniformity over the alphabet, runs above and
below its middle, and serial correlation. What passes is then weighed against
ordinary text: the likelihood ratio between the uniform alphabet and the
characters of all documents, over the number of encodings it could have been,
is an e-value, so its inverse is a p-value whatever the length, and longer
strings give smaller ones. The step-up procedure of
Benjamini and Hochberg over all candidates of the corpus sets the threshold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import bound_batches, released, runs, sliced, utf8

KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH = 20
#: False discoveries among the added spans, at most, as a share.
FALSE_SHARE = 1e-3
#: A test of the battery rejects randomness below this.
REJECT = 1e-3
#: Natural logarithms of p-values are counted in steps of this size.
STEP = 0.05

# Over lower-cased bytes, which have the same offsets.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_MARKS = (b"passw", b"secret", b"token", b"api")

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[[43, 47, 95, 45]] = True

_UPPER, _LOWER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
#: From narrow to wide.
_ALPHABETS = {
    "hex": _DIGITS + b"abcdef", "HEX": _DIGITS + b"ABCDEF", "lower": _LOWER, "UPPER": _UPPER, "base32": _UPPER + b"234567",
    "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER, "letters": _UPPER + _LOWER, "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + b"+/",
}
_PLACES: dict[str, np.ndarray] = {}
for _name, _letters in _ALPHABETS.items():
    _PLACES[_name] = np.full(256, -1)
    _PLACES[_name][list(_letters)] = np.arange(len(_letters))
_PLACES["base64"][ord("-")], _PLACES["base64"][ord("_")] = 62, 63


def inferred(token: np.ndarray) -> str | None:
    """The narrowest encoding that holds all characters; None for digits alone, and for one letter case with signs only."""
    digit = ((token >= 48) & (token <= 57)).any()
    upper = ((token >= 65) & (token <= 90)).any()
    lower = ((token >= 97) & (token <= 122)).any()
    if int(digit) + int(upper) + int(lower) < 2:
        # Without a digit hexadecimal is left out: letters alone are drawn from letters.
        return next((name for name in ("lower", "UPPER") if (_PLACES[name][token] >= 0).all()), None)
    return next(name for name, place in _PLACES.items() if (place[token] >= 0).all())


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: np.ndarray, encoding: str) -> tuple[float, float, float]:
    """p-values under randomness: uniformity (one-sided), runs and serial correlation (two-sided)."""
    x = _PLACES[encoding][token]
    k, n = len(_ALPHABETS[encoding]), len(x)
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # The exact mean and variance of the statistic, so that short strings are judged fairly.
    z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    above = x >= k // 2
    a = int(above.sum())
    b = n - a
    if a == 0 or b == 0:
        runs_p = 2.0 ** (1 - n)
    else:
        r = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = _two_sided((r - mean) / math.sqrt(var)) if var > 0 else 1.0
    y = x - x.mean()
    power = float((y * y).sum())
    serial = _two_sided((float((y[1:] * y[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return uniform, runs_p, serial


@dataclass
class Model:
    """What the corpus gives: log shares of the token characters, and the threshold."""

    log_share: np.ndarray
    #: Candidates with a log p-value of at most this are secrets; -inf: none.
    most: float = 0.0

    def log_p(self, token: np.ndarray, encoding: str) -> float:
        return min(0.0, float(self.log_share[token].sum()) + len(token) * math.log(len(_ALPHABETS[encoding])) + math.log(len(_ALPHABETS)))


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        data, at = utf8(batch.column(0))
        for lo, hi in sliced(data, at):
            total += np.bincount(data[at[lo] : at[hi]], minlength=256)
    yield pa.record_batch([pa.array(range(256), pa.int32()), pa.array(total, pa.int64())], names=["c", "n"])


def _candidates(b: np.ndarray, at: np.ndarray, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    """Random-looking runs (start, end, log p) among the bytes of rows, and the number of tests."""
    starts, ends = runs(_TOKEN[b], at)
    long = np.flatnonzero(ends - starts >= MIN_LENGTH)
    out, tests = [], 0
    for i in long:
        s, e = int(starts[i]), int(ends[i])
        token = b[s:e]
        encoding = inferred(token)
        if encoding is None:
            continue
        tests += 1
        if min(battery(token, encoding)) >= REJECT:
            out.append((s, e, model.log_p(token, encoding)))
    return out, tests


def _tested(model: Model):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            data, at = utf8(batch.column(0))
            for lo, hi in sliced(data, at):
                found, tests = _candidates(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], model)
                held[-1] = held.get(-1, 0) + tests
                for _, _, p in found:
                    k = math.floor(-p / STEP)
                    held[k] = held.get(k, 0) + 1
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], names=["step", "n"])

    return test


def fit(docs: DataFrame, false_share: float = FALSE_SHARE) -> Model:
    """Characters and the threshold over all texts; what is gathered is one row per byte value or step."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = np.zeros(256)
    for r in texts.mapInArrow(released(_histogram), "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        counts[r["c"]] = r["n"]
    counts = np.where(_TOKEN, counts + 1, 0)
    with np.errstate(divide="ignore"):
        model = Model(np.log(counts / counts.sum()))
    rows = texts.mapInArrow(released(_tested(model)), "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
    steps = {r["step"]: r["n"] for r in rows}
    tests = steps.pop(-1, 0)
    model.most, seen = -math.inf, 0
    for k in sorted(steps, reverse=True):
        seen += steps[k]
        if -k * STEP <= math.log(false_share * seen / tests):
            model.most = -k * STEP
    return model


def base_spans(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the pattern matches; runs of hex digits are given."""
    out = [(s, 2, e) for s, e in hexes]
    low = text.lower()
    if any(m in low for m in _MARKS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(out)


def scan(column: pa.Array, model: Model) -> Iterator[tuple[list[tuple[int, int, int]], int]]:
    """For each row its spans (start, kind, end) in code points, base ones first, and how many are base ones."""
    data, at = utf8(column)
    for lo, hi in sliced(data, at):
        b, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        hs, he = runs(_HEX[b], own)
        long = he - hs >= 16
        hs, he = hs[long], he[long]
        added = [x for x in _candidates(b, own, model)[0] if x[2] <= model.most]
        first = np.searchsorted(hs, own)
        first_added = np.searchsorted([x[0] for x in added], own)
        raw = b.tobytes()
        for i in range(hi - lo):
            a, z = int(own[i]), int(own[i + 1])
            spans = base_spans(raw[a:z], [(int(s) - a, int(e) - a) for s, e in zip(hs[first[i] : first[i + 1]], he[first[i] : first[i + 1]], strict=True)])
            base = len(spans)
            for s, e, _ in added[first_added[i] : first_added[i + 1]]:
                if not any(x <= s - a and e - a <= y for x, _, y in spans[:base]):
                    spans.append((s - a, 3, e - a))
            if spans:
                point = np.append(0, np.cumsum((b[a:z] & 0xC0) != 0x80))
                spans = [(int(point[s]), k, int(point[e])) for s, k, e in spans]
            yield spans, base


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _found(model: Model):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, names = [], [], []
            for spans, base in scan(batch.column(1), model):
                counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                digests.append(hashlib.sha256(_named(spans[:base]).encode()).hexdigest())
                names.append(_named(spans))
            c = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.record_batch([batch.column(0), *(pa.array(c[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(names, pa.string())],
                                  names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return find


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of ``docs`` (doc_id, text).

    ``spans`` lists kind:start:end in code points by start. A null text is
    empty and has no spans; repeated rows each get their own result; an empty
    table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_found(model or fit(docs))), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def without(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with ``mark`` in place of each stretch that spans cover."""
    out, done = [], 0
    for s, _, e in sorted(spans):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join(out) + text[done:] if spans else text


def _redacted(model: Model, place: int, mark: str):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            made = []
            for i, (spans, _) in enumerate(scan(column, model)):
                if spans:
                    made.append((i, without(column[i].as_py(), spans, mark)))
            if made:
                values = column.to_pylist()
                for i, text in made:
                    values[i] = text
                column = pa.array(values, batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), column)

    return redact


def redact_secrets(docs: DataFrame, mark: str = "[secret]", model: Model | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with every span in ``text`` replaced; texts without spans, null too, stay."""
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(released(_redacted(model or fit(docs), docs.columns.index("text"), mark)), docs.schema)
