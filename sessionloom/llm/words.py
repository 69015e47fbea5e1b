"""Words of Arrow string columns as 64-bit numbers, without a loop over words.

Texts are cut at ASCII bytes only, and only A-Z is lower-cased, so that the
UTF-8 bytes can be handled as they stand. A word's number is the sum of a
pseudo-random value for each of its bytes at its place within the word
(tabulation hashing), then mixed. Sums, unlike polynomials modulo 2**64, have no
structured words that collide: any two different words share a number with a
chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that are turned into numbers at once: they bound a worker's memory.
SLICE_BYTES = 1 << 19
#: Rows that Spark hands to a worker at once, at most: with texts of some KB Spark's own 10,000 fill a worker.
BATCH_ROWS = 1000
#: Places within a word whose values are kept in a table.
PLACES = 64

_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return x


def _value(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The value of a byte at a place within its word, from 0."""
    return mix(_VALUES[byte] + place.astype(np.uint64) * _STEP)


_TABLE = _value(*(x.ravel() for x in np.indices((PLACES, 256))))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows); a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(kept: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``kept`` that do not cross the row bounds ``at``."""
    n = len(kept)
    near = np.empty(n, bool)
    near[:1] = False
    near[1:] = kept[:-1]
    near[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(kept & ~near)
    near[-1:] = False
    near[:-1] = kept[1:]
    near[at[1:][at[1:] > 0] - 1] = False
    return starts, np.flatnonzero(kept & ~near) + 1


class Words:
    """Words of consecutive rows: numbers, and the row's first word at ``rows``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kept: np.ndarray):
        base, end = int(at[0]), int(at[-1])
        b, at = data[base:end], at - base
        inside = kept[b]
        self.starts, self.ends = runs(inside, at)
        letters, lengths = b[inside], self.ends - self.starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        values = _TABLE[(np.minimum(place, PLACES - 1) << 8) | letters]
        far = np.flatnonzero(place >= PLACES)
        values[far] = _value(place[far], letters[far])
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        self.numbers = mix(sums[first + lengths] - sums[first])
        self.rows = np.searchsorted(self.starts, at)


def grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """A number for every run of ``k`` words, rows not yet kept apart."""
    m = len(numbers) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(k), np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += numbers[i : i + m]
    return mix(out)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to BATCH_ROWS; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if not 0 < given <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def released(work):
    """A function over Arrow batches that gives its memory back to the system at its end.

    Python workers serve many tasks; what one has freed would stay with them.
    """
    @functools.wraps(work)
    def run(*args):
        try:
            yield from work(*args)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def sliced(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES; a longer text stands alone."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def shingle_sets(column: pa.Array, kept: np.ndarray = SPACED, k: int = 5) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles of ``k`` words; fewer words make one shingle."""
    data, at = utf8(column)
    for lo, hi in sliced(data, at):
        w = Words(data, at[lo : hi + 1], kept)
        g = grams(w.numbers, k)
        for i in range(hi - lo):
            a, b = int(w.rows[i]), int(w.rows[i + 1])
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:
                yield grams(w.numbers[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
