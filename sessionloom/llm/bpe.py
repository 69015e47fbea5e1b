"""BPE encoding and decoding with content-defined chunk reuse.

Chunk bounds are where a rolling hash of the last bytes hits a pattern, so
passages that documents share are cut alike wherever they stand. A task
encodes each chunk once and keeps the result by the chunk's bytes, in a bounded
store. What a chunk's ends hold depends on its neighbours, so every join is
repaired: the last piece of the left and the first of the right chunk are
encoded anew together, and the stretch grows by a piece to either side until
its outer pieces are those that the chunks had by themselves. The split into
pieces reads from left to right and looks no further than a piece's end, so
from there on both agree exactly.

Misses are split by the tokenizer's own pattern and encoded word by word, with
a bounded store of words. Texts outside the set of characters for which this
split is known to be exact go through the library whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _VALUES, bound_batches, mix, released, sliced, utf8

#: Bytes that the rolling hash sees.
SEEN = 16
#: A bound every so many bytes on average; at most so many between two.
MEAN, MOST = 256, 4096
#: Entries of the stores of words and of chunks.
KEPT_WORDS, KEPT_CHUNKS = 150_000, 10_000

# The split pattern of the vocabulary file, written out for Latin letters.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ňŊ-ž"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\x20\t\n\r0-9{_LETTERS}]+")
#: Characters whose lower case, normal form and class are known to be those of the library.
_SURE = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ňŊ-ž‐-‧‰-⁞₠-⃀]*")
_SPACES = "\t\n\r "
#: Of the rolling hash.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Store(dict):
    """A mapping of bounded size: when it is full the older half goes, in the order of entry."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def put(self, key, value):
        if len(self) >= self.most:
            for old in list(islice(self, self.most // 2)):
                del self[old]
        self[key] = value
        return value


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, all others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTER_OF = _byte_letters()


class Words(Store):
    """Word -> (ids, tokens, word), the first two joined by a space; a word is one piece of the split, lower-cased."""

    def __init__(self, model):
        super().__init__(KEPT_WORDS)
        self.model = model

    def __missing__(self, word):
        written = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTER_OF)
        tokens = self.model.tokenize(written)
        if len(tokens) == 1:
            return self.put(word, (str(tokens[0].id), tokens[0].value, word))
        return self.put(word, (" ".join([str(t.id) for t in tokens]), " ".join([t.value for t in tokens]), word))


def rolling(b: np.ndarray) -> np.ndarray:
    """A number for every SEEN bytes in a row, put together from halves."""
    out, step, width = _VALUES[b], np.array([_BASE]), 1
    while width < SEEN:
        out = out[:-width] * step + out[width:] if len(out) > width else out[:0]
        step, width = step * step, 2 * width
    return mix(out)


def chunk_bounds(b: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Bounds of the chunks of UTF-8 bytes, from 0 to their number.

    Texts start at ``at`` (last: the end) and are cut as each would be alone.
    """
    n = len(b)
    at = np.array([0, n]) if at is None else at
    cuts = np.flatnonzero(rolling(b) % np.uint64(MEAN) == 0) + SEEN
    # What the hash sees must lie within one text.
    cuts = cuts[cuts - at[np.searchsorted(at, cuts, side="left") - 1] >= SEEN]
    cuts = np.unique(np.concatenate([at, cuts]))
    wide = np.flatnonzero(np.diff(cuts) > MOST)
    if len(wide):
        cuts = np.unique(np.concatenate([cuts, *(np.arange(cuts[i], cuts[i + 1], MOST) for i in wide)]))
    # A bound within a character moves to the next one's start.
    padded = np.append(b, np.uint8(0))
    while len(inside := np.flatnonzero((padded[cuts] & 0xC0) == 0x80)):
        cuts[inside] += 1
    return np.unique(cuts)


@functools.lru_cache(1)
def tokenizer(path: str):
    """The tokenizer of a vocabulary file, read once by a worker: what each task read anew stayed with the worker in part."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Codec:
    """One task's stores, and the worker's tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.words = Words(self.tokenizer.model)
        self.chunks = Store(KEPT_CHUNKS)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def sure(self, text: str) -> bool:
        return (text.isascii() and text.isprintable() or _SURE.fullmatch(text) is not None) and not any(s in text for s in self.specials)

    def pieces(self, text: str) -> list[tuple[str, str, str]]:
        """The encoded pieces of a lower-cased text."""
        return list(map(self.words.__getitem__, _SPLIT.findall(text)))

    def chunk(self, raw: bytes) -> tuple[int, list]:
        """Characters and encoded pieces of a chunk by itself."""
        got = self.chunks.get(raw)
        if got is None:
            s = raw.decode().lower()
            got = self.chunks.put(raw, (len(s), self.pieces(s)))
        return got

    def encode(self, text: str) -> tuple[str, str]:
        """(ids, tokens) of a text, each joined by a space; the second is what decoding gives."""
        return next(self.encode_all(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))

    def encode_all(self, b: np.ndarray, at: np.ndarray) -> Iterator[tuple[str, str]]:
        """``encode`` of each of the texts that start at ``at``."""
        cuts = chunk_bounds(b, at)
        first, raw = np.searchsorted(cuts, at).tolist(), b.tobytes()
        cuts = cuts.tolist()
        for i in range(len(at) - 1):
            text = raw[at[i] : at[i + 1]].decode()
            if self.sure(text):
                done = self._joined(text.lower(), [raw[x:y] for x, y in zip(cuts[first[i] : first[i + 1]], cuts[first[i] + 1 : first[i + 1] + 1], strict=True)])
                ids, tokens, _ = zip(*done) if done else ((), (), ())
                yield " ".join(ids), " ".join(tokens)
            else:
                e = self.tokenizer.encode(text, add_special_tokens=False)
                yield " ".join(map(str, e.ids)), self.tokenizer.decode(e.ids, skip_special_tokens=False)

    def _joined(self, low: str, chunks: list[bytes]) -> list[tuple[str, str, str]]:
        """The encoded pieces of a lower-cased text from those of its chunks."""
        done: list[tuple[str, str, str]] = []
        cut = 0
        for raw in chunks:
            n, own = self.chunk(raw)
            # White space on either side of the join: no piece spans it.
            if not cut or not done or low[cut - 1] in _SPACES or low[cut] in _SPACES:
                done += own
            else:
                left, right, new = self._repaired(low, cut, done, own)
                del done[len(done) - left :]
                done += new
                done += own[right:]
            cut += n
        return done

    def _repaired(self, low: str, cut: int, done: list, own: list) -> tuple[int, int, list]:
        """How many pieces to either side of ``cut`` are encoded anew, and what takes their place."""
        left = right = 0
        start = end = cut
        grow_left = grow_right = True
        while True:
            if grow_left:
                left += 1
                while low[start - 1] in _SPACES:
                    start -= 1
                start -= len(done[-left][2])
            if grow_right:
                while low[end] in _SPACES:
                    end += 1
                end += len(own[right][2])
                right += 1
            new = self.pieces(low[start:end])
            grow_left = left < len(done) and new[0][2] != done[-left][2]
            grow_right = right < len(own) and new[-1][2] != own[right - 1][2]
            if not grow_left and not grow_right:
                return left, right, new


def _encoded(path: str, full: bool):
    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec(path)
        for batch in batches:
            data, at = utf8(batch.column(1))
            for lo, hi in sliced(data, at):
                rows = []
                for ids, text in c.encode_all(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                    n = ids.count(" ") + 1 if ids else 0
                    if full:
                        rows.append((n, np.array(ids.split(), np.int32), text))
                    else:
                        rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                n, x, y = zip(*rows, strict=True)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(x, pa.list_(pa.int32()) if full else pa.string()), pa.array(y, pa.string())], names=names)

    names = ["doc_id", "n_tokens", "ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return encode


def encoded(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """Token ids and decoded text of every row of ``docs`` (doc_id, text); with ``full`` false their digests.

    ``path`` names the vocabulary file, which every executor must have. A null
    text is empty: no ids, an empty decoded text. Repeated rows each get their
    own result; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(_encoded(path, full), f"doc_id long, n_tokens long, {kind}")
