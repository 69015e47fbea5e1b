"""Byte-pair merges of very many words at once.

A worker keeps the ids of the words it has seen, by the words' 64-bit numbers.
Very many words are new all the same. The symbols of all new words of some texts
stand in one array, linked to their neighbours. In each round every word merges
its pair of the lowest rank, the leftmost of several, as a tokenizer does word
by word. Rounds are as many as any one word has merges.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .bpe import _LETTER_OF, _SPLIT, Codec
from .words import SPACED, Words

#: Bytes of a piece from which on it goes through the library alone: rounds must stay few, and places fit six bits.
LONG = 48

#: Rank of a pair that does not merge, symbol outside a piece, and mark of a free place in the table of pairs.
_NONE, _OUT, _FREE = np.int32(1 << 24), 0xFFFF, np.uint32(0xFFFFFFFF)#: Words whose ids a worker keeps, about; when there are more it starts anew.
KEPT = 500_000

_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
# The endings that the vocabulary's split pattern keeps apart.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every character that can be in a text whose split is exact, by the split pattern itself."""
    out = np.full(0x3000, _OTHER, np.uint8)
    for i in range(0x3000):
        if len(_SPLIT.findall(chr(i) * 2)) == 2:
            out[i] = _DIGIT
        elif _SPLIT.findall(chr(i) + "!") == [chr(i), "!"]:
            out[i] = _LETTER
    out[[9, 10, 13, 32]] = _SPACE
    return out


class Merges:
    """The merges of a vocabulary file with word ends, and its tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError(f"{path} is no vocabulary of byte pairs with word ends")
        vocab = model["vocab"]
        if max(vocab.values()) >= _OUT:
            raise ValueError(f"{path} has ids of {_OUT} and more")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self._table(np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32))
        self.inner = np.array([vocab[_LETTER_OF[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[_LETTER_OF[b] + "</w>"] for b in range(256)], np.uint32)
        # Ranks of pairs of bytes, the second within its piece or its last one: most look-ups are of these.
        second = np.concatenate([self.inner, self.last])
        self.first = self._rank(np.repeat(self.inner, 512), np.tile(second, 256)) << 6
        self.codec = Codec(path)
        self._forget()

    def _table(self, keys: np.ndarray) -> None:
        """A hash table of pairs, at most a quarter full: a pair that meets another one stands in the next free place."""
        self.bits = max(4 * len(keys), 16).bit_length()
        self.held = np.full(1 << self.bits, _FREE, np.uint32)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.held[at] == _FREE)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.held[at[first]], self.ranks[at[first]] = keys[left[first]], left[first]
            still = np.ones(len(left), bool)
            still[first] = False
            left, at = left[still], self._next(at[still])

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE of those that do not merge."""
        keys = left << np.uint32(16) | right
        at = self._slot(keys)
        held = self.held[at]
        out = np.where(held == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((held != keys) & (held != _FREE))
        at = at[open_]
        while len(open_):
            at = self._next(at)
            held = self.held[at]
            same = held == keys[open_]
            out[open_[same]] = self.ranks[at[same]]
            more = ~same & (held != _FREE)
            open_, at = open_[more], at[more]
        return out

    def merged(self, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of fewer than LONG bytes that begin at ``starts``, and each piece's number of ids."""
        n = len(b)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.append(starts[1:], n)
        # Place n stands for what is before and after a piece; no pair with its symbol merges.
        symbols = np.append(self.inner[b], np.uint32(_OUT))
        symbols[ends - 1] = self.last[b[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[starts] = n
        place = np.arange(n + 1, dtype=np.int32)
        place[:n] -= np.repeat(starts.astype(np.int32), ends - starts)
        score = np.full(n + 1, _NONE << 6, np.int32)
        pairs = b.astype(np.int64) << 9
        pairs[:-1] |= b[1:]
        pairs[ends - 2] |= 256
        score[:n] = self.first[pairs]
        score[ends - 1] = _NONE << 6
        score |= place
        alive = np.ones(n, bool)
        pieces, inside, begun = np.arange(len(starts)), slice(0, n), starts
        while True:
            least = np.minimum.reduceat(score[inside], begun)
            going = np.flatnonzero(least < _NONE << 6)
            if not len(going):
                break
            least = least[going]
            at = starts[pieces[going]] + (least & 63)
            if 2 * len(going) < len(pieces):
                # Most pieces are done: the others are looked at alone from now on.
                pieces = pieces[going]
                size = (ends - starts)[pieces]
                begun = np.cumsum(size) - size
                inside = np.repeat(starts[pieces] - begun, size) + np.arange(int(size.sum()))
            gone = after[at]
            symbols[at] = self.made[least >> 6]
            alive[gone] = False
            score[gone] = _NONE << 6
            following, leading = after[gone], before[at]
            after[at], before[following] = following, at
            score[at] = self._rank(symbols[at], symbols[following]) << 6 | place[at]
            score[leading] = self._rank(symbols[leading], symbols[at]) << 6 | place[leading]
        return symbols[:n][alive].astype(np.int32), np.add.reduceat(alive, starts, dtype=np.int64)

    def words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that a space each ends, and each word's number of ids."""
        text = joined.decode().lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = _classes()[points]
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        self._endings(points, kind, begins)
        begins[kind == _SPACE] = False
        b = np.frombuffer(text.encode(), np.uint8)
        wide = (1 + (points > 0x7F) + (points > 0x7FF)).astype(np.int64)
        place = np.cumsum(wide) - wide
        # Spaces leave; pieces and words keep their places among what is left.
        inside = b != 32
        moved = np.cumsum(inside) - inside
        ended = moved[place[kind == _SPACE]]
        starts = moved[place[begins]]
        b = b[inside]
        size = np.diff(np.append(starts, len(b)))
        short = size < LONG
        letters = np.repeat(short, size)
        ids, counts = self.merged(b[letters], np.cumsum(size[short]) - size[short])
        if not short.all():
            ids, counts = self._with_long(b, starts, size, short, ids, counts)
        total = np.append(0, np.cumsum(counts))
        return ids, np.diff(total[np.searchsorted(starts, np.append(0, ended))])

    def _endings(self, points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
        """Move the bounds around an apostrophe that stands alone before one of the endings, which are pieces of their own."""
        padded = np.append(points, [32, 32, 32])
        at = np.flatnonzero((points == 39) & begins)
        for ending in _ENDINGS:
            fits = np.logical_and.reduce([padded[at + 1 + i] == ord(c) for i, c in enumerate(ending)])
            x = at[fits]
            begins[x + 1] = False
            after = x + 1 + len(ending)
            after = after[after < len(points)]
            begins[after] = True
            # Of two endings that fit the first one is taken.
            at = at[~fits]

    def _with_long(self, b, starts, size, short, ids, counts):
        whole, parts = np.zeros(len(starts), np.int64), {}
        whole[short] = counts
        for i in np.flatnonzero(~short).tolist():
            written = "".join(_LETTER_OF[x] for x in b[starts[i] : starts[i] + size[i]].tolist())
            parts[i] = np.array([t.id for t in self.codec.tokenizer.model.tokenize(written)], np.int32)
            whole[i] = len(parts[i])
        out = np.empty(int(whole.sum()), np.int32)
        place = np.cumsum(whole) - whole
        out[np.repeat(place[short] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
        for i, part in parts.items():
            out[place[i] : place[i] + len(part)] = part
        return out, whole

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _ids_of(self, numbers: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and number of the ids of distinct words, in the order of their numbers; new ones are added."""
        if len(self.known) > KEPT:
            self._forget()
        place = np.searchsorted(self.known, numbers)
        new = np.flatnonzero(np.append(self.known, np.uint64(0))[place] != numbers) if len(self.known) else np.arange(len(numbers))
        if len(new):
            size = (ends - starts)[new] + 1
            begun = np.cumsum(size) - size
            joined = np.full(int(size.sum()), 32, np.uint8)
            within = np.arange(len(joined)) - np.repeat(begun, size)
            letters = within < np.repeat(size - 1, size)
            joined[letters] = data[(np.repeat(starts[new], size) + within)[letters]]
            ids, counts = self.words(joined.tobytes())
            self.known, self.size = np.insert(self.known, place[new], numbers[new]), np.insert(self.size, place[new], counts)
            self.at = np.insert(self.at, place[new], len(self.flat) + np.cumsum(counts) - counts)
            self.flat = np.concatenate([self.flat, ids])
            place = np.searchsorted(self.known, numbers)
        return self.at[place], self.size[place]

    def texts(self, data: np.ndarray, at: np.ndarray):
        """The ids of each of the texts that start at ``at`` (last: the end), in order."""
        base, end = int(at[0]), int(at[-1])
        data = data[base:end]
        raw = data.tobytes()
        texts = [raw[x - base : y - base].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        sure = [self.codec.sure(t) for t in texts]
        words = Words(data, at - base, SPACED)
        n_words = np.diff(words.rows)
        kept = np.repeat(np.array(sure, bool), n_words)
        numbers, some, which = np.unique(words.numbers[kept], return_index=True, return_inverse=True)
        first, lengths = self._ids_of(numbers, data, words.starts[kept][some], words.ends[kept][some])
        # Ids of all words in a row: each word's start where those of the word before it end.
        per_word = lengths[which]
        last = np.cumsum(per_word)
        ids = self.flat[np.repeat(first[which] - (last - per_word), per_word) + np.arange(int(last[-1]) if len(last) else 0)]
        in_text = np.cumsum(np.append(0, np.where(sure, n_words, 0)))
        bounds = np.append(0, last)[in_text].tolist()
        for i, text in enumerate(texts):
            if sure[i]:
                yield ids[bounds[i] : bounds[i + 1]]
            else:
                yield np.array(self.codec.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)


@functools.lru_cache(1)
def merges(path: str) -> Merges:
    """A worker reads a vocabulary once."""
    return Merges(path)
