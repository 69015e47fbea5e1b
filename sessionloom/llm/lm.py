"""Language-model scoring: a gated recurrent network with a class-factored output.

Words are counted over all training documents. The VOCABULARY most frequent
ones (the text's end is one of them) are put by frequency into classes of
CLASS_WORDS; one more class holds all other words. The network gives the
probability of a word's class, then of the word within it; within the class of
rare words that is the smoothed share by the counts, so the probabilities of
all words and one unknown word sum to one.

The recurrent unit is a minimal gated one: a gate and a candidate from the last
two words, and a state that moves towards the candidate as far as the gate is
open. No step multiplies matrices, so a window's gates are computed at once and
the steps are a scan.

Training is truncated back-propagation in numpy. A first model is fitted on
SEED_DOCS documents. Then all training documents, as the numbers of their
words, are dealt by hash into parts of about PART_TOKENS tokens, whatever the
cluster; every part trains its own copy on all of its documents in the order of
doc_id, and the copies are averaged, weighted by their tokens, in groups of
MEET. Scoring carries the state through a whole document: lanes of documents
run side by side, each document after the other in its lane, and the state is
reset at a document's start only.

Counts of frequent words are sent to the tasks, at most SENT_WORDS of them;
those of all others are joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import SPACED, Words, bound_batches, released, sliced, utf8

CLASS_WORDS, CLASSES = 50, 40
VOCABULARY = CLASS_WORDS * CLASSES
HIDDEN = 24
#: Words whose counts go to all tasks, at most: 24 bytes each.
SENT_WORDS = 400_000
#: Counts are told apart by so many steps to a doubling when the sent ones are chosen.
COUNT_STEPS = 64
#: Documents of the first model, those with the least hash of doc_id of at most so many bytes, and passes over them.
SEED_DOCS, SEED_BYTES, SEED_EPOCHS = 300, 1 << 16, 2
#: Tokens of a part, about; parts at most, beyond which they get larger.
PART_TOKENS, MOST_PARTS = 1_000_000, 20_000
#: Steps of back-propagation, lanes in training, lanes and steps at once in scoring.
WINDOW, TRAIN_LANES, LANES, STEPS = 48, 64, 256, 64
#: Rates of the first model and of the parts.
RATES = (5e-3, 3e-3)
#: Models averaged in one task.
MEET = 16
#: The text's end, as a word's number; no word has it but by chance.
END = np.uint64(0x5EED0E4D0FD0C5)
SMOOTH = 0.1
#: Tokens that are scored, and looked up, at once: they bound a worker's memory.
GROUP_TOKENS, LOOK_TOKENS = 2_500_000, 250_000
#: Tokens laid out at once in training, about: they bound a worker's memory.
TRAIN_TOKENS = 500_000
#: Words of a partition held before they are sent on.
HELD = 1_000_000


def tokens(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's word numbers and the end."""
    data, at = utf8(column)
    for lo, hi in sliced(data, at):
        w = Words(data, at[lo : hi + 1], SPACED)
        for i in range(hi - lo):
            yield np.append(w.numbers[w.rows[i] : w.rows[i + 1]], END)


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1)) % folds


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, back = np.unique(words, return_inverse=True)
        return words, np.bincount(back, weights=n, minlength=len(words)).astype(np.int64)

    def sent() -> pa.RecordBatch:
        words, n = merged()
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        texts = list(tokens(batch.column(0)))
        if texts:
            held.append(np.unique(np.concatenate(texts), return_counts=True))
        if sum(len(x) for x, _ in held) > HELD:
            held = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield sent()
                held = []
    if held:
        yield sent()


@dataclass
class Lexicon:
    """Counts and classes. ``words`` is sorted; ``ids`` are model words, -1 for others."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int
    complete: bool
    rare_total: int = 0
    rare_distinct: int = 0
    #: The model's words, sorted, and their ids.
    model_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    model_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Where the words of each run of first bits begin; made in each task.
    starts: np.ndarray | None = None
    shift: np.uint64 = np.uint64(0)

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> Lexicon:
        order = np.lexsort((words, -counts))[:VOCABULARY]
        ids = np.full(len(words), -1, np.int64)
        ids[order] = np.arange(len(order))
        by = np.argsort(words)
        out = cls(words[by], counts[by], ids[by], total, distinct, len(words) == distinct)
        out.rare_total = total - int(counts[order].sum())
        out.rare_distinct = distinct - len(order)
        out.model_words, out.model_ids = out.words[out.ids >= 0], out.ids[out.ids >= 0]
        return out

    def _places(self, numbers: np.ndarray) -> np.ndarray:
        """Where each number stands among the words if it is there.

        Numbers are hashes, so their first bits nearly give the place: the
        search starts there and goes on by one while words are less.
        """
        if self.starts is None:
            bits = max(1, len(self.words).bit_length())
            self.shift = np.uint64(64 - bits)
            self.starts = np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        last = len(self.words) - 1
        at = np.minimum(self.starts[numbers >> self.shift], last)
        left = np.flatnonzero(self.words[at] < numbers)
        while len(left):
            left = left[at[left] < last]
            at[left] += 1
            left = left[self.words[at[left]] < numbers[left]]
        return at

    def coder(self) -> Lexicon:
        """Only what gives words their ids."""
        none = np.zeros(0, np.int64)
        return Lexicon(np.zeros(0, np.uint64), none, none, self.total, self.distinct, False, model_words=self.model_words, model_ids=self.model_ids)

    def code(self, numbers: np.ndarray) -> np.ndarray:
        """Model ids (VOCABULARY: rare)."""
        if not len(self.model_words):
            return np.full(len(numbers), VOCABULARY, np.int16)
        at = np.searchsorted(self.model_words, numbers)
        at[at == len(self.model_words)] = 0
        return np.where(self.model_words[at] == numbers, self.model_ids[at], VOCABULARY).astype(np.int16)

    def look(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1: not here) and model ids (VOCABULARY: rare)."""
        if not len(self.words):
            return np.full(len(numbers), 0 if self.complete else -1), np.full(len(numbers), VOCABULARY)
        at = self._places(numbers)
        here = self.words[at] == numbers
        counts = np.where(here, self.counts[at], 0 if self.complete else -1)
        ids = np.where(here, self.ids[at], -1)
        return counts, np.where(ids < 0, VOCABULARY, ids)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _exponentials(x: np.ndarray) -> np.ndarray:
    """Of logits, in place, and their sums by row; logits over 60 count as 60 and no sum is zero, so all stays finite."""
    np.minimum(x, np.float32(60), out=x)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], np.float32) + np.float32(1e-30)


def _softmax(x: np.ndarray) -> np.ndarray:
    total = _exponentials(x)
    x /= total[:, None]
    return x


class Network:
    """``x`` and ``y`` hold what the last and the second last word give to the gate and to the candidate; the last id stands for rare words."""

    SHAPES = {
        "x": (VOCABULARY + 1, 2 * HIDDEN), "y": (VOCABULARY + 1, 2 * HIDDEN),
        "c": (HIDDEN, CLASSES + 1), "cb": (CLASSES + 1,), "w": (CLASSES, HIDDEN, CLASS_WORDS), "wb": (CLASSES, CLASS_WORDS),
    }

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        self.flat = (rng.normal(0, 0.08, size) if flat is None else flat).astype(np.float32)
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    def start(self, lexicon: Lexicon) -> None:
        """Output biases from the counts: the untrained model is the unigram one."""
        share = np.full(VOCABULARY, SMOOTH)
        known = lexicon.ids >= 0
        share[lexicon.ids[known]] += lexicon.counts[known]
        byc = share.reshape(CLASSES, CLASS_WORDS)
        self.wb[:] = np.log(byc / byc.sum(axis=1, keepdims=True))
        mass = np.append(byc.sum(axis=1), lexicon.rare_total + SMOOTH)
        self.cb[:] = np.log(mass / mass.sum())

    def run(self, last: np.ndarray, second: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each word (steps, lanes, HIDDEN), and the last one.

        ``last`` and ``second`` are the words read before each step, ``fresh``
        marks starts, ``h`` is the state so far.
        """
        g = self.x[last]
        g += self.y[second]
        gate, candidate = _sigmoid(g[..., :HIDDEN].copy()), np.tanh(g[..., HIDDEN:])
        held = 1 - gate
        held[fresh] = 0
        states = gate * candidate
        for t in range(len(last)):
            states[t] += held[t] * h
            h = states[t]
        return (states, h, (gate, candidate, held)) if keep else (states, h)

    def log_p(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithms of the words' probabilities; of a rare word, that of its class."""
        k = np.minimum(words // CLASS_WORDS, CLASSES)
        logits = states @ self.c
        logits += self.cb
        out = logits[np.arange(len(k)), k].astype(np.float64)
        out -= np.log(_exponentials(logits))
        order = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                inner = states[at] @ self.w[c]
                inner += self.wb[c]
                own = inner[np.arange(len(at)), words[at] - c * CLASS_WORDS]
                out[at] += own - np.log(_exponentials(inner))
        return out

    def gradients(self, last: np.ndarray, second: np.ndarray, words: np.ndarray, mask: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[Network, np.ndarray]:
        """Of the mean loss of a window, and the state after it."""
        steps, lanes = last.shape
        states, end, (gate, candidate, held) = self.run(last, second, fresh, h, keep=True)
        g = Network(np.zeros_like(self.flat))
        flat = states.reshape(-1, HIDDEN)
        at = np.flatnonzero(mask.ravel())
        k = np.minimum(words.ravel()[at] // CLASS_WORDS, CLASSES)
        # By class, so that each class is one slice.
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        s, y = flat[at], words.ravel()[at]
        scale = np.float32(1 / max(1, len(at)))
        p = _softmax(s @ self.c + self.cb)
        p[np.arange(len(k)), k] -= 1
        p *= scale
        g.c[:] = s.T @ p
        g.cb[:] = p.sum(axis=0)
        ds = p @ self.c.T
        cuts = np.searchsorted(k, np.arange(CLASSES + 1))
        m = cuts[CLASSES]
        own = [(c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]]
        q = self.wb[k[:m]]
        for c, part in own:
            q[part] += s[part] @ self.w[c]
        q = _softmax(q)
        q[np.arange(m), y[:m] - k[:m] * CLASS_WORDS] -= 1
        q *= scale
        for c, part in own:
            g.w[c] = s[part].T @ q[part]
            g.wb[c] = q[part].sum(axis=0)
            ds[part] += q[part] @ self.w[c].T
        down = np.zeros_like(flat)
        down[at] = ds
        down = down.reshape(steps, lanes, HIDDEN)
        for t in range(steps - 2, -1, -1):
            down[t] += down[t + 1] * held[t + 1]
        before = np.concatenate([h[None], states[:-1]])
        before[fresh] = 0
        into = np.empty((steps, lanes, 2 * HIDDEN), np.float32)
        np.multiply(down, (candidate - before) * gate * (1 - gate), out=into[..., :HIDDEN])
        np.multiply(down, gate * (1 - candidate * candidate), out=into[..., HIDDEN:])
        rows = into.reshape(-1, 2 * HIDDEN)
        for table, ids in ((g.x, last.ravel()), (g.y, second.ravel())):
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            table[ids[first]] = np.add.reduceat(rows[order], first, axis=0)
        return g, end


def laned(lengths: list[int], lanes: int) -> list[list[int]]:
    """Rows by lane, the longest first to the shortest lane, so that lanes end together."""
    heap = [(0, k) for k in range(min(lanes, max(1, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + lengths[i], k))
    return out


def _grid(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, ...]:
    """(steps, lanes) arrays: the last and the second last word read, the word to come, row (-1: none) and starts."""
    plan = laned([len(x) for x in texts], lanes)
    steps = max((sum(len(texts[i]) for i in lane) for lane in plan), default=0)
    words = np.full((len(plan), steps), VOCABULARY, np.int16)
    row = np.full((len(plan), steps), -1, np.int32)
    fresh = np.zeros((len(plan), steps), bool)
    for k, lane in enumerate(plan):
        at = 0
        for i in lane:
            n = len(texts[i])
            words[k, at : at + n] = texts[i]
            row[k, at : at + n] = i
            fresh[k, at] = True
            at += n
    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[:, 1:] = x[:, :-1]
        out[:, :1] = out[fresh] = VOCABULARY
        return out

    last = before(words)
    return tuple(x.T.copy() for x in (last, before(last), words, row, fresh))


class Trainer:
    """Adam over windows of a grid; the state goes on from window to window."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.t = network, rate, 0
        self.m, self.v, self.spare = (np.zeros_like(network.flat) for _ in range(3))

    def learn(self, texts: list[np.ndarray]) -> None:
        last, second, words, row, fresh = _grid(texts, TRAIN_LANES)
        h = np.zeros((last.shape[1], HIDDEN), np.float32)
        for a in range(0, len(last), WINDOW):
            z = a + WINDOW
            g, h = self.network.gradients(last[a:z], second[a:z], words[a:z], row[a:z] >= 0, fresh[a:z], h)
            g = g.flat
            norm = math.sqrt(float(g @ g))
            if norm > 1:
                g /= norm
            self.t += 1
            spare = self.spare
            np.multiply(g, g, out=spare)
            g -= self.m
            g *= 0.1
            self.m += g
            spare -= self.v
            spare *= 0.01
            self.v += spare
            np.divide(self.v, 1 - 0.99**self.t, out=spare)
            np.sqrt(spare, out=spare)
            spare += 1e-8
            np.divide(self.m, spare, out=spare)
            spare *= self.rate / (1 - 0.9**self.t)
            self.network.flat -= spare


def _grouped(texts: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """All rows (key, …, tokens) in order, in runs of one key and of at most ``most`` tokens; a longer text stands alone."""
    held, n = [], 0
    for row in texts:
        if held and (row[0] != held[-1][0] or n + len(row[-1]) > most):
            yield held
            held, n = [], 0
        held.append(row)
        n += len(row[-1])
    if held:
        yield held


def _coded(sent):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            ids = [lexicon.code(x).tobytes() for x in tokens(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    return code


def _refined(sent):
    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = sent.value
        rows = ((part, np.frombuffer(ids.as_buffer(), np.int16)) for batch in batches for part, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        now, trainer, n = None, None, 0

        def model() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([float(n)], pa.float64()), pa.array([trainer.network.flat.tobytes()], pa.binary())], names=["part", "weight", "model"])

        for group in _grouped(rows, TRAIN_TOKENS):
            if group[0][0] != now:
                if trainer is not None:
                    yield model()
                now, trainer, n = group[0][0], Trainer(Network(flat.copy()), RATES[1]), 0
            trainer.learn([x for _, x in group])
            n += sum(len(x) for _, x in group)
        if trainer is not None:
            yield model()

    return refine


def _averaged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((p, w, m) for b in batches for p, w, m in zip(*(b.column(c).to_pylist() for c in ("part", "weight", "model")), strict=True)), key=lambda r: r[0])
    weight = sum(w for _, w, _ in rows)
    total = sum(np.frombuffer(m, np.float32) * w for _, w, m in rows)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([weight], pa.float64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["part", "weight", "model"])


def count_words(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, Lexicon]:
    """(word, n) over all texts as a table, and what is sent of it: the most frequent words, SENT_WORDS at most.

    They are found from how many words have a count within each step; the steps
    grow with the count, so they are few whatever the corpus. Words of the
    step that would go over the bound are joined, as all rarer ones.
    """
    counts = scratch.save(docs.select("text").mapInArrow(released(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("n") * COUNT_STEPS)
    least, seen = 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).orderBy(F.desc("step")).collect():
        seen += r["v"]
        if seen > SENT_WORDS:
            least = r["step"] + 1
            break
    got = counts.where(step >= least).toArrow()
    words = got["word"].to_numpy().view(np.uint64) if len(got) else np.zeros(0, np.uint64)
    return counts, Lexicon.of(words, got["n"].to_numpy() if len(got) else np.zeros(0, np.int64), sums["n"] or 0, sums["v"])


def train(docs: DataFrame, lexicon: Lexicon, scratch: Scratch) -> Network:
    """The averaged network from training documents (doc_id, text).

    A document's part depends on its doc_id and text and on the number of
    tokens only, so the network does not depend on how rows are partitioned.
    """
    spark, network = docs.sparkSession, Network()
    network.start(lexicon)
    seed = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") <= SEED_BYTES)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEED_DOCS)
    rows = docs.join(F.broadcast(seed), "doc_id").where(F.octet_length("text") <= SEED_BYTES).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow()
    texts = [lexicon.code(t) for c in rows["text"].chunks for t in tokens(c)]
    if texts:
        trainer = Trainer(network, RATES[0])
        for _ in range(SEED_EPOCHS):
            trainer.learn(texts)
    n = parts = max(1, min(MOST_PARTS, -(-lexicon.total // PART_TOKENS)))
    coder, start = (spark.sparkContext.broadcast(x) for x in (lexicon.coder(), network.flat))
    coded = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text").mapInArrow(released(_coded(coder)), "part int, doc_id long, ids binary")
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids").select("part", "ids")
    models = scratch.save(dealt.mapInArrow(released(_refined(start)), "part long, weight double, model binary"), "models")
    while n > 1:
        n = -(-n // MEET)
        group = (F.col("part") % n).alias("group")
        old, models = models, scratch.save(models.groupBy(group).applyInArrow(_averaged, "part long, weight double, model binary"), "models")
        scratch.drop(old)
    row = models.first()
    return Network(np.frombuffer(row["model"], np.float32)) if row else network


def score_rows(network: Network, lexicon: Lexicon, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known ones, base and model log10 sums, without what must be joined; and that: rows, words, times."""
    count = len(texts)
    lengths = np.array([len(x) for x in texts])
    row = np.repeat(np.arange(count, dtype=np.int32), lengths)
    sums = np.zeros((4, count))
    ids = np.empty(len(row), np.int16)
    away_rows, away_words = [], []
    numbers = np.concatenate(texts)
    for a in range(0, len(row), LOOK_TOKENS):
        part = slice(a, a + LOOK_TOKENS)
        c, ids[part] = lexicon.look(numbers[part])
        here, own = c >= 0, row[part]
        logs = np.log10(c[here] + SMOOTH)
        rare = np.where(ids[part][here] == VOCABULARY, logs - np.log10(lexicon.rare_total + SMOOTH * (lexicon.rare_distinct + 1)), 0.0)
        for k, x in enumerate((c[here] > 0, logs, rare, np.ones(len(logs)))):
            sums[k] += np.bincount(own[here], weights=x, minlength=count)
        away_rows.append(own[~here].astype(np.uint64))
        away_words.append(numbers[part][~here])
    known, base, score, found = sums
    base = base - found * np.log10(lexicon.total + SMOOTH * (lexicon.distinct + 1))
    del numbers, row
    last, second, words, of, fresh = _grid(np.split(ids, np.cumsum(lengths)[:-1]), LANES)
    h = np.zeros((last.shape[1], HIDDEN), np.float32)
    for a in range(0, len(last), STEPS):
        states, h = network.run(last[a : a + STEPS], second[a : a + STEPS], fresh[a : a + STEPS], h)
        r = of[a : a + STEPS].ravel()
        at = np.flatnonzero(r >= 0)
        p = network.log_p(states.reshape(-1, HIDDEN)[at], words[a : a + STEPS].ravel()[at])
        score += np.bincount(r[at], weights=p, minlength=count) / np.log(10)
    away = np.stack([np.concatenate(away_rows), np.concatenate(away_words)])
    pairs = np.unique(away, axis=1, return_counts=True) if away.size else (away, np.zeros(0, np.int64))
    return lengths, known.astype(np.int64), base, score, pairs[0][0].astype(np.int64), pairs[0][1], pairs[1]


PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, away array<struct<word:long,n:long>>"


def _scored(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, flat = sent.value
        network, done = Network(flat), TaskContext.get().partitionId() << 36
        kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
        # Groups run over batches, so that lanes are long.
        rows = ((None, (k, h), x) for b in batches for k, h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), tokens(b.column(2)), strict=True))
        for group in _grouped(rows, GROUP_TOKENS):
            n, known, base, score, row, word, times = score_rows(network, lexicon, [x for *_, x in group])
            cuts = np.searchsorted(row, np.arange(len(group) + 1))
            away = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(times.astype(np.int64))], ["word", "n"])).cast(kind)
            ids, held = pa.array([r[0] for _, r, _ in group], pa.int64()), pa.array([r[1] for _, r, _ in group], pa.bool_())
            yield pa.record_batch([pa.array(np.arange(done, done + len(group))), ids, held, pa.array(n), pa.array(known), pa.array(base), pa.array(score), away], names=[x.split()[0] for x in PARTIAL.split(", ")[:8]])
            done += len(group)

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    A null text is empty and has one token, the end. A null doc_id is in
    training. Repeated rows count as often as they stand and each get their
    result; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lm")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (fold(doc_id, 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    training = rows.where("not held_out").select("doc_id", "text")
    counts, lexicon = count_words(training, scratch)
    network = train(training, lexicon, scratch)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, network.flat))
    partial = scratch.save(rows.mapInArrow(released(_scored(sent)), PARTIAL), "partial")
    all_words, rare = (np.log10(n + SMOOTH * (v + 1)) for n, v in ((lexicon.total, lexicon.distinct), (lexicon.rare_total, lexicon.rare_distinct)))
    out = partial.drop("away").withColumn("train_tokens", F.lit(lexicon.total).cast("long"))
    if not lexicon.complete:
        # Only words under the least sent count are joined, so no key is frequent in training.
        pairs = partial.select("row", F.explode("away").alias("a")).select("row", "a.word", F.col("a.n").alias("times"))
        c = F.coalesce("n", F.lit(0))
        found = pairs.join(counts, "word", "left").groupBy("row").agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum("times").alias("t"), F.sum(F.col("times") * F.log10(c + F.lit(SMOOTH))).alias("s"))
        out = out.join(found, "row", "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce("k", F.lit(0)),
            "base": F.col("base") + F.coalesce(F.col("s") - F.col("t") * float(all_words), F.lit(0.0)),
            "score": F.col("score") + F.coalesce(F.col("s") - F.col("t") * float(rare), F.lit(0.0)),
        })
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"), "score")
