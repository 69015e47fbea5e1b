"""Toxicity: a convolutional text classifier over hashed words, in numpy.

A word is the pair of two independent hashes, each with its own embedding, so
that a rare word rarely meets a telling one in both. Filters of one, two and
three words run over the whole text; the largest value of each filter feeds a
logistic output. Networks of several seeds form a committee: their mean
probability counts, since a single seed may miss what another finds. Each starts
from a bounded number of documents, in a task of its own; where there are more,
all of them train it further, in parts dealt by hash whose networks are
averaged. The threshold is calibrated for each language, which is
inferred from the text's function words, and the score is bent so that the
threshold lies at 0.5.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALNUM, Words, bound_batches, released, sliced, utf8

BITS, HALF = 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PAD = 1 << BITS
#: Labelled documents that the first networks are fitted on, at most, and their words in all: those with the
#: least hash of doc_id; a document that would go over the words is passed over. If they are not all, all train them further.
FIT_ROWS, FIT_WORDS = 6000, 4_000_000
EPOCHS = 8
#: Documents of a part, and parts at most; documents and words that a task holds at a time.
PART_ROWS, MOST_PARTS = 12_000, 128
HELD_ROWS, HELD_WORDS = 3000, 2_000_000
#: Passes of a part over its documents, and the rate of its steps.
MORE_EPOCHS, MORE_RATE = 2, 0.02
#: Sums of parts that meet in one task.
MEET = 8
#: Networks of a committee.
SEEDS = (11, 12, 13)
#: Distinct fitted texts that a word must stand in to get an embedding. Rarer words keep their place with an
#: embedding of zero, here and in scoring: they would only let single labels be learnt by heart.
LEAST_TEXTS = 6
#: Of many texts at least this share, so that the words with an embedding are bounded by the words of a text, not by the corpus.
LEAST_SHARE = 1 / 2000
#: Steps of a probability in which labels are counted for the thresholds.
BINS = 10_000
#: Positives of a language that its own threshold needs.
LEAST_POSITIVES = 15

#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that with for this from are was",
    "de": "der die und das den mit von ist nicht ein eine auf",
    "fr": "le les des et dans pour est du une sur par au",
    "es": "el los las y con por una del es para se lo",
}
LANGUAGES = (*FUNCTION_WORDS, "")


def _numbers(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM).numbers


_KNOWN = np.concatenate([_numbers(x) for x in FUNCTION_WORDS.values()])
_KNOWN_OF = np.repeat(np.arange(len(FUNCTION_WORDS)), [len(x.split()) for x in FUNCTION_WORDS.values()])
_ORDER = np.argsort(_KNOWN)
_KNOWN, _KNOWN_OF = _KNOWN[_ORDER], _KNOWN_OF[_ORDER]


def languages(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The index in LANGUAGES of each row's language; the last for none."""
    at = np.searchsorted(_KNOWN, numbers)
    at[at == len(_KNOWN)] = 0
    hit = _KNOWN[at] == numbers
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    counts = np.zeros((len(rows) - 1, len(FUNCTION_WORDS)))
    np.add.at(counts, (row[hit], _KNOWN_OF[at[hit]]), 1)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), len(FUNCTION_WORDS))


class Scorer:
    """What gives probabilities, and a threshold for each language."""

    thresholds: np.ndarray

    def raw(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def scores(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        p = self.raw(numbers, rows)
        t = self.thresholds[languages(numbers, rows)]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def even_thresholds() -> np.ndarray:
    return np.full(len(LANGUAGES), 0.5)


@dataclass
class Classifier(Scorer):
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=even_thresholds)
    #: The words, sorted, that have an embedding; None: all.
    words: np.ndarray | None = None

    @classmethod
    def fresh(cls, seed: int = 11) -> Classifier:
        rng = np.random.default_rng(seed)
        tables = [np.vstack([rng.normal(0, 0.01, (PAD, HALF)), np.zeros((1, HALF))]).astype(np.float32) for _ in range(2)]
        filters = [rng.normal(0, 0.3, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(tables, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)

    def padded(self, numbers: np.ndarray, rows: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes with gaps after every row, the rows' starts, and where the gaps are. Words that are not ``known`` count as zeros."""
        gap = max(WIDTHS) - 1
        n, count = len(numbers), len(rows) - 1
        place = np.arange(n) + gap * np.repeat(np.arange(count), np.diff(rows))
        ids = np.full((2, n + gap * count), PAD)
        ids[0, place] = (numbers >> np.uint64(64 - BITS)).astype(np.int64)
        ids[1, place] = ((numbers >> np.uint64(16)) & np.uint64(PAD - 1)).astype(np.int64)
        gaps = ids[0] == PAD
        if known is not None:
            ids[:, place[~known]] = PAD
        return ids, rows[:-1] + gap * np.arange(count), gaps

    def features(self, ids: np.ndarray, starts: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x = np.concatenate([self.tables[0][ids[0]], self.tables[1][ids[1]]], axis=1)
        pooled, maps = [], []
        for w, k, c in zip(WIDTHS, self.filters, self.shift, strict=True):
            y = x @ k[0]
            for j in range(1, w):
                y[:-j] += x[j:] @ k[j]
            y += c
            y[gaps] = 0
            # An empty row still has its gap, so reduceat sees no empty stretch.
            pooled.append(np.maximum(np.maximum.reduceat(y, starts, axis=0), 0))
            maps.append(y)
        return np.hstack(pooled), x, maps

    def raw(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probabilities before calibration, for rows of any number of words."""
        if len(rows) < 2:
            return np.zeros(0)
        known = None if self.words is None else within(numbers, self.words)
        pooled, _, _ = self.features(*self.padded(numbers, rows, known))
        return 1 / (1 + np.exp(-(pooled @ self.out + self.bias).astype(np.float64)))


@dataclass
class Committee(Scorer):
    """The mean of its members' probabilities."""

    members: list[Classifier]
    thresholds: np.ndarray = field(default_factory=even_thresholds)

    def raw(self, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.mean([m.raw(numbers, rows) for m in self.members], axis=0)


def within(numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which numbers are among the sorted words."""
    if not len(words):
        return np.zeros(len(numbers), bool)
    return words[np.minimum(np.searchsorted(words, numbers), len(words) - 1)] == numbers


def _touched(table: np.ndarray, memory: np.ndarray, ids: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """A step of Adagrad on the rows that have gradients."""
    keep = ids != PAD
    at, back = np.unique(ids[keep], return_inverse=True)
    g = np.zeros((len(at), table.shape[1]), np.float32)
    np.add.at(g, back, grads[keep])
    memory[at] += g * g
    table[at] -= rate * g / np.sqrt(memory[at] + 1e-8)


def positive_weight(share: float) -> float:
    return min(4.0, 0.5 / max(share, 1e-3))


class Learner:
    """Adagrad on one network; what it remembers goes on from one group of texts to the next."""

    def __init__(self, model: Classifier, seed: int, rate: float):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.memory = [np.full_like(t, 1e-3) for t in model.tables]
        self.dense = [*model.filters, *model.shift, model.out]
        self.held = [np.full_like(x, 1e-3) for x in self.dense]
        self.bias_held = 1e-3

    def touched(self) -> list[np.ndarray]:
        """Of either table, the rows that were ever changed."""
        return [(m != np.float32(1e-3)).any(axis=1) for m in self.memory]

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, known: list[np.ndarray], positive: float, epochs: int) -> None:
        """Batches are of documents in a shuffled order."""
        model = self.model
        weight = np.where(labels == 1, positive, 1.0)
        for epoch in range(epochs):
            order = self.rng.permutation(len(texts))
            step = self.rate / (1 + 0.15 * epoch)
            for lo in range(0, len(order), 32):
                pick = order[lo : lo + 32]
                rows = np.append(0, np.cumsum([len(texts[i]) for i in pick]))
                ids, starts, gaps = model.padded(np.concatenate([texts[i] for i in pick]), rows, np.concatenate([known[i] for i in pick]))
                pooled, x, maps = model.features(ids, starts, gaps)
                p = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
                g = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = [None] * len(self.dense)
                grads[-1] = pooled.T @ g + 1e-5 * model.out
                down = np.outer(g, model.out) * (pooled > 0)
                sent_ids: list[np.ndarray] = []
                sent: list[np.ndarray] = []
                ends = np.append(starts[1:], ids.shape[1])
                for k, w in enumerate(WIDTHS):
                    top = np.stack([maps[k][s:e].argmax(axis=0) + s for s, e in zip(starts, ends, strict=True)])
                    d = down[:, k * FILTERS : (k + 1) * FILTERS]
                    grads[k] = np.empty_like(model.filters[k])
                    for j in range(w):
                        at = np.minimum(top + j, ids.shape[1] - 1)
                        grads[k][j] = np.einsum("bfe,bf->ef", x[at], d)
                        sent_ids.append(at.ravel())
                        sent.append((d[:, :, None] * model.filters[k][j].T[None]).reshape(-1, 2 * HALF))
                    grads[len(WIDTHS) + k] = d.sum(axis=0)
                at, change = np.concatenate(sent_ids), np.concatenate(sent)
                for h in range(2):
                    _touched(model.tables[h], self.memory[h], ids[h][at], change[:, h * HALF : (h + 1) * HALF], step)
                for value, m, d in zip(self.dense, self.held, grads, strict=True):
                    m += d * d
                    value -= step * d / np.sqrt(m + 1e-8)
                self.bias_held += float(g.sum()) ** 2
                model.bias -= step * float(g.sum()) / np.sqrt(self.bias_held)


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.08) -> Classifier:
    """Fit on word numbers of documents."""
    model = Classifier.fresh(seed)
    learner = Learner(model, seed, rate)
    model.words = common_words(texts)
    learner.learn(texts, labels, [within(x, model.words) for x in texts], positive_weight(labels.mean()), epochs)
    for table, seen in zip(model.tables, learner.touched(), strict=True):
        table[~seen] = 0
    return model


def committee(spark: SparkSession, texts: list[np.ndarray], labels: np.ndarray, seeds: tuple[int, ...] = SEEDS, epochs: int = EPOCHS) -> Committee:
    """Networks of consecutive ``seeds``, each fitted in a task of its own on texts that FIT_WORDS bounds."""
    sent = spark.sparkContext.broadcast((np.concatenate(texts), np.cumsum([len(x) for x in texts]), labels))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ends, y = sent.value
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                made = pickle.dumps(train(np.split(numbers, ends[:-1]), y, epochs=epochs, seed=seed))
                yield pa.record_batch([pa.array([seed], pa.int64()), pa.array([made], pa.binary())], names=["seed", "model"])

    tasks = spark.range(min(seeds), max(seeds) + 1, 1, len(seeds))
    made = tasks.mapInArrow(fitted, "seed long, model binary").collect()
    sent.destroy()
    return Committee([pickle.loads(x["model"]) for x in sorted(made, key=lambda x: x["seed"])])


def common_words(texts: list[np.ndarray]) -> np.ndarray:
    """The words, sorted, of at least LEAST_TEXTS distinct texts."""
    distinct = {x.tobytes(): x for x in texts}
    word, n = np.unique(np.concatenate([np.unique(x) for x in distinct.values()]), return_counts=True)
    return word[n >= LEAST_TEXTS]


def best_threshold(p: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The cut with the highest F1, midway between its neighbours and within 0.05 to 0.95; of ``n`` rows with a probability ``hits`` are positive."""
    order = np.argsort(-p, kind="stable")
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + max(1, hits.sum()))
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.05, 0.95))


def _binned(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = _lists(batch.column(1))
            numbers, rows = np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts]))
            p = np.concatenate([model.raw(x, np.array([0, len(x)])) for x in texts])
            yield pa.record_batch(
                [batch.column(0), pa.array(languages(numbers, rows).astype(np.int32)), pa.array(np.rint(p * BINS).astype(np.int32))], names=["toxic", "language", "bin"])

    return score


def calibrate(model: Scorer, known: DataFrame) -> None:
    """Thresholds from all labelled texts of ``known`` (toxic, numbers); what comes to the driver are counts by language and step of probability."""
    sent = known.sparkSession.sparkContext.broadcast(model)
    scored = known.select("toxic", "numbers").mapInArrow(released(_binned(sent)), "toxic int, language int, bin int")
    got = scored.groupBy("language", "bin").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")).orderBy("language", "bin").toArrow()
    sent.destroy()
    spoken, bins, hits, n = (got[c].to_numpy() for c in ("language", "bin", "hits", "n"))

    def best(rows: np.ndarray) -> float:
        at, back = np.unique(bins[rows], return_inverse=True)
        return best_threshold(at / BINS, np.bincount(back, weights=hits[rows]), np.bincount(back, weights=n[rows]))

    if hits.sum():
        model.thresholds[:] = best(np.ones(len(bins), bool))
    for k in range(len(LANGUAGES)):
        own = spoken == k
        if hits[own].sum() >= LEAST_POSITIVES:
            model.thresholds[k] = best(own)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        data, at = utf8(batch.column(2))
        for lo, hi in sliced(data, at):
            w = Words(data, at[lo : hi + 1], ALNUM)
            lists += [w.numbers[w.rows[i] : w.rows[i + 1]].view(np.int64) for i in range(hi - lo)]
        digests = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in lists]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(digests, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "toxic", "digest", "numbers"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Each row's word numbers."""
    values, at = np.asarray(column.values).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: how many of the texts hold it."""
    for batch in batches:
        word, n = np.unique(np.concatenate([np.unique(x) for x in _lists(batch.column(0))]), return_counts=True)
        yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def corpus_words(fitted: DataFrame, texts: int) -> np.ndarray:
    """The words, sorted, of at least LEAST_TEXTS and LEAST_SHARE of all distinct texts (digest, numbers), of which there are ``texts``."""
    each = fitted.select("digest", "numbers").dropDuplicates(["digest"]).select("numbers")
    counts = each.mapInArrow(released(_text_counts), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") >= float(max(LEAST_TEXTS, texts * LEAST_SHARE))).select("word").toArrow()
    return np.sort(got["word"].to_numpy().view(np.uint64)) if len(got) else np.zeros(0, np.uint64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """All rows (part, toxic, numbers) in order, in runs of one part and of at most HELD_ROWS and about HELD_WORDS."""
    now, texts, labels, size = None, [], [], 0
    for batch in batches:
        for part, toxic, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
            if texts and (part != now or len(texts) >= HELD_ROWS or size + len(x) > HELD_WORDS):
                yield now, texts, np.array(labels)
                texts, labels, size = [], [], 0
            now = part
            texts.append(x)
            labels.append(toxic)
            size += len(x)
    if texts:
        yield now, texts, np.array(labels)


@dataclass
class Sums:
    """Networks added up, each times its documents: dense values, and of either table the rows that changed, with their documents."""

    n: float
    dense: list[np.ndarray]
    at: list[np.ndarray]
    rows: list[np.ndarray]
    docs: list[np.ndarray]

    @classmethod
    def of(cls, learner: Learner, n: int) -> Sums:
        at = [np.flatnonzero(x) for x in learner.touched()]
        return cls(
            n, [n * x.astype(np.float64) for x in (*learner.dense, np.array(learner.model.bias))], at,
            [np.float32(n) * t[i] for t, i in zip(learner.model.tables, at, strict=True)], [np.full(len(i), n, np.float32) for i in at])

    @classmethod
    def added(cls, parts: Iterable[Sums]) -> Sums:
        n, dense = 0, []
        rows, docs = [np.zeros((PAD + 1, HALF)) for _ in range(2)], [np.zeros(PAD + 1) for _ in range(2)]
        for part in parts:
            n += part.n
            dense = [x + y for x, y in zip(dense, part.dense, strict=True)] if dense else part.dense
            for h in range(2):
                rows[h][part.at[h]] += part.rows[h]
                docs[h][part.at[h]] += part.docs[h]
        at = [np.flatnonzero(x) for x in docs]
        return cls(n, dense, at, [x[i].astype(np.float32) for x, i in zip(rows, at, strict=True)], [x[i].astype(np.float32) for x, i in zip(docs, at, strict=True)])

    def mean(self, start: Classifier, words: np.ndarray) -> Classifier:
        """Rows of words are the mean over the parts that changed them; what none changed is as it was."""
        tables = [t.copy() for t in start.tables]
        for t, i, rows, docs in zip(tables, self.at, self.rows, self.docs, strict=True):
            t[i] = rows / docs[:, None]
        *dense, bias = [x / self.n for x in self.dense]
        dense = [x.astype(np.float32) for x in dense]
        k = len(WIDTHS)
        return Classifier(tables, dense[:k], dense[k : 2 * k], dense[-1], float(bias), words=words)


SUMS = "seed long, part long, sums binary"


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    seed, part, sums = zip(*rows, strict=True)
    return pa.record_batch([pa.array(seed, pa.int64()), pa.array(part, pa.int64()), pa.array([pickle.dumps(x) for x in sums], pa.binary())], names=["seed", "part", "sums"])


def _refined(sent):
    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pickled, words, positive, epochs, rate = sent.value
        now, learners, n = None, [], 0
        for part, texts, labels in _held(batches):
            if part != now:
                if learners:
                    yield _sums_batch([(k, now, Sums.of(x, n)) for k, x in enumerate(learners)])
                now, n = part, 0
                learners = [Learner(m, 1000 * k + part, rate) for k, m in enumerate(pickle.loads(pickled))]
            known = [within(x, words) for x in texts]
            for learner in learners:
                learner.learn(texts, labels, known, positive, epochs)
            n += len(texts)
        if learners:
            yield _sums_batch([(k, now, Sums.of(x, n)) for k, x in enumerate(learners)])

    return refine


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((p, m) for b in batches for p, m in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True)), key=lambda r: r[0])
    yield _sums_batch([(key[0].as_py(), key[1].as_py(), Sums.added(pickle.loads(m) for _, m in rows))])


def refined(start: Committee, fitted: DataFrame, n: int, texts: int, share: float, scratch: Scratch) -> Committee:
    """Members trained further by all ``n`` documents (rank, doc_id, toxic, digest, numbers), each in one part.

    Parts, and the order within them, are matters of doc_id and number alone.
    """
    spark = fitted.sparkSession
    words = corpus_words(fitted, texts)
    parts = count = max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
    sent = spark.sparkContext.broadcast((pickle.dumps(start.members), words, positive_weight(share), MORE_EPOCHS, MORE_RATE))
    dealt = fitted.withColumn("part", F.pmod("rank", F.lit(parts)).cast("int")).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "rank", "doc_id")
    sums = scratch.save(dealt.select("part", "toxic", "numbers").mapInArrow(released(_refined(sent)), SUMS), "sums")
    sent.destroy()
    while count > 1:
        count = -(-count // MEET)
        old, sums = sums, scratch.save(sums.groupBy("seed", (F.col("part") % count).alias("group")).applyInArrow(_added, SUMS), "sums")
        scratch.drop(old)
    got = {r["seed"]: pickle.loads(r["sums"]) for r in sums.collect()}
    return Committee([got[k].mean(m, words) if k in got else m for k, m in enumerate(start.members)])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_words: int = FIT_WORDS) -> Scorer:
    """Learn from all labelled documents outside the held-out fold.

    Rows whose fold is 1 set the thresholds, all others the weights: at most
    ``rows`` of ``most_words`` words in all give the first networks, which all of
    them then train further. Of the texts of a repeated doc_id the least one
    counts, of its labels the greatest. Without a label of either kind every
    score is that of the untrained output's bias.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "toxicity")
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(fold(F.col("doc_id"), 5) != 0).join(chosen, "doc_id")
    known = known.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).mapInArrow(released(_word_numbers), "doc_id long, toxic int, digest long, numbers array<long>")
    known = scratch.save(known.withColumns({"rank": F.xxhash64("doc_id"), "fold": fold(F.col("doc_id"), 5)}), "known")
    fitted = known.where("fold <> 1")
    sums = fitted.agg(F.count("*").alias("n"), F.count_distinct("digest").alias("texts"), F.sum("toxic").alias("toxic")).first()
    n, positives = sums["n"], sums["toxic"] or 0
    if not 0 < positives < n:
        scratch.keep_only()
        model = Classifier.fresh()
        model.out[:] = 0
        return model
    left, first = most_words, []
    # ``rows`` bounds what is listed and sent, ``most_words`` what comes to the driver.
    # Saved, for a limit that is collected sends so many rows of every task.
    least = scratch.save(fitted.select("rank", "doc_id", F.size("numbers").alias("n")).orderBy("rank", "doc_id").limit(rows), "least")
    for r in least.orderBy("rank", "doc_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            first.append((r["doc_id"],))
    some = fitted.join(F.broadcast(spark.createDataFrame(first, "doc_id long")), "doc_id", "left_semi")
    got = some.orderBy("rank", "doc_id").select("toxic", "numbers").toArrow()
    texts = [x for c in got["numbers"].chunks for x in _lists(c)]
    model = committee(spark, texts, got["toxic"].to_numpy().astype(np.int64)) if texts else Committee([Classifier.fresh(k) for k in SEEDS])
    if len(first) < n:
        model = refined(model, fitted, n, sums["texts"], positives / n, scratch)
    calibrate(model, known.where("fold = 1"))
    scratch.keep_only()
    return model


def _scored(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            out = []
            data, at = utf8(batch.column(batch.num_columns - 1))
            for lo, hi in sliced(data, at):
                w = Words(data, at[lo : hi + 1], ALNUM)
                out.append(model.scores(w.numbers, w.rows))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.record_batch([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return score


def score_toxicity(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    A null or empty text has no words and gets the score of none. Repeated rows
    get equal scores; a null doc_id is not held out; an empty table gives an
    empty result. No column but ``text`` enters a score.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(released(_scored(sent)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, model: Scorer) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under 0.5."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scored(sent)
        for batch in batches:
            text = pa.record_batch([batch.column(place)], names=["text"])
            for got in score(iter([text])):
                yield batch.filter(pa.array(got.column(0).to_numpy() < 0.5))

    return docs.mapInArrow(released(keep), docs.schema)
