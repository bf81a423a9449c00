"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is a stream of letters, whatever their script, in which white space counts as one blank and all else is dropped; blanks
between single letters are dropped too. So characters put between the letters of an insult fall away. The kernel
compares two sentences by their common subsequences of ``ORDER`` letters that span ``SPAN`` at most, each weighted by
``DECAY`` to the power of its span: a gap or an inserted letter only weakens a match. The machine is trained on
sentences of labelled documents, windows of ``FRAGMENT`` letters, in the space that the landmarks among them span; as every kernel
value is a sum over subsequences, the trained machine is folded into one weight for each subsequence that a landmark has, found by
the subsequence itself. A whole text is read by sums over its positions. Its score is a logistic curve over how bad its worst
sentence is and how many of its sentences reach each of ``BARS`` in the machine's measure.

A label is of a document, not of a sentence. So a toxic document's sentences are those whose runs of letters are far more
frequent in toxic documents than in others, and after each round those that the machine finds worst; a clean document's
are drawn at random, and after each round those that the machine finds worst. Training takes at most ``MAX_TRAINING``
labelled documents, those with the least hashes of their id, every fifth of which only fits the curve.

Letters that no training document has are all the same letter, which no landmark has.

Edge cases: a null or empty text has the score of no evidence; a label that is null or without a document is not used;
without labels of both kinds every score is 0; repeated rows are each scored; an empty table gives an
empty result; other columns are ignored, or passed through by ``score_column``, whose score then takes an unused name.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boutline.llm.common import on_workers, slices, text_of, unused

ORDER, SPAN, DECAY = 5, 7, 0.5
#: Positions summed to the score of a window.
WINDOW = 12
#: Positions that a window reads.
FRAGMENT = WINDOW + SPAN - 1
MAX_TRAINING = 4000
LANDMARKS = 512
#: A run of ``ORDER`` letters is evidence if so many toxic documents, such a share of them, and so many times the share of clean ones have it.
MIN_WITNESS, MIN_SHARE, MIN_RATIO = 4, 0.005, 6
#: What a sentence is to reach to count; the machine parts toxic from clean ones at 0 and holds both off it by 1.
BARS = (-0.5, 0.0)
#: Sentences that a round takes of a toxic document at most, and rounds of training.
TAKEN, ROUNDS = 4, 3
#: Clean sentences that a round adds.
HARDEST = 700
#: Letters told apart at most, so that a subsequence fits 64 bits.
MAX_LETTERS = 4000
#: What a positive counts for against a negative in the curve.
BALANCE = 2.0
_DROPPED = 0xFFFF
_GAPS = [c for c in combinations(range(1, SPAN), ORDER - 1)]
CHUNK = 1 << 18


class Alphabet(NamedTuple):
    """Code 0 is the blank, the last two are letters not met in training and what parts two texts."""

    table: np.ndarray  # the code of each code point
    letters: int

    @property
    def strange(self) -> int:
        return self.letters + 1

    @property
    def apart(self) -> int:
        return self.letters + 2

    @property
    def bits(self) -> int:
        return self.apart.bit_length()

    @property
    def index_type(self) -> type:
        return np.uint32 if ORDER * self.bits <= 32 else np.uint64


def alphabet(texts: list[str]) -> Alphabet:
    """The letters of some texts, the commonest if there are too many."""
    met: Counter = Counter()
    for text in texts:
        met.update({c for c in text.lower() if c.isalpha()})
    code = {c: i for i, c in enumerate(sorted(c for c, _ in met.most_common(MAX_LETTERS)), 1)}
    strange = len(code) + 1

    def of(point: int) -> int:
        char = chr(point)
        if char.isalpha():
            return code.get(char.lower()[0], strange)
        return 0 if char.isspace() else _DROPPED

    return Alphabet(np.array([of(c) for c in range(sys.maxunicode + 1)], dtype=np.uint16), len(code))


def stream(text: str, letters: Alphabet) -> np.ndarray:
    """The codes of a text, runs of blanks as one, with a blank at each end, single letters in a row as one word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = letters.table[points]
    codes = np.concatenate((np.zeros(1, np.uint16), codes[codes != _DROPPED], np.zeros(1, np.uint16)))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    blanks = np.flatnonzero(codes == 0)
    single = np.diff(blanks) == 2
    return np.delete(codes, blanks[1:-1][single[:-1] & single[1:]])


def features(codes: np.ndarray, letters: Alphabet) -> Iterator[tuple[np.ndarray, float, int]]:
    """For each pattern of gaps: the subsequence at every position, the weight of its span, and the span."""
    kind, n = letters.index_type, len(codes)
    padded = np.concatenate((codes.astype(kind), np.full(SPAN, letters.apart, kind)))
    shift = kind(letters.bits)
    begun: dict[tuple[int, ...], np.ndarray] = {(): padded[:n]}
    for gaps in _GAPS:
        for k in range(1, ORDER):
            if gaps[:k] not in begun:
                begun = {key: value for key, value in begun.items() if key == gaps[: len(key)]}
                begun[gaps[:k]] = (begun[gaps[: k - 1]] << shift) | padded[gaps[k - 1] : gaps[k - 1] + n]
        yield begun[gaps], DECAY ** (gaps[-1] - ORDER + 1), gaps[-1]


class Table(NamedTuple):
    shift: int
    keys: np.ndarray
    values: np.ndarray


def tables(ids: np.ndarray, weights: np.ndarray) -> list[Table]:
    """Exact look-up of a weight by its subsequence: those that clash in a table are in the next one."""
    out, width = [], 8 * ids.dtype.itemsize
    none = ids.dtype.type(np.iinfo(ids.dtype).max)  # codes of what parts texts alone: never a subsequence of a landmark
    while len(ids):
        bits = max(8, (16 * len(ids)).bit_length())
        table = Table(width - bits, np.full(1 << bits, none), np.zeros(1 << bits, np.float32))
        place = _place(ids, table)
        _, first = np.unique(place, return_index=True)
        table.keys[place[first]], table.values[place[first]] = ids[first], weights[first]
        rest = np.ones(len(ids), bool)
        rest[first] = False
        ids, weights = ids[rest], weights[rest]
        out.append(table)
    return out


def _place(ids: np.ndarray, table: Table) -> np.ndarray:
    kind = ids.dtype.type
    return ((ids * kind(0x9E3779B1 if kind is np.uint32 else 0x9E3779B97F4A7C15)) >> kind(table.shift)).astype(np.intp)


class Machine(NamedTuple):
    letters: Alphabet
    weights: list[Table]
    offset: float


class Model(NamedTuple):
    machine: Machine
    curve: np.ndarray  # what each reading counts for, and the offset

    def scores(self, readings: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(readings @ self.curve[:-1] + self.curve[-1], -30, 30)))


def windows(codes: np.ndarray, machine: Machine) -> np.ndarray:
    """What the machine makes of each window of ``WINDOW`` positions."""
    at = np.zeros(len(codes))
    for index, decay, _ in features(codes, machine.letters):
        for table in machine.weights:
            place = _place(index, table)
            hit = np.flatnonzero(table.keys[place] == index)
            at[hit] += decay * table.values[place[hit]]
    width = min(WINDOW, len(codes))
    count = len(codes) - width + 1
    sums = at[:count].copy()
    for k in range(1, width):  # not by running sums, whose rounding depends on all that comes before
        sums += at[k : k + count]
    return sums + machine.offset


def readings(texts: list[str], machine: Machine) -> np.ndarray:
    """A row for each text: its worst window, the logarithm of one more than how often its windows come to reach each bar.

    Only windows that begin in the text count. Texts are laid end to end and read in one go, so far apart that no such
    window reaches the next text: the readings are the same in any batch.
    """
    out, group, size = [np.zeros((0, len(BARS) + 1))], [], 0

    def read() -> None:
        gap = np.full(WINDOW + SPAN, machine.letters.apart, np.uint16)
        sizes = np.array([len(x) for x in group])
        sums = windows(np.concatenate([y for x in group for y in (x, gap)]), machine)
        starts = np.cumsum(sizes + len(gap)) - sizes - len(gap)
        edges = np.stack((starts, starts + sizes), axis=1).ravel()
        columns = [np.maximum.reduceat(sums, edges)[::2]]
        for bar in BARS:
            above = sums >= bar
            rising = above & ~np.concatenate(([False], above[:-1]))
            rising[starts] = above[starts]
            columns.append(np.log1p(np.add.reduceat(rising.astype(np.int64), edges)[::2]))
        out.append(np.stack(columns, axis=1))
        group.clear()

    for text in texts:
        codes = stream(text, machine.letters)
        group.append(codes)
        size += len(codes)
        if size >= CHUNK:
            read()
            size = 0
    if group:
        read()
    return np.concatenate(out)


def _vector(codes: np.ndarray, letters: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a sentence, those of one window of a text, and their weights."""
    codes = codes[:FRAGMENT]
    known = codes <= letters.letters
    found, weights = [], []
    for gaps, (index, decay, span) in zip(_GAPS, features(codes, letters)):
        n = max(0, min(WINDOW, len(codes) - span))
        whole = known[:n].copy()
        for g in gaps:
            whole &= known[g : g + n]
        found.append(index[:n][whole])
        weights.append(np.full(int(whole.sum()), decay))
    ids, at = np.unique(np.concatenate(found), return_inverse=True)
    return ids, np.bincount(at, np.concatenate(weights), len(ids))


def _grams(codes: np.ndarray, letters: Alphabet) -> np.ndarray:
    """The runs of ``ORDER`` letters at every position."""
    return next(features(codes, letters))[0]


def _evidence(toxic: list[np.ndarray], clean: list[np.ndarray], letters: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters that toxic documents have far oftener than others, sorted, and the logarithm of how much."""
    runs, often = np.unique(np.concatenate([np.unique(_grams(s, letters)) for s in toxic]), return_counts=True)
    keep = often >= max(MIN_WITNESS, MIN_SHARE * len(toxic))
    runs, often, seldom = runs[keep], often[keep], np.zeros(int(keep.sum()))
    if not len(runs):
        return runs, seldom
    for s in clean:
        own = np.unique(_grams(s, letters))
        at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
        seldom[at[runs[at] == own]] += 1
    ratio = (often / len(toxic)) / ((seldom + 0.5) / len(clean))
    return runs[ratio >= MIN_RATIO], np.log(ratio[ratio >= MIN_RATIO])


def _worst(sums: np.ndarray, taken: int) -> list[int]:
    """Places of the largest sums, none within a sentence of another."""
    sums, out = sums.copy(), []
    for _ in range(taken):
        at = int(sums.argmax())
        if out and not sums[at] > 0:
            break
        out.append(at)
        sums[max(0, at - FRAGMENT) : at + FRAGMENT] = -np.inf
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 0.1, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows within the margin, summed in blocks. The last column of ``x`` is one."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty * len(x)
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = np.flatnonzero(y * (x @ w) < 1)
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for i in range(0, len(inside), 1024):
            rows = x[inside[i : i + 1024]]
            weighed = rows * cost[inside[i : i + 1024], None]
            left += weighed.T @ rows
            right += weighed.T @ y[inside[i : i + 1024]]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


class Marks(NamedTuple):
    """The landmarks by subsequence: ``start`` says where the entries of each of ``ids`` begin, which are landmarks and their weights."""

    ids: np.ndarray
    start: np.ndarray
    mark: np.ndarray
    value: np.ndarray

    def kernel(self, sentences: list["Vector"], n: int) -> np.ndarray:
        """The kernel of each sentence with each of ``n`` landmarks."""
        ids, values = (np.concatenate(x) for x in zip(*sentences))
        row = np.repeat(np.arange(len(sentences)), [len(v) for v, _ in sentences])
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[at] == ids
        first, size = self.start[at[known]], np.diff(self.start)[at[known]]
        entry = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(row[known] * n, size) + self.mark[entry]
        return np.bincount(cell, self.value[entry] * np.repeat(values[known], size), len(sentences) * n).reshape(-1, n)


def _marks(landmarks: list["Vector"]) -> Marks:
    ids = np.concatenate([v[0] for v in landmarks])
    order = np.argsort(ids, kind="stable")
    known, start = np.unique(ids[order], return_index=True)
    mark = np.repeat(np.arange(len(landmarks)), [len(v[0]) for v in landmarks])[order]
    return Marks(known, np.append(start, len(ids)), mark, np.concatenate([v[1] for v in landmarks])[order])


Vector = tuple[np.ndarray, np.ndarray]


def _trained(positive: list[Vector], negative: list[Vector], letters: Alphabet, rng: np.random.Generator) -> Machine:
    """Trains on the vectors of sentences and folds the machine into a weight for each subsequence of a landmark.

    Of the landmarks, half are toxic sentences and half clean ones, each of the later ones more likely, as those are the hardest.
    """
    sentences = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    picks = rng.permutation(len(positive))[: LANDMARKS // 2].tolist()
    late = np.arange(len(negative)) + 1.0
    picks += (len(positive) + rng.choice(len(negative), min(len(negative), LANDMARKS // 2), replace=False, p=late / late.sum())).tolist()
    marks = _marks([sentences[i] for i in picks])
    own, vectors = np.linalg.eigh(marks.kernel([sentences[i] for i in picks], len(picks)))
    use = own > 1e-6 * own.max()
    whiten = vectors[:, use] / np.sqrt(own[use])
    x = np.ones((len(sentences), whiten.shape[1] + 1))
    for i in range(0, len(sentences), 256):
        x[i : i + 256, :-1] = marks.kernel(sentences[i : i + 256], len(picks)) @ whiten
    cost = np.where(y > 0, len(y) / (2 * len(positive)), len(y) / (2 * len(negative)))
    w, offset = _svm(x, y, cost)
    owner = np.repeat(np.arange(len(marks.ids)), np.diff(marks.start))
    return Machine(letters, tables(marks.ids, np.bincount(owner, marks.value * (whiten @ w)[marks.mark], len(marks.ids))), offset)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Trains on labelled texts."""
    y, rng = np.array(labels), np.random.default_rng(seed)
    letters = alphabet(texts)
    empty = Model(Machine(letters, [], 0.0), np.array([0.0] * (len(BARS) + 1) + [-30.0]))
    if not len(y) or not y.sum() or y.all():
        return empty
    apart = np.arange(len(texts)) % 5 == 4  # what the curve from raw scores is fitted to
    if not y[apart].sum() or not y[~apart].sum() or y[apart].all() or y[~apart].all():
        apart[:] = False
    held, held_y = ([t for t, h in zip(texts, apart) if h], y[apart]) if apart.any() else (texts, y)
    streams, y = [stream(t, letters) for t, h in zip(texts, apart) if not h], y[~apart]
    toxic, clean = [s for s, label in zip(streams, y) if label], [s for s, label in zip(streams, y) if not label]
    del streams
    runs, ratios = _evidence(toxic, clean, letters)
    if not len(runs):
        return empty
    positive = []
    for s in toxic:
        grams = _grams(s, letters)
        at = np.minimum(np.searchsorted(runs, grams), len(runs) - 1)
        told = np.where(runs[at] == grams, ratios[at], 0.0)
        if told.any():
            positive += [_vector(s[max(0, k - 2) :], letters) for k in _worst(told, TAKEN) if told[k] > 0]
    if not positive:
        return empty
    negative = []
    for s in clean:
        for k in rng.integers(0, max(1, len(s) - FRAGMENT), 2):
            negative.append(_vector(s[k:], letters))
    machine = _trained(positive, negative, letters, rng)
    for _ in range(ROUNDS):
        worst = []
        for s in clean:
            sums = windows(s, machine)
            at = int(sums.argmax())
            worst.append((float(sums[at]), s[at : at + FRAGMENT]))
        worst.sort(key=lambda x: x[0])
        negative += [_vector(s, letters) for _, s in worst[-HARDEST:]]
        again = []
        for s in toxic:
            sums = windows(s, machine)
            again += [_vector(s[k:], letters) for k in _worst(sums, TAKEN) if sums[k] > worst[-1][0]]
        machine = _trained(positive + again, negative, letters, rng)
    return Model(machine, _curve(readings(held, machine), held_y))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve over readings, by Newton steps with a little shrinkage."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    cost = np.where(y > 0, BALANCE, 1.0)
    ridge = np.diag([0.1] * x.shape[1] + [1e-2])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (cost * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model on labelled documents that are not held out, at most ``MAX_TRAINING`` of them."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").toPandas()  # MAX_TRAINING bounds it
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


def score_column(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and in the last column a score, 0 to 1, from the whole text of each row alone; it is ``score`` or, where
    the input has that, ``score_`` and so on."""
    spark = docs.sparkSession
    on_workers(spark)
    letters, weights, offset = model.machine
    parts = (tuple(letters), [tuple(t) for t in weights], offset, model.curve)
    shared = spark.sparkContext.broadcast(parts)  # what landmarks have, 30 MB at most, however large the input
    at, (name,) = docs.columns.index("text"), unused(docs.columns, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, weights, offset, curve = shared.value
        model = Model(Machine(Alphabet(*letters), [Table(*t) for t in weights], offset), curve)
        for batch in slices(batches):
            scores = model.scores(readings([t or "" for t in batch.column(at).to_pylist()], model.machine))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of each row."""
    return score_column(text_of(docs), model).select("doc_id", "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
