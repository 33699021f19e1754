"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shipping import ship

from .kernels import SPACE, U, find_words, mix, pieces
from .near_dup import shingle_sets

#: Hashed words, then slots for coarse measures of the text.
WORD_BITS = 18
MEASURES, STEPS = 6, 12
SIZE = (1 << WORD_BITS) + MEASURES * STEPS
#: ASCII marks become spaces in the second view of a text, so that "word," and "word" share a feature.
PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def measures(data: np.ndarray, at: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """For every text a slot for each measure: log words, share of distinct words, letters a word, capitals, digits, marks."""
    starts, ends, first = find_words(data, at)
    words = np.diff(first)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)

    inside = np.maximum(total(~SPACE[data]), 1)
    n = np.maximum(words, 1)
    shares = [
        np.log2(n) * 0.7,
        distinct / n * (STEPS - 1),
        inside / n,
        total((data >= 65) & (data <= 90)) / inside * (STEPS - 1),
        np.sqrt(total((data >= 48) & (data <= 57)) / inside) * (STEPS - 1),
        np.sqrt(total(np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8))) / inside) * (STEPS - 1),
    ]
    return np.stack([(1 << WORD_BITS) + k * STEPS + np.clip(x, 0, STEPS - 1).astype(np.int64) for k, x in enumerate(shares)], 1)


def featured(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Features of stretches of a text column: first row, end row, slots, where each text's slots begin."""
    for lo, hi, data, at in pieces(texts):
        names, bounds = shingle_sets(data, at, 1)
        plain, ends = shingle_sets(PLAIN[data], at, 1)
        coarse = measures(data, at, np.diff(bounds))
        row = np.arange(hi - lo)
        rows = np.concatenate([np.repeat(row, np.diff(bounds)), np.repeat(row, np.diff(ends)), np.repeat(row, MEASURES)])
        slots = np.concatenate([(names >> U(64 - WORD_BITS)).astype(np.int64), (mix(plain) >> U(64 - WORD_BITS)).astype(np.int64), coarse.ravel()])
        yield lo, hi, slots[np.argsort(rows, kind="stable")], bounds + ends + MEASURES * np.arange(hi - lo + 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(limits[k] - weights . features): one set of weights, limits in order."""

    weights: np.ndarray
    limits: np.ndarray

    def scores(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[slots].astype(np.float64))])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every limit."""
        return sigmoid(scores[:, None] - self.limits[None, :])


def ordered(spread: np.ndarray) -> np.ndarray:
    """Limits in order from a first one and the logarithms of the gaps behind it."""
    return spread[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(spread[1:], -4, 4)))])


def likelihood(scores: np.ndarray, limits: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """P(grade) of each row: the difference of two cumulative links."""
    top = len(limits)
    upper = np.where(grades < top, sigmoid(limits[np.minimum(grades, top - 1)] - scores), 1.0)
    lower = np.where(grades > 0, sigmoid(limits[np.maximum(grades - 1, 0)] - scores), 0.0)
    return np.maximum(upper - lower, 1e-9)


def gradients(scores: np.ndarray, spread: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative logarithm of the likelihood: by each row's score, and by `spread`."""
    limits, top = ordered(spread), len(spread)
    upper = np.where(grades < top, sigmoid(limits[np.minimum(grades, top - 1)] - scores), 1.0)
    lower = np.where(grades > 0, sigmoid(limits[np.maximum(grades - 1, 0)] - scores), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    by_limit = np.bincount(np.minimum(grades, top - 1), np.where(grades < top, -du / p, 0), top) + np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, dl / p, 0), top)
    by_limit /= len(grades)
    gaps = np.exp(np.clip(spread[1:], -4, 4))
    by_spread = np.concatenate([[by_limit.sum()], [by_limit[k + 1 :].sum() * gaps[k] for k in range(top - 1)]])
    return (du - dl) / p / len(grades), by_spread


def fit_ordinal(slots: np.ndarray, bounds: np.ndarray, grades: np.ndarray, levels: int, steps: int = 400, batch: int = 1024, rate: float = 0.03, decay: float = 5e-4, least: int = 3, seed: int = 0) -> Ordinal:
    """Maximum likelihood by Adam on minibatches, with decay and a rate that falls to 0; features of fewer than `least` documents weigh nothing.

    The limits are a first one and positive gaps, so they stay in order.
    """
    rng = np.random.default_rng(seed)
    model = Ordinal(np.zeros(SIZE), np.zeros(levels - 1))
    spread = np.zeros(levels - 1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", model.weights), ("t", spread))}

    def move(name: str, x: np.ndarray, g: np.ndarray, t: int) -> None:
        m, v = state[name]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    counts = np.diff(bounds)
    seen = np.bincount(slots, minlength=SIZE) >= least
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(grades), min(batch, len(grades)))
        n = counts[rows]
        used = slots[np.repeat(bounds[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        local = np.concatenate([[0], np.cumsum(n)])
        by_score, by_spread = gradients(model.scores(used, local), spread, grades[rows])
        g = np.where(seen, np.bincount(used, np.repeat(by_score, n), SIZE) + decay * model.weights, 0.0)
        move("w", model.weights, g, t)
        move("t", spread, by_spread, t)
    model.limits = ordered(spread)
    return model


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, seed: int = 0) -> Ordinal:
    """The model of at most `sample` labelled documents, those with the least hashed ids; the only bound on what is read.

    Defined results: a document with several labels has the lowest grade of them; labels without an id, a quality or a
    toxicity, and labels of documents that are not there, are left out; ties of the hash follow the id; rows that share
    an id all have its grade; a null text is an empty one, a very long one is read whole; without any label every score
    is 0. Other columns are not read.
    """
    ship(docs.sparkSession)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade_of(F.col("quality"), F.col("toxic"))).alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)  # bounded, so it may be sent to all tasks

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found, bounds in featured(batch.column(1)):
                rows = [found[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], names=["doc_id", "grade", "slots"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(slots, "doc_id long, grade int, slots binary").toArrow()
    order = np.lexsort((np.array([zlib.crc32(x) for x in rows.column("slots").to_pylist()], np.int64), rows.column("doc_id").to_numpy()))
    rows = rows.take(pa.array(order))
    parts = [np.frombuffer(x, "<i4") for x in rows.column("slots").to_pylist()]
    if not parts:
        return Ordinal(np.zeros(SIZE), np.array([-1.0, 1.0]))
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return fit_ordinal(np.concatenate(parts), bounds, rows.column("grade").to_numpy().astype(np.int64), 3, seed=seed)


def rate(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """Every document's expected grade and tail probability: doc_id, grade, tail, kept.

    `tail` is the probability of the highest grade; a document is kept if it is at least `least`. Nothing is shuffled;
    the model, of a fixed size, is sent to all tasks.

    Defined results: a null text is an empty one, which its measures alone rate; a very long text is rated whole; a
    document at the limit is kept; rows are rated one by one, equal ones alike, null ids too; an empty table gives an
    empty one. Other columns are not read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            tails = tail_rows(own, batch.column(1))
            columns = [batch.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            yield pa.record_batch(columns, names=["doc_id", "grade", "tail", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grade double, tail double, kept boolean")


def tail_rows(model: Ordinal, texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), len(model.limits)))
    for lo, hi, slots, bounds in featured(texts):
        out[lo:hi] = model.tails(model.scores(slots, bounds))
    return out


def select_good(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, of any name and type, that `rate` keeps; its defined results hold."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.limits))
    ship(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array(tail_rows(own, batch.column(place))[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
