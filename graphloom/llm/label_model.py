"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or neither on each document, or are silent on texts too short for
them. Expectation-maximisation over the counts of vote patterns estimates how often each labeller is
right, without gold labels; the posterior of a pattern is the training label of its documents. A linear
scorer over hashed words, word endings and word shapes is then trained on these labels and judges every
document, also those on which no labeller votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .text import mix, slices, words

DIMENSIONS = 1 << 13
#: Bound of the training sample, which is drawn by the hash of the ids.
SAMPLE = 8_000
#: Below a half: a clean text that is lost costs more than a poor one that stays.
THRESHOLD = 0.3
EPOCHS = 30
#: A small sample is passed more often, up to this number of steps.
STEPS = 900
RATE = 0.5
PENALTY = 1e-5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for with der die das und den von mit sich auf ist "
    "le la les de des et un une du que el los las y en por para con"
).split()

LABELLERS = ("symbols", "capitals", "stop_words", "repetition", "diversity", "line_shape")
VOTES = ", ".join(f"{x} int" for x in LABELLERS)


def _hash_words(items: list[str]) -> np.ndarray:
    return np.unique(words(pa.array([" ".join(items)])).hash)


_STOPS = _hash_words(STOP_WORDS + [w.capitalize() for w in STOP_WORDS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}[]~^=_\\"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Features(NamedTuple):
    votes: np.ndarray
    n_words: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


#: Expected shares of the votes -1, 0 and 1 on bad and on good texts.
BELIEF = np.array([[0.45, 0.45, 0.1], [0.02, 0.58, 0.4]])
#: Vote of a labeller on a text too short for it: no evidence for either class.
SILENT = 2


def _vote(asked: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(asked, good.astype(np.int8) - bad.astype(np.int8), SILENT).astype(np.int8)


def features(column: pa.Array, dimensions: int = DIMENSIONS) -> Features:
    """Votes and hashed counts of a slice of texts. A text without words gets no vote and no feature."""
    w = words(column)
    n = np.diff(w.first)
    some = np.maximum(n, 1)
    zero = np.zeros(len(w.data) + 1, np.int64)

    def per_word(table: np.ndarray) -> np.ndarray:
        total = zero.copy()
        np.cumsum(table[w.data], out=total[1:])
        return total[w.end] - total[w.start]

    def per_row(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[w.first[1:]] - total[w.first[:-1]]

    size = w.end - w.start
    symbols, upper, lower = per_word(_SYMBOL), per_word(_UPPER), per_word(_LOWER)
    slot = np.minimum(np.searchsorted(_STOPS, w.hash), len(_STOPS) - 1)
    stops = per_row(_STOPS[slot] == w.hash) / some
    symbolic = per_row(symbols > 0) / some
    shouted = per_row((upper > 1) & (lower == 0)) / some
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    repeated = per_row(same) / some
    bars = per_row((size == 1) & (symbols == 1)) / some
    # distinct words of each row, against what even a long prose text keeps
    pair = np.lexsort((w.hash, w.row))
    new = np.ones(len(pair), bool)
    new[1:] = (w.hash[pair][1:] != w.hash[pair][:-1]) | (w.row[pair][1:] != w.row[pair][:-1])
    distinct = per_row(new) / np.maximum(n, 1) ** 0.75
    many = n >= 10
    none = np.zeros(len(n), bool)
    votes = np.stack(
        [
            _vote(n > 0, none, symbolic > 0.2),
            _vote(n > 0, none, shouted > 0.3),
            _vote(many, (stops > 0.1) & (stops < 0.7), stops < 0.03),
            _vote(many, repeated < 0.05, repeated > 0.3),
            _vote(many, distinct > 1.0, distinct < 0.5),
            _vote(many, none, bars > 0.15),
        ],
        axis=1,
    )
    last = np.zeros(len(w.hash), np.uint64)
    for back in range(1, 3):
        at = w.end - back
        last = last * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
    shape = (
        (upper > 0) * 1 + (lower > 0) * 2 + np.minimum(symbols, 3) * 4 + np.minimum(size, 15) * 16 + same * 256
    ).astype(np.uint64)
    top = np.uint64(dimensions)
    keys = np.concatenate(
        [w.hash % top, mix(last + np.uint64(1 << 40)) % top, mix(shape + np.uint64(1 << 41)) % top]
    ).astype(np.int64)
    key, count = np.unique(np.tile(w.row, 3) * dimensions + keys, return_counts=True)
    row, bucket = key // dimensions, key % dimensions
    # logarithm of the counts, scaled to unit length, so that long texts weigh as much as short ones
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=len(column)))
    return Features(votes, n, row, bucket, value / norm[row])


def vote_table(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Votes of each labeller for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                votes = features(batch.column(1).slice(lo, hi - lo), dimensions).votes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(v, pa.int32()) for v in votes.T)],
                    names=["doc_id", *LABELLERS],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {VOTES}")


class LabelModel(NamedTuple):
    """P(good) and, for each labeller, P(vote -1, 0, 1 | bad) and P(vote | good)."""

    prior: float
    table: np.ndarray

    def logs(self, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the probability of each row's votes together with bad, and with good."""
        at, labeller = votes.astype(np.int64) + 1, np.arange(votes.shape[1])
        bad, good = (np.pad(np.log(t), ((0, 0), (0, 1)))[labeller, at].sum(1) for t in self.table)
        return bad + np.log(1 - self.prior), good + np.log(self.prior)

    def likelihood(self, votes: np.ndarray) -> np.ndarray:
        return np.logaddexp(*self.logs(votes))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        bad, good = self.logs(votes)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_labels(votes: np.ndarray, count: np.ndarray, tolerance: float = 1e-10) -> LabelModel:
    """Expectation-maximisation over vote patterns until the likelihood of a document stands still.

    It starts from the majority of the votes. ``BELIEF``, weighed as a fiftieth of the documents for each class (a quarter of
    that for the classes' shares), keeps the classes to their meaning where hardly any document belongs to one of them.
    """
    belief = np.repeat(BELIEF[:, None, :], votes.shape[1], axis=1)
    if not len(count):
        return LabelModel(0.5, belief)
    good = 1 / (1 + np.exp(-1.5 * np.where(votes == SILENT, 0, votes).sum(1)))
    extra, last = 0.02 * count.sum(), -np.inf
    while True:
        share = np.stack([1 - good, good]) * count
        table = np.stack([(share @ (votes == v)) for v in (-1, 0, 1)], axis=2) + extra * belief
        table /= table.sum(2, keepdims=True)
        prior = float((share[1].sum() + extra / 4) / (count.sum() + extra / 2))
        model = LabelModel(prior, table)
        # a bounded objective that no step lowers, so the loop ends
        gain = float(count @ model.likelihood(votes) + extra * ((belief * np.log(table)).sum() + np.log(prior * (1 - prior)) / 4))
        if gain - last <= tolerance * count.sum():
            return model
        good, last = model.posterior(votes), gain


def fit_scorer(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    """Logistic regression by mini-batch gradient steps; weights and the bias as the last entry.

    ``parts``: of each document its buckets, their values and its label in [0, 1].
    """
    weights, bias = np.zeros(dimensions), 0.0
    order = np.random.default_rng(1)
    size = np.array([len(b) for b, _, _ in parts])
    label = np.array([y for _, _, y in parts])
    bucket = np.concatenate([b for b, _, _ in parts]) if parts else np.zeros(0, int)
    value = np.concatenate([v for _, v, _ in parts]) if parts else np.zeros(0)
    at = np.concatenate([[0], np.cumsum(size)]).astype(int)
    step = 256
    epochs = max(EPOCHS, STEPS * step // max(1, len(parts)))
    for epoch in range(epochs if parts else 0):
        rate = RATE * step / 16 / (1 + 6 * epoch / epochs)
        shuffled = order.permutation(len(parts))
        for lo in range(0, len(parts), step):
            pick = shuffled[lo : lo + step]
            n = size[pick]
            own = np.repeat(np.arange(len(pick)), n)
            flat = np.repeat(at[pick] - np.cumsum(n) + n, n) + np.arange(n.sum())
            b, v = bucket[flat], value[flat]
            margin = np.bincount(own, weights[b] * v, minlength=len(pick)) + bias
            error = (label[pick] - 1 / (1 + np.exp(-margin))) / len(pick)
            weights *= 1 - rate * PENALTY
            weights += rate * np.bincount(b, error[own] * v, minlength=dimensions)
            bias += 0.1 * rate * error.sum()
    return np.append(weights, bias)


def train(
    docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS
) -> tuple[LabelModel, np.ndarray]:
    """Fit the label model on the votes of all rows and the scorer on a bounded sample.

    The driver holds at most 4^6 counted vote patterns; one task holds ``sample`` rows of at most
    ``dimensions`` features each and returns the weights.
    """
    patterns = vote_table(docs, dimensions).groupBy(*LABELLERS).agg(F.count(F.lit(1)).alias("n")).collect()
    votes = np.array([[r[x] for x in LABELLERS] for r in patterns], np.int8).reshape(-1, len(LABELLERS))
    model = fit_labels(votes, np.array([r["n"] for r in patterns], float))
    # a share of the hash range with 95 % of the bound in expectation, so that the limit hardly ever cuts
    share = min(1.0, 0.95 * sample / max(1, sum(r["n"] for r in patterns)))
    top = min(int(share * 2.0**64) - 2**63, 2**63 - 1)
    taken = docs.where(F.col("text").isNotNull() & (F.xxhash64("doc_id") <= top))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                f = features(batch.column(1).slice(lo, hi - lo), dimensions)
                y = model.posterior(f.votes)
                at = np.searchsorted(f.row, np.arange(hi - lo + 1))
                parts += [
                    (f.bucket[a:b].astype(np.int16 if dimensions <= 1 << 15 else np.int32), f.count[a:b].astype(np.float32), p)
                    for a, b, p in zip(at[:-1], at[1:], y, strict=True)
                    if b > a
                ]
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(parts, dimensions).tobytes()])], names=["weights"])

    fitted = stage(taken.select("doc_id", "text").limit(sample)).df.coalesce(1).mapInArrow(fit, "weights binary")
    rows = fitted.collect()
    return model, np.frombuffer(rows[0]["weights"]) if rows else np.zeros(dimensions + 1)


def score(column: pa.Array, weights: np.ndarray, model: LabelModel) -> tuple[np.ndarray, ...]:
    """Words, label posterior and score of a slice of texts; the score of a text without words is 0."""
    rows = len(column)
    f = features(column, len(weights) - 1)
    margin = np.bincount(f.row, weights[f.bucket] * f.count, minlength=rows) + weights[-1]
    value = np.where(f.n_words > 0, 1 / (1 + np.exp(-np.clip(margin, -500, 500))), 0.0)
    return f.n_words, model.posterior(f.votes), value


def classify(
    docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, text) rows with the label model's ``posterior``, the scorer's ``score`` and ``kept``.

    Null, empty and blank texts have no features: they score 0 and are not kept. Repeated rows are judged
    alike, each for itself; a null doc_id is carried; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model, weights = train(docs, sample, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                n, posterior, value = score(batch.column(1).slice(lo, hi - lo), weights, model)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n, pa.int64()),
                        pa.array(posterior),
                        pa.array(value),
                        pa.array((value >= threshold) & (n > 0)),
                    ],
                    names=["doc_id", "n_words", "posterior", "score", "kept"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, posterior double, score double, kept boolean")


def good_documents(
    docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns and without a join."""
    model, weights = train(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sample, dimensions)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                n, _, value = score(part.column(at), weights, model)
                yield part.filter(pa.array((value >= threshold) & (n > 0)))

    return docs.mapInArrow(run, docs.schema)
