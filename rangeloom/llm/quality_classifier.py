"""Quality by naive Bayes support vectors.

A document's features are indicators of n-grams, hashed into 2**BITS columns: words, and one to
three neighbouring word shapes (case, letters, digits, last character, same word as before). Each
indicator is scaled by the log-count ratio of the two classes, the row is brought to unit length,
and a linear hinge-loss model is fitted by dual coordinate descent. A logistic fit on labelled
documents that the descent has not seen maps the margin to 0..1.

Null and empty texts have no features; their margin is the intercept. Without labels of both
classes every margin is 0. Every row is scored by its own text: rows that repeat a doc_id or have none
get scores of their own, equal texts equal ones; a null doc_id counts as the empty text for the
held-out rule. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import bounded_labels, crc_of_id, fitted_logistic, written

BITS = 18
#: Labelled documents of each class that a fit reads at most.
PER_CLASS = 5_000
CALIBRATION, EPOCHS, COST = 20, 8, 1.0
THRESHOLD = 0.3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> int:
    """A code below 64 for the case, letters, digits and last character of a word."""
    case = 2 if word.isupper() and len(word) > 1 else int(word[:1].isupper())
    last = word[-1]
    end = 0 if last.isalnum() else 1 if last in ".," else 2 if last in "!?" else 3 if last == "|" else 4
    return (case * 2 + any(c.isalpha() for c in word)) * 2 + any(c.isdigit() for c in word) + 12 * end


class Features:
    """Column numbers of a text's n-grams; keeps the codes of words it has met."""

    def __init__(self, bits: int = BITS, limit: int = 400_000) -> None:
        self.bits, self.limit, self.known = bits, limit, {}

    def _hashed(self, x: np.ndarray, salt: int) -> np.ndarray:
        x = (x.astype(np.uint64) + np.uint64(salt)) * _MULTIPLIER
        x ^= x >> np.uint64(29)
        return ((x * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, text: str | None) -> np.ndarray:
        """Distinct column numbers, ascending."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = (xxhash.xxh3_64_intdigest(w.lower().encode("utf-8", "surrogatepass")) >> 8) << 7 | shape(w)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        word = codes >> 7
        s = (codes & 127) * 2
        s[1:] += word[1:] == word[:-1]
        parts = [self._hashed(s, 1), self._hashed(word, 2)]
        if len(s) > 1:
            parts.append(self._hashed(s[1:] * 128 + s[:-1], 3))
        if len(s) > 2:
            parts.append(self._hashed((s[2:] * 128 + s[1:-1]) * 128 + s[:-2], 4))
        return np.unique(np.concatenate(parts))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """Per column, the log of its smoothed share in class 1 over that in class 0."""
    good, bad = np.ones(width), np.ones(width)
    for row, label in zip(rows, y, strict=True):
        (good if label > 0 else bad)[row] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def unit(values: np.ndarray) -> np.ndarray:
    return values / max(1e-9, float(np.sqrt(values @ values)))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the hinge-loss model on unit rows of scaled indicators."""
    weights, intercept, dual = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    values = [unit(r[x]) for x in rows]
    share = {label: max(1, int((y == label).sum())) for label in (-1, 1)}
    most = [cost * len(rows) / (2 * share[label]) for label in y]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (weights[x] @ v + intercept) - 1
            moved = min(max(dual[i] - gradient / (1 + (len(x) > 0)), 0.0), most[i])
            if step := (moved - dual[i]) * y[i]:
                weights[x] += step * v
                intercept += step
                dual[i] = moved
    return weights, intercept


class Model:
    """Scaled weights of the columns, the intercept and the logistic map."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, intercept: float, slope: float, shift: float) -> None:
        self.ratios, self.weights, self.intercept, self.slope, self.shift = ratios, weights, intercept, slope, shift

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns] @ unit(self.ratios[columns])) + self.intercept

    def score(self, columns: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(columns) + self.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> Model:
    """Fits on ``labels(doc_id, quality)`` of ``docs(doc_id, text)``.

    The labelled rows are bounded by ``per_class``; one task fits on their features and sends back
    2**bits weights.
    """
    width = 1 << bits
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = written(bounded_labels(labels, "quality", per_class), "quality-labels")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            rows = [features.of(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("turn"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "label", "turn", "columns"])

    def learn(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("doc_id", kind="stable")
        y = np.where(found["label"] != 0, 1, -1)
        own = (found["turn"] >= CALIBRATION).to_numpy()
        rows = [np.asarray(x, np.int64) for x in found["columns"]]
        train = [x for x, t in zip(rows, own, strict=True) if t]
        if len(set(y[own])) < 2:
            return pd.DataFrame({"ratios": [np.zeros(width)], "weights": [np.zeros(width)], "intercept": [0.0], "slope": [1.0], "shift": [0.0]})
        ratios = log_count_ratios(train, y[own], width)
        weights, intercept = dual_descent(train, y[own], ratios)
        model = Model(ratios, weights, intercept, 2.0, 0.0)
        z = [model.margin(x) for x, t in zip(rows, own, strict=True) if not t]
        slope, shift = fitted_logistic(z, [int(v > 0) for v in y[~own]], (2.0, 0.0))
        return pd.DataFrame({"ratios": [ratios], "weights": [weights], "intercept": [intercept], "slope": [slope], "shift": [shift]})

    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "turn", "text").mapInArrow(read, "doc_id long, label int, turn int, columns array<int>")
    found = rows.groupBy().applyInPandas(learn, "ratios array<double>, weights array<double>, intercept double, slope double, shift double").collect()
    if not found:
        return Model(np.zeros(width), np.zeros(width), 0.0, 1.0, 0.0)
    f = found[0]
    return Model(np.asarray(f["ratios"]), np.asarray(f["weights"]), f["intercept"], f["slope"], f["shift"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(int(np.log2(len(shared.value.ratios))))
        for batch in batches:
            scores = [shared.value.score(features.of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    """True for the rows whose labels no fit may see."""
    return F.pmod(crc_of_id(), F.lit(5)) == 0
