"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

The ratios come from counts over a sample of labelled training documents of bounded size
(``MAX_LABELLED``, all of them below that); the features with the most evidence are kept.
Logistic regression on presence times ratio is fitted on a smaller one (``MAX_TRAIN``). Both are
chosen by a hash of the id from the labels alone, and only ids are sent to the tasks: no text
is shuffled. Scores read whole texts.

A null or empty text has no features, so its score is that of the bias. Without labelled rows,
or with one class only, the score is the share of label 1 (0 without rows). Labels may repeat a
doc_id: then 1 wins. Repeated documents count as often as they stand. Columns beside text and id
are never read; columns named ``score`` and ``predicted`` are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusctx.llm.arrow import byte_view, column_udf, releasing
from corpusctx.llm.bounded import hashed_sample
from corpusctx.sources.scratch import materialize

ORDERS = (3, 4, 5)
BITS = 18
FEATURES = 1 << 13
#: Features whose log-likelihood ratio stays below this are noise at the size of the table.
LEAST_EVIDENCE = 10.0
#: Most labelled ids whose documents are counted for the ratios, chosen by a hash of the id.
MAX_LABELLED = 1 << 15
#: Most labelled ids whose documents the regression is fitted on, a part of the former.
MAX_TRAIN = 8192
THRESHOLD = 0.3
_ROUNDS, _RATE, _PENALTY, _SMOOTHING = 120, 0.5, 1e-4, 1.0
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(data):
    """Hashed n-grams of one text's bytes, ASCII letters in lower case; repeats included."""
    low, out = _LOWER[data] + np.uint32(1), []
    for n in ORDERS:
        if len(low) >= n:
            h = np.full(len(low) - n + 1, n, np.uint32)
            for k in range(n):
                h += low[k : len(low) - n + 1 + k] * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _texts(array):
    data, offsets = byte_view(array)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def _present(data, wanted):
    """Distinct wanted features of a text, a piece at a time so long texts stay bounded."""
    found = np.zeros(0, np.uint32)
    step, overlap = 1 << 20, max(ORDERS) - 1
    for at in range(0, max(len(data), 1), step):
        own = grams(data[at : at + step + overlap])
        found = np.unique(np.concatenate([found, own[wanted[own]]]))
    return found


def gram_counts(labelled):
    """(feature, positive, negative): documents of each class that hold a feature; feature -1 counts documents."""

    def run(batches):
        counts, totals, every = np.zeros((2, 1 << BITS), np.int64), [0, 0], np.ones(1 << BITS, bool)
        for batch in batches:
            for text, label in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
                counts[label][_present(text, every)] += 1
                totals[label] += 1
        seen = np.flatnonzero(counts.sum(axis=0))
        rows = [np.append(seen, -1), np.append(counts[1][seen], totals[1]), np.append(counts[0][seen], totals[0])]
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["feature", "positive", "negative"])

    found = labelled.select("text", "label").mapInArrow(releasing(run), "feature long, positive long, negative long")
    return found.groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


class Model:
    """Bias and one weight per kept feature; everything else weighs nothing."""

    def __init__(self, features, weights, bias):
        self.features, self.weights, self.bias = np.asarray(features, np.uint32), np.asarray(weights, np.float64), float(bias)

    def tables(self):
        wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[self.features] = True
        weight[self.features] = self.weights
        return wanted, weight

    def column(self, text):
        """Probability of label 1 of a text column."""

        def prepare():
            wanted, weight = self.tables()

            def run(texts):
                odds = [weight[_present(t, wanted)].sum() + self.bias for t in _texts(texts)]
                return pa.array(1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -500, 500))), pa.float64())

            return run

        return column_udf(prepare, "double")(text)


def _evidence(positive, negative, n_pos, n_neg):
    """Log-likelihood ratio statistic of presence against class."""

    def term(seen, n, share):
        rate = seen / n
        return seen * np.log(np.maximum(rate, 1e-12) / share) + (n - seen) * np.log(np.maximum(1 - rate, 1e-12) / np.maximum(1 - share, 1e-12))

    share = (positive + negative) / (n_pos + n_neg)
    return term(positive, n_pos, share) + term(negative, n_neg, share)


def _regress(rows, labels, scale, prior):
    """Weights and bias by gradient steps with a rate of its own per weight; ``rows``: feature numbers of each document."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), sizes)
    weights, bias = np.zeros(len(scale)), np.log(prior / (1 - prior))
    seen, seen_bias = np.full(len(scale), 1e-6), 1e-6
    for _ in range(_ROUNDS):
        odds = np.bincount(doc, (weights * scale)[flat], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels
        slope = np.bincount(flat, error[doc], len(scale)) * scale / len(rows) + _PENALTY * weights
        seen += slope**2
        weights -= _RATE * slope / np.sqrt(seen)
        seen_bias += error.mean() ** 2
        bias -= _RATE * error.mean() / np.sqrt(seen_bias)
    return weights * scale, bias


def fit(docs, labels, label_col="toxic", text_col="text", id_col="doc_id", max_train=MAX_TRAIN, max_labelled=MAX_LABELLED):
    """Model of the labelled rows of ``docs``; pass only the documents that may be learned from."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialize(hashed_sample(marks, max_labelled), "labelled")
    # The driver holds one row per feature at most, and the bounded samples.
    counts = gram_counts(texts.join(F.broadcast(marks), "doc_id")).toPandas()  # max_labelled rows
    total = counts[counts.feature == -1]
    n_pos, n_neg = int(total.positive.sum()), int(total.negative.sum())
    if not n_pos or not n_neg:
        odds = 500.0 if n_pos else -500.0
        return Model([], [], odds)
    counts = counts[counts.feature >= 0].sort_values("feature")
    positive, negative = counts.positive.to_numpy(float), counts.negative.to_numpy(float)
    strength = _evidence(positive, negative, n_pos, n_neg)
    kept = np.argsort(-strength, kind="stable")[:FEATURES]
    kept = np.sort(kept[strength[kept] >= LEAST_EVIDENCE])
    features, positive, negative = counts.feature.to_numpy()[kept], positive[kept], negative[kept]
    ratio = np.log((positive + _SMOOTHING) / (n_pos + 2 * _SMOOTHING)) - np.log((negative + _SMOOTHING) / (n_neg + 2 * _SMOOTHING))
    number = np.zeros(1 << BITS, np.int32)
    number[features] = np.arange(len(features))

    def prepare():
        wanted = np.zeros(1 << BITS, bool)
        wanted[features] = True
        return lambda array: pa.array([number[_present(t, wanted)].tobytes() for t in _texts(array)], pa.binary())

    sample = texts.join(F.broadcast(hashed_sample(marks, max_train)), "doc_id")  # max_train rows
    sample = sample.select("label", column_udf(prepare, "binary")(F.col("text")).alias("present")).toPandas()
    rows = [np.frombuffer(b, np.int32).astype(np.int64) for b in sample.present]
    weights, bias = _regress(rows, sample.label.to_numpy(float), ratio, n_pos / (n_pos + n_neg))
    return Model(features, weights, bias)


def score(docs, model, text_col="text"):
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    scored = docs.withColumn("score", model.column(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
