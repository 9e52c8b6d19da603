"""Operator 10: a quality classifier by regularised quadratic discriminant.

Documents become a vector of transformed statistics.  Each class is a Gaussian
whose covariance is shrunk towards the pooled one and towards its diagonal; a
score is the logistic function of the difference of Mahalanobis log densities,
by Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.threads import one_thread
from . import quality_rules, shared, textbatch

FEATURES = (
    "log_words", "log_word_length", "capitals", "digits", "symbols", "bars", "calls", "stops", "other_marks",
    "same_word", "repeat_words", "distinct_words", "log_line_words", "single_points", "loud_words",
)
#: Words (and a fifth of the code points) that every document is taken to have besides its own, so that shares of short texts are near 0.
SHRINK = 50


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each document of a chunk: logarithms of sizes, and shares p as asin(sqrt(p))."""
    docs = len(offsets) - 1
    starts, ends, doc = textbatch.blank_words(data, offsets)
    lead = (data & 0xC0) != 0x80
    points = np.append(0, np.cumsum(lead))
    length = points[ends] - points[starts]
    of_byte = np.repeat(np.arange(docs), np.diff(offsets))

    def marked(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of_byte[flags], minlength=docs).astype(float)

    def kinds(chars: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars)] = True
        return table[data]

    capital = (data >= 0x41) & (data <= 0x5A)
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)  # U+00C0 to U+00DE
    small = (data >= 0x61) & (data <= 0x7A)
    small[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7)
    word = textbatch.word_hashes(data, starts, ends)
    words = np.bincount(doc, minlength=docs).astype(float)
    per_word = lambda flags: np.bincount(doc[flags], minlength=docs) / (words + SHRINK)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    _, _, first = textbatch.distinct(textbatch._mixed(word + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    at, h = quality_rules._windows(word, doc, 3)
    later = np.ones(len(at), bool)
    later[textbatch.distinct(h)[2]] = False
    again = quality_rules._covered(at[later], 3, len(word))
    loud_letters = np.append(0, np.cumsum(capital))
    small_letters = np.append(0, np.cumsum(small))
    loud = (loud_letters[ends] - loud_letters[starts] >= 2) & (small_letters[ends] == small_letters[starts])
    solid = np.bincount(doc, length, docs) + 5 * SHRINK
    letters = marked(capital) + marked(small) + 5 * SHRINK
    lines = marked(data == 0x0A) + 1
    share = lambda p: np.arcsin(np.sqrt(np.clip(p, 0, 1)))
    unique = np.zeros(len(word), bool)
    unique[first] = True
    return np.stack([
        np.log1p(words), np.log1p(np.bincount(doc, length, docs) / np.maximum(words, 1)), share(marked(capital) / letters), share(marked(kinds(b"0123456789")) / solid),
        share(marked(kinds(b"#*$%&<>")) / solid), share(marked(kinds(b"|")) / solid), share(marked(kinds(b"!?")) / solid), share(marked(kinds(b".,;:")) / solid),
        share(marked(kinds(b"\"'()[]{}/\\_-+=~^@`")) / solid), share(per_word(same)), share(per_word(again)), share(per_word(unique)), np.log1p(words / lines),
        share(per_word(length == 1)), share(per_word(loud)),
    ], axis=1)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): a row for each row; null and empty texts have the vector of no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in textbatch.chunks(batches, "_text"):
            x = features(data, offsets)
            yield shared.rows(schema, batch.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())))

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes, and the log of the prior odds of class 1."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.factor[k].T
            density.append(-0.5 * ((z * z).sum(axis=1) + self.log_det[k]))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def solve(n: np.ndarray, total: np.ndarray, square: np.ndarray, *, to_pooled: float, to_diagonal: float, floor: float) -> Discriminant:
    """The discriminant of two classes from their counts, sums and sums of products; a class without rows has the other's shape."""
    mean = np.stack([total[k] / n[k] if n[k] else total[1 - k] / max(n[1 - k], 1) for k in (0, 1)])
    scatter = np.stack([square[k] - n[k] * np.outer(mean[k], mean[k]) if n[k] else np.zeros_like(square[k]) for k in (0, 1)])
    pooled = scatter.sum(axis=0) / max(n.sum(), 1)
    factor, log_det = [], []
    for k in (0, 1):
        own = scatter[k] / n[k] if n[k] else pooled
        c = (1 - to_pooled) * own + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(low))
        log_det.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.stack(factor), np.array(log_det), float(np.log(n[1] + 1) - np.log(n[0] + 1)))


def fit(features_: DataFrame, labels: DataFrame, *, to_pooled: float = 0.3, to_diagonal: float = 0.1, floor: float = 3e-3) -> Discriminant:
    """Fits to (doc_id, x) and (doc_id, label 0 or 1), over all labelled rows: each task has a row of sums, and Spark adds them place by place."""
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, d)
            for k in (0, 1):
                one = x[label == k]
                n[k] += len(one)
                total[k] += one.sum(axis=0)
                square[k] += one.T @ one
        if n.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 + 2 * d + 2 * d * d)), pa.array(np.concatenate([n, total.ravel(), square.ravel()]))], ["place", "sum"])

    labelled = features_.join(labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)"), "doc_id").select("x", "label")
    found = labelled.mapInArrow(sums, "place long, sum double").groupBy("place").agg(F.sum("sum").alias("sum")).collect()  # 2 + 2 d + 2 d^2 rows
    whole = np.zeros(2 + 2 * d + 2 * d * d)
    for r in found:
        whole[r["place"]] = r["sum"]
    return solve(whole[:2], whole[2 : 2 + 2 * d].reshape(2, d), whole[2 + 2 * d :].reshape(2, d, d), to_pooled=to_pooled, to_diagonal=to_diagonal, floor=floor)


def score(features_: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            yield shared.rows(schema, batch.column(0), model.scores(np.asarray(batch.column(1).flatten(), float).reshape(-1, d)))

    return features_.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out(name: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0


def learned_from(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows that aren't held out."""
    return labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(~held_out())


def keep(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score the threshold or more, with all their columns; learns as ``classify``."""
    model = fit(document_features(docs, id_col, text_col), learned_from(labels, label_col, id_col))
    return shared.filtered(docs, text_col, lambda data, offsets: model.scores(features(data, offsets)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents.

    Learns from the labels of rows that aren't held out; null labels and labels
    other than 0 and 1 are left out, repeated labels count each.  Null and empty
    texts are scored by the vector of no words; without labels all scores are 0.5.
    """
    x = shared.written(document_features(docs, id_col, text_col), "features")
    scored = score(x, fit(x, learned_from(labels, label_col, id_col)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
