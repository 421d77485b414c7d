"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every tree is a full binary tree in arrays, so all documents of a batch walk down it together in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_bucket, kind, map_batches, table, texts

#: Labelled rows that the trees are fitted on, at most about this many, drawn by hash of the id.
TRAINING_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digits", "spaces", "high_bytes", "sentence_marks", "brackets",
    "code_marks", "odd_marks", "quotes_dashes", "distinct_words", "distinct_lines", "log_lines", "top_word", "ended_lines",
)

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b".,;:!?", b"()[]{}", b"#*$%&|<>", b"@^~`\\=+_/", b"\"'-"]
_MEMBERS = np.array([[b in c for b in range(256)] for c in _CLASSES], np.float64).T


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w, k = len(raw), len(words), len(lines)
    shares = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _MEMBERS / n).tolist() if n else [0.0] * len(_CLASSES)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    ended = sum(x.rstrip()[-1:] in b".!?:" for x in lines)
    return [
        np.log1p(n), np.log1p(w), n / w if w else 0.0, *shares,
        len(counts) / w if w else 0.0, len(set(lines)) / k if k else 0.0, np.log1p(k), max(counts.values()) / w if w else 0.0, ended / k if k else 0.0,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and features, an array of doubles in the order of FEATURES, of every whole text; null counts as empty."""

    def work(batch: pa.RecordBatch):
        rows = [statistics(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind(docs, 'doc_id')}, features array<double>")


@dataclass
class Trees:
    """feature and threshold: one row for each tree, one column for each inner node, level by level; leaf: its leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least_hessian: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boost trees on the logistic loss with histograms of gradients over at most ``bins`` quantile bins a feature.

    Without rows, or with one label only, there are no trees and every score is the share of label 1 (0.5 without rows).
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base, inner, n_features = float(np.log(share / (1 - share))), 2**depth - 1, x.shape[1]
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    features, thresholds, leaves, total = [], [], [], np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            place = at - first
            cut = np.zeros(width, np.int64) + bins
            for j in range(n_features):
                key = place * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
                gain[(hs < least_hessian) | (h_all - hs < least_hessian)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                cut = np.where(better, k, cut)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
            for i in range(width):
                if cut[i] < bins:
                    threshold[first + i] = edges[feature[first + i]][cut[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[leaf]
        features.append(feature), thresholds.append(threshold), leaves.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def training_sample(features: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """features and quality of the labelled rows, at most about ``max_rows``, however labels and documents repeat.

    Rows that agree in id, features and label are one. The bound holds for what is left: rows are drawn by their hash.
    """
    labelled = labels.where("quality IN (0, 1)").select("doc_id", "quality").distinct()
    n = labelled.count()
    # a first draw by id keeps the join small; with ids told once it is the final one
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20))) if n > max_rows else labelled
    rows = durable(features.join(drawn, "doc_id").select("doc_id", "features", "quality").distinct())
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "features", "quality"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    return rows.select("features", "quality")


def fit_quality(features: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> Trees:
    """Fit on the rows of ``features`` that ``labels`` (doc_id, quality 0 or 1) covers, at most about ``max_rows``.

    Null labels and null ids teach nothing; a document with several labels is a row for each; rows that repeat teach once.
    """
    rows = training_sample(features, labels, max_rows).toPandas()
    x = np.array(rows["features"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["quality"].to_numpy()))  # the order of rows from Spark must not matter
    return fit_trees(x[order], rows["quality"].to_numpy(np.float64)[order])


def score_quality(features: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (0 to 1, probability of label 1) and predicted (1 if score >= 0.5) of each row of features.

    Empty and null texts have features, all 0, and so a score. Repeated rows are scored alike; an empty table gives an
    empty result.
    """

    def work(batch: pa.RecordBatch):
        x = np.array(batch.column("features").to_pylist(), np.float64).reshape(batch.num_rows, len(FEATURES))
        score = trees.score(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(features, work, f"doc_id {kind(features, 'doc_id')}, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    features = durable(document_statistics(docs))
    trees = fit_quality(features, labels.where(id_bucket("doc_id", 3) != 1))
    return score_quality(features, trees).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
