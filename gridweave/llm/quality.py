"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, doc_stats

#: Labelled documents that a classifier learns from at most.
SAMPLE = 20_000
#: Shares of the pooled covariance, and of a multiple of the identity, that are tried.
POOLED, ROUND = (0.05, 0.25, 0.5, 1.0), (0.01, 0.05, 0.2)
#: Statistics count up to so many standard deviations from the mean.
CLIP = 6.0


@dataclass(frozen=True)
class Discriminant:
    """Two normal densities over standardised statistics; `whiten` are the inverses of their covariances' Cholesky factors."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray  # (2, p)
    whiten: np.ndarray  # (2, p, p), lower triangles
    offset: np.ndarray  # log prior - log |Cholesky factor|
    settings: tuple[float, float] = (0.0, 0.0)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -CLIP, CLIP)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, priors included."""
        z = self.standard(x)
        logs = [self.offset[c] - 0.5 * np.square((z - self.centres[c]) @ self.whiten[c].T).sum(axis=1) for c in (0, 1)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def fit_once(x: np.ndarray, y: np.ndarray, pooled: float, round_: float) -> Discriminant:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -CLIP, CLIP)
    p = z.shape[1]
    centres = np.stack([z[y == c].mean(axis=0) for c in (0, 1)])
    each = [(z[y == c] - centres[c]).T @ (z[y == c] - centres[c]) for c in (0, 1)]
    counts = [int((y == c).sum()) for c in (0, 1)]
    common_ = (each[0] + each[1]) / max(1, len(y) - 2)
    whiten, offset = [], []
    for c in (0, 1):
        own = (1 - pooled) * each[c] / max(1, counts[c] - 1) + pooled * common_
        own = (1 - round_) * own + round_ * max(np.trace(own) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        offset.append(np.log(counts[c] / len(y)) - np.log(np.diag(factor)).sum())
    return Discriminant(mean, scale, centres, np.stack(whiten), np.array(offset), (pooled, round_))


def fit(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> Discriminant:
    """Choose the shrinkage by the log loss of four folds, by id, and fit with it on all rows.

    With one label only, or none, every score is that label's share (a half without rows).
    """
    if len(np.unique(y)) < 2 or min(np.bincount(y, minlength=2)) < 2:
        p = x.shape[1]
        odds = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), np.zeros((2, p, p)), np.array([0.0, odds]))
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % 4 for i in ids])

    def loss(pooled: float, round_: float) -> float:
        total = 0.0
        for k in range(4):
            own, rest = fold == k, fold != k
            if own.any() and min(np.bincount(y[rest], minlength=2)) >= 2:
                odds = fit_once(x[rest], y[rest], pooled, round_).log_odds(x[own])
                total += np.logaddexp(0, np.where(y[own] == 1, -odds, odds)).sum()
        return total

    return fit_once(x, y, *min(((a, b) for a in POOLED for b in ROUND), key=lambda s: (loss(*s), s)))


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> Discriminant:
    """Fit on at most `sample` labelled documents, picked by a hash of their ids; `train` says which ids may be used."""
    return fit(*doc_stats.learn_from(common.labelled_sample(docs, labels, label, F.lit(True) if train is None else train, sample)))


def classify(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of every document. A null text is the empty text, whose statistics are all 0.

    The score depends on the text alone, so equal texts have equal scores; repeated rows stay, an empty table gives an
    empty result, and columns but doc_id and text are not read.
    """

    def make() -> Callable:
        def rows(batch):
            score = model.score(doc_stats.table(batch)[1])
            return {"doc_id": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return rows

    return common.map_texts(docs, [common.doc_id(), "text"], "doc_id long, score double, predicted int", make)


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    kind = docs.schema

    def run(batches):
        for part in common.text_slices(batches):
            yield part.filter(model.score(doc_stats.table(part)[1]) >= 0.5)

    return docs.mapInArrow(run, kind)
