"""Quality rules: fixed limits, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, doc_stats

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 48, 10, 1.0
#: Features along which the score may only fall (-1): more symbols, shouting, doubled lines or repeats never help.
FALLING = ("symbols", "marks", "dup_lines", "repeat_words", "same_as_before")
MIN_WORDS, MOST_REPEATS = 50, 50


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays. A leaf points at itself, so every row takes `depth` steps in every tree."""

    feature: np.ndarray
    limit: np.ndarray  # to the left up to and including
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, signs: Sequence[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Second-order boosting of the log loss over binned features.

    A split along a feature with sign s must give its right child a value that is not against s of the left one's, and
    the children's own subtrees stay on their side of the mean of the two values: so every tree, and their sum, is
    monotone. With one label only, or none, there are no trees and the score is that label's share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, limit, left, right, value
    roots: list[int] = []
    if len(np.unique(y)) < 2:
        nodes, roots, trees = [[0, 0.0, 0, 0, 0.0]], [0], 0
    p = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(p)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, p), dtype=np.int64)
    margin = np.full(len(x), base)

    def grow(rows: np.ndarray, low: float, high: float, level: int, g: np.ndarray, h: np.ndarray) -> int:
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([0, 0.0, at, at, float(np.clip(-total_g / (total_h + RIDGE), low, high)) * rate])
        best = (1e-6, None)
        for j in range(p if level < depth and len(rows) >= 2 * LEAST else 0):
            k = len(edges[j])
            if not k:
                continue
            own = codes[rows, j]
            left_g, left_h, left_n = (np.bincount(own, w, k + 1)[:-1].cumsum() for w in (g[rows], h[rows], None))
            v_left = np.clip(-left_g / (left_h + RIDGE), low, high)
            v_right = np.clip(-(total_g - left_g) / (total_h - left_h + RIDGE), low, high)
            # loss of a constant v over a side: g v + (h + ridge) v^2 / 2
            side = lambda v, a, b: -(a * v + 0.5 * (b + RIDGE) * v * v)
            v_all = np.clip(-total_g / (total_h + RIDGE), low, high)
            gain = side(v_left, left_g, left_h) + side(v_right, total_g - left_g, total_h - left_h) - side(v_all, total_g, total_h)
            gain[(left_n < LEAST) | (len(rows) - left_n < LEAST) | (signs[j] * (v_right - v_left) < 0)] = -np.inf
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (j, c, v_left[c], v_right[c]))
        if best[1] is not None:
            j, c, v_left, v_right = best[1]
            middle, to_left = (v_left + v_right) / 2, codes[rows, j] <= c
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            left = grow(rows[to_left], *bounds[0], level + 1, g, h)
            right = grow(rows[~to_left], *bounds[1], level + 1, g, h)
            nodes[at][:4] = [j, float(edges[j][c]), left, right]
        else:
            margin[rows] += nodes[at][4]
        return at

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), -4.0, 4.0, 0, chance - y, np.maximum(chance * (1 - chance), 1e-6)))
    for at, node in enumerate(nodes):  # only leaves have values
        node[4] = node[4] if node[2] == at else 0.0
    feature, limit, left, right, value = zip(*nodes, strict=True)
    return Trees(np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on at most `sample` labelled documents, picked by a hash of their ids."""
    x, y, _ = doc_stats.learn_from(common.labelled_sample(docs, labels, label, F.lit(True) if train is None else train, sample))
    return fit(x, y, [-1 if f in FALLING else 0 for f in doc_stats.FEATURES])


def apply_rules(docs: DataFrame, model: Trees) -> DataFrame:
    """The counts, whether the fixed limits fail, and whether the document is kept.

    A null text has no words and fails. Repeated rows stay; an empty table gives an empty result; columns but doc_id
    and text are not read.
    """

    def make() -> Callable:
        def rows(batch):
            base, x = doc_stats.table(batch)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MOST_REPEATS * base[:, 0])
            score = model.score(x)
            return {"doc_id": batch.column(0)} | {n: base[:, k] for k, n in enumerate(doc_stats.BASE)} | {"base_failed": failed, "kept": ~failed & (score >= 0.5), "score": score}

        return rows

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in doc_stats.BASE) + ", base_failed boolean, kept boolean, score double"
    return common.map_texts(docs, [common.doc_id(), "text"], schema, make)
