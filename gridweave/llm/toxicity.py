"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins two vectors: one of the word, and the mean of those of its character runs, so that a form that was
never seen still shares the runs of a known stem. The network reads windows of words that overlap; a document's logit is
the largest of its windows'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each label that the network learns from at most.
SAMPLE = {1: 800, 0: 1200}
WINDOW, STRIDE = 32, 24
BUCKETS, EMBED, HIDDEN = 8192, 12, 8
STEPS, WARM, BATCH, RATE = 320, 120, 128, 0.01
#: Words whose projections a worker keeps; it starts afresh beyond.
REMEMBERED = 150_000
BLOCK = 2048
EDGES = b".,;:!?*#$%&|\"'()[]<>"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the bucket of its core, and the buckets of its runs of three and four bytes, all words' one after another, with where each word's begin."""
    cores = [b"<" + (w.strip(EDGES) or w) + b">" for w in words]
    text = np.frombuffer(b"".join(cores) + bytes(4), dtype="u1").astype(np.uint64)
    lengths = np.fromiter(map(len, cores), dtype=np.int64, count=len(cores))
    ends = np.cumsum(lengths)
    three = text[:-4] | text[1:-3] << np.uint64(8) | text[2:-2] << np.uint64(16)
    four = three | text[3:-1] << np.uint64(24) | np.uint64(1 << 32)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS
    word = np.repeat(np.arange(len(cores)), lengths)
    left = ends[word] - np.arange(len(word))
    runs = np.stack([mix(three), mix(four)], axis=1)
    valid = np.stack([left >= 3, left >= 4], axis=1)
    counts = np.add.reduceat(valid.sum(axis=1), ends - lengths) if len(cores) else np.zeros(0, dtype=np.int64)
    total = np.zeros(len(cores), dtype=np.uint64)
    if len(cores):
        place = (np.arange(len(word)) - (ends - lengths)[word]).astype(np.uint64)
        total = np.add.reduceat((text[:-4] + np.uint64(1)) * (place * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)), ends - lengths)
    return mix(total), runs[valid], np.cumsum(counts) - counts


def run_means(table: np.ndarray, runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(starts, len(runs)))[:, None]
    return np.add.reduceat(table[runs], starts, axis=0) / counts


@dataclass
class Network:
    chars: np.ndarray
    words: np.ndarray
    inputs: np.ndarray  # (2, 2 EMBED, 3 HIDDEN): for the two directions; update, reset, candidate
    bias: np.ndarray  # (2, 3 HIDDEN)
    state: np.ndarray  # (2, HIDDEN, 3 HIDDEN)
    look: np.ndarray  # (2 HIDDEN,)
    out: np.ndarray  # (2 HIDDEN,)
    shift: np.ndarray  # (1,)

    NAMES = ("chars", "words", "inputs", "bias", "state", "look", "out", "shift")

    @classmethod
    def fresh(cls, seed: int, shift: float) -> Network:
        r = np.random.default_rng(seed)
        some = lambda size, *shape: r.normal(0, size, shape).astype(np.float32)
        e, h = EMBED, HIDDEN
        return cls(some(0.3, BUCKETS, e), some(0.1, BUCKETS, e), some(0.3, 2, 2 * e, 3 * h), np.zeros((2, 3 * h), np.float32), some(0.3, 2, h, 3 * h), some(0.5, 2 * h), some(0.5, 2 * h), np.array([shift], np.float32))

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        own, runs, starts = word_inputs(words)
        return np.concatenate([run_means(self.chars, runs, starts), self.words[own]], axis=1), (own, runs, starts)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.matmul(x, self.inputs) + self.bias[:, None]

    def project_words(self, words: list[bytes], chunk: int = 20_000) -> np.ndarray:
        """Projections of many words, some at a time: their character runs take much more room than the result."""
        return np.concatenate([self.project(self.embed(words[i : i + chunk])[0]) for i in range(0, len(words), chunk)], axis=1)

    def read(self, projected: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of windows (rows of word numbers), the states and the attention. Both directions take a step at a time."""
        n, length = index.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((n, length, 2 * HIDDEN), np.float32)
        for t in range(length):
            back = length - 1 - t
            x = np.stack([projected[0][index[:, t]], projected[1][index[:, back]]])
            m = np.stack([mask[:, t], mask[:, back]])[:, :, None]
            g = np.matmul(h, self.state)
            gate = sigmoid(x[..., : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = gate[..., :HIDDEN], gate[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            if keep is not None:
                keep.append((h, z, r, c, g[..., 2 * HIDDEN :], m))
            h = (c + z * (h - c)) * m
            states[:, t, :HIDDEN], states[:, back, HIDDEN:] = h
        weight = np.where(mask > 0, states @ self.look, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        return np.matmul(weight[:, None], states)[:, 0] @ self.out + self.shift[0], states, weight

    def gradients(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, target: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss of the windows."""
        x, (own, runs, starts) = self.embed(words)
        steps: list = []
        logits, states, attention = self.read(self.project(x), index, mask, steps)
        d = ((sigmoid(logits) - target) * weights).astype(np.float32)
        pooled = np.matmul(attention[:, None], states)[:, 0]
        d_pooled = d[:, None] * self.out
        d_attention = np.matmul(states, d_pooled[:, :, None])[:, :, 0]
        d_weight = attention * (d_attention - (attention * d_attention).sum(axis=1, keepdims=True))
        d_states = attention[:, :, None] * d_pooled[:, None] + d_weight[:, :, None] * self.look
        got = {"out": pooled.T @ d, "shift": np.array([d.sum()]), "look": np.einsum("nt,nth->h", d_weight, states), "state": np.zeros_like(self.state)}
        n, length = index.shape
        carried = np.zeros((2, n, HIDDEN), np.float32)
        d_steps = np.empty((length, 2, n, 3 * HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            before, z, r, c, g, m = steps[t]
            dh = (carried + np.stack([d_states[:, t, :HIDDEN], d_states[:, length - 1 - t, HIDDEN:]])) * m
            dc = dh * (1 - z) * (1 - c * c)
            dz, dr = dh * (before - c) * z * (1 - z), dc * g * r * (1 - r)
            d_steps[t] = np.concatenate([dz, dr, dc], axis=-1)
            dg = np.concatenate([dz, dr, dc * r], axis=-1)
            got["state"] += np.matmul(before.transpose(0, 2, 1), dg)
            carried = dh * z + np.matmul(dg, self.state.transpose(0, 2, 1))
        d_projected = np.zeros((2, len(words), 3 * HIDDEN), np.float32)
        for k, rows in enumerate((index.T, index.T[::-1])):
            flat = rows.ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
            d_projected[k, flat[order][first]] = np.add.reduceat(d_steps[:, k].reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        got["bias"] = d_projected.sum(axis=1)
        got["inputs"] = np.matmul(x.T, d_projected)
        dx = np.matmul(d_projected, self.inputs.transpose(0, 2, 1)).sum(axis=0)
        counts = np.diff(np.append(starts, len(runs)))
        got["chars"], got["words"] = np.zeros_like(self.chars), np.zeros_like(self.words)
        np.add.at(got["chars"], runs, np.repeat(dx[:, :EMBED] / counts[:, None], counts, axis=0))
        np.add.at(got["words"], own, dx[:, EMBED:])
        return got


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (windows, WINDOW) over documents that stand one after another, the mask of those that exist, and each document's first window.

    Windows begin every STRIDE words and the last one reaches the end; a document without words has one empty window.
    """
    each = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    first = np.cumsum(each) - each
    doc = np.repeat(np.arange(len(lengths)), each)
    begin = (np.arange(len(doc)) - first[doc]) * STRIDE
    inside = begin[:, None] + np.arange(WINDOW)
    mask = inside < lengths[doc][:, None]
    return np.where(mask, (np.cumsum(lengths) - lengths)[doc][:, None] + inside, 0), mask.astype(np.float32), first


class Scorer:
    """Runs a network in one worker; words' projections are remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.index: dict[bytes, int] = {}
        self.projected = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.index) > REMEMBERED:
            self.index = {}
        new = [w for w in words if w not in self.index]
        held, need = len(self.index), len(self.index) + len(new)
        if need > self.projected.shape[1]:
            self.projected = np.concatenate([self.projected, np.zeros((2, max(need, 2 * self.projected.shape[1]) - self.projected.shape[1], 3 * HIDDEN), np.float32)], axis=1)
        if new:
            self.projected[:, held:need] = self.network.project_words(new)
        self.index.update(zip(new, range(held, need), strict=True))

    def window_logits(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all documents, and where each document's begin."""
        self.learn(set().union(*docs))
        lengths = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        get = self.index.__getitem__
        ids = np.fromiter((get(w) for d in docs for w in d), dtype=np.int64, count=int(lengths.sum()))
        ids = np.append(ids, 0)
        index, mask, first = windows(lengths)
        out = [self.network.read(self.projected, ids[index[i : i + BLOCK]], mask[i : i + BLOCK])[0] for i in range(0, len(index), BLOCK)]
        return np.concatenate(out) if out else np.zeros(0, np.float32), first

    def score(self, texts: list[str]) -> np.ndarray:
        logits, first = self.window_logits([common.lower_words(t) for t in texts])
        return sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)) if len(texts) else np.zeros(0)


def train(texts: list[str], y: np.ndarray, weights: np.ndarray, seed: int = 1, steps: int = STEPS) -> Network:
    """Fit by Adam, for `steps` batches. A document's label belongs to its strongest window, which is found anew after each pass; before the first
    finds can be trusted, some windows of each document at random share its label."""
    r = np.random.default_rng(seed)
    share = float((weights * y).sum() / weights.sum()) if len(y) else 0.5
    net = Network.fresh(seed, float(np.log((share + 0.01) / (1.01 - share))))
    if len(np.unique(y)) < 2:
        net.out[:] = 0
        return net
    docs = [common.lower_words(t) for t in texts]
    lengths = np.array([len(d) for d in docs])
    index, mask, first = windows(lengths)
    vocabulary: dict[bytes, int] = {}
    ids = np.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d), dtype=np.int64, count=int(lengths.sum())), 0)
    known = list(vocabulary) or [b""]
    last = np.append(first[1:], len(index))
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in Network.NAMES}
    step = 0
    while step < steps:
        if step < WARM:
            picks = np.concatenate([r.integers(a, b, size=min(3, b - a)) for a, b in zip(first, last, strict=True)])
        else:
            projected = net.project_words(known)
            logits = np.concatenate([net.read(projected, ids[index[i : i + BLOCK]], mask[i : i + BLOCK])[0] for i in range(0, len(index), BLOCK)])
            top = np.array([a + int(logits[a:b].argmax()) for a, b in zip(first, last, strict=True)])
            picks = np.concatenate([top, r.integers(first, last)[y == 0]])
        doc = np.searchsorted(first, picks, side="right") - 1
        order = r.permutation(len(picks))
        for i in range(0, len(order), BATCH):
            if step >= steps:
                break
            own = order[i : i + BATCH]
            rows = ids[index[picks[own]]]
            used, local = np.unique(rows, return_inverse=True)
            got = net.gradients([known[k] for k in used], local.reshape(rows.shape), mask[picks[own]], y[doc[own]].astype(np.float32), (weights[doc[own]] / len(own)).astype(np.float32))
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / steps) + 0.1)
            for k, g in got.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", sample: dict[int, int] | None = None) -> Network:
    """Train on a bounded sample of each label; weights restore the labels' shares among all ids that may be used."""
    allowed = F.lit(True) if allowed is None else allowed
    sample = sample or SAMPLE
    counts = {r["k"]: r["n"] for r in labels.where(F.col("doc_id").isNotNull() & allowed).groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    rows = sorted(
        tuple(r) for k, bound in sample.items() for r in common.labelled_sample(docs, labels.where(F.col(label) == k), label, allowed, bound).select("doc_id", F.coalesce("text", F.lit("")), "label").collect()
    )
    y = np.array([r[2] for r in rows], dtype=np.int64)
    share = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    weights = np.array([share[k] for k in y.tolist()])
    return train([r[1] for r in rows], y, weights / weights.mean() if len(y) else weights)


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score, predicted) of every document: the score of its strongest window.

    A null text is the empty text, whose score is that of no words at all. Repeated rows stay; an empty table gives an
    empty result; columns but doc_id and text are not read.
    """

    def make() -> Callable:
        scorer = Scorer(network)

        def rows(batch: pa.RecordBatch) -> dict:
            score = scorer.score(common.texts_of(batch))
            return {"doc_id": batch.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return rows

    return common.map_texts(docs, [common.doc_id(), "text"], "doc_id long, score double, predicted int", make)
