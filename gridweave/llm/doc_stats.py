"""Statistics of a document, which the quality operators learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common

#: Symbols that the quality rules count.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
#: Words that are added to each share's denominator.
DAMP = 20
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares and sizes that models see; how each is transformed stands in `features`.
FEATURES = (
    "log_words", "log_word_chars", "symbols", "upper", "digits", "marks", "dup_lines", "repeat_words", "distinct_words", "top_word", "same_as_before",
    "log_line_words", "short_words", "stops",
)
_CLASS = np.zeros(256, dtype="u1")
for _k, _chars in enumerate((SPACE, SYMBOLS, bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?", b".,;:"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = 8  # later bytes of a character
_CLASS[0xC0:] = 9  # first bytes of characters beyond ASCII


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    if size < 1 << 21:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    equal = np.flatnonzero(key[order][1:] == key[order][:-1])
    twice = np.zeros(len(ids), dtype=bool)
    for at in (order[equal], order[equal + 1]):
        twice[at] = twice[at + 1] = twice[at + 2] = True
    return int(twice.sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The BASE counts and the FEATURES of one text; all are 0 for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(BASE), [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype="u1")], minlength=10)
    _, space, symbols, upper, lower, digits, marks, stops, later, beyond = kinds.tolist()
    chars = len(raw) - later - space
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    doubled = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    counts = np.bincount(ids)
    before = int((ids[1:] == ids[:-1]).sum())
    short = int((np.fromiter(map(len, words), dtype=np.int64, count=n) <= 3).sum())
    letters = upper + lower + beyond
    # Shares are damped, so that a few words say little.
    some, much = n + DAMP, chars + 5 * DAMP
    features = [
        np.log1p(n), np.log1p(chars / n), (symbols / much) ** 0.5, (upper / (letters + 5 * DAMP)) ** 0.5, (digits / much) ** 0.5, (marks / much) ** 0.5,
        (doubled / (len(lines) + 1)) ** 0.5, (repeats / some) ** 0.5, (len(index) + DAMP) / some, ((int(counts.max()) - 1) / some) ** 0.5, (before / some) ** 0.5,
        np.log1p(n / len(lines)), short / some, (stops / some) ** 0.5,
    ]
    return (n, chars, symbols, doubled, repeats), features


def table(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """BASE counts and FEATURES of a slice of documents, a row each."""
    got = [statistics(t) for t in common.texts_of(batch)]
    return np.array([b for b, _ in got], dtype=np.int64).reshape(-1, len(BASE)), np.array([f for _, f in got], dtype=np.float64).reshape(-1, len(FEATURES))


def learn_from(sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and ids of a bounded labelled sample (doc_id, text, label), in an order that reruns keep."""

    def make():
        return lambda batch: {"doc_id": batch.column(0), "label": batch.column(2), "x": [f.tolist() for f in table(batch)[1]]}

    rows = common.map_texts(sample, [common.doc_id(), "text", "label"], "doc_id long, label int, x array<double>", make).collect()
    rows = sorted(map(tuple, rows))
    x = np.array([r[2] for r in rows], dtype=np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r[1] for r in rows], dtype=np.int64), np.array([r[0] for r in rows], dtype=np.int64)
