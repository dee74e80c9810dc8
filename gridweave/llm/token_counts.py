"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE.

Two tokens may stand side by side in an encoding if and only if the encoding of their joined bytes is the two again, and
an encoding is right if all its neighbours are. So each prefix of a word has one last token that fits behind the
encoding of what comes before it, and its count is one more than that of the shorter prefix.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import common
from .arrays import BatchBpe, HashTable, Remembered, Trie
from .bpe import byte_symbols

#: Most tokens of a document that is within the limit.
LIMIT = 512
#: Runs whose counts a worker remembers, at least those it met last and twice as many at most; and most token pairs.
REMEMBERED, PAIRS = 450_000, 500_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that no word crosses: one run without white space and a space in front, or white space.
RUN = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
SPACES = re.compile(f"[{_WS}]+\\Z")


class PrefixCounter:
    def __init__(self, spec: str):
        d = json.loads(spec)
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        raw = {t: bytes(symbols[c] for c in t) for t in d["model"]["vocab"]}
        self.tokens = {raw[t]: i for t, i in d["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.tokens.items()}
        self.ranks = {}
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.tokens[raw[a]], self.tokens[raw[b]]] = (rank, self.tokens[raw[a] + raw[b]])
        single = [self.tokens[bytes([b])] for b in range(256)]
        self.batch = BatchBpe(single, single, self.ranks)
        # A token that its own bytes don't give can never end a prefix.
        words = list(self.tokens)
        ids, ends = self.batch.encode(words)
        right = (np.diff(ends) == 1) & (ids[ends[:-1]] == [self.tokens[w] for w in words])
        self.tokens = {w: self.tokens[w] for w, ok in zip(words, right, strict=True) if ok}
        self.trie = Trie(self.tokens)
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.pairs = HashTable()
        self.known = Remembered(REMEMBERED)
        self.opened: dict[bytes, list[int]] = {}

    @staticmethod
    def spec(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        if d.get("normalizer") or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level files without normaliser are supported")
        return json.dumps({k: d[k] for k in ("model", "added_tokens")}, ensure_ascii=False)

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each of `b` may follow the one of `a`; pairs that are new are tried out together."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        got = self.pairs.get(keys, -1)
        if len(new := np.unique(keys[got < 0])):
            if self.pairs.count > PAIRS:
                self.pairs, new = HashTable(), np.unique(keys)
            left, right = (new >> np.uint64(32)).astype(np.int32), (new & np.uint64(0xFFFFFFFF)).astype(np.int32)
            ids, ends = self.batch.encode([self.bytes[x] + self.bytes[y] for x, y in zip(left.tolist(), right.tolist(), strict=True)])
            two = np.flatnonzero(np.diff(ends) == 2)
            ok = np.zeros(len(new), dtype=np.int32)
            ok[two] = (ids[ends[two]] == left[two]) & (ids[ends[two] + 1] == right[two])
            self.pairs.put(new, ok)
            got = self.pairs.get(keys, -1)
        return got == 1

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of all prefixes of all words one after another, each word's empty one first, and where each word's begin."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype="u1")
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        start, end, token = self.trie.matches(text, ends[word])
        inside = start - (ends - lengths)[word[start]]
        order = np.argsort(inside, kind="stable")
        start, end, token, inside = start[order], end[order] + word[start[order]], token[order], inside[order]
        start = start + word[start]  # a word of k bytes has k + 1 prefixes
        bounds = np.searchsorted(inside, np.arange(int(lengths.max(initial=0)) + 1))
        last, counts = np.full(len(text) + len(words), -1, dtype=np.int32), np.zeros(len(text) + len(words), dtype=np.int32)
        for k, (x, y) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
            i, j, t = start[x:y], end[x:y], token[x:y]
            if k:
                fits = self.adjacent(last[i], t)
                i, j, t = i[fits], j[fits], t[fits]
            last[j], counts[j] = t, counts[i] + 1
        return counts, np.concatenate([[0], ends + np.arange(1, len(words) + 1)])

    def word_counts(self, word: bytes) -> list[int]:
        """Token count of every prefix of one word, the empty one first."""
        counts = self.opened.get(word)
        return self.table([word])[0].tolist() if counts is None else counts

    def open(self, texts: list[str]) -> None:
        """Put the words of `texts` through the table together, ahead of `prefix_counts` of each."""
        words = list({w.encode() for t in texts for run in self.units(t) for w in self.pattern.findall(run)})
        counts, ends = self.table(words)
        counts, ends = counts.tolist(), ends.tolist()
        self.opened = {w: counts[a:b] for w, a, b in zip(words, ends, ends[1:])}  # noqa: B905

    def run_count(self, run: str) -> int:
        return int(sum(self.word_counts(word.encode())[-1] for word in self.pattern.findall(run)))

    def segments(self, text: str) -> list[str]:
        """Texts between special tokens, and the special tokens, in order."""
        if self.specials and any(s in text for s in self.special):
            return [x for x in self.specials.split(text) if x]
        return [text] if text else []

    def units(self, text: str) -> list[str]:
        out: list[str] = []
        for x in self.segments(text):
            out += [x] if x in self.special else RUN.findall(x)
        return out

    def learn(self, runs: set[str]) -> None:
        """Make the counts of all of `runs` known; the words of those that are new go through the table together."""
        new, known = self.known.unknown(runs), self.known.young
        parts = [[w.encode() for w in self.pattern.findall(r)] for r in new]
        words = [w for w in {w for x in parts for w in x} if w not in self.tokens]
        sums, ends = self.table(words)
        total = dict(zip(words, sums[ends[1:] - 1].tolist(), strict=True))
        for run, x in zip(new, parts, strict=True):
            known[run] = 1 if run in self.special else sum([total.get(w, 1) for w in x])

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of text[:i] for every i from 0 to its length.

        Where a prefix ends inside a special token's string, that part counts as ordinary text.
        """
        out, total = [0], 0
        for segment in self.segments(text):
            if segment in self.special:
                out += [total + n for n in self._open(segment)[1:-1]] + [total + 1]
                total += 1
            else:
                got = self._open(segment)
                out += [total + n for n in got[1:]]
                total += got[-1]
        if self.special and len(out) == len(text) + 1:
            out = self._special_heads(text, out)
        return out

    def _special_heads(self, text: str, out: list[int]) -> list[int]:
        # A head of a special string belongs to the run before it until the string is whole.
        at = 0
        for segment in self.segments(text):
            end = at + len(segment)
            if segment in self.special:
                start = max((m.end() for m in self.specials.finditer(text, 0, at)), default=0)
                whole = self._open(text[start : end - 1])
                before = out[start]
                out[at + 1 : end] = [before + n for n in whole[at - start + 1 :]]
            at = end
        return out

    def _open(self, text: str) -> list[int]:
        """prefix_counts of a text without special tokens."""
        out, total, spaces = [0], 0, ""
        before = 0  # count ahead of the white space that is open
        for run in RUN.findall(text):
            body = run.strip(" ") if run[0] == " " and run.strip(" ") else run
            if SPACES.fullmatch(run):
                for c in run:
                    spaces += c
                    out.append(before + self.run_count(spaces))
                total += self.run_count(run)
                continue
            lead = run[: len(run) - len(body)]
            if lead:
                out.append(before + self.run_count(spaces + lead))
            out += [total + n for n in self._word_run(lead, run)]
            total = out[-1]
            before, spaces = total, ""
        return out

    def _word_run(self, lead: str, run: str) -> list[int]:
        """Counts of the prefixes of a run, from the first that holds more than `lead`."""
        out, done, at = [], 0, 0
        for word in self.pattern.findall(run):
            counts = self.word_counts(word.encode())
            ends = np.cumsum([len(c.encode()) for c in word]).tolist()
            for k in range(1, len(word) + 1):
                if at + k > len(lead):
                    # An apostrophe's ending is a word of its own only when it is whole.
                    out.append(self.run_count(run[: at + k]) if word[0] == "'" else done + counts[ends[k - 1]])
            done += counts[-1]
            at += len(word)
        return out

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return max(i for i, n in enumerate(self.prefix_counts(text)) if n <= budget)

    def around(self, units: list[str], counts: np.ndarray, budget: int) -> tuple[int, int, str]:
        """Where the budget ends: the characters and tokens ahead of the runs that must be opened, and these runs."""
        sums = np.cumsum(counts)
        k = int(np.searchsorted(sums, budget, side="right"))  # runs that fit whole
        start, stop = min(k, len(units)), k + 1
        while start and start < len(units) and SPACES.fullmatch(units[start - 1]):  # white space is counted anew when it ends the prefix
            start -= 1
        while stop < len(units) and (SPACES.fullmatch(units[stop - 1]) or stop < k + 2):
            stop += 1
        return sum(map(len, units[:start])), int(sums[start - 1]) if start else 0, "".join(units[start:stop])

    def fit_units(self, units: list[str], counts: np.ndarray, budget: int) -> int:
        """`fit` from the runs' counts: only the runs around the budget are opened, nothing is encoded again."""
        chars, base, text = self.around(units, counts, budget)
        return chars + max(i for i, n in enumerate(self.prefix_counts(text)) if base + n <= budget)


_counters: dict[str, PrefixCounter] = {}


def worker_counter(name: str) -> PrefixCounter:
    if name not in _counters:
        _counters.clear()
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            _counters[name] = PrefixCounter(f.read())
    return _counters[name]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every text, whether they are over `limit`, and the characters of the longest prefix within it.

    A null text is the empty text, with no tokens. Rows come out as often as they come in; further columns are not read.
    """
    name = common.publish(docs.sparkSession, "byte-bpe.json", PrefixCounter.spec(tokenizer).encode())

    def make() -> Callable:
        counter = worker_counter(name)

        def rows(batch):
            texts = common.texts_of(batch)
            units = [counter.units(t) for t in texts]
            counter.learn(set().union(*units))
            get = counter.known.young.__getitem__
            counts = [np.fromiter(map(get, u), dtype=np.int64, count=len(u)) for u in units]
            totals = [int(c.sum()) for c in counts]
            ends = [counter.around(u, c, limit) if n > limit else None for u, c, n in zip(units, counts, totals, strict=True)]
            counter.open([e[2] for e in ends if e])
            fits = [len(t) if e is None else e[0] + max(i for i, n in enumerate(counter.prefix_counts(e[2])) if e[1] + n <= limit) for t, e in zip(texts, ends, strict=True)]
            return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": totals, "over_limit": [n > limit for n in totals], "fit_chars": fits}

        return rows

    return common.map_texts(docs, [common.doc_id(), "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)
