"""Array forms of what tokenisation needs: a hash table, BPE merging of many words at once, a trie."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int32(2**31 - 1)
#: Longest word, in bytes, that is merged beside others, and cells of one block of words.
WIDE, CELLS = 256, 2_000_000


class Remembered:
    """Values by key, of which at least the `bound` that were asked for last are kept, and twice as many at most."""

    def __init__(self, bound: int):
        self.bound, self.young, self.old = bound, {}, {}

    def unknown(self, keys: set) -> list:
        """The keys without a value; all others are in `young` from now on."""
        if len(self.young) > self.bound:
            self.old, self.young = self.young, {}
        young, get, out = self.young, self.old.get, []
        for k in keys - young.keys():
            value = get(k)
            if value is None:
                out.append(k)
            else:
                young[k] = value
        return out


class HashTable:
    """Distinct unsigned 64-bit keys to 32-bit values, open addressing; all keys of a call take a probe at a time."""

    def __init__(self, keys=(), values=()):
        self.count = 0
        self._room(max(16, len(keys)))
        self.put(np.asarray(keys, dtype=np.uint64), np.asarray(values, dtype=np.int32))

    def _room(self, n: int) -> None:
        bits = int(np.ceil(np.log2(n * 3)))
        self.keys, self.values = np.full(1 << bits, EMPTY), np.zeros(1 << bits, dtype=np.int32)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that the table lacks."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old = self.keys != EMPTY
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._room(len(keys))
            self.count = 0
        self.count += len(keys)
        slot = keys * MIX >> self.shift
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            took, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[took], self.values[took] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = keys * MIX >> self.shift
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(missing))
        open_ = np.flatnonzero((there != keys) & (there != EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (there != EMPTY)
            open_, slot = open_[more], slot[more]
        return out


class BatchBpe:
    """Exact BPE of many words: each round joins, in every word, the pair of lowest rank that stands first."""

    def __init__(self, inner: Sequence[int], final: Sequence[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.inner, self.final, self.merges = np.array(inner, dtype=np.int32), np.array(final, dtype=np.int32), merges
        pairs = np.array(list(merges), dtype=np.uint64).reshape(-1, 2)
        ranks = np.array([r for r, _ in merges.values()], dtype=np.int32)
        self.table = HashTable(pairs[:, 0] << np.uint64(32) | pairs[:, 1], ranks)
        self.made = np.zeros(int(ranks.max(initial=-1)) + 1, dtype=np.int32)
        self.made[ranks] = [i for _, i in merges.values()]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.table.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), NEVER)

    def one(self, word: bytes) -> list[int]:
        """A single word of any length, with a heap of pairs."""
        ids: list[int | None] = [*self.inner[np.frombuffer(word[:-1], dtype="u1")].tolist(), int(self.final[word[-1]])]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(ids) and (p := (ids[x], ids[y])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], x, *p))
        return [i for i in ids if i is not None]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin (one more than words). Words are not empty."""
        n = len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(words), dtype="u1")
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < n and lengths[order[at]] <= WIDE:
            end = at + 1  # words of like length, as many as CELLS holds
            most = min(WIDE, max(8, int(lengths[order[at]] * 1.25)))
            end = min(int(np.searchsorted(lengths[order], most, side="right")), at + max(1, CELLS // most))
            rows = order[at:end]
            done += self._block(text, starts[rows], lengths[rows], rows)
            at = end
        for row in order[at:].tolist():
            ids = np.array(self.one(words[row]), dtype=np.int32)
            done.append((np.array([row]), ids[None, :], np.array([len(ids)])))
        counts = np.zeros(n, dtype=np.int64)
        for rows, _, held in done:
            counts[rows] = held
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(int(ends[-1]), dtype=np.int32)
        for rows, ids, held in done:
            column = np.arange(ids.shape[1])
            live = column < held[:, None]
            out[(ends[rows][:, None] + column)[live]] = ids[live]
        return out, ends

    def _block(self, text, starts, lengths, rows) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width, n = int(lengths.max()), len(rows)
        column = np.arange(width)
        ids = self.inner[text[np.minimum(starts[:, None] + column, len(text) - 1)]]
        ids[np.arange(n), lengths - 1] = self.final[text[starts + lengths - 1]]
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        ranks[column[1:] >= lengths[:, None]] = NEVER
        held, done = lengths.copy(), []
        while True:
            if not ids.shape[1] > 1:
                done.append((rows, ids, held))
                break
            spot = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), spot]
            live = best != NEVER
            if not live.all():
                done.append((rows[~live], ids[~live], held[~live]))
                rows, ids, ranks, held, spot, best = rows[live], ids[live], ranks[live], held[live], spot[live], best[live]
            if not len(rows):
                break
            every = np.arange(len(rows))
            ids[every, spot] = self.made[best]
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > spot[:, None]), axis=1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= spot[:, None]), axis=1)
            held = held - 1
            left, right = np.flatnonzero(spot > 0), np.flatnonzero(spot + 1 < held)
            ranks[left, spot[left] - 1] = self._ranks(ids[left, spot[left] - 1], ids[left, spot[left]])
            ranks[right, spot[right]] = self._ranks(ids[right, spot[right]], ids[right, spot[right] + 1])
        return done


class Trie:
    """All tokens that begin at each byte of a text."""

    def __init__(self, tokens: dict[bytes, int]):
        children: dict[int, int] = {}
        ends = [-1]
        for word, token in tokens.items():
            node = 0
            for b in word:
                key = node << 8 | b
                node = children.get(key, 0)
                if not node:
                    node = children[key] = len(ends)
                    ends.append(-1)
            ends[node] = token
        self.table = HashTable(np.fromiter(children.keys(), dtype=np.uint64, count=len(children)), np.fromiter(children.values(), dtype=np.int32, count=len(children)))
        self.ends = np.array(ends, dtype=np.int32)

    def matches(self, text: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of every token in `text`; one that begins at i ends at stops[i] at most."""
        at = np.arange(len(text))
        node = np.zeros(len(text), dtype=np.int64)
        out, step = [], 0
        while len(at):
            inside = at + step < stops[at]
            at, node = at[inside], node[inside]
            node = self.table.get(node.astype(np.uint64) << np.uint64(8) | text[at + step].astype(np.uint64), 0).astype(np.int64)
            alive = node > 0
            at, node, step = at[alive], node[alive], step + 1
            token = self.ends[node]
            hit = token >= 0
            out.append((at[hit], at[hit] + step, token[hit]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
