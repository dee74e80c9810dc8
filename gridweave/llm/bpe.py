"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The lexicon is an automaton whose states share suffixes; the numbers on its arcs add up to a word's index, which gives
its token ids. It is one file of plain arrays that every worker maps into memory. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrays import BatchBpe, Remembered

#: Words that the lexicon takes from the corpus, the most frequent first; all others are merged when they are met.
LEXICON_WORDS = 65_536
#: Words whose results a worker remembers: at least those it met last, twice as many at most.
REMEMBERED = 160_000
#: Text, in bytes, that is encoded at once.
SLICE_BYTES = 500_000
#: Longest word of the lexicon in bytes, which bounds its size.
LEXICON_BYTES = 48


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: bytes that print stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with a suffix at word ends, as a tokenizer file describes it."""

    def __init__(self, spec: str):
        self.spec = spec
        d = json.loads(spec)
        model = d["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(json.dumps({k: d[k] for k in ("model", "added_tokens", "pre_tokenizer")}, ensure_ascii=False))

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word."""
        return self.batch.one(word)

    @cached_property
    def batch(self) -> BatchBpe:
        return BatchBpe(self.inner, self.final, self.merges)

    def pieces(self, run: str) -> list[bytes | int]:
        """The words of a run without white space: bytes to encode, or the id of a special token."""
        if self.specials and "<" in run and self.specials.search(run):
            out: list[bytes | int] = []
            for part in self.specials.split(run):
                out += [self.special[part]] if part in self.special else self.pieces(part) if part else []
            return out
        # Characters one by one: the normaliser knows no final sigma.
        text = unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        return [x.encode() for x in self.pattern.findall(text)]


#: White space of the tokenizer; str.split() also takes U+001C to U+001F, which are no white space there.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def runs_of(text: str) -> list[str]:
    if any(c in text for c in SEPARATORS):
        return [x for x in SPACE.split(text) if x]
    return text.split()


def build_automaton(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs of the minimal acyclic automaton of sorted, distinct words: keys (state << 8 | byte) in order, targets, outputs; and which states end a word.

    States are frozen from the end of each word once the next one leaves it, and equal ones are shared. An arc's output
    is the number of words of its state that come before those through it, so that a path's sum is the word's index.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple, int]] = []  # final, arcs, words below

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append((*key, node[0] + sum(states[t][2] for _, t in node[1])))
        return known[key]

    path: list[list] = [[False, []]]  # open states along the last word: final, arcs
    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) - 1 > shared:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    order = [root] + [s for s in range(len(states)) if s != root]
    number = {s: i for i, s in enumerate(order)}
    rows = []
    for s in order:
        before = int(states[s][0])
        for label, target in states[s][1]:
            rows.append((number[s] << 8 | label, number[target], before))
            before += states[target][2]
    arcs = np.array(rows, dtype="<u4").reshape(-1, 3)
    arcs = arcs[np.argsort(arcs[:, 0])]
    return arcs[:, 0].copy(), arcs[:, 1].copy(), arcs[:, 2].copy(), np.array([states[s][0] for s in order], dtype="u1")


class Lexicon:
    """The transducer over mapped arrays."""

    MAGIC = b"GWLX0001"

    def __init__(self, buffer):
        if bytes(buffer[:8]) != self.MAGIC:
            raise ValueError("not a lexicon")
        arcs, states, words, ids = struct.unpack("<4I", bytes(buffer[8:24]))
        at = 24

        def take(count, kind="<u4"):
            nonlocal at
            out = np.frombuffer(buffer, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.keys, self.targets, self.outputs = take(arcs), take(arcs), take(arcs)
        self.starts, self.ids, self.finals = take(words + 1), take(ids), take(states, "u1")

    @classmethod
    def compile(cls, words: Iterable[bytes], encode: Callable[[bytes], list[int]]) -> bytes:
        words = sorted(set(words) - {b""})
        keys, targets, outputs, finals = build_automaton(words)
        ids = [encode(w) for w in words]
        flat = np.array([i for x in ids for i in x], dtype="<u4")
        starts = np.cumsum([0, *map(len, ids)]).astype("<u4")
        return cls.MAGIC + struct.pack("<4I", len(keys), len(finals), len(words), len(flat)) + b"".join(x.tobytes() for x in (keys, targets, outputs, starts, flat, finals))

    @classmethod
    def map(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype="u1", mode="r"))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The index of each word, -1 where the lexicon lacks it; all words take a step at a time."""
        n = len(words)
        found = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return found
        text = np.frombuffer(b"".join(words), dtype="u1")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts = np.cumsum(lengths) - lengths
        who = np.flatnonzero(lengths)
        state, total = np.zeros(len(who), dtype=np.uint32), np.zeros(len(who), dtype=np.int64)
        step = 0
        while len(who):
            key = state << np.uint32(8) | text[starts[who] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            fits = self.keys[at] == key
            who, at, total = who[fits], at[fits], total[fits]
            state, total = self.targets[at], total + self.outputs[at]
            step += 1
            ended = lengths[who] == step
            done = ended & (self.finals[state] == 1)
            found[who[done]] = total[done]
            who, state, total = who[~ended], state[~ended], total[~ended]
        return found

    def ids_of(self, index: int) -> np.ndarray:
        return self.ids[self.starts[index] : self.starts[index + 1]]


class Encoder:
    """Encodes and decodes texts in one worker."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.known = Remembered(REMEMBERED)

    @cached_property
    def strings(self) -> dict[int, str]:
        """Tokens with a space in front."""
        return {i: f" {t}" for i, t in self.bpe.strings.items()}

    def _packed(self, ids) -> tuple[bytes, str]:
        """Ids as bytes, and the decoded text, each token with a space in front."""
        return np.asarray(ids, dtype="<u4").tobytes(), "".join([self.strings[i] for i in ids])

    def codes(self, words: list[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """Results of words: those of the lexicon by the transducer, all others merged at once."""
        index = self.lexicon.find(words)
        out = {words[k]: self._packed(self.lexicon.ids_of(index[k]).tolist()) for k in np.flatnonzero(index >= 0).tolist()}
        rest = [words[k] for k in np.flatnonzero(index < 0).tolist()]
        if rest:
            ids, ends = self.bpe.batch.encode(rest)
            raw, flat, ends = ids.astype("<u4").tobytes(), [self.strings[i] for i in ids.tolist()], ends.tolist()
            out.update((w, (raw[4 * a : 4 * b], "".join(flat[a:b]))) for w, a, b in zip(rest, ends, ends[1:]))  # noqa: B905
        return out

    def learn(self, runs: set[str]) -> None:
        """Make all of `runs` known."""
        new, known = self.known.unknown(runs), self.known.young
        parts = [self.bpe.pieces(r) for r in new]
        codes = self.codes(list({p for x in parts for p in x if isinstance(p, bytes)}))
        for run, pieces in zip(new, parts, strict=True):
            if len(pieces) == 1 and isinstance(pieces[0], bytes):
                known[run] = codes[pieces[0]]
            else:
                got = [codes[p] if isinstance(p, bytes) else self._packed([p]) for p in pieces]
                known[run] = b"".join([g[0] for g in got]), "".join([g[1] for g in got])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text the ids as little-endian unsigned 32-bit integers, and the decoded text."""
        runs = [runs_of(t) for t in texts]
        self.learn(set().union(*runs))
        out, get = [], self.known.young.__getitem__
        for x in runs:
            got = list(map(get, x))
            out.append((b"".join([g[0] for g in got]), "".join([g[1] for g in got])[1:]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces: the file names no decoder. Special tokens stay."""
        return "".join(self.strings[int(i)] for i in ids)[1:]


def build_lexicon(docs: DataFrame, bpe: WordBpe, size: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of all documents, `size` at most.

    How many words have a count is told in steps of an eighth of a power of two, which are a few hundred rows whatever
    the corpus; the words of all steps that fit come to the driver, and no more than those.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    with common.Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(common.count_words(docs).where(F.octet_length("word") <= LEXICON_BYTES).withColumn("step", step), "words")
        fits, total = None, 0
        for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
            total += r["count"]
            if total > size:
                break
            fits = r["step"]
        top = [] if fits is None else counts.where(F.col("step") >= fits).select("word").collect()
    return Lexicon.compile({p for r in top for p in bpe.pieces(r["word"]) if isinstance(p, bytes)}, bpe.merge)


def encode_documents(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Encode every text of `docs` and decode it again.

    `with_ids` adds the ids themselves. A null text is the empty text, which has no tokens. Rows come out as often as they come in, in no order; further
    columns are not read. The tokenizer file is read on the driver alone.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    bpe = WordBpe.load(tokenizer)
    name = common.publish(spark, "lexicon.bin", build_lexicon(docs, bpe, size))
    rules = common.publish(spark, "bpe.json", bpe.spec.encode())

    def make() -> Callable:
        encoder = worker_encoder(rules, name)

        def rows(batch):
            got = encoder.encode(common.texts_of(batch))
            out = {
                "doc_id": batch.column(0),
                "n_tokens": [len(ids) // 4 for ids, _ in got],
                "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _ in got],
                "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for _, text in got],
            }
            if with_ids:
                flat = np.frombuffer(b"".join([ids for ids, _ in got]), dtype="<i4")
                out["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *out["n_tokens"]]).astype(np.int32), flat)
            return out

        return rows

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return common.map_texts(docs, [common.doc_id(), "text"], schema, make, SLICE_BYTES)


#: One encoder a worker and lexicon: tasks that follow each other in a worker share it.
_encoders: dict[tuple[str, str], Encoder] = {}


def worker_encoder(rules: str, lexicon: str) -> Encoder:
    if (rules, lexicon) not in _encoders:
        _encoders.clear()
        with open(SparkFiles.get(rules), encoding="utf-8") as f:
            _encoders[rules, lexicon] = Encoder(WordBpe(f.read()), Lexicon.map(SparkFiles.get(lexicon)))
    return _encoders[rules, lexicon]
