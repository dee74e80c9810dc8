import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridweave.llm import arrays, bpe, common, token_counts

WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
rnd = random.Random(5)
ODD = ["", " ", "ΑΣ Σ ΣΑΣ's I'LL", "İstanbul É é", "<|endoftext|>x<|startoftext|>  <|endoftext|", "a\x1cb \x1d c\x85d", "don't''s 'll", "x" * 3000, "\n\n b", "don'", "İ ﬁ ß ẞ Ǆ"]
ODD += ["".join(rnd.choice("ab'sldtrevm \n\t 1é日<|endoftext|> .") for _ in range(rnd.randint(1, 60))) for _ in range(400)]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.WordBpe.load(WORDS)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(token_counts.PrefixCounter.spec(BYTES))


def test_hash_table_keeps_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    t = arrays.HashTable(keys[:10], np.arange(10))
    t.put(keys[10:], np.arange(10, len(keys)))
    assert t.get(keys, -1).tolist() == list(range(len(keys)))
    assert (t.get(keys + np.uint64(1 << 50), -1) == -1).all()


def test_automaton_finds_words_and_shares_suffixes():
    words = sorted({b"a", b"and", b"band", b"hand", b"hands", b"bands", "über".encode()})
    keys, targets, outputs, finals = bpe.build_automaton(words)
    assert len(finals) < sum(map(len, words)) / 2
    lexicon = bpe.Lexicon(np.frombuffer(bpe.Lexicon.compile(words, lambda w: [len(w)]), dtype="u1"))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"an", b"bandsx", b"z", b"ban"]).tolist() == [-1] * 5
    assert [lexicon.ids_of(i).tolist() for i in range(len(words))] == [[len(w)] for w in words]
    assert bpe.Lexicon(np.frombuffer(bpe.Lexicon.compile([], None), dtype="u1")).find([b"a"]).tolist() == [-1]


def test_merging_is_exact_for_one_and_many(word_bpe):
    words = [p for t in ODD for r in bpe.runs_of(t) for p in word_bpe.pieces(r) if isinstance(p, bytes)]
    ids, ends = word_bpe.batch.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [word_bpe.merge(w) for w in words]


def test_encoding_is_the_librarys(word_bpe):
    lexicon = bpe.Lexicon(np.frombuffer(bpe.Lexicon.compile([b"the", b"don", b"ab"], word_bpe.merge), dtype="u1"))
    got, lib = bpe.Encoder(word_bpe, lexicon).encode(ODD), library(WORDS)
    for text, (ids, decoded) in zip(ODD, got, strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == lib.decode(want, skip_special_tokens=False), text


def test_encode_documents_round_trip(spark, hard_docs, no_docs):
    lib, texts = library(WORDS), Counter((r.doc_id, r.text) for r in hard_docs.collect())
    rows = bpe.encode_documents(hard_docs, WORDS, size=5, with_ids=True).collect()
    want = Counter()
    for (doc, text), n in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.encode_documents(no_docs, WORDS).collect() == []


def test_every_prefix_has_the_librarys_count(counter):
    lib = library(BYTES)
    for text in ODD:
        if len(text) < 100:
            want = [len(x.ids) for x in lib.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
            assert counter.prefix_counts(text) == want, text
            for budget in (0, 1, 5, 20):
                units = counter.units(text)
                counter.learn(set(units))
                counts = np.array([counter.known.young[u] for u in units], dtype=np.int64)
                best = max(i for i, n in enumerate(want) if n <= budget)
                assert counter.fit(text, budget) == counter.fit_units(units, counts, budget) == best


def test_count_tokens(spark, hard_docs, no_docs):
    lib = library(BYTES)
    rows = token_counts.count_tokens(hard_docs, BYTES).collect()
    want = Counter()
    for r in hard_docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.count_tokens(no_docs, BYTES).collect() == []


def test_word_counts(spark, hard_docs, no_docs):
    want = Counter(w for r in hard_docs.collect() for w in common.lower_words(r.text or ""))
    got = {r.word.encode(): r.n for r in common.count_words(hard_docs, flush=2).collect()}
    assert got == dict(want)
    assert common.count_words(no_docs).collect() == []


def test_encoding_takes_rows_in_small_batches(spark):
    """Whole 64 MB batches, in the JVM and in two workers, took an executor over its memory in the pipeline."""

    def sizes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    spark.conf.set(key, "64m")
    try:
        assert bpe.encode_documents(docs, WORDS).where("n_tokens = 2000").count() == 4000
        sizes = docs.mapInArrow(sizes_of, "n long, size long").collect()
        assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 2 * common.BATCH_BYTES
        spark.conf.set(key, "1m")
        common.small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_slices_hold_as_much_text_as_asked():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 40, None, "y" * 70, "z" * 20, "w" * 20]})
    assert [s.num_rows for s in common.text_slices([batch], most=100)] == [2, 2, 1]
