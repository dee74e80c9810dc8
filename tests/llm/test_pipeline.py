import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridweave.llm import common


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(common.materialise(stage(spark, docs[-1], sf_dir), name))
    return docs


def shingles(text):
    words = common.lower_words(text or "")
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_columns_stay_until_the_last_stage(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_keeps_good_documents_unchanged(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert stages[1].exceptAll(stages[0]).count() == 0
    assert np.mean([(d in kept) == (q == 1) for d, q in labels.items()]) > 0.97


def test_near_dedup_against_brute_force(stages):
    before, after = ({r.doc_id: shingles(r.text) for r in d.collect()} for d in stages[1:3])
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    ids = sorted(before)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if similar(before[a], before[b])]
    dropped = set(before) - set(after)
    # what went has a near copy, nearly all near copies went, and of equal texts one stays
    near = lambda a, b: len(a & b) >= 0.6 * len(a | b)
    assert all(any(near(before[d], before[x]) for x in ids if x != d) for d in dropped)
    assert np.mean([a not in after or b not in after for a, b in pairs]) > 0.9
    assert {frozenset(s) for s in after.values()} >= {frozenset(before[b]) for a, b in pairs if before[a] == before[b] and b in after}


def test_secrets_are_masked_and_rows_stay(stages):
    before, after = ({r.doc_id: r for r in d.collect()} for d in stages[2:4])
    assert before.keys() == after.keys()
    assert all(after[k].text == before[k].text or "[SECRET]" in after[k].text for k in before)


def test_mix_repeats_whole_documents(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert all(before[r.doc_id] == r for r in stages[4].collect()) and max(copies.values()) <= 3
    size = {k: len(re.findall(common.WORD, r.text or "")) for k, r in before.items()}
    words, taken = defaultdict(int), defaultdict(int)
    for k, r in before.items():
        words[r.source] += size[k]
        taken[r.source] += size[k] * copies[k]
    assert abs(sum(taken.values()) - sum(words.values())) < 0.02 * sum(words.values())


def test_last_stage_is_the_librarys_encoding(spark, stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    for r in rows[:300]:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[5].collect()))
