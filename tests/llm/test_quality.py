import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import common, doc_stats, quality, rules
from gridweave.llm.queries import op1_quality_classifier, op4_quality_rules


def base_counts(text):
    words = re.findall(common.WORD, text or "")
    found, marked, seen, doubled = Counter(zip(words, words[1:], words[2:])), set(), set(), 0
    for i in range(len(words) - 2):
        if found[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(common.WORD, line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", "".join(words))), doubled, len(marked)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 600)
    x = r.normal(0, 1, (600, len(doc_stats.FEATURES)))
    x[:, 2] = np.abs(x[:, 2]) * np.where(y == 1, 0.3, 2)
    return x, y, np.arange(600)


def test_statistics_match_brute_force(hard_docs):
    for r in hard_docs.collect():
        assert doc_stats.statistics(r.text or "")[0] == base_counts(r.text)


def test_repeats_with_many_words():
    ids = np.array([3, 1 << 30, 5, 9, 3, 1 << 30, 5, 7])
    assert doc_stats.repeated_words(ids) == 6


def test_scores_are_log_density_differences(data):
    x, y, ids = data
    m = quality.fit_once(x, y, 0.25, 0.05)
    z = m.standard(x[:5])
    for c in (0, 1):
        cov = np.linalg.inv(m.whiten[c].T @ m.whiten[c])
        d = z - m.centres[c]
        want = np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        got = m.offset[c] - 0.5 * np.square(d @ m.whiten[c].T).sum(axis=1)
        assert np.allclose(want, got)
    assert ((quality.fit(x, y, ids).score(x) >= 0.5) == y).mean() > 0.8


def test_one_label_gives_its_share(data):
    x, _, ids = data
    assert np.allclose(quality.fit(x[:0], np.zeros(0, int), ids[:0]).score(x[:2]), 0.5)
    assert (quality.fit(x, np.ones(600, int), ids).score(x[:2]) > 0.9).all()
    assert (rules.fit(x, np.ones(600, int), [0] * x.shape[1]).score(x[:2]) > 0.9).all()
    assert np.allclose(rules.fit(x[:0], np.zeros(0, int), [0] * x.shape[1]).score(x[:2]), 0.5)


def test_trees_are_flat_and_monotone(data):
    x, y, _ = data
    signs = [-1 if f in rules.FALLING else 0 for f in doc_stats.FEATURES]
    m = rules.fit(x, y, signs)
    assert ((m.score(x) >= 0.5) == y).mean() > 0.85

    def walk(row):
        total = m.base
        for at in m.roots:
            while m.left[at] != at:
                at = m.left[at] if row[m.feature[at]] <= m.limit[at] else m.right[at]
            total += m.value[at]
        return total

    assert np.allclose([walk(r) for r in x[:20]], m.margin(x[:20]))
    for j, s in enumerate(signs):
        if s:
            grid = np.repeat(x[:20], 30, axis=0)
            grid[:, j] = np.tile(np.linspace(-3, 6, 30), 20)
            assert (np.diff(m.margin(grid).reshape(20, 30), axis=1) <= 1e-12).all()


def test_op1_held_out_accuracy(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(rows[d].predicted, q) for d, q in labels.items() if rows[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in rows.items())
    assert np.mean([p == q for p, q in held]) > 0.97


def test_op4_counts_and_verdict(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_hard_documents(hard_docs, no_docs, data):
    m, t = quality.fit(*data), rules.fit(*data[:2], [0] * len(doc_stats.FEATURES))
    n = hard_docs.count()
    scored = quality.classify(hard_docs, m).collect()
    assert len(scored) == n and all(np.isfinite(r.score) for r in scored)
    assert quality.keep_good(hard_docs, m).schema == hard_docs.schema
    assert quality.keep_good(hard_docs, m).count() == sum(r.predicted for r in scored)
    assert rules.apply_rules(hard_docs, t).count() == n
    assert quality.classify(no_docs, m).collect() == rules.apply_rules(no_docs, t).collect() == quality.keep_good(no_docs, m).collect() == []


def test_learning_skips_null_labels(spark, hard_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    rows = common.labelled_sample(hard_docs, labels, "quality", common.crc_remainder("doc_id", 1) == 0, 10).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(3, 1), (3, 1), (6, 0)]
