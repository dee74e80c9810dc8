import numpy as np

from gridweave.llm import toxicity
from gridweave.llm.queries import op7_toxicity


def test_gradients_match_differences():
    net = toxicity.Network.fresh(3, 0.1)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    words, r = [b"hello", b"you,", b"a", b"idiot!"], np.random.default_rng(0)
    index, mask, y, w = r.integers(0, 4, (3, 6)), np.ones((3, 6)), np.array([1, 0, 1.0]), np.ones(3) / 3
    mask[1, 4:] = 0

    def loss():
        logits = net.read(net.project(net.embed(words)[0]), index, mask)[0]
        return float((w * (np.logaddexp(0, logits) - y * logits)).sum())

    got = net.gradients(words, index, mask, y, w)
    for k in net.NAMES:
        a = getattr(net, k)
        for j in list(map(tuple, np.argwhere(np.abs(got[k].reshape(a.shape)) > 1e-4)))[::7][:5]:
            held = a[j]
            a[j] = held + 1e-2
            up = loss()
            a[j] = held - 1e-2
            down = loss()
            a[j] = held
            assert abs((up - down) / 2e-2 - got[k][j]) < 2e-3 * max(0.05, abs(got[k][j]))


def test_windows_cover_all_words():
    lengths = np.array([0, 1, 32, 33, 80, 0, 500])
    index, mask, first = toxicity.windows(lengths)
    ends = np.append(first[1:], len(index))
    for k, n in enumerate(lengths.tolist()):
        got = index[first[k] : ends[k]][mask[first[k] : ends[k]] > 0]
        at = int(lengths[:k].sum())
        assert set(got.tolist()) == set(range(at, at + n)) and ends[k] > first[k]


def test_scores_do_not_depend_on_company():
    net = toxicity.Network.fresh(1, 0.0)
    texts = ["", "one two", "word " * 100 + "end", "a b c " * 40]
    together = toxicity.Scorer(net).score(texts)
    assert np.allclose(together, [toxicity.Scorer(net).score([t])[0] for t in texts], atol=1e-5)


def test_training_finds_a_rare_stem():
    r = np.random.default_rng(2)
    texts, y = [], []
    for i in range(300):
        words = [f"{a}{b}" for a, b in zip(r.choice(["th", "er", "on", "an"], 90), r.choice(["ing", "ed", "re", ""], 90))]
        y.append(i % 4 == 0)
        if y[-1]:
            words[int(r.integers(90))] = f"snark{r.choice(['le', 'en', 'ung', 'est', 'ix'])}"
        texts.append(" ".join(words))
    y = np.array(y, dtype=np.int64)
    net = toxicity.train(texts[:240], y[:240], np.ones(240))
    score = toxicity.Scorer(net).score(texts[240:])
    assert ((score >= 0.5) == y[240:]).mean() > 0.9


def test_one_label_gives_a_constant(hard_docs, no_docs):
    net = toxicity.train(["a b", "c"], np.array([0, 0]), np.ones(2))
    rows = toxicity.score_documents(hard_docs, net).collect()
    assert len(rows) == hard_docs.count() and len({r.score for r in rows}) == 1 and rows[0].predicted == 0
    assert toxicity.score_documents(no_docs, toxicity.train([], np.zeros(0, int), np.zeros(0))).collect() == []


def test_op7_held_out(spark):
    rows = {r.doc_id: r for r in op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.toxic for r in labels]) > 0.97
