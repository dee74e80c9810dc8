import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.llm import common, graph, simhash


def brute_fingerprint(text, n=3):
    words = [w.decode() for w in common.lower_words(text or "")]
    parts = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def text_of(r, n):
    return " ".join(r.choice(["the", "of", "and"] + [f"w{k}" for k in range(400)]) for _ in range(n))


def test_fingerprints_match_brute_force(hard_docs):
    rows = simhash.fingerprints(hard_docs).collect()
    want = Counter((r.doc_id, brute_fingerprint(r.text)) for r in hard_docs.collect())
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in rows) == want
    r = random.Random(1)
    for n in (1, 2, 3, 4, 300, 900):
        t = text_of(r, n)
        assert simhash.majority(simhash.hashes(t, 3)) == brute_fingerprint(t)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7 * k) for k in range(200, 260)] + [(500, 500), (600, 601), (601, 600), (-5, 40)]
    with common.Scratch(spark) as scratch:
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).collect() == []
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = brute_components(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    least = defaultdict(list)
    for x, c in want.items():
        least[c].append(x)
    assert got == {x: min(least[c]) for x, c in want.items()}


def test_chains_hold_for_every_two_bits():
    plan = simhash.chains(2, 7)
    for i in range(64):
        for j in range(64):
            d = 1 << i | 1 << j
            assert any(not d & mask and all((d & m).bit_count() <= most for m, most in more) for mask, more, _ in plan)


@pytest.mark.parametrize("dense", [64, 3])
def test_links_and_components_match_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(dense)
    base = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(25):
            x = (b if r.random() < 0.6 else x) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64) if r.random() < 0.4 else 0)
            fps.add(x)
    rows = [(i, simhash.signed(f)) for i, f in enumerate(sorted(fps, key=lambda x: x * 0x9E3779B97F4A7C15 % (1 << 64)))]
    rows += [(1000 + i, f) for i, (_, f) in enumerate(rows[:20])]
    accept = lambda a, b: simhash.F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= 2
    got = {x.doc_id: x.component_id for x in simhash.link_components(spark.createDataFrame(rows, "doc_id long, fp long"), simhash.chains(2, 7), accept).collect()}
    roots = brute_components({f for _, f in rows}, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = defaultdict(list)
    for i, f in rows:
        least[roots[f]].append(i)
    assert got == {i: min(least[roots[f]]) for i, f in rows}
    assert len(set(got.values())) < len(fps)


def test_hard_documents(hard_docs, no_docs):
    rows = simhash.near_duplicates(hard_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in hard_docs.collect())
    by = {r.doc_id: r.component_id for r in rows}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[None] is None
    assert simhash.near_duplicates(no_docs).collect() == simhash.keep_one(no_docs).collect() == []
    kept = simhash.keep_one(hard_docs)
    assert kept.schema == hard_docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id: 1 for r in rows if r.doc_id not in (1, 2, 4)})


@pytest.mark.parametrize("hubs", [4, 1])
def test_keep_one_keeps_one_of_each_group(spark, monkeypatch, hubs):
    monkeypatch.setattr(simhash, "HUBS", hubs)
    r = random.Random(7)
    rows, n = [], 0
    for g in range(30):
        words = text_of(r, 300).split()
        for _ in range(r.choice([1, 2, 5])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 3])):
                copy[r.randrange(300)] = f"new{r.random()}"
            rows.append((n, " ".join(copy), g))
            n += 1
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source long")).collect()
    assert Counter(x.source for x in kept) == Counter(range(30))
    first = {}
    for i, _, g in rows:
        first.setdefault(g, i)
    assert {x.source: x.doc_id for x in kept} == first


def kept_of(spark, texts):
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def brute_kept(texts):
    sets = [{simhash.xxhash.xxh64_intdigest(s, 42) for s in simhash.shingles(t, 5)} for t in texts]
    roots = brute_components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i, c in roots.items():
        least[c] = min(i, least.get(c, i))
    return set(least.values())


def test_a_repeated_line_does_not_make_near_copies(spark):
    r = random.Random(3)
    texts = [" ".join([f"w{g}x{r.randrange(10**6)}" for _ in range(300)] + ["home about news contact login"] * 40) for g in range(6)]
    texts.append(texts[0] + " " + "home about news contact login " * 5)
    assert kept_of(spark, texts) == brute_kept(texts) == set(range(6))


def test_pairs_above_the_similarity_are_found_and_others_stay(spark):
    r = random.Random(4)
    texts = []
    for g in range(120):
        words = [f"w{g}x{r.randrange(10**6)}" for _ in range(400)]
        texts.append(" ".join(words))
        at = r.choice([34, 38, 42, 46, 50, 60])  # words off the end: similarities around 0.8
        texts.append(" ".join(words[at:] + [f"n{g}x{r.randrange(10**6)}" for _ in range(at)]))
    assert kept_of(spark, texts) == brute_kept(texts)


@pytest.mark.parametrize("rounds", [4, 1, 0])
def test_large_groups_that_drift_are_one_component(spark, monkeypatch, rounds):
    """Each copy is near to the next few alone; a common half gives all of them common keys."""
    monkeypatch.setattr(simhash, "HUBS", rounds)
    r = random.Random(5)
    texts = []
    for g in range(4):
        words = [f"w{g}x{k}" for k in range(300)]
        for step in range(25):
            for k in range(12):
                words[(step * 12 + k) % 150] = f"n{g}x{step}x{k}"
            texts.append(" ".join(words))
    r.shuffle(texts)
    assert kept_of(spark, texts) == brute_kept(texts)
    assert len(brute_kept(texts)) == 4


def test_the_ring_keeps_all_pairs_within_the_distance(spark):
    """Some start's chains are within their budgets whenever all bits are, wherever the differences lie; far pairs have none, mostly."""
    r = random.Random(11)
    rows, far = [], 0
    for k in range(3000):
        a, n = r.getrandbits(128), r.choice([0, 1, 5, 20, 39, 40, 41, 64])
        spread = r.sample(range(128), n) if k % 2 else list(range(k % 64, min(128, k % 64 + n)))
        b = a ^ sum(1 << j for j in spread)
        low = (1 << 64) - 1
        rows.append((len(spread), *(simhash.signed(v) for v in (a & low, a >> 64, b & low, b >> 64))))
    df = spark.createDataFrame(rows, "n int, a long, b long, c long, d long")
    pairs = df.selectExpr("n", "named_struct('x', a, 'y', b, 'size', 10) AS l", "named_struct('x', c, 'y', d, 'size', 10) AS r")
    for x in pairs.withColumn("close", simhash.close(0.8)).collect():
        assert x.close == (x.n <= simhash.FAR)
    for _ in range(500):
        d = r.getrandbits(128)
        far += any(all((d & mask).bit_count() <= most for mask, most in start) for start in simhash.ring())
    assert far < 150


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(5, "a b c d e f g", "x"), (5, "a b c d e f g", "y"), (None, "h i j k l m n", "z"), (None, "h i j k l m n", "z"), (None, "a b c d e f g", "u"), (3, "q", "q"), (None, None, "v"), (9, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    for name in ("node", "_node", "_times", "same", "x", "key", "root", "doc"):
        docs = docs.withColumn(name, F.col("_id"))
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == {(5, "a b c d e f g"): 1, (None, "h i j k l m n"): 1, (3, "q"): 1, (9, ""): 1}


def test_dense_keys_lose_no_pair(spark):
    """Texts that share half their words have dense keys; the pairs of 0.8 among them are all found, by whichever path."""
    r = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(200))
    texts = []
    for g in range(60):
        own = [f"o{g}x{k}" for k in range(220)]
        texts.append(shared + " " + " ".join(own))
        at = r.choice([5, 10, 20, 60])
        texts.append(shared + " " + " ".join(own[at:]))
    assert kept_of(spark, texts) == brute_kept(texts)
