import re
from collections import defaultdict

import duckdb
import pytest

from gridweave.llm import common, mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        share = sum(weight[s] for s in rest)
        target = {s: most * sizes[s] if s in stopped else left * weight[s] / share for s in names}
        over = {s for s in rest if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        stopped |= over


def sizes_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len(re.findall(common.WORD, r.text or ""))
    return dict(out)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 50, None: 7}, {"b": 5}, {"é": 10, "z": 10, "Z": 4000, "y": 0}, {f"s{i}": 3**i for i in range(9)}])
def test_targets_match_repeated_sharing(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(want)


def test_mix_matches_sql_and_targets(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    rows = mixing.mix(docs).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    cur = con.execute(mixing.MIX_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(cur.fetchall())
    want, taken = brute_targets(sizes_of(docs.collect())), defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.03 * t + 20 for s, t in want.items())


def test_hard_documents(hard_docs, no_docs):
    rows = mixing.mix(hard_docs, carry=True).collect()
    assert len(rows) == hard_docs.count()
    want, taken = brute_targets(sizes_of(hard_docs.collect())), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(common.WORD, r.doc.text or "")) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(hard_docs, carry=True).collect()))
    assert mixing.mix(no_docs).collect() == []


def test_targets_are_met_by_equal_documents(spark):
    docs = spark.range(40_000).selectExpr("id doc_id", "'w x y z' text", "if(id % 4 = 0, 'a', 'b') source")
    got = mixing.mix(docs).groupBy("source").sum("taken").collect()
    want = brute_targets({"a": 40_000, "b": 120_000})
    assert {r[0]: r[1] for r in got} == pytest.approx(want, abs=4)


def brute_copies(words, target, most=3.0):
    """Expected copies by size class, by halving the level until the words fit."""
    low, high = 0.0, 1e6
    of = lambda level: {c: min(most, level * (1 + c / 8)) for c in words}
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(of(mid)[c] * n for c, n in words.items()) < target else (low, mid)
    return of(high)


def test_inclusion_frequencies_are_the_stated_ones(spark):
    """150 sources alike but for their weights are as many draws: how often a size is taken once more is its inclusion."""
    sizes = [1, 2, 3, 5, 9, 17, 33, 40, 70, 140] * 6
    rows = [(s * 1000 + k, " ".join(["w"] * n), f"s{s:03d}") for s in range(150) for k, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by, words = defaultdict(list), defaultdict(int)
    for n in sizes:
        words[n.bit_length() - 1] += n
    for r in got:
        by[int(r.source[1:]) % 3, r.size.bit_length() - 1].append(r.copies)
    seen = set()
    for (k, c), copies in by.items():
        want = brute_copies(words, next(r.target for r in got if int(r.source[1:]) % 3 == k))[c]
        assert {x - int(want + 1e-9) for x in copies} <= {0, 1}
        deviation = (want % 1 * (1 - want % 1) / len(copies)) ** 0.5
        assert abs(sum(copies) / len(copies) - want) < 4 * deviation + 0.03
        seen.add(round(want, 3))
    assert len(seen) > 12  # the inclusion differs by source and by size


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "t"), (3, None, None)], "doc_id long, text string, source string")
    for name in ("size", "copies", "taken", "target", "source_size", "_copy", "_u", "_p", "_class", "doc"):
        docs = docs.withColumn(name, docs.text)
    rows = mixing.mix(docs, carry=True).select("doc.*")
    assert rows.schema == docs.schema and sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))
