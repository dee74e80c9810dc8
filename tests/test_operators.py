"""Operators against plain Python, and their edge cases."""

import math
import random
import re
import statistics as statistics_of

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import registry
from gridweave.functions import colour, text
from gridweave.operators import catalog, fixtures, histograms, matching, statistics


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("width", [3, 10, 1e18])
@pytest.mark.parametrize("tie", ["below", "above"])
def test_nearest_by_brute_force(spark, width, tie):
    r = random.Random(1)
    left = [(r.choice("ab"), r.randrange(60), i) for i in range(120)] + [("c", 5, 999)]
    right = [(r.choice("ab"), r.randrange(60), 1000 + i) for i in range(25)]
    got = matching.nearest(spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, m long"), ["k"], "t", "m", tie, width).collect()
    best = {}
    for k, t, m in right:
        best[k, t] = min(m, best.get((k, t), m))
    want = {}
    for k, t, i in left:
        near = [(abs(t - u), u if tie == "below" else -u, m) for (kk, u), m in best.items() if kk == k]
        want[i] = min(near)[2] if near else None
    assert {x.id: x.m for x in got} == want


def test_nearest_with_empty_sides(spark):
    left, right = spark.createDataFrame([("a", 1, 2)], "k string, t long, id long"), spark.createDataFrame([], "k string, t long, m long")
    assert [x.m for x in matching.nearest(left, right, ["k"], "t", "m").collect()] == [None]
    assert matching.nearest(left.limit(0), right, ["k"], "t", "m").collect() == []


def test_anchor_groups_compare_with_the_first(spark):
    rows = [("a", t) for t in (0, 4, 8, 11, 30)] + [("b", 5)]
    got = {(x.k, x.anchor): x.n for x in matching.anchor_groups(spark.createDataFrame(rows, "k string, t long"), "k", "t", 6).collect()}
    assert got == {("a", 0): 2, ("a", 8): 2, ("a", 30): 1, ("b", 5): 1}


def test_name_queries(spark):
    names = spark.createDataFrame([("Red-1.nef",), ("blue.nef",), ("green2",)], "n string")
    find = lambda q: {x.n for x in names.where(catalog.name_query(F.col("n"), q)).collect()}
    assert find("") == find(" , ") == {"Red-1.nef", "blue.nef", "green2"}
    assert find("RED, een") == {"Red-1.nef", "green2"} and find("!=red") == {"blue.nef", "green2"}


def test_toggles_and_matchers(spark):
    both = one(spark, a=catalog.tri_state(F.lit(False), True, True), b=catalog.tri_state(F.lit(False), True, False), c=catalog.tri_state(F.lit(False), False, True))
    assert tuple(both) == (True, False, True)
    v = F.lit("Maker X100")
    assert tuple(one(spark, a=catalog.matcher(v, False, "no"), b=catalog.matcher(v, True, "re:x1"), c=catalog.matcher(v, True, "maker x100"), d=catalog.matcher(v, True, "x100"))) == (True, True, True, False)


def test_eviction_counts(spark):
    df = spark.range(100).select("id", (F.col("id") * 7 % 100).alias("t"))
    assert catalog.evict(df, 100, "t", "id").count() == 0
    assert {x.t for x in catalog.evict(df, 80, "t", "id").collect()} == set(range(24))


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 0.999])
def test_nth_element(spark, share):
    r = random.Random(3)
    values = [r.choice([1.5, 2.5, r.random() * 100]) for _ in range(500)]
    got = statistics.nth_element(spark.createDataFrame([(v,) for v in values], "v double"), "v", share).collect()
    assert [x.value for x in got] == [sorted(values)[int(500 * share)]]


def test_percentiles_from_bins(spark):
    df = spark.range(1001).select((F.col("id") / 10).alias("v"))
    got = histograms.binned_percentiles(df, "v", (0.0, 0.25, 1.0)).first()
    assert got.p0 == pytest.approx(0, abs=0.2) and got.p1 == pytest.approx(25, abs=0.2) and got.p2 == 100.0
    same = spark.range(5).select(F.lit(3.0).alias("v"))
    assert histograms.binned_percentiles(same, "v", (0.5,)).first().p0 == 3.0


def test_match_of_a_distribution_with_itself(spark):
    bins = spark.createDataFrame([(k, 1 + k % 3) for k in range(20)], "bin long, n long")
    assert all(x.bin == x.match for x in histograms.match_cdf(bins, bins).collect())


def test_knots_and_tables(spark):
    v = [F.lit(x) for x in (800.0, 950.0, 2500.0)]
    assert tuple(one(spark, a=matching.between_knots(v[0]), b=matching.between_knots(v[1]), c=matching.between_knots(v[2]))) == pytest.approx((0.5, 0.65, 0.1))
    t = [0.0, 10.0, 30.0]
    look = lambda x, **k: colour.lookup(F.lit(x), t, **k)
    assert tuple(one(spark, a=look(0.5), b=look(-1.0), c=look(5.0), d=look(-1.0, clip_below=False), e=look(3.0, clip_above=False))) == (5.0, 0.0, 30.0, -10.0, 50.0)


def test_texts(spark):
    s = lambda x: text.shutter_text(F.lit(x))
    assert tuple(one(spark, a=s(0.004), b=s(0.5), c=s(2.0), d=s(2.5), e=s(0.7))) == ("1/250", "1/2", "2", "2.5", "0.7")
    p = lambda x: text.shutter_parse(F.lit(x))
    assert tuple(one(spark, a=p("1/250"), b=p("3"), c=p("1/0"), d=p("x"), e=p(""))) == (0.004, 3.0, 0.0, 0.0, 0.0)
    path = F.lit("/a/b.c/d.e.NEF")
    got = one(spark, base=text.base_name(path), ext=text.extension(path), none=text.extension(F.lit("/a.b/c")), name=text.name_template("%p1/%f_%s3%%.%e", path, F.lit(1), F.lit(7), F.lit(None).cast("date")), rel=text.relative_path(path, "/a/"))
    assert tuple(got) == ("d.e", "NEF", "", "b.c/d.e_007%.NEF", "b.c/d.e.NEF")


def test_significant_digits(spark):
    s = lambda x: text.significant(F.lit(x), 2)
    assert tuple(one(spark, a=s(0.01234), b=s(1250.0), c=s(0.0))) == pytest.approx((0.012, 1300.0, 0.0))


def test_best_spelling(spark):
    df = spark.createDataFrame([("Lens A",), ("lens b",), ("other",)], "n string")
    got = {x.n: x.match for x in matching.best_spelling(df, "n", ("Lens A", "Lens B"), 1).collect()}
    assert got == {"Lens A": "Lens A", "lens b": "Lens B", "other": None}


def test_lookup_falls_back(spark):
    df = spark.createDataFrame([("m", 1), ("m", 2), ("x", 1)], "make string, serial int")
    exact, general = spark.createDataFrame([("m", 1, "e")], "make string, serial int, v string"), spark.createDataFrame([("m", "g")], "make string, v string")
    got = {(x.make, x.serial): x.v for x in catalog.lookup_fallback(df, exact, general, ["make", "serial"], ["make"], "v").collect()}
    assert got == {("m", 1): "e", ("m", 2): "g", ("x", 1): None}


def test_student_t(spark):
    a, b = [1.0, 2.0, 4.0, 5.0], [2.0, 6.0, 7.0]
    df = spark.createDataFrame([(x, "a") for x in a] + [(x, "b") for x in b], "v double, k string")
    ma, mb = sum(a) / 4, sum(b) / 3
    pooled = (sum((x - ma) ** 2 for x in a) + sum((x - mb) ** 2 for x in b)) / 5
    assert statistics.student_t(df, "v", F.col("k") == "a", F.col("k") == "b").first().t == pytest.approx((ma - mb) / (pooled * (1 / 4 + 1 / 3)) ** 0.5)


def test_surface_fit(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y")).withColumn("v", 1.0 + 2 * F.col("x") - 3 * F.col("y") + 0.5 * F.col("x") * F.col("y"))
    assert statistics.fit_plane(df, "x", "y", "v").tolist() == pytest.approx([1, 2, -3, 0.5])


def brute_images(spark, sf_dir):
    return {r.img: r.a for r in fixtures.planes(spark, sf_dir).collect()}


def test_median5x5_covers_all_images(spark, sf_dir):
    images = brute_images(spark, sf_dir)
    got = {(r.img, r.y, r.x): r.b for r in registry.QUERIES["median5x5"].run(spark, sf_dir).collect()}
    assert len(got) == 64 * len(images)
    for img in (min(images), 99, 100, max(images)):
        a = images[img]
        for y in range(8):
            for x in range(8):
                around = [a[v * 8 + u] for v in range(max(0, y - 2), min(8, y + 3)) for u in range(max(0, x - 2), min(8, x + 3))]
                assert got[img, y, x] == pytest.approx(statistics_of.median(around), abs=2e-6)


def test_bad_pixel_interpolate_covers_all_images(spark, sf_dir):
    images = brute_images(spark, sf_dir)
    got = {(r.img, r.y, r.x): r.b for r in registry.QUERIES["bad_pixel_interpolate"].run(spark, sf_dir).collect()}
    assert len(got) == 64 * len(images)
    for img in (min(images), 199, 200, max(images)):
        a = images[img]
        for y in range(8):
            for x in range(8):
                want = a[y * 8 + x]
                if abs(want) > 0.3 and 2 <= y <= 5 and 2 <= x <= 5:
                    pairs = [(a[(y + dy) * 8 + x + dx], a[(y - dy) * 8 + x - dx]) for dy, dx in ((0, 2), (2, 0), (2, 2), (2, -2))]
                    want = sum((p + q) / 2 / (abs(p - q) + 0.01) for p, q in pairs) / sum(1 / (abs(p - q) + 0.01) for p, q in pairs)
                assert got[img, y, x] == pytest.approx(want, abs=2e-6)


def test_auto_threshold_covers_all_images(spark, sf_dir):
    images = brute_images(spark, sf_dir)
    got = {r.img: r.threshold for r in registry.QUERIES["auto_threshold"].run(spark, sf_dir).collect()}
    assert got.keys() == images.keys()
    step = lambda v, c: 0.5 * (1 + (s := abs(v) * 16 / (c / 100) - 16) / math.sqrt(1 + s * s))
    for img in (min(images), 59, 60, max(images)):
        assert got[img] == next((c for c in range(1, 100) if sum(step(v, c) for v in images[img]) <= 0.64), 100)


def test_coordinate_transform_covers_all_images(spark, sf_dir):
    images = brute_images(spark, sf_dir)
    rows = registry.QUERIES["coordinate_transform"].run(spark, sf_dir).collect()
    assert len(rows) == 64 * len(images) and {r.img for r in rows} == images.keys()
    for r in (r for r in rows if r.img in (49, 50, max(images))):
        u, v = (r.x - 3.5) / 1.1, (r.y - 3.5) / 1.1
        xr, yr = u * math.cos(0.2) - v * math.sin(0.2), u * math.sin(0.2) + v * math.cos(0.2)
        k = 1 + 0.05 * (xr * xr + yr * yr) / 12.25
        assert (r.sy, r.sx, r.r) == pytest.approx((yr * k + 3.5, xr * k + 3.5, math.hypot(r.x, r.y)), abs=2e-6)


def test_queue_to_head_places_every_row(spark, sf_dir):
    events = sorted((r.event_type != "error", r.event_id) for r in registry.table(spark, sf_dir, "events").collect())
    got = registry.QUERIES["queue_to_head"].run(spark, sf_dir).collect()
    assert len(events) > 200 and sorted((r.place, r.event_id, r.selected) for r in got) == [(i + 1, e, not other) for i, (other, e) in enumerate(events)]


def test_catalog_sort_descending_sorts_the_whole_catalogue(spark, sf_dir):
    rows = registry.QUERIES["catalog_sort_descending"].run(spark, sf_dir).collect()
    parts = registry.table(spark, sf_dir, "part").collect()
    want = sorted(((r.p_retailprice, r.p_name, r.p_partkey) for r in parts), reverse=True)
    assert len(parts) > 50 and [(r.focal, r.name, r.id) for r in rows] == want


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "part", "lineitem"):
        if (sf_dir / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(registry.QUERIES[name].sql)
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert want and sorted(repr(tuple(r[c] for c in columns)) for r in registry.QUERIES[name].run(spark, str(sf_dir)).collect()) == want


def test_nearest_settings_with_missing_and_odd_values(spark, tmp_path):
    r = random.Random(5)
    odd = [None, -1.0, -3.5, float("nan"), float("inf"), 0.0]
    k = lambda: r.choice(["{}", '{"k": -1}', '{"k": -4}', '{"k": 7}'] if r.random() < 0.3 else [f'{{"k": {r.randrange(9)}}}'])
    rows = [(i, r.choice([0, 1, 2, 52, None]), r.choice(["purchase", "error"]), r.choice(odd) if r.random() < 0.3 else round(r.random() * 40, 1), k()) for i in range(300)]
    rows += [(900, 7, "purchase", 1.0, '{"k": 1}'), (901, 7, "error", 3.0, "{}"), (902, 8, "purchase", 1.0, '{"k": 1}'), (903, 8, "error", -9.0, '{"k": 1}'), (904, 9, "purchase", 1.0, '{"k": 1}')]
    rows += [(905, 10, "purchase", 1.0, '{"k": 1}'), (906, 10, "error", None, '{"k": 1}'), (907, 10, "error", 5.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') TO '{tmp_path}/one.parquet'")
    (tmp_path / "in").mkdir()
    (tmp_path / "one.parquet").rename(tmp_path / "in" / "events.parquet")
    same_as_sql(spark, tmp_path / "in", "nearest_by_log_distance")


@pytest.mark.parametrize("flat", [(), ("a",), ("b",), ("a", "b")])
def test_nearest_settings_by_brute_force_in_small_cells(spark, monkeypatch, flat):
    kept = {}
    monkeypatch.setattr(matching, "keep", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    r = np.random.default_rng(2)
    draw = lambda n: [(i, "m", 1.0 if "a" in flat else float(a), 2.0 if "b" in flat else float(b)) for i, (a, b) in enumerate(zip(np.exp(r.normal(size=n)).round(3), r.integers(1, 100, n), strict=True))]
    left, right = draw(1500) + [(9000, "m", 1e-6, 1e6), (9001, "other", 1.0, 1.0)], draw(6000)
    schema = "{} long, model string, a double, b double"
    got = matching.nearest_settings(spark.createDataFrame(left, schema.format("event_id")), spark.createDataFrame(right, schema.format("template")), ["model"]).collect()
    a, b = (np.array([x[c] for x in right]) for c in (2, 3))
    want = {}
    for i, _, x, y in left[:-1]:
        d = np.sqrt(np.log2(x / a) ** 2 + np.log2(y / b) ** 2).round(6)
        want[i] = (float(d.min()), int(d.argmin()))
    assert {x.event_id: (x.distance, x.template) for x in got} == want
    if not flat:
        assert max(x.n for x in kept["cells"].select(F.size("t").alias("n")).collect()) <= 4 * matching.CELL


def test_nearest_level_keeps_parts_without_size_or_brand(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i::BIGINT AS p_partkey, CASE WHEN i % 11 > 0 THEN 'b' || (i % 3) END AS p_brand, CASE WHEN i % 5 > 0 THEN (i * 13 % 50)::INT END AS p_size FROM range(200) t(i) UNION ALL SELECT 1, 'alone', 5 UNION ALL SELECT 2, 'alone', NULL) TO '{tmp_path}/part.parquet'")
    same_as_sql(spark, tmp_path, "nearest_level")


def test_no_frame_reaches_to_the_end(spark, sf_dir):
    """Such a frame is worked out anew for each row."""
    for name in ("nearest_level", "nearest_template"):
        plan = registry.QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("around", [0.002, 0.0])
def test_percentiles_of_groups_need_no_table_of_all_values(spark, tmp_path, monkeypatch, around):
    monkeypatch.setattr(statistics, "AROUND", around)
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CASE i % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS l_returnflag, CASE WHEN i % 4 = 2 OR i % 7 = 0 THEN NULL WHEN i % 4 = 1 THEN i % 3 ELSE i * 7919 % 10007 / 100 END::DOUBLE AS l_extendedprice,
        CASE WHEN i % 9 > 0 THEN i % 40 END::BIGINT AS l_partkey FROM range(5000) t(i) UNION ALL SELECT 'D', 5.5, 1 UNION ALL SELECT 'E', 1.25, 1 UNION ALL SELECT 'E', 2.5, NULL) TO '{tmp_path}/lineitem.parquet'""")
    same_as_sql(spark, tmp_path, "table_percentiles")
    plan = registry.QUERIES["table_percentiles"].run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx(" in plan and not re.search(r"\b(percentile|median)\(", plan)
