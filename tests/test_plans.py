import pytest
from pyspark.sql import functions as F

from gridweave import registry
from gridweave.plans import stages


def add(df, by=0):
    return df.withColumn("v", F.col("v") + by)


def scale(df, by=1):
    return df.withColumn("v", F.col("v") * by)


STEPS = [stages.Step("add", add, {"by": 0}, bit=1), stages.Step("scale", scale, {"by": 1}, fast=False, bit=2), stages.Step("more", add, {"by": 0}, bit=4)]


def test_neutral_and_slow_steps_go():
    names = lambda *a, **k: [s.name for s in stages.plan(STEPS, *a, **k)]
    assert names({"add": {"by": 2}}) == ["add"]
    assert names({"add": {"by": 2}, "scale": {"by": 3}}) == ["add", "scale"]
    assert names({"add": {"by": 2}, "scale": {"by": 3}}, fast=True) == ["add"]


def test_only_what_changed_runs_again(spark):
    df = spark.range(3).withColumn("v", F.col("id"))
    inc = stages.Incremental(STEPS)
    params = {"add": {"by": 1}, "scale": {"by": 2}, "more": {"by": 5}}
    out, ran = inc.run(df, params)
    assert ran == ["add", "scale", "more"] and [r.v for r in out.collect()] == [7, 9, 11]
    params["more"] = {"by": 6}
    out, ran = inc.run(df, params, ["tone"], {"tone": 4, "raw": 1})
    assert ran == ["more"] and [r.v for r in out.collect()] == [8, 10, 12]
    assert inc.run(df, params, ["tone", "raw"], {"tone": 4, "raw": 1})[1] == ["add", "scale", "more"]
    assert inc.run(df, params, [], {})[1] == []


def test_overlay():
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert stages.overlay([{"b": {"c": 5}}, {"a": None, "b": {"d": 7}}], base) == {"a": 1, "b": {"c": 5, "d": 7}}


@pytest.mark.parametrize("tile,halo", [(4, 1), (3, 2), (8, 2), (16, 3)])
def test_tiles_hold_what_their_own_area_needs(spark, tile, halo):
    n = 10
    df = spark.range(n * n).select(F.lit(1).alias("img"), F.expr(f"cast(id div {n} as int)").alias("y"), (F.col("id") % n).cast("int").alias("x"), F.col("id").alias("v"))
    t = stages.tiles(df, tile, halo)
    rows = t.collect()
    for r in {(r.ty, r.tx, r.y0, r.x0) for r in rows}:
        have = {(p.y, p.x) for p in rows if (p.ty, p.tx) == r[:2]}
        assert have == {(y, x) for y in range(max(0, r[2] - halo), min(n, r[2] + tile + halo)) for x in range(max(0, r[3] - halo), min(n, r[3] + tile + halo))}
    assert sorted((r.y, r.x, r.v) for r in stages.untile(t, tile).collect()) == sorted((r.y, r.x, r.v) for r in df.collect())


def test_a_map_over_images_does_not_shuffle(spark, sf_dir):
    for name in ("box_blur", "median3x3", "guided_filter", "flood_fill", "demosaic_bilinear", "lut_apply", "rule_override", "rgb_lab"):
        plan = registry.QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan, name
