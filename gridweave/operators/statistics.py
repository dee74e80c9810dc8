"""Means, deviations, order statistics, white balance, fits: aggregates that go to the network as one row a group and task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register, table
from .fixtures import MOSAIC, PX, SIDE, explode_plane, hold, mosaic, pixels, planes


def mean_std(column: str) -> tuple[Column, Column]:
    """Population mean and deviation from sums; rounding never makes the variance negative."""
    mean = F.avg(column)
    return mean, F.sqrt(F.greatest(F.avg(F.col(column) * F.col(column)) - mean * mean, F.lit(0.0)))


@register("mean_std", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(sqrt(greatest(avg(l_discount * l_discount) - avg(l_discount) ** 2, 0)), 6) AS std FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    mean, std = mean_std("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"))


@register("mad", f"WITH {PX} SELECT img, round(median(abs(v)) / 0.6745, 6) AS mad FROM px GROUP BY img")
def _(spark, sf_dir):
    """Median of absolute values over 0.6745, within each image's row: nothing is shuffled."""
    s = F.array_sort(F.transform("a", F.abs))
    n = F.size("a")
    middle = (F.get(s, F.expr("(size(a) - 1) div 2").cast("int")) + F.get(s, F.expr("size(a) div 2").cast("int"))) / 2
    return planes(spark, sf_dir).where(n > 0).select("img", F.round(middle / 0.6745, 6).alias("mad"))


@register("mad_bins", "WITH b AS (SELECT l_linenumber AS lvl, least(trunc(abs(l_extendedprice - 50000))::BIGINT, 32767) AS bin, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY lvl ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY lvl) AS total FROM b) SELECT lvl, round(arg_min(bin + (total / 2.0 - (cum - n)) / n, bin) FILTER (cum >= total / 2.0) / 0.6745, 4) AS mad FROM r GROUP BY lvl")
def _(spark, sf_dir):
    """The same from a histogram of absolute values that ends at a cap."""
    bins = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("lvl"), F.least(F.abs(F.col("l_extendedprice") - 50000).cast("long"), F.lit(32767)).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lvl")
    r = bins.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    half = F.col("total") / 2.0
    inside = F.col("bin") + (half - (F.col("cum") - F.col("n"))) / F.col("n")
    return r.groupBy("lvl").agg(F.round(F.min_by(inside, F.when(F.col("cum") >= half, F.col("bin"))) / 0.6745, 4).alias("mad"))


@register("tail_stats", "WITH l AS (SELECT l_returnflag AS f, (l_extendedprice - 40000) / 500 AS v FROM lineitem), m AS (SELECT f, avg(v) FILTER (v >= 32.7) AS up, avg(v) FILTER (v < -32.7) AS down, max(v) AS hi, min(v) AS lo FROM l GROUP BY f) SELECT f, round(up, 4) AS up, round(down, 4) AS down, round(hi, 4) AS hi, round(lo, 4) AS lo, round(sqrt(avg((v - up) ** 2) FILTER (v >= 32.7)), 4) AS up_std, round(sqrt(avg((v - down) ** 2) FILTER (v <= -32.7)), 4) AS down_std FROM l JOIN m USING (f) GROUP BY ALL")
def _(spark, sf_dir):
    """Means beyond a threshold either way, and deviations about them, from sums of one pass: the lower mean leaves the threshold itself out, the lower deviation does not."""
    v = (F.col("l_extendedprice") - 40000) / 500
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), v.alias("v"))
    when = lambda c, x: F.when(c, x)
    over, under, under_or = F.col("v") >= 32.7, F.col("v") < -32.7, F.col("v") <= -32.7
    sums = df.groupBy("f").agg(
        F.avg(when(over, F.col("v"))).alias("up"), F.avg(when(under, F.col("v"))).alias("down"), F.max("v").alias("hi"), F.min("v").alias("lo"),
        F.avg(when(over, F.col("v") ** 2)).alias("u2"), F.avg(when(under_or, F.col("v") ** 2)).alias("d2"), F.avg(when(under_or, F.col("v"))).alias("d1"),
    )
    up_std, down_std = F.sqrt(F.col("u2") - F.col("up") ** 2), F.sqrt(F.col("d2") - 2 * F.col("d1") * F.col("down") + F.col("down") ** 2)
    return sums.select("f", *(F.round(c, 4).alias(c) for c in ("up", "down", "hi", "lo")), F.round(up_std, 4).alias("up_std"), F.round(down_std, 4).alias("down_std"))


@register("subband_stats", "SELECT l_linenumber AS lvl, l_returnflag AS dir, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sigma FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("lvl"), F.col("l_returnflag").alias("dir")).agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_pop("l_discount"), 6).alias("sigma"))


#: Fixed values of the white-balance query: camera matrix by row.
CAMERA = ((0.6, 0.3, 0.1), (0.2, 0.7, 0.1), (0.05, 0.15, 0.8))


@register("grey_world", f"WITH {MOSAIC}, m AS (SELECT img, " + ", ".join(f"coalesce(avg(v + 1) FILTER (c = {c} AND v <= 0.25), 0) AS m{c}" for c in range(3)) + " FROM mo GROUP BY img) SELECT img, " + ", ".join(f"round({a} * m0 + {b} * m1 + {c} * m2, 6) AS {n}" for n, (a, b, c) in zip("rgb", CAMERA)) + " FROM m")
def _(spark, sf_dir):
    """Mean of each colour's unclipped sites, 0 without any, through the camera's matrix."""
    m = mosaic(spark, sf_dir).groupBy("img").agg(*(F.coalesce(F.avg(F.when((F.col("c") == c) & (F.col("v") <= 0.25), F.col("v") + 1)), F.lit(0.0)).alias(f"m{c}") for c in range(3)))
    return m.select("img", *(F.round(sum(w * F.col(f"m{c}") for c, w in enumerate(row)), 6).alias(n) for n, row in zip("rgb", CAMERA, strict=True)))


@register("spot_white_balance", f"WITH {MOSAIC} SELECT img, c, round(avg(v), 6) AS mean, round(max(v), 6) AS most, count(*) AS n FROM mo WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND v < 0.3 GROUP BY ALL")
def _(spark, sf_dir):
    """Mean and most of a rectangle's sites below clipping, by colour."""
    df = mosaic(spark, sf_dir).where(F.col("x").between(2, 5) & F.col("y").between(2, 5) & (F.col("v") < 0.3))
    return df.groupBy("img", "c").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.count("*").alias("n"))


@register("channel_medians", f"WITH {MOSAIC} SELECT img, c, round(median(v), 6) AS median FROM mo WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY ALL")
def _(spark, sf_dir):
    return mosaic(spark, sf_dir).where(F.col("x").between(1, 6) & F.col("y").between(1, 6)).groupBy("img", "c").agg(F.round(F.median("v"), 6).alias("median"))


def student_t(df: DataFrame, column: str, first: Column, second: Column) -> DataFrame:
    """Two-sample t of equal variances, from counts, sums and sums of squares."""
    s = df.agg(*(f(F.when(w, e)).alias(f"{n}{k}") for k, w in ((1, first), (2, second)) for n, f, e in (("n", F.count, F.lit(1)), ("s", F.sum, F.col(column)), ("q", F.sum, F.col(column) ** 2))))
    m = lambda k: F.col(f"s{k}") / F.col(f"n{k}")
    rest = lambda k: F.col(f"q{k}") - F.col(f"s{k}") * m(k)
    pooled = (rest(1) + rest(2)) / (F.col("n1") + F.col("n2") - 2)
    return s.select(((m(1) - m(2)) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), F.col("n1").alias("n1"), F.col("n2").alias("n2"))


@register("student_t", "WITH s AS (SELECT count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_pop(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_pop(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem) SELECT round((m1 - m2) / sqrt((v1 * n1 + v2 * n2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 5) AS t, n1, n2 FROM s")
def _(spark, sf_dir):
    f = F.col("l_returnflag")
    return student_t(table(spark, sf_dir, "lineitem"), "l_extendedprice", f == "A", f == "R").withColumn("t", F.round("t", 5))


@register("candidate_search", "WITH h AS (SELECT l_linenumber AS k, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem GROUP BY 1), c AS (SELECT g / 40.0::DOUBLE AS gain FROM range(1, 81) t(g)) SELECT arg_min(gain, (round(e, 9), gain)) AS gain, round(min(e), 6) AS error FROM (SELECT gain, sum((x * gain - y) ** 2) AS e FROM h, c GROUP BY gain)")
def _(spark, sf_dir):
    """The candidate gain that brings the classes' means closest. Classes are few; candidates are an array beside them."""
    h = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))
    c = h.select("x", "y", F.explode(F.array(*(F.lit(g / 40.0) for g in range(1, 81)))).alias("gain"))
    e = c.groupBy("gain").agg(F.sum((F.col("x") * F.col("gain") - F.col("y")) ** 2).alias("e"))
    return e.agg(F.min_by("gain", F.struct(F.round("e", 9), "gain")).alias("gain"), F.round(F.min("e"), 6).alias("error"))


@register("green_equil", f"WITH {MOSAIC}, g AS (SELECT img, avg(v + 1) FILTER (y % 2 = 0) AS a, avg(v + 1) FILTER (y % 2 = 1) AS b FROM mo WHERE c = 1 GROUP BY img) SELECT img, y, x, round(CASE WHEN c <> 1 THEN v + 1 WHEN y % 2 = 0 THEN (v + 1) * (a + b) / 2 / CASE WHEN a = 0 THEN 1 ELSE a END ELSE (v + 1) * (a + b) / 2 / CASE WHEN b = 0 THEN 1 ELSE b END END, 6) AS v FROM mo JOIN g USING (img)")
def _(spark, sf_dir):
    """Greens of even and odd rows get one mean. Each image is a row, so its means need neither shuffle nor join."""
    of = lambda k: F.filter(F.transform("a", lambda v, i: F.when((F.floor(i / SIDE) % 2 == k) & ((F.floor(i / SIDE) + i % SIDE) % 2 == 1), v + 1)), lambda v: v.isNotNull())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    df = hold(hold(planes(spark, sf_dir), "e", mean(of(0))), "o", mean(of(1)))
    both = (F.col("e") + F.col("o")) / 2
    gain = lambda c: both / F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    green = lambda i: (F.floor(i / SIDE) + i % SIDE) % 2 == 1
    v = F.transform("a", lambda v, i: F.round(F.when(~green(i), v + 1).when(F.floor(i / SIDE) % 2 == 0, (v + 1) * gain("e")).otherwise((v + 1) * gain("o")), 6))
    return explode_plane(df.withColumn("v", v), "v")


@register("channel_minima", f"WITH {MOSAIC} SELECT c, round(min(v - CASE c WHEN 0 THEN -0.3 WHEN 1 THEN -0.2 ELSE -0.25 END) FILTER (v >= CASE c WHEN 0 THEN -0.3 WHEN 1 THEN -0.2 ELSE -0.25 END), 6) AS least FROM mo GROUP BY c")
def _(spark, sf_dir):
    black = F.when(F.col("c") == 0, -0.3).when(F.col("c") == 1, -0.2).otherwise(-0.25)
    return mosaic(spark, sf_dir).groupBy("c").agg(F.round(F.min(F.when(F.col("v") >= black, F.col("v") - black)), 6).alias("least"))


@register("global_max_normalise", "WITH m AS (SELECT max(greatest(l_quantity, l_extendedprice / 100, l_tax)) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / greatest(2 * m, 65535) * 1000, 6) AS v FROM lineitem, m")
def _(spark, sf_dir):
    """Divide by the largest value of any channel: one row a task for the maximum, then a map."""
    df = table(spark, sf_dir, "lineitem")
    most = df.agg(F.max(F.greatest("l_quantity", F.col("l_extendedprice") / 100, "l_tax")).alias("m"))
    rows = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(F.broadcast(most))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / F.greatest(2 * F.col("m"), F.lit(65535.0)) * 1000, 6).alias("v"))


@register("dark_channel", f"WITH {PX} SELECT img, (y // 4)::INT AS ty, (x // 4)::INT AS tx, round(min((v + 1) / 1.5), 6) AS dark, round(min(v), 6) AS least FROM px GROUP BY ALL")
def _(spark, sf_dir):
    """Least value of each patch, over the ambient light and as it is."""
    t = lambda c: F.expr(f"cast({c} div 4 as int)")
    return pixels(spark, sf_dir).groupBy("img", t("y").alias("ty"), t("x").alias("tx")).agg(F.round(F.min((F.col("v") + 1) / 1.5), 6).alias("dark"), F.round(F.min("v"), 6).alias("least"))


def nth_element(df: DataFrame, column: str, share: float) -> DataFrame:
    """The value at place int(n * share) of the sorted column. Bins halve the search: the bin that holds the place is found by counts, and only its rows are sorted."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    place, size = int(n * share), 65536
    scale = (size - 1) / (high - low) if n and high > low else 0.0
    index = ((F.col(column) - F.lit(low)) * F.lit(scale)).cast("long")
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = df.groupBy(index.alias("bin")).agg(F.count("*").alias("n")).withColumn("cum", F.sum("n").over(w)).where(F.col("cum") > place).orderBy("bin").limit(1).first()
    inside = df.where(index == (at["bin"] if at else -1)).select(column).withColumn("r", F.row_number().over(Window.orderBy(column)))
    return inside.where(F.col("r") == place - (at["cum"] - at["n"] if at else 0) + 1).select(F.col(column).alias("value"))


#: How far about a share, of all rows, its value is looked for first.
AROUND = 0.002


def percentiles(df: DataFrame, by: str, column: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, p0, p1, ...): exact percentiles of each group, straight between the two values about a place; groups without a value are left out.

    Approximate percentiles, from partial aggregates, cut each group's range close about each share. Counts of the runs between cuts tell which
    run holds a place, and only its values are sorted. The cuts settle how much is sorted, not the result.
    """
    df = df.where(F.col(column).isNotNull()).select(F.col(by).alias("_by"), F.col(column).alias("_v"))
    about = [min(1.0, max(0.0, s + d)) for s in shares for d in (-AROUND, AROUND)]
    cuts = df.groupBy(F.col("_by").alias("_of")).agg(F.percentile_approx("_v", about).alias("_cuts"), F.count("*").alias("_n"))
    run = sum((F.col("_v") >= F.get("_cuts", F.lit(i))).cast("int") for i in range(len(about)))
    rows = df.join(F.broadcast(cuts), F.col("_by").eqNullSafe(F.col("_of"))).select("_by", "_v", "_n", run.alias("_run"))
    w = Window.partitionBy("_of").orderBy("_in")
    runs = rows.groupBy(F.col("_by").alias("_of"), F.col("_run").alias("_in"), "_n").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    place = [(F.col("_n") - 1) * F.lit(float(s)) for s in shares]
    ends = [(F.floor(k), F.ceil(k)) for k in place]
    held = F.lit(False)
    for k in (k for pair in ends for k in pair):
        held = held | ((F.col("_before") <= k) & (k < F.col("_before") + F.col("_c")))
    runs = runs.where(held).select("_of", "_in", "_before")
    inside = rows.join(F.broadcast(runs), F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_in")))
    inside = inside.groupBy("_by", "_run", "_before", "_n", "_v").agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy("_by", "_run").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    value = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    part = lambda a, b, k: F.when(a == b, a).otherwise(a + (b - a) * F.max(k - F.floor(k)))
    return inside.groupBy(F.col("_by").alias(by)).agg(*(part(value(a), value(b), k).alias(f"p{i}") for i, ((a, b), k) in enumerate(zip(ends, place, strict=True))))


@register("ambient_quantile", "WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem), q AS (SELECT v AS q FROM r WHERE r = trunc(n * 0.95)::BIGINT) SELECT round(q, 6) AS quantile, round(avg(v), 4) AS ambient, count(*) AS n FROM r, q WHERE v >= q GROUP BY q")
def _(spark, sf_dir):
    """The order statistic at 95 %, and the mean of what is not below it."""
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    q = nth_element(df, "l_extendedprice", 0.95)
    rows = df.join(F.broadcast(q), F.col("l_extendedprice") >= F.col("value"))
    return rows.groupBy(F.round("value", 6).alias("quantile")).agg(F.round(F.avg("l_extendedprice"), 4).alias("ambient"), F.count("*").alias("n"))


@register("tile_dispersion", f"WITH {PX} SELECT img, (y // 4)::INT AS ty, (x // 4)::INT AS tx, round(avg(v + 1), 6) AS mean, round(var_pop(v + 1) / avg(v + 1), 6) AS dispersion FROM px GROUP BY ALL")
def _(spark, sf_dir):
    """Mean of each tile and its variance over the mean, null where that is 0."""
    t = lambda c: F.expr(f"cast({c} div 4 as int)")
    v = F.col("v") + 1
    return pixels(spark, sf_dir).groupBy("img", t("y").alias("ty"), t("x").alias("tx")).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.try_divide(F.var_pop(v), F.avg(v)), 6).alias("dispersion"))


def blend_factor(x: Column, threshold: Column | float) -> Column:
    """A smooth step that is a half at the threshold."""
    s = x * 16.0 / threshold - 16.0
    return 0.5 * (1.0 + s / F.sqrt(1.0 + s * s))


def auto_threshold(df: DataFrame) -> DataFrame:
    """The least of 99 thresholds at which the step's sum over the image is 1 % at most; all within the image's row."""
    total = lambda c: F.aggregate("a", F.lit(0.0), lambda s, v: s + blend_factor(F.abs(v), c / 100.0))
    fits = F.filter(F.sequence(F.lit(1), F.lit(99)), lambda c: total(c) <= F.size("a") / 100.0)
    return df.select("img", F.coalesce(F.get(fits, F.lit(0)), F.lit(100)).cast("int").alias("threshold"))


@register("auto_threshold", f"WITH {PX}, s AS (SELECT img, c, sum(0.5 * (1 + (abs(v) * 16.0 / (c / 100.0) - 16.0) / sqrt(1 + (abs(v) * 16.0 / (c / 100.0) - 16.0) ** 2))) AS s, count(*) AS n FROM px, range(1, 100) t(c) GROUP BY ALL) SELECT img, coalesce(min(c) FILTER (s <= n / 100.0), 100)::INT AS threshold FROM s GROUP BY img")
def _(spark, sf_dir):
    return auto_threshold(planes(spark, sf_dir))


@register("dot_product", f"WITH {PX} SELECT a.img, round(sum(a.v * b.v), 6) AS dot FROM px a JOIN px b ON b.img = a.img + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.img")
def _(spark, sf_dir):
    """Of each image with the next one: a join of rows that hold whole images."""
    p = planes(spark, sf_dir)
    q = p.select((F.col("img") - 1).alias("img"), F.col("a").alias("b"))
    return p.join(q, "img").select("img", F.round(F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v), 6).alias("dot"))


@register("mode_average_frames", f"WITH {PX} SELECT img // 4 AS grp, y, x, round(avg(v), 6) AS mean, (sum(trunc((v + 1) * 1000)::BIGINT) // count(*))::BIGINT AS whole FROM px GROUP BY ALL")
def _(spark, sf_dir):
    """Frames of a template as a mean, and as a mean of whole numbers that drops the rest."""
    p = pixels(spark, sf_dir)
    whole = F.expr("sum(cast((v + 1) * 1000 as bigint)) div count(*)")
    return p.groupBy(F.expr("img div 4").alias("grp"), "y", "x").agg(F.round(F.avg("v"), 6).alias("mean"), whole.alias("whole"))


@register("reject_frames", "WITH f AS (SELECT l_linenumber AS frame, stddev_pop(l_extendedprice) + l_linenumber * 800 AS e FROM lineitem GROUP BY l_linenumber) SELECT frame, e > 1.05 * avg(e) OVER () AND count(*) OVER () >= 5 AS bad FROM f")
def _(spark, sf_dir):
    """Frames whose error is over a factor of the mean, if there are at least five."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("frame")).agg((F.stddev_pop("l_extendedprice") + F.col("l_linenumber") * 800).alias("e"))
    whole = Window.partitionBy()
    return f.select("frame", ((F.col("e") > 1.05 * F.avg("e").over(whole)) & (F.count("*").over(whole) >= 5)).alias("bad"))


@register("noise_residual", f"WITH {PX}, m AS (SELECT img, y % 3 AS dir, median(abs(v)) / 0.6745 AS m FROM px GROUP BY ALL) SELECT img, round(sum(m * m), 6) AS total, round(max(m * m), 6) AS most FROM m GROUP BY img")
def _(spark, sf_dir):
    m = pixels(spark, sf_dir).groupBy("img", (F.col("y") % 3).alias("dir")).agg((F.median(F.abs("v")) / 0.6745).alias("m"))
    return m.groupBy("img").agg(F.round(F.sum(F.col("m") ** 2), 6).alias("total"), F.round(F.max(F.col("m") ** 2), 6).alias("most"))


@register("auto_denoise", f"WITH {PX}, t AS (SELECT img, (y // 4) * 2 + x // 4 AS tile, stddev_pop(v) AS s FROM px GROUP BY ALL), m AS (SELECT img, avg(s) AS mean, max(s) AS most, count(*) AS n FROM t GROUP BY img) SELECT img, round((mean * n - most) / (n - 1) * CASE WHEN most > 0.14 THEN 0.8 WHEN most > 0.12 THEN 0.9 ELSE 1.0 END, 6) AS level FROM m")
def _(spark, sf_dir):
    """Mean over tiles without the noisiest, times a factor by the noisiest."""
    t = pixels(spark, sf_dir).groupBy("img", F.expr("(y div 4) * 2 + x div 4").alias("tile")).agg(F.stddev_pop("v").alias("s"))
    m = t.groupBy("img").agg(F.avg("s").alias("mean"), F.max("s").alias("most"), F.count("*").alias("n"))
    factor = F.when(F.col("most") > 0.14, 0.8).when(F.col("most") > 0.12, 0.9).otherwise(1.0)
    return m.select("img", F.round((F.col("mean") * F.col("n") - F.col("most")) / (F.col("n") - 1) * factor, 6).alias("level"))


def fit_plane(df: DataFrame, x: str, y: str, v: str) -> np.ndarray:
    """Least squares of v on 1, x, y, xy: sums of products in one aggregate, four equations on the driver."""
    basis = [F.lit(1.0), F.col(x), F.col(y), F.col(x) * F.col(y)]
    row = df.agg(*(F.sum(a * b) for a in basis for b in basis), *(F.sum(a * F.col(v)) for a in basis)).first()
    return np.linalg.solve(np.array(row[:16], dtype=float).reshape(4, 4), np.array(row[16:], dtype=float))


@register("least_squares_fit")
def _(spark, sf_dir):
    """Coefficients of a surface through all pixels."""
    got = fit_plane(pixels(spark, sf_dir), "x", "y", "v")
    return spark.createDataFrame([(k, float(c)) for k, c in enumerate(got)], "k int, coefficient double")


@register("linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS offset_, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("offset_"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))
