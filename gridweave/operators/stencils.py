"""Operators on images: neighbourhoods, frames that are laid over each other, geometry, masks.

An image is an array in a row, so a neighbourhood is a slice of it: these operators are maps, without shuffle or join.
Arrays hold one tile; larger images are cut into tiles with a margin first (`plans.tiles`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .fixtures import MOSAIC, PX, SIDE, explode_plane, hold, planes

Y, X = f"(i div {SIDE})", f"(i % {SIDE})"


def window(a: str, r: int, i: str = "i", ry: int | None = None) -> str:
    """SQL for the values around place `i`, r to each side (ry up and down); the frame shrinks at borders."""
    ry = r if ry is None else ry
    y, x = f"({i} div {SIDE})", f"({i} % {SIDE})"
    left = f"greatest({x} - {r}, 0)"
    row = f"slice({a}, cast(_line * {SIDE} + {left} + 1 as int), cast(least({x} + {r}, {SIDE - 1}) - {left} + 1 as int))"
    return f"flatten(transform(sequence(greatest({y} - {ry}, 0), least({y} + {ry}, {SIDE - 1})), _line -> {row}))"


def each(body: str, a: str = "a") -> Column:
    """`body` for every place i of array `a`."""
    return F.expr(f"transform(sequence(0, size({a}) - 1), i -> {body})")


def mean_of(values: str) -> str:
    return f"aggregate({values}, cast(0 as double), (s, v) -> s + v, s -> s / size({values}))"


def total_of(values: str) -> str:
    return f"aggregate({values}, cast(0 as double), (s, v) -> s + v)"


def at(a: str, dy: int, dx: int) -> str:
    """SQL for the value at an offset; the border's values repeat beyond it."""
    return f"get({a}, cast(least(greatest({Y} + ({dy}), 0), {SIDE - 1}) * {SIDE} + least(greatest({X} + ({dx}), 0), {SIDE - 1}) as int))"


def inside(margin: int) -> str:
    return f"({Y} between {margin} and {SIDE - 1 - margin} and {X} between {margin} and {SIDE - 1 - margin})"


def box_blur(df: DataFrame, r: int, a: str = "a", out: str = "b") -> DataFrame:
    """Mean of rows, then of columns, over frames that shrink at borders; the radius stops one short of the side."""
    r = min(r, SIDE - 1)
    return hold(hold(df, "_h", each(mean_of(window(a, r, ry=0)), a)), out, each(mean_of(window("_h", 0, ry=r)), a)).drop("_h")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return explode_plane(df.select("img", *(F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in columns)), *columns)


BLUR = "WINDOW h AS (PARTITION BY img, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def blur_sql(r: int, value: str = "v", source: str = "px") -> str:
    return f"(SELECT img, y, x, avg(h) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS b FROM (SELECT img, y, x, avg({value}) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS h FROM {source}))"


@register("box_blur", f"WITH {PX} SELECT img, y, x, round(b, 6) + 0.0 AS b FROM {blur_sql(2)}")
def _(spark, sf_dir):
    return rounded(box_blur(planes(spark, sf_dir), 2), "b")


@register("box_blur_abs", f"WITH {PX} SELECT img, y, x, round(b, 6) + 0.0 AS b FROM {blur_sql(1, 'abs(v)')}")
def _(spark, sf_dir):
    return rounded(box_blur(hold(planes(spark, sf_dir), "a", F.transform("a", F.abs)), 1), "b")


@register("box_blur_cfa", f"WITH {MOSAIC} SELECT img, y, x, round(avg(v) OVER (PARTITION BY img, y, x % 2 ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS b FROM mo")
def _(spark, sf_dir):
    """Moving mean over sites of one colour, which are two apart."""
    values = f"filter(transform(array(-2, 0, 2), d -> if({X} + d between 0 and {SIDE - 1}, get(a, cast(i + d as int)), null)), v -> v is not null)"
    return rounded(planes(spark, sf_dir).withColumn("b", each(mean_of(values))), "b")


def stencil_sql(weights: dict[tuple[int, int], float], source: str = "px") -> str:
    """A sum of neighbours with the border repeated, as a join on shifted places."""
    values = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for (dy, dx), w in weights.items())
    return f"(SELECT p.img, p.y, p.x, sum(k.w * q.v) AS b FROM {source} p, (VALUES {values}) k(dy, dx, w) JOIN {source} q ON q.img = p.img AND q.y = least(greatest(p.y + dy, 0), {SIDE - 1}) AND q.x = least(greatest(p.x + dx, 0), {SIDE - 1}) GROUP BY ALL)"


def gaussian(sigma: float, r: int) -> dict[tuple[int, int], float]:
    from math import exp

    line = [exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    total = sum(line) ** 2
    return {(dy - r, dx - r): line[dy] * line[dx] / total for dy in range(2 * r + 1) for dx in range(2 * r + 1)}


def convolve(df: DataFrame, weights: dict[tuple[int, int], float], a: str = "a", out: str = "b") -> DataFrame:
    return hold(df, out, each(" + ".join(f"{w!r}D * {at(a, dy, dx)}" for (dy, dx), w in weights.items()), a))


@register("gaussian_3x3", f"WITH {PX} SELECT img, y, x, round(b, 6) + 0.0 AS b FROM {stencil_sql(gaussian(0.55, 1))}")
def _(spark, sf_dir):
    return rounded(convolve(planes(spark, sf_dir), gaussian(0.55, 1)), "b")


@register("gaussian_5x5", f"WITH {PX} SELECT img, y, x, round(b, 6) + 0.0 AS b FROM {stencil_sql(gaussian(0.8, 2))}")
def _(spark, sf_dir):
    return rounded(convolve(planes(spark, sf_dir), gaussian(0.8, 2)), "b")


def neighbours_sql(r: int, agg: str, extra: str = "", step: int = 1) -> str:
    return f"(SELECT p.img, p.y, p.x, p.v, {agg} AS m FROM px p JOIN px q ON q.img = p.img AND abs(q.y - p.y) <= {r} AND abs(q.x - p.x) <= {r} AND (q.y - p.y) % {step} = 0 AND (q.x - p.x) % {step} = 0 {extra} GROUP BY ALL)"


def median_of(values: str) -> str:
    """The middle of an odd number of values, the mean of both of an even one."""
    s = f"array_sort({values})"
    return f"(get({s}, cast((size({values}) - 1) div 2 as int)) + get({s}, cast(size({values}) div 2 as int))) / 2"


@register("median3x3", f"WITH {PX} SELECT img, y, x, round(m, 6) AS b FROM {neighbours_sql(1, 'median(q.v)')}")
def _(spark, sf_dir):
    return rounded(planes(spark, sf_dir).withColumn("b", each(median_of(window("a", 1)))), "b")


def median5x5(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("b", each(median_of(window("a", 2)))), "b")


@register("median5x5", f"WITH {PX} SELECT img, y, x, round(m, 6) AS b FROM {neighbours_sql(2, 'median(q.v)')}")
def _(spark, sf_dir):
    return median5x5(planes(spark, sf_dir))


@register("median_plus", f"WITH {PX} SELECT p.img, p.y, p.x, round(median(q.v), 6) AS b FROM px p, (VALUES (0, 0), (-2, 0), (2, 0), (0, -2), (0, 2)) k(dy, dx) JOIN px q ON q.img = p.img AND q.y = CASE WHEN p.y + dy < 0 THEN p.y - dy WHEN p.y + dy > 7 THEN p.y - dy ELSE p.y + dy END AND q.x = CASE WHEN p.x + dx < 0 OR p.x + dx > 7 THEN p.x - dx ELSE p.x + dx END GROUP BY ALL")
def _(spark, sf_dir):
    """Five points of a cross two apart; beyond the border they are mirrored."""
    mirror = lambda c, d: f"(if({c} + ({d}) between 0 and {SIDE - 1}, {c} + ({d}), {c} - ({d})))"
    points = ", ".join(f"get(a, cast({mirror(Y, dy)} * {SIDE} + {mirror(X, dx)} as int))" for dy, dx in ((0, 0), (-2, 0), (2, 0), (0, -2), (0, 2)))
    return rounded(planes(spark, sf_dir).withColumn("b", each(f"get(array_sort(array({points})), 2)")), "b")


@register("middle_four_of_six", f"WITH {PX}, w AS (SELECT img, y, list_sort(list(v)) AS l FROM px WHERE x < 6 GROUP BY ALL) SELECT img, y, round((l[2] + l[3] + l[4] + l[5]) / 4, 6) AS b FROM w")
def _(spark, sf_dir):
    """Mean of six without the least and the largest."""
    rows = planes(spark, sf_dir).select("img", F.posexplode(F.expr(f"transform(sequence(0, {SIDE - 1}), y -> slice(array_sort(slice(a, y * {SIDE} + 1, 6)), 2, 4))")).alias("y", "l"))
    return rows.select("img", "y", F.round(F.expr("aggregate(l, cast(0 as double), (s, v) -> s + v) / 4"), 6).alias("b"))


@register("hot_pixels", f"WITH {PX} SELECT img, y, x FROM {neighbours_sql(1, 'sum(q.v + 0.6) - (any_value(p.v) + 0.6)')} WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND v + 0.6 > 0.2 * m")
def _(spark, sf_dir):
    """Places that exceed a share of their eight neighbours' sum, but for a margin of two."""
    hot = f"filter(sequence(0, size(a) - 1), i -> {inside(2)} and get(a, i) + 0.6D > 0.2D * ({total_of('transform(' + window('a', 1) + ', v -> v + 0.6D)')} - (get(a, i) + 0.6D)))"
    return planes(spark, sf_dir).select("img", F.explode(F.expr(hot)).alias("i")).select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"))


@register("hot_dead_median", f"WITH {PX}, m AS {neighbours_sql(2, 'median(q.v)', step=2)}, d AS (SELECT p.img, p.y, p.x, any_value(p.v) AS v, any_value(p.m) AS m, avg(abs(q.v - q.m)) AS dev FROM m p JOIN m q ON q.img = p.img AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY ALL) SELECT img, y, x, v > m AS hot FROM d WHERE abs(v - m) > 2.5 * dev")
def _(spark, sf_dir):
    """Sites that are off the median of their colour by more than the deviation around them allows."""
    same = f"filter(transform(array(-18, -16, -14, -2, 0, 2, 14, 16, 18), d -> if({Y} + (case when d < -8 then -2 when d > 8 then 2 else 0 end) between 0 and {SIDE - 1} and {X} + (d - (case when d < -8 then -16 when d > 8 then 16 else 0 end)) between 0 and {SIDE - 1}, get(a, cast(i + d as int)), null)), v -> v is not null)"
    df = hold(planes(spark, sf_dir), "m", each(median_of(same)))
    df = hold(df, "off", F.zip_with("a", "m", lambda v, m: F.abs(v - m)))
    bad = f"filter(sequence(0, size(a) - 1), i -> get(off, i) > 2.5D * {mean_of(window('off', 2))})"
    rows = df.select("img", "a", "m", F.explode(F.expr(bad)).alias("i"))
    return rows.select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"), F.expr("get(a, i) > get(m, i)").alias("hot"))


@register("impulse_mask", f"WITH {PX}, b AS (SELECT p.img, p.y, p.x, p.v, abs(p.v - s.b) AS h FROM px p JOIN {stencil_sql(gaussian(0.8, 2))} s USING (img, y, x)) SELECT p.img, p.y, p.x FROM b p JOIN b q ON q.img = p.img AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY ALL HAVING any_value(p.h) > 2.5 * (sum(q.h) - any_value(p.h)) / (count(*) - 1)")
def _(spark, sf_dir):
    """Where the high pass is far above that of its neighbours."""
    df = hold(convolve(planes(spark, sf_dir), gaussian(0.8, 2)), "h", F.zip_with("a", "b", lambda v, b: F.abs(v - b)))
    w = window("h", 2)
    mask = f"filter(sequence(0, size(a) - 1), i -> get(h, i) > 2.5D * ({total_of(w)} - get(h, i)) / (size({w}) - 1))"
    return df.select("img", F.explode(F.expr(mask)).alias("i")).select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"))


@register("impulse_repair", f"WITH {PX}, t AS (SELECT *, abs(v) > 0.25 AS bad FROM px) SELECT p.img, p.y, p.x, round(CASE WHEN any_value(p.bad) THEN coalesce(avg(q.v) FILTER (NOT q.bad), any_value(p.v)) ELSE any_value(p.v) END, 6) AS b FROM t p JOIN t q ON q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL")
def _(spark, sf_dir):
    """Marked places take the mean of the clean ones around them, if there are some."""
    clean = f"filter({window('a', 1)}, v -> abs(v) <= 0.25D)"
    body = f"if(abs(get(a, i)) > 0.25D and size({clean}) > 0, {mean_of(clean)}, get(a, i))"
    return rounded(planes(spark, sf_dir).withColumn("b", each(body)), "b")


def bad_pixel_interpolate(df: DataFrame) -> DataFrame:
    """Marked sites from pairs of same-coloured neighbours in four directions, each weighted by how little it changes."""
    pairs = [(at("a", dy, dx), at("a", -dy, -dx)) for dy, dx in ((0, 2), (2, 0), (2, 2), (2, -2))]
    top = " + ".join(f"({p} + {q}) / 2 / (abs({p} - {q}) + 0.01D)" for p, q in pairs)
    under = " + ".join(f"1 / (abs({p} - {q}) + 0.01D)" for p, q in pairs)
    return rounded(df.withColumn("b", each(f"if(abs(get(a, i)) > 0.3D and {inside(2)}, ({top}) / ({under}), get(a, i))")), "b")


@register("bad_pixel_interpolate", f"WITH {PX} SELECT p.img, p.y, p.x, round(CASE WHEN abs(p.v) > 0.3 AND p.y BETWEEN 2 AND 5 AND p.x BETWEEN 2 AND 5 THEN (SELECT sum((a.v + b.v) / 2 / (abs(a.v - b.v) + 0.01)) / sum(1 / (abs(a.v - b.v) + 0.01)) FROM (VALUES (0, 2), (2, 0), (2, 2), (2, -2)) k(dy, dx) JOIN px a ON a.img = p.img AND a.y = p.y + dy AND a.x = p.x + dx JOIN px b ON b.img = p.img AND b.y = p.y - dy AND b.x = p.x - dx) ELSE p.v END, 6) AS b FROM px p")
def _(spark, sf_dir):
    return bad_pixel_interpolate(planes(spark, sf_dir))


@register("guided_filter", f"WITH {PX}, s AS (SELECT img, y, x, v, v * v AS v2 FROM px), m AS (SELECT a.img, a.y, a.x, a.b AS m, b.b AS m2 FROM {blur_sql(1)} a JOIN {blur_sql(1, 'v2', 's')} b USING (img, y, x)), k AS (SELECT img, y, x, (m2 - m * m) / (m2 - m * m + 0.01) AS p, m * (1 - (m2 - m * m) / (m2 - m * m + 0.01)) AS q FROM m) SELECT img, y, x, round(p.b * v + q.b, 6) AS b FROM px JOIN {blur_sql(1, 'p', 'k')} p USING (img, y, x) JOIN {blur_sql(1, 'q', 'k')} q USING (img, y, x)")
def _(spark, sf_dir):
    """Guided by itself: a line fitted in every box, the lines' coefficients averaged."""
    df = box_blur(planes(spark, sf_dir), 1, "a", "m")
    df = box_blur(hold(df, "a2", F.transform("a", lambda v: v * v)), 1, "a2", "m2")
    df = hold(df, "p", F.zip_with("m", "m2", lambda m, s: (s - m * m) / (s - m * m + 0.01)))
    df = hold(df, "q", F.zip_with("m", "p", lambda m, p: m * (1 - p)))
    df = box_blur(box_blur(df, 1, "p", "pb"), 1, "q", "qb")
    return rounded(df.withColumn("b", each("get(pb, i) * get(a, i) + get(qb, i)")), "b")


@register("unsharp_mask", f"WITH {PX} SELECT img, y, x, round(v + 0.8 * CASE WHEN abs(v - b) > 0.02 THEN v - b ELSE 0 END, 6) AS b FROM px JOIN {stencil_sql(gaussian(0.8, 2))} USING (img, y, x)")
def _(spark, sf_dir):
    df = convolve(planes(spark, sf_dir), gaussian(0.8, 2), out="g")
    return rounded(df.withColumn("b", F.zip_with("a", "g", lambda v, g: v + 0.8 * F.when(F.abs(v - g) > 0.02, v - g).otherwise(0.0))), "b")


@register("local_contrast", f"WITH {PX} SELECT img, y, x, round(greatest(v + 0.7 * (v - b) * CASE WHEN v > b THEN 1.2 ELSE 0.8 END, -0.3), 6) AS b FROM px JOIN {blur_sql(2)} USING (img, y, x)")
def _(spark, sf_dir):
    """Difference to the blur, with factors of their own for lighter and darker, and a floor."""
    df = box_blur(planes(spark, sf_dir), 2, out="g")
    return rounded(df.withColumn("b", F.zip_with("a", "g", lambda v, g: F.greatest(v + 0.7 * (v - g) * F.when(v > g, 1.2).otherwise(0.8), F.lit(-0.3)))), "b")


@register("defringe", f"WITH {PX}, d AS (SELECT img, y, x, v, (v - b) ** 2 AS e FROM px JOIN {blur_sql(1)} USING (img, y, x)), t AS (SELECT *, avg(e) OVER (PARTITION BY img) AS m FROM d) SELECT p.img, p.y, p.x, round(CASE WHEN any_value(p.e) > 2 * any_value(p.m) THEN sum(q.v / (q.e + q.m)) / sum(1 / (q.e + q.m)) ELSE any_value(p.v) END, 6) AS b FROM t p JOIN t q ON q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL")
def _(spark, sf_dir):
    """Places that deviate much more than the image does take a mean of their box, weighted by how little each deviates."""
    df = hold(box_blur(planes(spark, sf_dir), 1, out="g"), "e", F.zip_with("a", "g", lambda v, g: (v - g) * (v - g)))
    df = hold(hold(df, "mean", F.expr(mean_of("e"))), "w", F.transform("e", lambda e: 1 / (e + F.col("mean"))))
    df = hold(df, "vw", F.zip_with("a", "w", lambda v, w: v * w))
    return rounded(df.withColumn("b", each(f"if(get(e, i) > 2 * mean, {total_of(window('vw', 1))} / {total_of(window('w', 1))}, get(a, i))")), "b")


@register("directional_pyramid", f"WITH {PX} SELECT img, y, x, round(b2 + 1.5 * (v - b1) + 0.8 * (b1 - b2), 6) AS b FROM px JOIN (SELECT img, y, x, b AS b1 FROM {blur_sql(1)}) USING (img, y, x) JOIN (SELECT img, y, x, b AS b2 FROM {blur_sql(2, 'b', blur_sql(1))}) USING (img, y, x)")
def _(spark, sf_dir):
    """Differences of levels of ever wider blurs, each with a gain, on the last level."""
    df = box_blur(box_blur(planes(spark, sf_dir), 1, "a", "b1"), 2, "b1", "b2")
    return rounded(df.withColumn("b", each("get(b2, i) + 1.5D * (get(a, i) - get(b1, i)) + 0.8D * (get(b1, i) - get(b2, i))")), "b")


@register("dehaze", f"WITH {PX}, d AS {neighbours_sql(1, 'min(q.v + 1)')}, t AS (SELECT *, greatest(1 - 0.6 * m / 1.5, 0.1) AS t FROM d) SELECT img, y, x, round((v + 1 - 1.5) / t + 1.5, 6) AS b FROM t")
def _(spark, sf_dir):
    """Haze from the darkest value around, taken out against the ambient light, with a floor for what passes."""
    df = planes(spark, sf_dir).withColumn("m", each(f"array_min({window('a', 1)}) + 1"))
    return rounded(df.withColumn("b", F.zip_with("a", "m", lambda v, m: (v + 1 - 1.5) / F.greatest(1 - 0.6 * m / 1.5, F.lit(0.1)) + 1.5)), "b")


@register("contrast_mask", f"WITH {PX}, g AS (SELECT p.img, p.y, p.x, sqrt((a.v - b.v) ** 2 + (c.v - d.v) ** 2) AS g FROM px p JOIN px a ON a.img = p.img AND a.y = p.y AND a.x = least(p.x + 1, 7) JOIN px b ON b.img = p.img AND b.y = p.y AND b.x = greatest(p.x - 1, 0) JOIN px c ON c.img = p.img AND c.x = p.x AND c.y = least(p.y + 1, 7) JOIN px d ON d.img = p.img AND d.x = p.x AND d.y = greatest(p.y - 1, 0)) SELECT img, y, x, round(b, 6) + 0.0 AS b FROM {blur_sql(1, '0.5 * (1 + (g * 16 / 0.2 - 16) / sqrt(1 + (g * 16 / 0.2 - 16) ** 2))', 'g')}")
def _(spark, sf_dir):
    """Gradient through a smooth step, blurred."""
    g = f"sqrt(power({at('a', 0, 1)} - {at('a', 0, -1)}, 2) + power({at('a', 1, 0)} - {at('a', -1, 0)}, 2))"
    step = lambda v: 0.5 * (1 + (v * 16 / 0.2 - 16) / F.sqrt(1 + (v * 16 / 0.2 - 16) ** 2))
    return rounded(box_blur(hold(planes(spark, sf_dir), "g", F.transform(each(g), step)), 1, "g"), "b")


@register("dual_blend", f"WITH {PX} SELECT p.img, p.y, p.x, round(m * p.v + (1 - m) * q.b, 6) AS b FROM (SELECT *, least(abs(v) * 4, 1) AS m FROM px) p JOIN {blur_sql(1)} q USING (img, y, x)")
def _(spark, sf_dir):
    """Two results mixed by a mask."""
    df = hold(box_blur(planes(spark, sf_dir), 1, out="g"), "m", F.transform("a", lambda v: F.least(F.abs(v) * 4, F.lit(1.0))))
    return rounded(df.withColumn("b", each("get(m, i) * get(a, i) + (1 - get(m, i)) * get(g, i)")), "b")


@register("demosaic_bilinear", f"WITH {MOSAIC} SELECT p.img, p.y, p.x, " + ", ".join(f"round(CASE WHEN any_value(p.c) = {c} THEN any_value(p.v) ELSE avg(q.v) FILTER (q.c = {c}) END, 6) AS {n}" for c, n in enumerate("rgb")) + " FROM mo p JOIN mo q ON q.img = p.img AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL")
def _(spark, sf_dir):
    """A site keeps its own colour; the others are means of the sites around it that have them."""
    df = planes(spark, sf_dir)
    colour = lambda i: f"(case when ({i} div {SIDE}) % 2 = 0 and ({i} % {SIDE}) % 2 = 0 then 0 when ({i} div {SIDE}) % 2 = 1 and ({i} % {SIDE}) % 2 = 1 then 2 else 1 end)"
    df = hold(df, "z", F.expr(f"transform(sequence(0, size(a) - 1), i -> struct({colour('i')} as c, get(a, i) as v))"))
    for c, n in enumerate("rgb"):
        own = f"transform(filter({window('z', 1)}, z -> z.c = {c}), z -> z.v)"
        df = df.withColumn(n, each(f"if(get(z, i).c = {c}, get(a, i), {mean_of(own)})"))
    return rounded(df, "r", "g", "b")


@register("mosaic_mono", f"WITH {MOSAIC} SELECT img, y, x, round(v, 6) AS r, round(v, 6) AS g, round(v, 6) AS b FROM mo")
def _(spark, sf_dir):
    return rounded(planes(spark, sf_dir).select("img", *(F.col("a").alias(n) for n in "rgb")), "r", "g", "b")


@register("false_colour_median", f"WITH {PX} SELECT img, y, x, round(CASE WHEN x BETWEEN 2 AND 5 THEN m ELSE v END, 6) AS b FROM {neighbours_sql(1, 'median(q.v)')}")
def _(spark, sf_dir):
    """Median of a colour-difference plane; the two outer columns stay."""
    return rounded(planes(spark, sf_dir).withColumn("b", each(f"if({X} between 2 and {SIDE - 3}, {median_of(window('a', 1))}, get(a, i))")), "b")


@register("frame_subtract", f"WITH {PX} SELECT a.img, a.y, a.x, round(greatest(a.v + 0.1 - b.v, 0), 6) AS v FROM px a JOIN px b ON b.img = a.img + 1 AND a.y = b.y AND a.x = b.x")
def _(spark, sf_dir):
    """A dark frame off each image: whole images are joined, not their pixels."""
    p = planes(spark, sf_dir)
    return rounded(p.join(p.select((F.col("img") - 1).alias("img"), F.col("a").alias("d")), "img").withColumn("v", F.zip_with("a", "d", lambda v, d: F.greatest(v + 0.1 - d, F.lit(0.0)))), "v")


@register("flat_field_divide", f"WITH {PX}, f AS (SELECT img, y, x, b + 2 AS f FROM {blur_sql(1)}) SELECT p.img, p.y, p.x, round(p.v * c.f / f.f, 6) AS v FROM px p JOIN f ON f.img = p.img + 1 AND f.y = p.y AND f.x = p.x JOIN f c ON c.img = f.img AND c.y = 4 AND c.x = 4")
def _(spark, sf_dir):
    """Over a blurred flat frame, relative to its centre."""
    p = planes(spark, sf_dir)
    flat = hold(box_blur(p, 1, out="g"), "f", F.transform("g", lambda v: v + 2)).select((F.col("img") - 1).alias("img"), "f")
    return rounded(p.join(flat, "img").withColumn("v", F.zip_with("a", "f", lambda v, f: v * F.get("f", F.lit(4 * SIDE + 4)) / f)), "v")


@register("frame_average", f"WITH {PX} SELECT a.img, a.y, a.x, round(0.5 * (a.v + b.v), 6) AS v FROM px a JOIN px b ON b.img = a.img + 1 AND a.y = b.y AND a.x = b.x")
def _(spark, sf_dir):
    p = planes(spark, sf_dir)
    return rounded(p.join(p.select((F.col("img") - 1).alias("img"), F.col("a").alias("d")), "img").withColumn("v", F.zip_with("a", "d", lambda v, d: 0.5 * (v + d))), "v")


@register("pixel_shift_median", f"WITH {PX}, f AS (SELECT img - k AS img, y - dy AS y, x - dx AS x, v FROM px, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) s(k, dy, dx)) SELECT img, y::INT AS y, x::INT AS x, round(median(v), 6) AS m, round(avg(v), 6) AS mean FROM f WHERE y BETWEEN 0 AND 6 AND x BETWEEN 0 AND 6 GROUP BY ALL HAVING count(*) = 4")
def _(spark, sf_dir):
    """Four frames, each shifted by one site, laid over each other."""
    p = planes(spark, sf_dir)
    df = p
    for k in (1, 2, 3):
        df = df.join(p.select((F.col("img") - k).alias("img"), F.col("a").alias(f"a{k}")), "img")
    shift = {0: (0, 0), 1: (1, 0), 2: (1, 1), 3: (0, 1)}
    frames = ", ".join(at("a" if not k else f"a{k}", *shift[k]) for k in range(4))
    four = df.withColumn("m", each(f"aggregate(slice(array_sort(array({frames})), 2, 2), cast(0 as double), (s, v) -> s + v) / 2")).withColumn("mean", each(f"aggregate(array({frames}), cast(0 as double), (s, v) -> s + v) / 4"))
    return rounded(four, "m", "mean").where(f"y < {SIDE - 1} AND x < {SIDE - 1}")


@register("mask_xor", f"WITH {PX}, a AS (SELECT img, y, x FROM px WHERE v > 0.05), b AS (SELECT img, y, x FROM px WHERE abs(v) < 0.1) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, sf_dir):
    """Places in one mask only: a comparison within the row where both are of the same image."""
    xor = F.expr("filter(sequence(0, size(a) - 1), i -> (get(a, i) > 0.05D) <> (abs(get(a, i)) < 0.1D))")
    return planes(spark, sf_dir).select("img", F.explode(xor).alias("i")).select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"))


@register("mask_invert", f"WITH {PX} SELECT img, y, x, NOT (v > 0.1) AS m FROM px")
def _(spark, sf_dir):
    return explode_plane(planes(spark, sf_dir).withColumn("m", F.transform("a", lambda v: ~(v > 0.1))), "m")


@register("bad_pixel_union", f"WITH {PX}, l(y, x) AS (VALUES (1, 1), (3, 4), (7, 7)) SELECT img, y, x FROM px WHERE v > 0.3 UNION SELECT img, y, x FROM px WHERE v = 0 UNION SELECT DISTINCT img, l.y, l.x FROM px, l")
def _(spark, sf_dir):
    """A list, hot places and zeros as one set; within the row an array is the set."""
    listed = F.array(*(F.lit(y * SIDE + x) for y, x in ((1, 1), (3, 4), (7, 7))))
    marked = F.expr("filter(sequence(0, size(a) - 1), i -> get(a, i) > 0.3D or get(a, i) = 0)")
    return planes(spark, sf_dir).select("img", F.explode(F.array_union(marked, listed)).alias("i")).select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"))


@register("flood_fill", f"WITH RECURSIVE {PX}, o AS (SELECT img, y, x FROM px WHERE v < 0.06), f AS (SELECT img, y, x FROM o WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT o.img, o.y, o.x FROM f JOIN o ON o.img = f.img AND abs(o.y - f.y) + abs(o.x - f.x) = 1) SELECT img, y, x FROM f")
def _(spark, sf_dir):
    """Open places that reach the border by steps up, down, left or right. The fill goes on within the row, a step a fold, as many as there are places."""
    edge = f"({Y} in (0, {SIDE - 1}) or {X} in (0, {SIDE - 1}))"
    start = F.expr(f"transform(sequence(0, size(a) - 1), i -> get(a, i) < 0.06D and {edge})")
    near = " or ".join((f"({X} > 0 and get(f, i - 1))", f"({X} < {SIDE - 1} and get(f, i + 1))", f"({Y} > 0 and get(f, i - {SIDE}))", f"({Y} < {SIDE - 1} and get(f, i + {SIDE}))"))
    grow = F.expr(f"aggregate(sequence(1, size(a) div 2), start, (f, n) -> transform(f, (m, i) -> m or (get(a, i) < 0.06D and coalesce({near}, false))))")
    return explode_plane(planes(spark, sf_dir).withColumn("start", start).withColumn("filled", grow), "filled").where("filled").select("img", "y", "x")


@register("flip", f"WITH {PX} SELECT img, y, 7 - x AS x, round(v, 6) AS v FROM px")
def _(spark, sf_dir):
    return rounded(planes(spark, sf_dir).withColumn("v", F.expr(f"flatten(transform(sequence(0, {SIDE - 1}), y -> reverse(slice(a, y * {SIDE} + 1, {SIDE}))))")), "v")


@register("rotate", f"WITH {PX} SELECT img, x AS y, 7 - y AS x, round(v, 6) AS v FROM px")
def _(spark, sf_dir):
    """A quarter turn to the right."""
    return rounded(planes(spark, sf_dir).withColumn("v", each(f"get(a, cast(({SIDE - 1} - {X}) * {SIDE} + {Y} as int))")), "v")


@register("subsample", f"WITH {PX} SELECT img, y // 3 AS y, x // 3 AS x, round(v, 6) AS v FROM px WHERE y % 3 = 0 AND x % 3 = 0")
def _(spark, sf_dir):
    rows = rounded(planes(spark, sf_dir).withColumnRenamed("a", "v"), "v").where("y % 3 = 0 AND x % 3 = 0")
    return rows.select("img", F.expr("cast(y div 3 as int)").alias("y"), F.expr("cast(x div 3 as int)").alias("x"), "v")


@register("crop", f"WITH {PX} SELECT img, y - 2 AS y, x - 1 AS x, round(v, 6) AS v FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def _(spark, sf_dir):
    """Rows of a rectangle are slices; nothing else is unpacked."""
    rows = planes(spark, sf_dir).select("img", F.posexplode(F.expr(f"transform(sequence(2, 5), y -> slice(a, y * {SIDE} + 2, 6))")).alias("y", "row"))
    return rows.select("img", "y", F.posexplode("row").alias("x", "v")).withColumn("v", F.round("v", 6))


@register("border", f"WITH {PX}, g AS (SELECT img, y, x FROM (SELECT DISTINCT img FROM px), range(10) t(y), range(10) u(x)) SELECT g.img, g.y::INT AS y, g.x::INT AS x, round(coalesce(v, -1.0), 6) AS v FROM g LEFT JOIN px ON px.img = g.img AND px.y = g.y - 1 AND px.x = g.x - 1")
def _(spark, sf_dir):
    """A frame of a constant around the image."""
    side = SIDE + 2
    body = f"transform(sequence(0, {side * side - 1}), i -> if((i div {side}) between 1 and {SIDE} and (i % {side}) between 1 and {SIDE}, get(a, cast((i div {side} - 1) * {SIDE} + i % {side} - 1 as int)), cast(-1 as double)))"
    return explode_plane(planes(spark, sf_dir).withColumn("v", F.transform(F.expr(body), lambda v: F.round(v, 6))), "v", width=side)


@register("resize_nearest", f"WITH {PX} SELECT p.img, t.y::INT AS y, u.x::INT AS x, round(p.v, 6) AS v FROM range(5) t(y), range(5) u(x) JOIN px p ON p.y = floor(t.y * 8 / 5.0) AND p.x = floor(u.x * 8 / 5.0)")
def _(spark, sf_dir):
    body = f"transform(sequence(0, 24), i -> get(a, cast(floor((i div 5) * {SIDE} / 5.0D) * {SIDE} + floor((i % 5) * {SIDE} / 5.0D) as int)))"
    return explode_plane(planes(spark, sf_dir).withColumn("v", F.transform(F.expr(body), lambda v: F.round(v, 6))), "v", width=5)


def resize_weights(size: int, kernel: str, lobes: int = 3) -> list[list[tuple[int, float]]]:
    """For each place of the new side: old places and their weights, which add up to 1."""
    from math import floor, pi, sin

    scale = SIDE / size
    wide = max(scale, 1.0)
    out = []
    for k in range(size):
        centre = (k + 0.5) * scale - 0.5
        reach = wide * (lobes if kernel == "lanczos" else 1)
        terms = []
        for j in range(max(0, floor(centre - reach) + 1), min(SIDE - 1, floor(centre + reach)) + 1):
            t = (j - centre) / wide
            w = 1 - abs(t) if kernel == "linear" else 1.0 if t == 0 else lobes * sin(pi * t) * sin(pi * t / lobes) / (pi * pi * t * t)
            terms.append((j, w))
        total = sum(w for _, w in terms)
        out.append([(j, w / total) for j, w in terms])
    return out


def resize(df: DataFrame, size: int, kernel: str) -> DataFrame:
    """Rows, then columns, by weights that the plan holds as constants; results keep within the old values' range for Lanczos."""
    w = resize_weights(size, kernel)
    line = lambda terms, place: " + ".join(f"{v!r}D * get({place[0]}, cast({place[1].format(j=j)} as int))" for j, v in terms)
    across = "case i % {n} {arms} end".format(n=size, arms=" ".join(f"when {k} then {line(t, ('a', f'(i div {size}) * {SIDE} + ' + '{j}'))}" for k, t in enumerate(w)))
    down = "case i div {n} {arms} end".format(n=size, arms=" ".join(f"when {k} then {line(t, ('_h', '{j} * ' + str(size) + f' + i % {size}'))}" for k, t in enumerate(w)))
    df = hold(df, "_h", F.expr(f"transform(sequence(0, {SIDE * size - 1}), i -> {across})"))
    return df.withColumn("b", F.expr(f"transform(sequence(0, {size * size - 1}), i -> least(greatest({down}, array_min(a)), array_max(a)))")).drop("_h")


def resize_sql(size: int, kernel: str) -> str:
    values = ", ".join(f"({k}, {j}, {v!r}::DOUBLE)" for k, t in enumerate(resize_weights(size, kernel)) for j, v in t)
    return f"WITH {PX}, w(k, j, w) AS (VALUES {values}), m AS (SELECT img, min(v) AS lo, max(v) AS hi FROM px GROUP BY img), s AS (SELECT img, a.k AS y, b.k AS x, sum(a.w * b.w * v) AS s FROM px JOIN w a ON a.j = y JOIN w b ON b.j = x GROUP BY ALL) SELECT img, y, x, round(least(greatest(s, lo), hi), 6) AS b FROM s JOIN m USING (img)"


@register("resize_bilinear", resize_sql(5, "linear"))
def _(spark, sf_dir):
    return explode_plane(resize(planes(spark, sf_dir), 5, "linear").withColumn("b", F.transform("b", lambda v: F.round(v, 6))), "b", width=5)


@register("resize_lanczos", resize_sql(4, "lanczos"))
def _(spark, sf_dir):
    return explode_plane(resize(planes(spark, sf_dir), 4, "lanczos").withColumn("b", F.transform("b", lambda v: F.round(v, 6))), "b", width=4)


@register("zero_pixels", f"WITH {PX} SELECT img, y, x FROM px WHERE abs(v) < 0.001")
def _(spark, sf_dir):
    rows = planes(spark, sf_dir).select("img", F.explode(F.expr("filter(sequence(0, size(a) - 1), i -> abs(get(a, i)) < 0.001D)")).alias("i"))
    return rows.select("img", F.expr(f"cast(i div {SIDE} as int)").alias("y"), F.expr(f"cast(i % {SIDE} as int)").alias("x"))


@register("clipped_region", f"WITH {PX} SELECT img, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, count(*) AS n FROM px WHERE v > 0.2 GROUP BY img")
def _(spark, sf_dir):
    """Bounding box of clipped places."""
    spots = F.expr("filter(sequence(0, size(a) - 1), i -> get(a, i) > 0.2D)")
    df = planes(spark, sf_dir).withColumn("s", spots).where(F.size("s") > 0)
    ys, xs = F.expr(f"transform(s, i -> cast(i div {SIDE} as int))"), F.expr(f"transform(s, i -> cast(i % {SIDE} as int))")
    return df.select("img", F.array_min(ys).alias("y0"), F.array_min(xs).alias("x0"), F.array_max(ys).alias("y1"), F.array_max(xs).alias("x1"), F.size("s").cast("long").alias("n"))
