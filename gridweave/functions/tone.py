"""Tone and chroma operators as column expressions, and their queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.fixtures import PX, SIDE, explode_plane, hold, planes
from ..operators.statistics import percentiles
from ..operators.stencils import X, Y, at, blur_sql, box_blur, each, mean_of, rounded, stencil_sql, window
from ..registry import register, table
from . import colour
from .queries import LAB, RGB, channels, out, rgb


def lab(spark, sf_dir):
    """(k, l, a, b), each computed once a row."""
    values = colour.xyz_to_lab(*colour.matrix(colour.RGB_TO_XYZ, *channels()))
    return rgb(spark, sf_dir).select("k", F.inline(F.array(F.struct(*(c.alias(n) for n, c in zip("lab", values, strict=True))))))


def vibrance(a: Column, b: Column, strong: float, weak: float, limit: float) -> tuple[Column, Column]:
    """Chroma gains more where there is little: one gain below a limit, another above, straight between half of it and it."""
    c = F.hypot(a, b)
    t = colour.clamp((c - limit / 2) / (limit / 2))
    gain = 1 + weak * (1 - t) + strong * t
    return a * gain, b * gain


@register("vibrance", f"WITH {RGB}, {LAB}, g AS (SELECT *, greatest(0, least((sqrt(a * a + b * b) - 20) / 20.0, 1)) AS t FROM lab) SELECT k, round(a * (1 + 0.4 * (1 - t) + 0.1 * t), 4) AS a, round(b * (1 + 0.4 * (1 - t) + 0.1 * t), 4) AS b FROM g")
def _(spark, sf_dir):
    a, b = vibrance(F.col("a"), F.col("b"), 0.1, 0.4, 40.0)
    return lab(spark, sf_dir).select("k", F.round(a, 4).alias("a"), F.round(b, 4).alias("b"))


#: Fixed values of the query: hue from and to, chroma from, slope, offset.
REGIONS = ((-0.5, 0.6, 10.0, 1.1, 2.0), (0.2, 1.4, 5.0, 0.9, -1.0), (-3.2, 3.2, 60.0, 0.8, 0.0))


def correct_regions(light: Column, a: Column, b: Column, regions: Sequence[tuple[float, float, float, float, float]] = REGIONS) -> tuple[Column, Column]:
    """Regions by hue and chroma, each with slope and offset for lightness and slope for chroma, one after another; masks are of the image as it was."""
    c, h = F.hypot(a, b), F.atan2(b, a)
    out_light, gain = light, F.lit(1.0)
    for low, high, least, slope, offset in regions:
        inside = h.between(low, high) & (c >= least)
        out_light = F.when(inside, out_light * slope + offset).otherwise(out_light)
        gain = F.when(inside, gain * slope).otherwise(gain)
    return out_light, gain


@register("colour_regions", f"WITH {RGB}, {LAB}, m AS (SELECT *, atan2(b, a) BETWEEN -0.5 AND 0.6 AND sqrt(a * a + b * b) >= 10 AS m1, atan2(b, a) BETWEEN 0.2 AND 1.4 AND sqrt(a * a + b * b) >= 5 AS m2, sqrt(a * a + b * b) >= 60 AS m3 FROM lab), s AS (SELECT *, CASE WHEN m1 THEN l * 1.1 + 2 ELSE l END AS l1 FROM m), t AS (SELECT *, CASE WHEN m2 THEN l1 * 0.9 - 1 ELSE l1 END AS l2 FROM s) SELECT k, round(CASE WHEN m3 THEN l2 * 0.8 ELSE l2 END, 4) AS l, round((CASE WHEN m1 THEN 1.1 ELSE 1 END * CASE WHEN m2 THEN 0.9 ELSE 1 END * CASE WHEN m3 THEN 0.8 ELSE 1 END)::DOUBLE, 4) AS gain FROM t")
def _(spark, sf_dir):
    light, gain = correct_regions(F.col("l"), F.col("a"), F.col("b"))
    return lab(spark, sf_dir).select("k", F.round(light, 4).alias("l"), F.round(gain, 4).alias("gain"))


@register("working_saturation", f"WITH {RGB}, y AS (SELECT *, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y FROM c) SELECT k, round(greatest(y + 1.3 * (r - y), 0), 6) AS r, round(greatest(y + 1.3 * (g - y), 0), 6) AS g, round(greatest(y + 1.3 * (b - y), 0), 6) AS b FROM y")
def _(spark, sf_dir):
    """Channels are pulled away from the luminance, not below 0."""
    y = colour.luminance(*channels())
    return out(rgb(spark, sf_dir), "k", **{n: F.greatest(y + 1.3 * (c - y), F.lit(0.0)) for n, c in zip("rgb", channels(), strict=True)})


@register("recover_luminance", f"WITH {RGB}, e AS (SELECT k, r * 1.6 AS r, g * 1.6 AS g, b * 1.6 AS b FROM c), q AS (SELECT *, least(r, 1) + least(g, 1) + least(b, 1) AS s, r + g + b AS t FROM e) SELECT k, round(CASE WHEN greatest(r, g, b) > 1 THEN r * s / t ELSE r END, 6) AS r, round(CASE WHEN greatest(r, g, b) > 1 THEN g * s / t ELSE g END, 6) AS g, round(CASE WHEN greatest(r, g, b) > 1 THEN b * s / t ELSE b END, 6) AS b FROM q")
def _(spark, sf_dir):
    """Clipped pixels keep their colours' ratios at the luminance that clipping leaves."""
    e = [c * 1.6 for c in channels()]
    left, whole = sum((F.least(c, F.lit(1.0)) for c in e[1:]), F.least(e[0], F.lit(1.0))), e[0] + e[1] + e[2]
    over = F.greatest(*e) > 1
    return out(rgb(spark, sf_dir), "k", **{n: F.when(over, c * left / whole).otherwise(c) for n, c in zip("rgb", e, strict=True)})


@register("recover_blend", f"WITH {RGB}, e AS (SELECT k, r * 1.5 AS r, g * 1.5 AS g, b * 1.5 AS b FROM c), o AS (SELECT k, least(r, 1) AS r1, least(g, 1) AS g1, least(b, 1) AS b1, r, g, b FROM e), p AS (SELECT k, r, g, b, (r1 + g1 + b1) / 3 AS l, sqrt((r - g) ** 2 + (r + g - 2 * b) ** 2 / 3) AS full_, sqrt((r1 - g1) ** 2 + (r1 + g1 - 2 * b1) ** 2 / 3) AS cut, (r + g + b) / 3 AS m FROM o) SELECT k, round(l + (r - m) * CASE WHEN full_ > 0 THEN cut / full_ ELSE 1 END, 6) AS r, round(l + (g - m) * CASE WHEN full_ > 0 THEN cut / full_ ELSE 1 END, 6) AS g, round(l + (b - m) * CASE WHEN full_ > 0 THEN cut / full_ ELSE 1 END, 6) AS b FROM p")
def _(spark, sf_dir):
    """Lightness of the clipped pixel, hue of the whole one, and the clipped one's chroma."""
    e = [c * 1.5 for c in channels()]
    cut = [F.least(c, F.lit(1.0)) for c in e]
    chroma = lambda r, g, b: F.sqrt((r - g) * (r - g) + (r + g - 2 * b) * (r + g - 2 * b) / 3)
    full, part = chroma(*e), chroma(*cut)
    light, mean = (cut[0] + cut[1] + cut[2]) / 3, (e[0] + e[1] + e[2]) / 3
    ratio = F.when(full > 0, part / full).otherwise(1.0)
    return out(rgb(spark, sf_dir), "k", **{n: light + (c - mean) * ratio for n, c in zip("rgb", e, strict=True)})


@register("preserve_chroma", f"WITH {RGB}, {LAB} SELECT k, round(a * CASE WHEN a * a + b * b < 100 THEN 1.0 WHEN a * a + b * b < 900 THEN 0.8 ELSE 0.6 END, 4) AS a, round(b * CASE WHEN a * a + b * b < 100 THEN 1.0 WHEN a * a + b * b < 900 THEN 0.8 ELSE 0.6 END, 4) AS b FROM lab")
def _(spark, sf_dir):
    """A strength by class of chroma."""
    c2 = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    s = F.when(c2 < 100, 1.0).when(c2 < 900, 0.8).otherwise(0.6)
    return lab(spark, sf_dir).select("k", F.round(F.col("a") * s, 4).alias("a"), F.round(F.col("b") * s, 4).alias("b"))


@register("gamut_warning", f"WITH {RGB}, m AS (SELECT k, 1.6604910 * r - 0.5876411 * g - 0.0728499 * b AS r, -0.1245505 * r + 1.1328999 * g - 0.0083494 * b AS g, -0.0181508 * r - 0.1005789 * g + 1.1187297 * b AS b FROM c) SELECT k, abs(r - greatest(0, least(r, 1))) + abs(g - greatest(0, least(g, 1))) + abs(b - greatest(0, least(b, 1))) > 0.01 AS warned FROM m")
def _(spark, sf_dir):
    """What a smaller space's clipping changes by more than a little."""
    m = colour.matrix(((1.6604910, -0.5876411, -0.0728499), (-0.1245505, 1.1328999, -0.0083494), (-0.0181508, -0.1005789, 1.1187297)), *channels())
    off = [F.abs(c - colour.clamp(c)) for c in m]
    return rgb(spark, sf_dir).select("k", (off[0] + off[1] + off[2] > 0.01).alias("warned"))


@register("two_colour_toning", f"WITH {RGB}, y AS (SELECT *, greatest(0, least((0.2126729 * r + 0.7151522 * g + 0.0721750 * b - 0.2) / 0.6, 1)) AS t FROM c) SELECT k, round(r + 0.2 * (0.9 * t + 0.2 * (1 - t) - r), 6) AS r, round(g + 0.2 * (0.7 * t + 0.3 * (1 - t) - g), 6) AS g, round(b + 0.2 * (0.4 * t + 0.5 * (1 - t) - b), 6) AS b FROM y")
def _(spark, sf_dir):
    """A ramp from one tint to another by luminance, blended in."""
    t = colour.clamp((colour.luminance(*channels()) - 0.2) / 0.6)
    return out(rgb(spark, sf_dir), "k", **{n: c + 0.2 * (high * t + low * (1 - t) - c) for n, c, high, low in zip("rgb", channels(), (0.9, 0.7, 0.4), (0.2, 0.3, 0.5), strict=True)})


@register("hue_remap", f"WITH {RGB}, {LAB}, h AS (SELECT k, atan2(b, a) AS h FROM lab) SELECT k, round(CASE WHEN h < -1 THEN -3.2 + (h + 3.2) * 0.8 WHEN h < 0.5 THEN -1.44 + (h + 1) * 1.2 ELSE 0.36 + (h - 0.5) * 1.0 END, 4) AS h FROM h")
def _(spark, sf_dir):
    """A piecewise straight map of the hue."""
    h = F.atan2("b", "a")
    return lab(spark, sf_dir).select("k", F.round(F.when(h < -1, -3.2 + (h + 3.2) * 0.8).when(h < 0.5, -1.44 + (h + 1) * 1.2).otherwise(0.36 + (h - 0.5) * 1.0), 4).alias("h"))


@register("black_and_white", f"WITH {RGB} SELECT k, round(greatest(0, least((0.4 * r + 0.45 * g + 0.15 * b) * 1.1, 1)), 6) AS y FROM c")
def _(spark, sf_dir):
    r, g, b = channels()
    return out(rgb(spark, sf_dir), "k", y=colour.clamp((0.4 * r + 0.45 * g + 0.15 * b) * 1.1))


@register("exposure_compression", f"WITH {RGB}, e AS (SELECT k, g * 2.0::DOUBLE ** 0.7 AS v FROM c) SELECT k, round(CASE WHEN v <= 0.8 THEN v ELSE 0.8 + 0.2 * (1 - exp(-(v - 0.8) / 0.2)) END, 6) AS v FROM e")
def _(spark, sf_dir):
    """Exposure in stops, and a shoulder that never reaches white."""
    v = F.col("g") * 2.0**0.7
    return out(rgb(spark, sf_dir), "k", v=F.when(v <= 0.8, v).otherwise(0.8 + 0.2 * (1 - F.exp(-(v - 0.8) / 0.2))))


@register("jzazbz", f"WITH {RGB}, p AS (SELECT k, " + ", ".join("(({0}) * 100) AS {1}".format(" + ".join(f"{w} * {c}" for w, c in zip(row, "rgb")), n) for row, n in zip(colour.RGB_TO_XYZ, "xyz")) + " FROM c), q AS (SELECT k, 1.15 * x - 0.15 * z AS x, 0.66 * y + 0.34 * x AS y, z FROM p), l AS (SELECT k, 0.41478972 * x + 0.579999 * y + 0.014648 * z AS l, -0.20151 * x + 1.120649 * y + 0.0531008 * z AS m, -0.0166008 * x + 0.2648 * y + 0.6684799 * z AS s FROM q), e AS (SELECT k, " + ", ".join(f"((0.8359375 + 18.8515625 * (greatest({c}, 0) / 10000) ** 0.1593017578125::DOUBLE) / (1 + 18.6875 * (greatest({c}, 0) / 10000) ** 0.1593017578125::DOUBLE)) ** 134.034375::DOUBLE AS {c}" for c in "lms") + " FROM l) SELECT k, round(0.44 * (0.5 * (l + m)) / (1 - 0.56 * (0.5 * (l + m))), 6) AS j, round(3.524 * l - 4.066708 * m + 0.542708 * s, 6) AS a, round(0.199076 * l + 1.096799 * m - 1.295875 * s, 6) AS b FROM e")
def _(spark, sf_dir):
    """Forward into a space for a high dynamic range: cone responses through the PQ curve."""
    x, y, z = (c * 100 for c in colour.matrix(colour.RGB_TO_XYZ, *channels()))
    cones = colour.matrix(((0.41478972, 0.579999, 0.014648), (-0.20151, 1.120649, 0.0531008), (-0.0166008, 0.2648, 0.6684799)), 1.15 * x - 0.15 * z, 0.66 * y + 0.34 * x, z)

    def pq(c: Column) -> Column:
        t = F.pow(F.greatest(c, F.lit(0.0)) / 10000, F.lit(0.1593017578125))
        return F.pow((0.8359375 + 18.8515625 * t) / (1 + 18.6875 * t), F.lit(134.034375))

    df = rgb(spark, sf_dir).select("k", F.inline(F.array(F.struct(*(pq(c).alias(n) for n, c in zip("lms", cones, strict=True))))))
    light, m, s = F.col("l"), F.col("m"), F.col("s")
    i = 0.5 * (light + m)
    return out(df, "k", j=0.44 * i / (1 - 0.56 * i), a=3.524 * light - 4.066708 * m + 0.542708 * s, b=0.199076 * light + 1.096799 * m - 1.295875 * s)


@register("gain_map", f"WITH {PX}, g(j, i, w) AS (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 1.1), (0, 2, 1.3), (1, 0, 1.05), (1, 1, 1.2), (1, 2, 1.25), (2, 0, 1.15), (2, 1, 1.1), (2, 2, 1.4)), p AS (SELECT *, least(floor(y / 3.5), 1) AS j, least(floor(x / 3.5), 1) AS i FROM px) SELECT img, y, x, round(v * ((1 - (y / 3.5 - p.j)) * ((1 - (x / 3.5 - p.i)) * a.w + (x / 3.5 - p.i) * b.w) + (y / 3.5 - p.j) * ((1 - (x / 3.5 - p.i)) * c.w + (x / 3.5 - p.i) * d.w)), 6) AS v FROM p JOIN g a ON a.j = p.j AND a.i = p.i JOIN g b ON b.j = p.j AND b.i = p.i + 1 JOIN g c ON c.j = p.j + 1 AND c.i = p.i JOIN g d ON d.j = p.j + 1 AND d.i = p.i + 1")
def _(spark, sf_dir):
    """Gains on a coarse grid, bilinear between its points: the plan knows the gain of every place."""
    grid = ((1.0, 1.1, 1.3), (1.05, 1.2, 1.25), (1.15, 1.1, 1.4))
    gains = []
    for y in range(SIDE):
        for x in range(SIDE):
            j, i = min(int(y / 3.5), 1), min(int(x / 3.5), 1)
            u, v = y / 3.5 - j, x / 3.5 - i
            gains.append((1 - u) * ((1 - v) * grid[j][i] + v * grid[j][i + 1]) + u * ((1 - v) * grid[j + 1][i] + v * grid[j + 1][i + 1]))
    return rounded(planes(spark, sf_dir).withColumn("v", F.zip_with("a", F.array(*map(F.lit, gains)), lambda a, g: a * g)), "v")


@register("normalise_range", f"WITH {PX}, m AS (SELECT img, min(v) AS lo, max(v) AS hi FROM px GROUP BY img) SELECT img, y, x, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM px JOIN m USING (img)")
def _(spark, sf_dir):
    df = hold(planes(spark, sf_dir), "r", F.struct(F.array_min("a").alias("lo"), F.array_max("a").alias("hi")))
    span = F.col("r.hi") - F.col("r.lo")
    return rounded(df.withColumn("v", F.transform("a", lambda v: F.when(span > 0, (v - F.col("r.lo")) / span).otherwise(0.0))), "v")


@register("ratio_plane", f"WITH {PX} SELECT img, y, x, round(CASE WHEN b > 0 THEN v * abs(v) / b ELSE v END, 6) + 0.0 AS v FROM px JOIN {blur_sql(1)} USING (img, y, x)")
def _(spark, sf_dir):
    """Times a ratio of planes where its denominator is over 0."""
    df = box_blur(planes(spark, sf_dir), 1, out="g")
    return rounded(df.withColumn("v", F.zip_with("a", "g", lambda v, g: F.when(g > 0, v * F.abs(v) / g).otherwise(v))), "v")


@register("shadows_highlights", f"WITH {PX} SELECT img, y, x, round(v + 0.3 * greatest(0.05 - b, 0) - 0.2 * greatest(b - 0.05, 0), 6) + 0.0 AS v, round(b, 6) + 0.0 AS map FROM px JOIN {blur_sql(2)} USING (img, y, x)")
def _(spark, sf_dir):
    """A blurred map lifts the dark parts and lowers the light ones."""
    df = box_blur(planes(spark, sf_dir), 2, out="map")
    v = F.zip_with("a", "map", lambda v, m: v + 0.3 * F.greatest(0.05 - m, F.lit(0.0)) - 0.2 * F.greatest(m - 0.05, F.lit(0.0)))
    return rounded(df.withColumn("v", v), "v", "map")


@register("green_equil_local", f"WITH {PX} SELECT p.img, p.y, p.x, round(CASE WHEN (p.y + p.x) % 2 = 1 AND p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 AND abs(avg(q.v) - p.v) < 0.1 THEN (avg(q.v) + p.v) / 2 ELSE p.v END, 6) AS v FROM px p JOIN (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) k(dy, dx) ON true JOIN px q ON q.img = p.img AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7) GROUP BY p.img, p.y, p.x, p.v")
def _(spark, sf_dir):
    """Greens that differ little from their diagonal neighbours' mean meet it halfway."""
    near = f"(({at('a', -1, -1)} + {at('a', -1, 1)} + {at('a', 1, -1)} + {at('a', 1, 1)}) / 4)"
    green = f"(({Y} + {X}) % 2 = 1 and {Y} between 1 and {SIDE - 2} and {X} between 1 and {SIDE - 2})"
    return rounded(planes(spark, sf_dir).withColumn("v", each(f"if({green} and abs({near} - get(a, i)) < 0.1D, ({near} + get(a, i)) / 2, get(a, i))")), "v")


@register("microcontrast", f"WITH {PX} SELECT img, y, x, round(v + 0.5 * CASE WHEN abs(v - b) < 0.1 THEN v - b ELSE 0.1 * sign(v - b) END, 6) AS v FROM px JOIN {stencil_sql({(-1, 0): 0.25, (1, 0): 0.25, (0, -1): 0.25, (0, 1): 0.25})} USING (img, y, x)")
def _(spark, sf_dir):
    """Difference to the four neighbours' mean, up to a limit."""
    near = f"(({at('a', -1, 0)} + {at('a', 1, 0)} + {at('a', 0, -1)} + {at('a', 0, 1)}) / 4)"
    return rounded(planes(spark, sf_dir).withColumn("v", each(f"get(a, i) + 0.5D * if(abs(get(a, i) - {near}) < 0.1D, get(a, i) - {near}, 0.1D * sign(get(a, i) - {near}))")), "v")


@register("highlight_opposed", f"WITH {PX}, c AS (SELECT *, v > 0.2 AS clipped FROM px), o AS (SELECT img, coalesce(avg(v - b) FILTER (NOT clipped), 0) AS offs FROM c JOIN {blur_sql(1)} USING (img, y, x) GROUP BY img) SELECT img, y, x, round(CASE WHEN clipped THEN greatest(v, b + offs) ELSE v END, 6) AS v FROM c JOIN {blur_sql(1)} USING (img, y, x) JOIN o USING (img)")
def _(spark, sf_dir):
    """Clipped places take their box's mean and the offset that unclipped places have to theirs, if that is more."""
    df = box_blur(planes(spark, sf_dir), 1, out="g")
    open_ = F.filter(F.zip_with("a", "g", lambda v, g: F.when(v <= 0.2, v - g)), lambda d: d.isNotNull())
    df = hold(hold(df, "d", open_), "offs", F.expr(f"if(size(d) > 0, {mean_of('d')}, cast(0 as double))"))
    return rounded(df.withColumn("v", F.zip_with("a", "g", lambda v, g: F.when(v > 0.2, F.greatest(v, g + F.col("offs"))).otherwise(v))), "v")


@register("border_interpolation", f"WITH {PX} SELECT p.img, p.y, p.x, round(CASE WHEN p.y IN (0, 7) OR p.x IN (0, 7) THEN avg(q.v) ELSE p.v END, 6) AS v FROM px p JOIN px q ON q.img = p.img AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 AND (q.y - p.y) % 2 = 0 AND (q.x - p.x) % 2 = 0 GROUP BY p.img, p.y, p.x, p.v")
def _(spark, sf_dir):
    """The border takes the mean of its colour's sites around it."""
    w = window("z", 2)
    same = f"transform(filter({w}, s -> s.c = get(z, i).c), s -> s.v)"
    df = hold(planes(spark, sf_dir), "z", F.expr(f"transform(sequence(0, size(a) - 1), i -> struct(({Y} % 2) * 2 + {X} % 2 as c, get(a, i) as v))"))
    return rounded(df.withColumn("v", each(f"if({Y} in (0, {SIDE - 1}) or {X} in (0, {SIDE - 1}), {mean_of(same)}, get(a, i))")), "v")


@register("spot_clone", f"WITH {PX}, w AS (SELECT y, x, greatest(0, 1 - sqrt((y - 5) ** 2 + (x - 5) ** 2) / 2.5) AS f FROM px WHERE img = 0) SELECT p.img, p.y, p.x, round(p.v * (1 - w.f) + coalesce(s.v, 0) * w.f, 6) AS v FROM px p JOIN w USING (y, x) LEFT JOIN px s ON s.img = p.img AND s.y = p.y - 3 AND s.x = p.x - 3")
def _(spark, sf_dir):
    """A source circle copied over a target, feathered."""
    weight = [max(0.0, 1 - (((i // SIDE - 5) ** 2 + (i % SIDE - 5) ** 2) ** 0.5) / 2.5) for i in range(SIDE * SIDE)]
    df = planes(spark, sf_dir).withColumn("v", F.transform("a", lambda v, i: v * (1 - F.get(F.array(*map(F.lit, weight)), i)) + F.coalesce(F.when((i % SIDE >= 3) & (i >= 3 * SIDE), F.get("a", i - 3 * SIDE - 3)), F.lit(0.0)) * F.get(F.array(*map(F.lit, weight)), i)))
    return explode_plane(df.select("img", F.transform("v", lambda v: F.round(v, 6)).alias("v")), "v")


@register("table_percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(median(l_extendedprice), 4) AS p50, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    """The percentiles and the distinct parts each on their own: together, every part of a flag would hold a table of its prices."""
    li = table(spark, sf_dir, "lineitem")
    parts = li.groupBy(F.col("l_returnflag").alias("_of")).agg(F.count_distinct("l_partkey").alias("parts"))
    found = parts.join(F.broadcast(percentiles(li, "l_returnflag", "l_extendedprice", (0.25, 0.5))), F.col("_of").eqNullSafe(F.col("l_returnflag")), "left")
    return found.select(F.col("_of").alias("l_returnflag"), F.round("p0", 4).alias("p25"), F.round("p1", 4).alias("p50"), "parts")
