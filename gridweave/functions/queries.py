"""Queries over the scalar functions: every one is a projection that code generation fuses into the scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fixtures import PX, pixels
from ..registry import register, table
from . import colour, geometry, text

RGB = "c AS (SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS r, (p_retailprice - 850) / 1300 AS g, (p_partkey % 97) / 97.0::DOUBLE AS b FROM part)"


def rgb(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 50.0).alias("r"), ((F.col("p_retailprice") - 850) / 1300).alias("g"), ((F.col("p_partkey") % 97) / 97.0).alias("b"))


def channels():
    return F.col("r"), F.col("g"), F.col("b")


def out(df, key, **columns):
    return df.select(key, *(F.round(c, 6).alias(n) for n, c in columns.items()))


def _gamma(v):
    return f"CASE WHEN {v} <= 0.0031308 THEN 12.92 * {v} ELSE 1.055 * ({v}) ** (1 / 2.4::DOUBLE) - 0.055 END"


def _linear(v):
    return f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE (({v} + 0.055) / 1.055) ** 2.4::DOUBLE END"


@register("srgb_gamma", f"WITH {RGB} SELECT k, round({_gamma('r')}, 6) AS e, round({_linear('g')}, 6) AS d FROM c")
def _(spark, sf_dir):
    r, g, _ = channels()
    return out(rgb(spark, sf_dir), "k", e=colour.srgb_gamma(r), d=colour.srgb_linear(g))


@register("general_gamma", f"WITH {RGB} SELECT k, round(CASE WHEN r <= 0.018 THEN r * 4.5 ELSE r ** (1 / 2.2::DOUBLE) * 1.099 - 0.099 END, 6) AS e FROM c")
def _(spark, sf_dir):
    return out(rgb(spark, sf_dir), "k", e=colour.gamma(F.col("r"), 2.2, 0.018, 4.5, 0.099))


@register("luminance_saturation", f"WITH {RGB} SELECT k, round(0.2126729 * r + 0.7151522 * g + 0.0721750 * b, 6) AS y, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END, 6) AS s FROM c")
def _(spark, sf_dir):
    return out(rgb(spark, sf_dir), "k", y=colour.luminance(*channels()), s=colour.saturation(*channels()))


HUE = "CASE WHEN mx <= mn THEN 0 ELSE ((CASE WHEN mx = r THEN (g - b) / (mx - mn) WHEN mx = g THEN 2 + (b - r) / (mx - mn) ELSE 4 + (r - g) / (mx - mn) END / 6) + 1) % 1 END"


@register("rgb_hsv", f"WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c) SELECT k, round(({HUE}) % 1, 6) AS h, round(CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0 END, 6) AS s, round(mx, 6) AS v FROM m")
def _(spark, sf_dir):
    h, s, v = colour.rgb_to_hsv(*channels())
    return out(rgb(spark, sf_dir), "k", h=h, s=s, v=v)


@register("hsv_round_trip", f"WITH {RGB} SELECT k, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c")
def _(spark, sf_dir):
    """To HSV and back is what it was."""
    h, s, v = colour.rgb_to_hsv(*channels())
    df = rgb(spark, sf_dir).select("k", h.alias("h"), s.alias("s"), v.alias("v"))
    r, g, b = colour.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return out(df, "k", r=r, g=g, b=b)


@register("rgb_hsl", f"WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c) SELECT k, round(({HUE}) % 1, 6) AS h, round(CASE WHEN mx <= mn THEN 0 WHEN (mx + mn) / 2 <= 0.5 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END, 6) AS s, round((mx + mn) / 2, 6) AS l FROM m")
def _(spark, sf_dir):
    h, s, light = colour.rgb_to_hsl(*channels())
    return out(rgb(spark, sf_dir), "k", h=h, s=s, l=light)


@register("hsl_round_trip", f"WITH {RGB} SELECT k, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c")
def _(spark, sf_dir):
    h, s, light = colour.rgb_to_hsl(*channels())
    df = rgb(spark, sf_dir).select("k", h.alias("h"), s.alias("s"), light.alias("l"))
    r, g, b = colour.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l"))
    return out(df, "k", r=r, g=g, b=b)


def _f(v, w):
    return f"CASE WHEN ({v}) / {w} > 216.0::DOUBLE / 24389 THEN cbrt(({v}) / {w}) ELSE (24389.0::DOUBLE / 27 * ({v}) / {w} + 16) / 116 END"


XYZ = ["{} * r + {} * g + {} * b".format(*row) for row in colour.RGB_TO_XYZ]
LAB = f"x AS (SELECT k, {_f(XYZ[0], 0.9642)} AS fx, {_f(XYZ[1], '1.0::DOUBLE')} AS fy, {_f(XYZ[2], 0.8249)} AS fz FROM c), lab AS (SELECT k, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM x)"


@register("rgb_lab", f"WITH {RGB}, {LAB} SELECT k, round(l, 5) AS l, round(a, 5) AS a, round(b, 5) AS b FROM lab")
def _(spark, sf_dir):
    lab = colour.xyz_to_lab(*colour.matrix(colour.RGB_TO_XYZ, *channels()))
    return rgb(spark, sf_dir).select("k", *(F.round(c, 5).alias(n) for n, c in zip("lab", lab, strict=True)))


@register("lab_lch", f"WITH {RGB}, {LAB} SELECT k, round(sqrt(a * a + b * b), 4) AS c, round(atan2(b, a), 4) AS h FROM lab")
def _(spark, sf_dir):
    lab = colour.xyz_to_lab(*colour.matrix(colour.RGB_TO_XYZ, *channels()))
    c, h = colour.lab_to_lch(lab[1], lab[2])
    return rgb(spark, sf_dir).select("k", F.round(c, 4).alias("c"), F.round(h, 4).alias("h"))


@register("lab_round_trip", f"WITH {RGB} SELECT k, round(r, 4) AS r, round(g, 4) AS g, round(b, 4) AS b FROM c")
def _(spark, sf_dir):
    """RGB to Lab to LCh and all the way back."""
    lab = colour.xyz_to_lab(*colour.matrix(colour.RGB_TO_XYZ, *channels()))
    df = rgb(spark, sf_dir).select("k", *(c.alias(n) for n, c in zip("lab", lab, strict=True)))
    c, h = colour.lab_to_lch(F.col("a"), F.col("b"))
    df = df.select("k", "l", c.alias("c"), h.alias("h"))
    a, b = colour.lch_to_lab(F.col("c"), F.col("h"))
    back = colour.matrix(colour.XYZ_TO_RGB, *colour.lab_to_xyz(F.col("l"), a, b))
    return df.select("k", *(F.round(v, 4).alias(n) for n, v in zip("rgb", back, strict=True)))


@register("white_balance", f"WITH {RGB} SELECT k, round(r * 2.1, 6) AS r, round(g, 6) AS g, round(b * 1.6, 6) AS b, round(greatest(r * 2.1, g, b * 1.6), 6) AS most FROM c")
def _(spark, sf_dir):
    r, g, b = F.col("r") * 2.1, F.col("g"), F.col("b") * 1.6
    return out(rgb(spark, sf_dir), "k", r=r, g=g, b=b, most=F.greatest(r, g, b))


@register("channel_mixer", f"WITH {RGB} SELECT k, round(0.8 * r + 0.1 * g + 0.1 * b, 6) AS r, round(0.05 * r + 0.9 * g + 0.05 * b, 6) AS g, round(0.1 * g + 0.9 * b + 0.0 * r, 6) AS b FROM c")
def _(spark, sf_dir):
    r, g, b = colour.matrix(((0.8, 0.1, 0.1), (0.05, 0.9, 0.05), (0.0, 0.1, 0.9)), *channels())
    return out(rgb(spark, sf_dir), "k", r=r, g=g, b=b)


@register("scale_colours", "SELECT l_returnflag AS c, round(max(greatest((l_extendedprice - b) * m, 0)), 4) AS most, round(avg((l_extendedprice - b) * m), 4) AS mean FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 900 WHEN 'N' THEN 950 ELSE 1000 END AS b, CASE l_returnflag WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.0 ELSE 1.5 END::DOUBLE AS m FROM lineitem) GROUP BY 1")
def _(spark, sf_dir):
    """Black level off, multiplier on, by channel; and each channel's largest value."""
    c = F.col("l_returnflag")
    black = F.when(c == "A", 900).when(c == "N", 950).otherwise(1000)
    gain = F.when(c == "A", 2.0).when(c == "N", 1.0).otherwise(1.5)
    v = (F.col("l_extendedprice") - black) * gain
    return table(spark, sf_dir, "lineitem").groupBy(c.alias("c")).agg(F.round(F.max(F.greatest(v, F.lit(0.0))), 4).alias("most"), F.round(F.avg(v), 4).alias("mean"))


LUT = [round((k / 20) ** 0.5 * 10, 6) for k in range(21)]


@register("lut_apply", f"WITH t(i, v) AS (SELECT unnest(range(21)), unnest({LUT}::DOUBLE[])), l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 2 - 2 AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(a.v + (b.v - a.v) * (least(greatest(q, 0), 20) - a.i), 6) AS v FROM l JOIN t a ON a.i = greatest(0, least(floor(q), 19)) JOIN t b ON b.i = a.i + 1")
def _(spark, sf_dir):
    """An interpolated table as an array constant: neither join nor broadcast."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(colour.lookup(F.col("l_quantity") / 2 - 2, LUT), 6).alias("v"))


@register("lut_whole", f"WITH t(i, v) AS (SELECT unnest(range(21)), unnest({LUT}::DOUBLE[])) SELECT p_partkey, v FROM part JOIN t ON i = greatest(least(p_size - 10, 20), 0)")
def _(spark, sf_dir):
    values = F.array(*(F.lit(x) for x in LUT))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(values, F.greatest(F.least(F.col("p_size") - 10, F.lit(20)), F.lit(0))).alias("v"))


@register("blend_factor", "SELECT p_partkey, round(0.5 * (1 + (p_size / 50.0::DOUBLE * 16 / 0.4 - 16) / sqrt(1 + (p_size / 50.0::DOUBLE * 16 / 0.4 - 16) ** 2)), 6) AS f FROM part")
def _(spark, sf_dir):
    from ..operators.statistics import blend_factor

    return table(spark, sf_dir, "part").select("p_partkey", F.round(blend_factor(F.col("p_size") / 50.0, 0.4), 6).alias("f"))


@register("soft_light", f"WITH {RGB}, g AS (SELECT k, {_gamma('r')} AS g FROM (SELECT k, greatest(0, least(r, 1)) AS r FROM c)), m AS (SELECT k, 0.4 * (g * g * (3 - 2 * g)) + 0.6 * g AS m FROM g) SELECT k, round({_linear('m')}, 6) AS v FROM m")
def _(spark, sf_dir):
    return out(rgb(spark, sf_dir), "k", v=colour.soft_light(F.col("r"), 0.4))


@register("film_negative", f"WITH {RGB} SELECT k, round(least((greatest(r, 1e-6) / 0.18) ** -1.36::DOUBLE, 8), 6) AS v FROM c")
def _(spark, sf_dir):
    return out(rgb(spark, sf_dir), "k", v=colour.film_negative(F.col("r"), 0.18, 1.36, 8.0))


@register("vignette", f"WITH {PX} SELECT img, y, x, round(v * (1 + 0.4 * ((y - 3.5) ** 2 + (x - 3.5) ** 2) / 24.5), 6) AS v FROM px")
def _(spark, sf_dir):
    y, x = F.col("y"), F.col("x")
    return pixels(spark, sf_dir).select("img", "y", "x", F.round(F.col("v") * colour.vignette(y, x, 8, 0.4), 6).alias("v"))


@register("graduated_filter", f"WITH {PX}, t AS (SELECT *, greatest(0, least(((y - 3.5) * cos(0.4) - (x - 3.5) * sin(0.4)) / 4.0 + 0.5, 1)) AS t FROM px) SELECT img, y, x, round(v * 2.0::DOUBLE ** (-1.5 * t * t * (3 - 2 * t)), 6) AS v FROM t")
def _(spark, sf_dir):
    y, x = F.col("y"), F.col("x")
    return pixels(spark, sf_dir).select("img", "y", "x", F.round(F.col("v") * colour.gradient(y, x, 8, 0.4, 0.5, 1.5), 6).alias("v"))


_SCALE = (1.2 - 0.8) / ((((1 - 0.8) / (1.2 - 0.8)) ** -1.2 - 1) ** (1 / 1.2))


@register("gamut_compress", f"WITH {RGB}, d AS (SELECT k, greatest(r, g, b) AS m, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - r) / abs(greatest(r, g, b)) END AS d FROM c) SELECT k, round(m - CASE WHEN d < 0.8 THEN d ELSE 0.8 + {_SCALE!r} * ((d - 0.8) / {_SCALE!r}) / (1 + greatest((d - 0.8) / {_SCALE!r}, 0) ** 1.2::DOUBLE) ** (1 / 1.2::DOUBLE) END * abs(m), 6) AS v FROM d")
def _(spark, sf_dir):
    r, g, b = channels()
    return out(rgb(spark, sf_dir), "k", v=colour.compress_gamut(r, F.greatest(r, g, b), 0.8, 1.2, 1.2))


GAINS = (0.5, 0.2, 0.0, -0.3)
_W = [f"exp(-((ev + {2.0 * (3 - k)}) ** 2) / 8)" for k in range(4)]


@register("tone_equaliser", f"WITH {RGB}, e AS (SELECT k, g, log2(greatest(g, 0.0001)) AS ev FROM c) SELECT k, round(g * 2.0::DOUBLE ** (({' + '.join(f'{w} * {g}' for w, g in zip(_W, GAINS))}) / ({' + '.join(_W)})), 6) AS v FROM e")
def _(spark, sf_dir):
    return out(rgb(spark, sf_dir), "k", v=colour.band_gains(F.col("g"), GAINS))


@register("split_toning", f"WITH {RGB}, y AS (SELECT *, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y FROM c) SELECT k, round(r + 0.1 * (1 - y) - 0.05 * y, 6) AS r, round(g, 6) AS g, round(b + 0.08 * y, 6) AS b FROM y")
def _(spark, sf_dir):
    """Shadows towards one tint, highlights towards another."""
    r, g, b = channels()
    y = colour.luminance(r, g, b)
    return out(rgb(spark, sf_dir), "k", r=r + 0.1 * (1 - y) - 0.05 * y, g=g, b=b + 0.08 * y)


@register("lab_grid_toning", f"WITH {RGB}, {LAB} SELECT k, round(a + 3 + l / 100 * 5, 4) AS a, round(b - 2 + l / 100 * 4, 4) AS b FROM lab")
def _(spark, sf_dir):
    light, a, b = colour.xyz_to_lab(*colour.matrix(colour.RGB_TO_XYZ, *channels()))
    return rgb(spark, sf_dir).select("k", F.round(a + 3 + light / 100 * 5, 4).alias("a"), F.round(b - 2 + light / 100 * 4, 4).alias("b"))


@register("shutter_text", "SELECT event_id, CASE WHEN s > 0 AND s <= 0.5 THEN '1/' || floor(1 / s + 0.5)::BIGINT WHEN s = floor(s) THEN floor(s)::BIGINT::VARCHAR ELSE printf('%.1f', s) END AS t FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 / (event_id % 500 + 2) WHEN event_id % 3 = 1 THEN event_id % 30 + 1 ELSE event_id % 8 + 0.75 END::DOUBLE AS s FROM events)")
def _(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 3 == 0, 1.0 / (i % 500 + 2)).when(i % 3 == 1, i % 30 + 1).otherwise(i % 8 + 0.75)
    return table(spark, sf_dir, "events").select("event_id", text.shutter_text(s.cast("double")).alias("t"))


@register("shutter_parse", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN round(1 / (event_id % 500 + 2.0::DOUBLE), 6) WHEN event_id % 4 = 1 THEN event_id % 30 WHEN event_id % 4 = 2 THEN 0 ELSE 0 END::DOUBLE AS s FROM events")
def _(spark, sf_dir):
    i = F.col("event_id")
    t = F.when(i % 4 == 0, F.concat(F.lit("1/"), (i % 500 + 2).cast("string"))).when(i % 4 == 1, (i % 30).cast("string")).when(i % 4 == 2, "5/0").otherwise("fast")
    return table(spark, sf_dir, "events").select("event_id", F.round(text.shutter_parse(t), 6).alias("s"))


@register("exposure_texts", "SELECT p_partkey, printf('%.1f', p_size / 8.0::DOUBLE) AS f, CASE WHEN abs((p_partkey % 7 - 3) / 4.0) < 0.005 THEN '' ELSE printf('%.2f', (p_partkey % 7 - 3) / 4.0::DOUBLE) END AS c FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.aperture_text(F.col("p_size") / 8.0).alias("f"), text.compensation_text((F.col("p_partkey") % 7 - 3) / 4.0, True).alias("c"))


@register("frame_keys", "SELECT p_partkey, concat_ws(' ', rpad(upper(p_brand), 10, ' '), rpad(upper(p_type), 10, ' '), lpad(p_size::VARCHAR, 5, ' '), printf('%.6f', floor(s * 10.0::DOUBLE ** (1 - floor(log10(s))) + 0.5) / 10.0::DOUBLE ** (1 - floor(log10(s))))) AS dark, concat_ws(' ', p_brand, p_type, p_name, printf('%.2f', p_size * 1.0), printf('%.2f', p_size / 4.0)) AS flat FROM (SELECT *, p_size / 300.0::DOUBLE AS s FROM part)")
def _(spark, sf_dir):
    p, c = table(spark, sf_dir, "part"), F.col
    dark = text.dark_frame_key(c("p_brand"), c("p_type"), c("p_size"), c("p_size") / 300.0)
    return p.select("p_partkey", dark.alias("dark"), text.flat_field_key(c("p_brand"), c("p_type"), c("p_name"), c("p_size") * 1.0, c("p_size") / 4.0).alias("flat"))


@register("name_template", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') || '-' || coalesce(list_extract(string_split(regexp_replace(url, '/[^/]*$', ''), '/'), -1), '') || '_' || lpad((page_id % 1000)::VARCHAR, 4, '0') || '_' || (page_id % 6) || '-2024-01-31' AS name FROM pages")
def _(spark, sf_dir):
    c = F.col
    name = text.name_template("%f-%d_%s4_%r-%tF", c("url"), c("page_id") % 6, c("page_id") % 1000, F.lit("2024-01-31").cast("date"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))


@register("path_parts", "SELECT page_id, regexp_extract(url, '\\.([^./\\\\]+)$', 1) AS ext, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS base, md5(url) AS key, regexp_replace(url, '^https:/', '') AS rel FROM pages")
def _(spark, sf_dir):
    c = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.extension(c).alias("ext"), text.base_name(c).alias("base"), F.md5(c).alias("key"), text.relative_path(c, "https:/").alias("rel"))


@register("unique_names", "SELECT p_partkey, CASE WHEN r <= 100 THEN p_name || CASE WHEN r = 1 THEN '' ELSE '-' || (r - 1) END || '.tif' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS r FROM part)")
def _(spark, sf_dir):
    """A number is added to a name that is taken, up to 99; those beyond have no name."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey"))
    df = table(spark, sf_dir, "part").withColumn("r", r)
    return df.select("p_partkey", F.when(F.col("r") <= 100, F.concat("p_name", F.when(F.col("r") == 1, "").otherwise(F.concat(F.lit("-"), (F.col("r") - 1).cast("string"))), F.lit(".tif"))).alias("name"))


@register("lens_normalise", "SELECT p_partkey, regexp_replace(p_name || ' - ' || p_type || ' -x', '\\s*-\\s*', '-', 'g') AS lens, CASE WHEN p_partkey % 9 = 0 THEN 'PS' WHEN p_partkey % 4 = 0 THEN 'HDR' ELSE 'STD' END AS kind FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    lens = text.normalise_lens(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_type"), F.lit(" -x")))
    return table(spark, sf_dir, "part").select("p_partkey", lens.alias("lens"), text.image_type(k % 9 == 0, k % 4 == 0).alias("kind"))


@register("date_texts", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y:%m:%d %H:%M:%S') AS exif FROM events")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("exif"))


@register("resize_scale", "SELECT p_partkey, round(500 / w, 6) AS width, round(least(500 / w, 300 / h), 6) AS box, round(500 / greatest(w, h), 6) AS long_, round(CASE WHEN abs(500 / least(w, h) - 1) <= 1e-5 THEN 1 ELSE 500 / least(w, h) END, 6) AS short_ FROM (SELECT p_partkey, p_size * 20.0::DOUBLE AS w, p_retailprice AS h FROM part)")
def _(spark, sf_dir):
    w, h = F.col("p_size") * 20.0, F.col("p_retailprice")
    s = geometry.resize_scale
    return out(table(spark, sf_dir, "part"), "p_partkey", width=s(w, h, "width", 500.0), box=s(w, h, "box", 500.0, 300.0), long_=s(w, h, "long", 500.0), short_=s(w, h, "short", 500.0))


@register("framing", "SELECT p_partkey, (w + 2 * floor(least(w, h) * 0.05 + 0.5))::BIGINT AS fw, (h + 2 * floor(least(w, h) * 0.05 + 0.5))::BIGINT AS fh, least(floor(w * 0.9), floor(floor(h * 0.9) * 1.5))::BIGINT AS cw, least(floor(h * 0.9), floor(floor(w * 0.9) / 1.5))::BIGINT AS ch FROM (SELECT p_partkey, p_size * 20 AS w, floor(p_retailprice)::BIGINT AS h FROM part)")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("w"), F.floor("p_retailprice").alias("h"))
    fw, fh = geometry.frame_size(F.col("w"), F.col("h"), 0.05)
    cw, ch = geometry.auto_crop(F.col("w"), F.col("h"), F.lit(0.9), 1.5)
    return p.select("p_partkey", *(c.cast("long").alias(n) for n, c in (("fw", fw), ("fh", fh), ("cw", cw), ("ch", ch))))


def coordinate_transform(df: DataFrame) -> DataFrame:
    """Where places come from."""
    y, x = F.col("y"), F.col("x")
    sy, sx = geometry.transform(y, x, 8, 0.2, 0.05, 1.1)
    return df.select("img", "y", "x", F.round(sy, 6).alias("sy"), F.round(sx, 6).alias("sx"), F.round(geometry.polar(y, x)[0], 6).alias("r"))


@register("coordinate_transform", f"WITH {PX}, c AS (SELECT img, y, x, ((x - 3.5) / 1.1) * cos(0.2) - ((y - 3.5) / 1.1) * sin(0.2) AS xr, ((x - 3.5) / 1.1) * sin(0.2) + ((y - 3.5) / 1.1) * cos(0.2) AS yr FROM px) SELECT img, y, x, round(yr * (1 + 0.05 * (xr * xr + yr * yr) / 12.25) + 3.5, 6) AS sy, round(xr * (1 + 0.05 * (xr * xr + yr * yr) / 12.25) + 3.5, 6) AS sx, round(sqrt(x * x + y * y), 6) AS r FROM c")
def _(spark, sf_dir):
    return coordinate_transform(pixels(spark, sf_dir))


@register("tile_planner", "SELECT p_partkey, CASE WHEN w <= 200 THEN 1 ELSE ceil((w - 32) / 168.0)::INT END AS n, CASE WHEN w <= 200 THEN w ELSE (ceil((w - 32)::DOUBLE / ceil((w - 32) / 168.0)) + ceil((w - 32)::DOUBLE / ceil((w - 32) / 168.0))::INT % 2)::INT END AS step FROM (SELECT p_partkey, p_size * 40 AS w FROM part)")
def _(spark, sf_dir):
    n, step = geometry.tile_count(F.col("p_size") * 40, 200, 32)
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), step.alias("step"))
