"""Histograms and what is read from them: means, percentiles, exposure, distribution matching.

Bins are counted by partial aggregates, so what crosses the network is a row a bin and task. All that follows works on
bins, whose number a parameter bounds, not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register, table
from .fixtures import PX, pixels


def histogram(df: DataFrame, index: Column, weight: Column | None = None, by: tuple = ()) -> DataFrame:
    """(bin, n): rows, or the sum of weights, a bin; `index` is cut towards zero."""
    return df.groupBy(*by, index.cast("long").alias("bin")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


HIST = "h AS (SELECT trunc(l_extendedprice / 128)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL)"


def price_bins(spark, sf_dir) -> DataFrame:
    return histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") / 128)


@register("hist_luma", f"WITH {HIST} SELECT * FROM h")
def _(spark, sf_dir):
    return price_bins(spark, sf_dir)


@register("hist_merge", "SELECT bin, sum(n)::BIGINT AS n FROM (SELECT trunc(l_quantity)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL UNION ALL SELECT trunc(l_quantity)::BIGINT, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY bin")
def _(spark, sf_dir):
    """Two histograms added bin by bin."""
    li = table(spark, sf_dir, "lineitem")
    part = lambda f: histogram(li.where(F.col("l_returnflag") == f), F.col("l_quantity"))
    return part("A").unionAll(part("R")).groupBy("bin").agg(F.sum("n").alias("n"))


@register("hist_weighted_mean", f"WITH {HIST} SELECT sum(n)::BIGINT AS total, round(sum(bin * n) / sum(n), 6) AS mean FROM h")
def _(spark, sf_dir):
    return price_bins(spark, sf_dir).agg(F.sum("n").alias("total"), F.round(F.sum(F.col("bin") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def rebin(bins: DataFrame, index: Column) -> DataFrame:
    return bins.groupBy(index.cast("long").alias("bin")).agg(F.sum("n").alias("n"))


@register("hist_rebin", f"WITH {HIST} SELECT trunc(bin * 0.37)::BIGINT AS bin, sum(n)::BIGINT AS n FROM h GROUP BY 1")
def _(spark, sf_dir):
    return rebin(price_bins(spark, sf_dir), F.col("bin") * F.lit(0.37).cast("double"))


@register("hist_rebin_curve", f"WITH {HIST} SELECT trunc(sqrt(bin * 1000.0::DOUBLE))::BIGINT AS bin, sum(n)::BIGINT AS n FROM h GROUP BY 1")
def _(spark, sf_dir):
    return rebin(price_bins(spark, sf_dir), F.sqrt(F.col("bin") * 1000.0))


@register("hist_auto_exposure", "SELECT least((trunc(l_extendedprice * 2)::BIGINT >> 3), 32767) AS bin, sum(CASE WHEN l_returnflag = 'N' THEN 4 ELSE 1 END)::BIGINT AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    """Sites of the mosaic weigh 4, others 1; the scaled index loses its three lowest bits."""
    index = F.least(F.shiftright((F.col("l_extendedprice") * 2).cast("long"), 3), F.lit(32767))
    return histogram(table(spark, sf_dir, "lineitem"), index, F.when(F.col("l_returnflag") == "N", 4).otherwise(1))


@register("hist_raw_channels", "SELECT l_returnflag AS c, greatest(0, least(255, trunc((l_extendedprice - 900) / 105000 * 256)::BIGINT)) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf_dir):
    index = F.greatest(F.lit(0), F.least(F.lit(255), ((F.col("l_extendedprice") - 900) / 105000 * 256).cast("long")))
    return histogram(table(spark, sf_dir, "lineitem"), index, by=(F.col("l_returnflag").alias("c"),))


@register("hist_multi", "SELECT channel, bin, count(*) AS n FROM (SELECT 'quantity' AS channel, trunc(l_quantity)::BIGINT AS bin FROM lineitem UNION ALL SELECT 'discount', trunc(l_discount * 100 + 0.5)::BIGINT FROM lineitem UNION ALL SELECT 'tax', trunc(l_tax * 100 + 0.5)::BIGINT FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    """Several histograms in one pass over the rows."""
    channels = F.array(*(F.struct(F.lit(n).alias("channel"), v.cast("long").alias("bin")) for n, v in (("quantity", F.col("l_quantity")), ("discount", F.col("l_discount") * 100 + 0.5), ("tax", F.col("l_tax") * 100 + 0.5))))
    rows = table(spark, sf_dir, "lineitem").select(F.explode(channels).alias("x")).select("x.channel", "x.bin")
    return rows.groupBy("channel", "bin").agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, row: Column, column: Column, size: int) -> DataFrame:
    """Counts by two indices; what lies outside the square is dropped."""
    rows = df.select(F.floor(row).alias("r"), F.floor(column).alias("c"))
    return rows.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).groupBy("r", "c").agg(F.count("*").alias("n"))


@register("vectorscope", "SELECT r, c, count(*) AS n FROM (SELECT floor(l_quantity * 2.5)::BIGINT AS r, floor(l_extendedprice / 800)::BIGINT AS c FROM lineitem) WHERE r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 99 GROUP BY ALL")
def _(spark, sf_dir):
    return histogram_2d(table(spark, sf_dir, "lineitem"), F.col("l_quantity") * 2.5, F.col("l_extendedprice") / 800, 100)


@register("vectorscope_polar", "SELECT r, c, count(*) AS n FROM (SELECT floor(l_discount * 5 * cos(l_quantity / 8) * 32 + 32)::BIGINT AS r, floor(l_discount * 5 * sin(l_quantity / 8) * 32 + 32)::BIGINT AS c FROM lineitem) WHERE r BETWEEN 0 AND 63 AND c BETWEEN 0 AND 63 GROUP BY ALL")
def _(spark, sf_dir):
    """Hue and saturation as polar coordinates."""
    radius, angle = F.col("l_discount") * 5, F.col("l_quantity") / 8
    return histogram_2d(table(spark, sf_dir, "lineitem"), radius * F.cos(angle) * 32 + 32, radius * F.sin(angle) * 32 + 32, 64)


@register("waveform", f"WITH {PX} SELECT x, floor(v * 64)::BIGINT AS bin, count(*) AS n FROM px GROUP BY ALL")
def _(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("x", F.floor(F.col("v") * 64).alias("bin")).agg(F.count("*").alias("n"))


def running(bins: DataFrame) -> DataFrame:
    """Bins with the count up to and with each, and in all. The table has a row a bin."""
    w = Window.orderBy("bin")
    return bins.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy()))


@register("hist_cdf", f"WITH {HIST} SELECT bin, n, sum(n) OVER (ORDER BY bin)::BIGINT AS cum, min(bin) OVER () AS first_bin, max(bin) OVER () AS last_bin FROM h")
def _(spark, sf_dir):
    whole = Window.partitionBy()
    return running(price_bins(spark, sf_dir)).select("bin", "n", "cum", F.min("bin").over(whole).alias("first_bin"), F.max("bin").over(whole).alias("last_bin"))


def binned_percentiles(df: DataFrame, column: str, shares: tuple[float, ...], size: int = 65536) -> DataFrame:
    """Percentiles from `size` bins between the least and the largest value, straight within a bin: two passes, a row a bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    scale = (size - 1) / (high - low) if low is not None and high > low else 0.0
    bins = running(histogram(df, (F.col(column) - F.lit(low)) * F.lit(scale)))
    before = F.col("cum") - F.col("n")
    out = []
    for k, share in enumerate(shares):
        want = F.col("total") * share
        inside = F.col("bin") + (want - before) / F.col("n")
        out.append(F.min_by(F.greatest(F.lit(low), F.least(F.lit(high), inside / F.lit(scale or 1.0) + F.lit(low))), F.when(F.col("cum") >= want, F.col("bin"))).alias(f"p{k}"))
    return bins.agg(*out)


@register("percentile_bins", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT trunc((l_extendedprice - lo) * (65535 / (hi - lo)))::BIGINT AS bin, count(*) AS n FROM lineitem, m GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM b), q AS (SELECT arg_min(bin + (total * 0.02 - (cum - n)) / n, bin) FILTER (cum >= total * 0.02) AS a, arg_min(bin + (total * 0.98 - (cum - n)) / n, bin) FILTER (cum >= total * 0.98) AS b FROM r) SELECT round(greatest(lo, least(hi, a / (65535 / (hi - lo)) + lo)), 4) AS p0, round(greatest(lo, least(hi, b / (65535 / (hi - lo)) + lo)), 4) AS p1 FROM q, m")
def _(spark, sf_dir):
    got = binned_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.02, 0.98))
    return got.select(F.round("p0", 4).alias("p0"), F.round("p1", 4).alias("p1"))


@register("auto_exposure_stats", f"WITH {HIST}, r AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h) SELECT round(sum(bin * n) / sum(n), 6) AS mean, min(bin) FILTER (cum * 2 >= total) AS median, " + ", ".join(f"round(log2(1 + min(bin) FILTER (cum * 8 >= total * {k})), 6) AS octile{k}" for k in range(1, 8)) + " FROM r")
def _(spark, sf_dir):
    """Mean, the bin in which half of all lies behind, and the octiles' logarithms."""
    r = running(price_bins(spark, sf_dir))
    octile = lambda k: F.round(F.log2(1 + F.min(F.when(F.col("cum") * 8 >= F.col("total") * k, F.col("bin")))), 6).alias(f"octile{k}")
    return r.agg(F.round(F.sum(F.col("bin") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("bin"))).alias("median"), *(octile(k) for k in range(1, 8)))


@register("cum_octile", f"WITH {HIST} SELECT bin, least(7, floor(8.0 * (sum(n) OVER (ORDER BY bin) - n) / sum(n) OVER ()))::INT AS octile FROM h")
def _(spark, sf_dir):
    return running(price_bins(spark, sf_dir)).select("bin", F.least(F.lit(7), F.floor(8.0 * (F.col("cum") - F.col("n")) / F.col("total"))).cast("int").alias("octile"))


def match_cdf(source: DataFrame, target: DataFrame) -> DataFrame:
    """(bin, match): for each target bin the source bin whose running share is nearest, the lower one on ties.

    Both tables have a row a bin; one sorted union and two windows find the neighbours below and above.
    """
    a = running(source).select(F.col("bin").alias("s_bin"), (F.col("cum") / F.col("total")).alias("share"), F.lit(None).cast("long").alias("bin"))
    b = running(target).select(F.lit(None).cast("long").alias("s_bin"), (F.col("cum") / F.col("total")).alias("share"), "bin")
    s = F.when(F.col("s_bin").isNotNull(), F.struct("share", "s_bin"))
    order = Window.orderBy("share", F.col("s_bin").isNull().cast("int"), "s_bin", "bin")
    up = Window.orderBy(F.desc("share"), F.col("s_bin").isNull().cast("int"), F.desc("s_bin"), F.desc("bin"))
    upto = (Window.unboundedPreceding, 0)
    near = a.unionAll(b).withColumn("below", F.last(s, True).over(order.rowsBetween(*upto))).withColumn("above", F.last(s, True).over(up.rowsBetween(*upto))).where("bin IS NOT NULL")
    off = lambda c: F.coalesce(F.abs(F.col(c)["share"] - F.col("share")), F.lit(9.0))
    return near.select("bin", F.when(off("below") <= off("above"), F.col("below.s_bin")).otherwise(F.col("above.s_bin")).alias("match"))


@register("cdf_match", "WITH s AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS share FROM (SELECT trunc(l_extendedprice / 500)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)), t AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS share FROM (SELECT trunc(l_extendedprice / 500)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)) SELECT t.bin, arg_min(s.bin, (abs(s.share - t.share), s.share, CASE WHEN s.share <= t.share THEN -s.bin ELSE s.bin END)) AS match FROM s, t GROUP BY t.bin")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = lambda f: histogram(li.where(F.col("l_returnflag") == f), F.col("l_extendedprice") / 500)
    return match_cdf(part("R"), part("N"))


@register("hist_match_points", f"WITH {HIST}, r AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS share FROM h) SELECT k, min(bin) FILTER (share >= k / 16.0) AS bin FROM r, range(1, 17) t(k) GROUP BY k")
def _(spark, sf_dir):
    """Control points of a distribution's curve: the bins of equal shares."""
    r = running(price_bins(spark, sf_dir))
    points = [F.min(F.when(F.col("cum") / F.col("total") >= k / 16.0, F.col("bin"))) for k in range(1, 17)]
    return r.agg(F.array(*points).alias("p")).select(F.posexplode("p").alias("k", "bin")).select((F.col("k") + 1).cast("long").alias("k"), "bin")


@register("equalise_cutoff", f"WITH {HIST}, r AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above, sum(n) OVER () AS total FROM h) SELECT greatest(max(bin) FILTER (above >= total * 0.03), 128) AS cutoff FROM r")
def _(spark, sf_dir):
    """Walk down until 3 % are cut, but not below a floor."""
    r = running(price_bins(spark, sf_dir)).withColumn("above", F.col("total") - F.col("cum") + F.col("n"))
    return r.agg(F.greatest(F.max(F.when(F.col("above") >= F.col("total") * 0.03, F.col("bin"))), F.lit(128)).alias("cutoff"))


@register("brightness_factor", "WITH b AS (SELECT l_linenumber AS frame, trunc(l_extendedprice / 128)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY frame) AS total FROM b), m AS (SELECT frame, arg_min(bin + (total * 0.5 - (cum - n)) / n, bin) FILTER (cum * 2 >= total) AS median FROM r GROUP BY frame) SELECT frame, round((SELECT median FROM m WHERE frame = 1) / median, 6) AS factor FROM m")
def _(spark, sf_dir):
    """Medians within bins of each frame, and the first frame's over each."""
    bins = histogram(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice") / 128, by=(F.col("l_linenumber").alias("frame"),))
    w = Window.partitionBy("frame")
    r = bins.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    inside = F.col("bin") + (F.col("total") * 0.5 - (F.col("cum") - F.col("n"))) / F.col("n")
    m = r.groupBy("frame").agg(F.min_by(inside, F.when(F.col("cum") * 2 >= F.col("total"), F.col("bin"))).alias("median"))
    first = F.max(F.when(F.col("frame") == 1, F.col("median"))).over(Window.partitionBy())
    return m.select("frame", F.round(first / F.col("median"), 6).alias("factor"))


#: Class boxes (number, lowest and highest quantity, lowest and highest discount in hundredths).
BOXES = ((0, 1, 10, 0, 3), (1, 11, 25, 0, 5), (2, 26, 50, 0, 2), (3, 1, 20, 6, 10), (4, 26, 50, 3, 10))


@register("class_histogram", "WITH b(k, q0, q1, d0, d1) AS (VALUES (0, 1, 10, 0, 3), (1, 11, 25, 0, 5), (2, 26, 50, 0, 2), (3, 1, 20, 6, 10), (4, 26, 50, 3, 10)), l AS (SELECT l_quantity AS q, round(l_discount * 100) AS d, l_extendedprice AS e FROM lineitem) SELECT k, count(*) AS n, round(avg(q), 6) AS q, round(avg(e), 4) AS e FROM l JOIN b ON q BETWEEN q0 AND q1 AND d BETWEEN d0 AND d1 GROUP BY k")
def _(spark, sf_dir):
    """Rows by fixed class boxes that don't overlap: one expression, no join."""
    q, d = F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    k = F.coalesce(*(F.when(q.between(a, b) & d.between(c, e), n) for n, a, b, c, e in BOXES))
    rows = table(spark, sf_dir, "lineitem").withColumn("k", k).where("k IS NOT NULL")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("e"))


@register("top_colours", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand, p_type) AS place FROM c) SELECT p_brand, p_type, n, place FROM r WHERE place <= 50 AND n >= CASE WHEN (SELECT count(*) FROM c) > 100 THEN 2 ELSE 1 END")
def _(spark, sf_dir):
    """The largest classes; small ones go where there are many."""
    c = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    least = c.agg(F.when(F.count("*") > 100, 2).otherwise(1).alias("least"))
    top = c.orderBy(F.desc("n"), "p_brand", "p_type").limit(50).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand", "p_type")).cast("long"))
    return top.join(F.broadcast(least), F.col("n") >= F.col("least")).drop("least")
