"""Nearest, bracketing and grouping joins.

A nearest match is one sorted pass a key: both sides are joined in a union, ordered together, and each row takes the last
value below and the first above. Each side is shuffled once, on its key and a stretch of the order, whatever the number of
candidates, and a key with very many rows is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register, table
from ..scratch import keep
from .fixtures import hold

#: Microseconds by which the events of a user are dealt.
HOURS_6 = 6 * 3600 * 10**6
EVENTS = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = "


def neighbours(df: DataFrame, by: list[str], on: str, found: Column, width: float, above: bool = True) -> DataFrame:
    """`df` with `_below` and `_above`: the last non-null `found` at or before each row in the order of `on`, and the first at or after.

    A key's rows are dealt by runs of `width` of `on`, so that a key with very many rows is many tasks' work. What runs
    hand on to each other is a row a run: its first and its last `found`, carried over the runs in a small table. Both ways
    are frames from the start: one that reaches to the end is worked out anew for each row, in time that is quadratic in a run.
    """
    df = df.withColumn("_run", F.floor(F.col(on) / F.lit(float(width)))).withColumn("_found", found)
    ends = df.groupBy(*by, "_run").agg(F.max(F.when(F.col("_found").isNotNull(), F.struct(on, "_found"))).alias("_last"), F.min(F.when(F.col("_found").isNotNull(), F.struct(on, "_found"))).alias("_first"))
    runs = Window.partitionBy(*by).orderBy("_run")
    ends = ends.withColumn("_before", F.last("_last", True).over(runs.rowsBetween(Window.unboundedPreceding, -1))["_found"])
    ends = ends.withColumn("_after", F.last("_first", True).over(Window.partitionBy(*by).orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1))["_found"])
    w = Window.partitionBy(*by, "_run")
    first = F.col("_found").isNull().cast("int")  # among equal places, what is found counts both ways
    df = df.withColumn("_below", F.last("_found", True).over(w.orderBy(on, first).rowsBetween(Window.unboundedPreceding, 0)))
    if above:
        df = df.withColumn("_above", F.last("_found", True).over(w.orderBy(F.desc(on), first).rowsBetween(Window.unboundedPreceding, 0)))
    df = df.join(ends.select(*by, "_run", "_before", "_after"), [*by, "_run"])
    df = df.withColumn("_below", F.coalesce("_below", "_before"))
    return df.withColumn("_above", F.coalesce("_above", "_after")) if above else df


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, payload: str, tie: str = "below", width: float = 1e18) -> DataFrame:
    """`left` with the `payload` of the right row of equal `by` whose `on` is nearest, null without one.

    `tie` says which side holds if both are as near. Of right rows with one value of `on`, the least payload holds.
    """
    least = right.groupBy(*by, on).agg(F.min(payload).alias("_payload"))
    names = [c for c in left.columns if c not in by and c != on]
    l = left.select(*by, on, F.struct(*names).alias("_left"), F.lit(None).cast(least.schema["_payload"].dataType).alias("_payload"), F.lit(1).alias("_side"))  # noqa: E741
    r = least.select(*by, on, F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), "_payload", F.lit(0).alias("_side"))
    both = neighbours(l.unionByName(r), by, on, F.when(F.col("_side") == 0, F.struct(on, "_payload")), width)
    off = lambda c: F.abs(_number(F.col(c)[on]) - _number(F.col(on)))
    below_wins = F.col("_above").isNull() | ((off("_below") <= off("_above")) if tie == "below" else (off("_below") < off("_above")))
    return both.where("_side = 1").select(*by, on, *(F.col("_left")[c].alias(c) for c in names), F.when(F.col("_below").isNotNull() & below_wins, F.col("_below._payload")).otherwise(F.col("_above._payload")).alias(payload))


def _number(c: Column) -> Column:
    return c.cast("double")


def microseconds(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("us", F.expr(f"unix_micros(cast({ts} as timestamp))"))


@register("nearest_template", f"WITH l AS ({EVENTS}'purchase'), r AS ({EVENTS}'error'), j AS (SELECT l.event_id, l.user_id, r.event_id AS template, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts, r.event_id) AS k FROM l LEFT JOIN r ON l.user_id = r.user_id) SELECT event_id, user_id, template FROM j WHERE k = 1")
def _(spark, sf_dir):
    """For each purchase the user's error that is nearest in time, the earlier one on ties."""
    e = microseconds(table(spark, sf_dir, "events"))
    right = e.where("event_type = 'error'").select("user_id", "us", F.col("event_id").alias("template"))
    return nearest(e.where("event_type = 'purchase'").select("user_id", "us", "event_id"), right, ["user_id"], "us", "template", width=HOURS_6).select("event_id", "user_id", "template")


def log_distance(a: tuple[Column, Column], b: tuple[Column, Column], weight: float = 1.0) -> Column:
    """Euclidean distance of two settings in powers of two; the second setting's steps count `weight` times."""
    return F.sqrt(F.pow(F.log2(a[0] / b[0]), 2) + weight * F.pow(F.log2(a[1] / b[1]), 2))


#: Templates of a cell, about; the most strips of a key, and cells of a strip.
CELL, PARTS = 64, 256
#: Distances are compared to 6 decimals, so what is as near within this may be the match.
SLACK = 2e-6


def cuts(df: DataFrame, by: list[str], on: str, parts: Column) -> DataFrame:
    """(by, cuts): ascending values of `on` that cut a key's rows into about `parts` runs, `PARTS` at most. None is the least value, so no run is empty."""
    found = df.groupBy(*by).agg(F.percentile_approx(on, [k / PARTS for k in range(1, PARTS)]).alias("_c"), F.min(on).alias("_low"), F.floor(F.lit(PARTS) / parts).alias("_step"))
    step = F.greatest(F.lit(1), F.col("_step"))
    return found.select(*by, F.array_distinct(F.filter("_c", lambda c, i: (c > F.col("_low")) & ((i + 1) % step == 0))).alias("cuts"))


def run_of(v: Column, of: str = "cuts") -> Column:
    return F.size(F.filter(of, lambda c: c <= v))


def nearest_settings(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(event_id, distance, template) of `left` (event_id, by, a, b) and `right` (template, by, a, b): the least distance to 6 decimals, then the least template. All settings are positive or negative numbers.

    Two dimensions have no order to sort by, so the templates of a key are cut into strips of one dimension and these into cells of the other, of
    about `CELL` templates each. A capture is compared with its own cell; what it finds there bounds how far the match can be, and only the few
    captures whose reach leaves the cell are compared with the other cells within it. Left rows without a right row of equal `by` are left out.
    """
    at = (F.log2(F.abs("a")).alias("x"), F.log2(F.abs("b")).alias("y"))
    right = keep(right.groupBy(*by, "a", "b").agg(F.min("template").alias("template")).select("*", *at), "templates")
    strips = keep(cuts(right, by, "x", F.sqrt(F.count("*") / CELL)), "strips")
    right = right.join(F.broadcast(strips), by).withColumn("strip", run_of(F.col("x"))).drop("cuts")
    rows = keep(cuts(right, [*by, "strip"], "y", F.count("*") / CELL), "rows")
    cells = right.join(F.broadcast(rows), [*by, "strip"]).withColumn("cell", run_of(F.col("y")))
    cells = keep(cells.groupBy(*by, "strip", "cell").agg(F.collect_list(F.struct("template", "a", "b", "x", "y")).alias("t")), "cells")

    squared = lambda t: (t["x"] - F.col("x")) * (t["x"] - F.col("x")) + (t["y"] - F.col("y")) * (t["y"] - F.col("y"))
    exact = lambda t: F.struct(F.round(log_distance((F.col("a"), F.col("b")), (t["a"], t["b"])), 6).alias("distance"), t["template"].alias("template"))
    best = F.array_min(F.transform(F.filter("t", lambda t: squared(t) <= F.col("reach") * F.col("reach")), exact)).alias("best")

    own = left.select("event_id", *by, "a", "b", *at).join(F.broadcast(strips), by).withColumn("strip", run_of(F.col("x"))).withColumnRenamed("cuts", "_strips")
    own = own.join(F.broadcast(rows), [*by, "strip"]).withColumn("cell", run_of(F.col("y"))).join(cells, [*by, "strip", "cell"])
    own = hold(own, "reach", F.sqrt(F.array_min(F.transform("t", squared))) + SLACK)
    ends = (run_of(F.col("x") - F.col("reach"), "_strips").alias("_s0"), run_of(F.col("x") + F.col("reach"), "_strips").alias("_s1"), run_of(F.col("y") - F.col("reach")).alias("_c0"), run_of(F.col("y") + F.col("reach")).alias("_c1"))
    own = keep(own.select("event_id", *by, "a", "b", "x", "y", "reach", "strip", "cell", best, *ends), "captures")

    far = own.where("_s0 < _s1 OR _c0 < _c1").withColumnRenamed("strip", "_strip").withColumnRenamed("cell", "_cell").drop("best")
    far = far.withColumn("strip", F.explode(F.sequence("_s0", "_s1"))).join(F.broadcast(rows), [*by, "strip"])
    far = far.withColumn("cell", F.explode(F.sequence(run_of(F.col("y") - F.col("reach")), run_of(F.col("y") + F.col("reach"))))).where("strip != _strip OR cell != _cell")
    far = far.join(cells, [*by, "strip", "cell"]).select("event_id", best).where("best IS NOT NULL")
    return own.select("event_id", "best").unionAll(far).groupBy("event_id").agg(F.min("best").alias("best")).select("event_id", "best.distance", "best.template")


def like(c: Column) -> Column:
    """A number that stands for all of its kind: nulls, NaN, zero, infinities, and the sign of the others."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.signum(c))


def unlike_distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The distance where it is no finite number: a missing setting gives null, quotients and logarithms of zero are infinite, of unlike signs NaN."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    ratio = lambda p, q: F.when(p.isNull() | q.isNull(), None).when(q == 0, F.when(p == 0, nan).otherwise(p * inf)).otherwise(p / F.when(q != 0, q))
    square = lambda r: F.when(r.isNull(), None).when(F.isnan(r) | (r < 0), nan).when((r == 0) | (r == inf), inf).otherwise(0.0)
    return F.sqrt(square(ratio(a[0], b[0])) + square(ratio(a[1], b[1])))


@register("nearest_by_log_distance", "WITH l AS (SELECT event_id, user_id % 50 AS model, value + 1 AS iso, (props->>'k')::DOUBLE + 1 AS shutter FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS template, user_id % 50 AS model, value + 1 AS iso, (props->>'k')::DOUBLE + 1 AS shutter FROM events WHERE event_type = 'error'), d AS (SELECT event_id, template, round(sqrt(log2(l.iso / r.iso) ** 2 + log2(l.shutter / r.shutter) ** 2), 6) AS distance FROM l JOIN r USING (model)) SELECT event_id, arg_min(template, (distance, template)) AS template, min(distance) AS distance FROM d GROUP BY event_id")
def _(spark, sf_dir):
    """Within one model, the template whose settings are nearest, by cells of the plane. Distances are finite only between numbers of one sign; a capture
    that has no such template gets the first of those at the least distance of another kind, for which one template of each kind does."""
    k = F.get_json_object("props", "$.k").cast("double") + 1
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')").select("event_id", (F.col("user_id") % 50).alias("model"), (F.col("value") + 1).alias("a"), k.alias("b"), "event_type")
    e = e.withColumn("_a", like(F.col("a"))).withColumn("_b", like(F.col("b")))
    # a capture's comparisons cost far more than its bytes tell, so a file with few row groups must not leave them to few tasks
    e = keep(e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id"), "settings")
    number = F.abs("_a").eqNullSafe(1.0) & F.abs("_b").eqNullSafe(1.0)
    captures, templates = e.where("event_type = 'purchase'"), e.where("event_type = 'error'").withColumnRenamed("event_id", "template")
    by = ["model", "_a", "_b"]
    kinds = templates.groupBy(*by).agg(F.min("template").alias("template"))
    finite = nearest_settings(captures.where(number), templates.where(number), by)

    of = kinds.groupBy("model").agg(F.collect_list(F.struct("template", "_a", "_b")).alias("t"))
    d = lambda t: unlike_distance((F.col("_a"), F.col("_b")), (t["_a"], t["_b"]))
    first = F.array_min(F.transform("t", lambda t: F.struct(d(t).isNull().alias("none"), d(t).alias("distance"), t["template"].alias("template"))))
    same = F.exists("t", lambda t: (t["_a"] == F.col("_a")) & (t["_b"] == F.col("_b")))
    other = captures.join(F.broadcast(of), "model").where(~(number & F.coalesce(same, F.lit(False)))).groupBy("event_id").agg(F.min(first).alias("best"))
    return finite.select("event_id", "template", "distance").unionAll(other.select("event_id", "best.template", "best.distance"))


@register("nearest_level", "WITH t AS (SELECT DISTINCT p_brand, p_size * 2 AS level FROM part WHERE p_partkey % 7 = 0) SELECT p_partkey, p_size, (SELECT arg_min(level, (abs(level - p_size), -level)) FROM t WHERE t.p_brand = part.p_brand) AS level FROM part")
def _(spark, sf_dir):
    """The nearest calibrated level of the same make; of two as near, the higher. Sizes repeat, so each make's distinct ones are matched and the parts
    look theirs up. A part without a size is as near to all levels, so it gets the highest."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    levels = p.where("p_partkey % 7 = 0 AND p_size IS NOT NULL").select("p_brand", (F.col("p_size") * 2).alias("p_size")).withColumn("level", F.col("p_size"))
    sizes = p.where("p_brand IS NOT NULL AND p_size IS NOT NULL").select("p_brand", "p_size").distinct().withColumn("_own", F.col("p_size"))
    found = nearest(sizes, levels, ["p_brand"], "p_size", "level", "above", width=8).select("p_brand", F.col("_own").alias("_size"), "level")
    found = found.unionAll(levels.groupBy("p_brand").agg(F.max("level").alias("level")).select("p_brand", F.lit(None).cast("int").alias("_size"), "level"))
    same = (p["p_brand"] == found["p_brand"]) & p["p_size"].eqNullSafe(found["_size"])
    return p.join(found, same, "left").select("p_partkey", "p_size", "level")


#: Smallest aperture key above the value -> scale.
SCALES = ((950.0, 1.3), (1100.0, 1.2), (1400.0, 1.1), (1700.0, 1.05))


@register("aperture_scale", "WITH s(k, f) AS (VALUES (950.0, 1.3), (1100.0, 1.2), (1400.0, 1.1), (1700.0, 1.05)) SELECT p_partkey, coalesce((SELECT arg_min(f, k) FROM s WHERE k > p_retailprice), 1.0)::DOUBLE AS scale, round(least(p_size * greatest(1.0, coalesce((SELECT arg_min(f, k) FROM s WHERE k > p_retailprice), 1.0)), 50)::DOUBLE, 6) AS level FROM part")
def _(spark, sf_dir):
    """The scale of the smallest key above a value; it counts only above 1 and stops at the white level. The table is known to the plan."""
    scale = F.lit(1.0)
    for key, value in sorted(SCALES, reverse=True):
        scale = F.when(F.col("p_retailprice") < key, value).otherwise(scale)
    return table(spark, sf_dir, "part").select("p_partkey", scale.alias("scale"), F.round(F.least(F.col("p_size") * F.greatest(F.lit(1.0), scale), F.lit(50.0)), 6).alias("level"))


#: Knots of a profile by focal length.
KNOTS = ((900.0, 0.5), (1000.0, 0.8), (1250.0, 0.2), (1600.0, -0.3), (2000.0, 0.1))


def between_knots(x: Column, knots=KNOTS) -> Column:
    """Straight lines between knots; the first and the last value beyond them."""
    out = F.lit(knots[-1][1])
    for (a, u), (b, v) in reversed(list(zip(knots, knots[1:]))):  # noqa: B905
        out = F.when(x < b, u + (v - u) * ((x - a) / (b - a))).otherwise(out)
    return F.when(x <= knots[0][0], knots[0][1]).otherwise(out)


@register("bracket_lerp", "WITH k(a, u) AS (VALUES (900.0::DOUBLE, 0.5::DOUBLE), (1000.0, 0.8), (1250.0, 0.2), (1600.0, -0.3), (2000.0, 0.1)), l AS (SELECT p_partkey, p_retailprice AS x, (SELECT max(a) FROM k WHERE a <= p_retailprice) AS lo, (SELECT min(a) FROM k WHERE a > p_retailprice) AS hi FROM part) SELECT p_partkey, round(CASE WHEN lo IS NULL THEN 0.5 WHEN hi IS NULL THEN 0.1 ELSE p.u + (q.u - p.u) * ((x - lo) / (hi - lo)) END, 6) AS amount FROM l LEFT JOIN k p ON p.a = lo LEFT JOIN k q ON q.a = hi")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(between_knots(F.col("p_retailprice")), 6).alias("amount"))


@register("profile_blend", "SELECT a.p_partkey, round(a.p_retailprice * 0.3 + b.p_retailprice * 0.7, 6) AS price FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, sf_dir):
    """Coefficients of two profiles in given shares."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_retailprice").alias("q"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(F.col("p_retailprice") * 0.3 + F.col("q") * 0.7, 6).alias("price"))


def best_spelling(df: DataFrame, column: str, names: tuple[str, ...], most: int) -> DataFrame:
    """The exact name, else the one of least edit distance up to `most`, the smaller on ties."""
    far = F.array(*(F.struct(F.levenshtein(F.lower(column), F.lit(n.lower())).alias("d"), F.lit(n).alias("n")) for n in names))
    best = F.array_min(far)
    return df.withColumn("match", F.when(best["d"] <= most, best["n"])).withColumn("distance", best["d"])


@register("lens_match", "WITH n(n) AS (VALUES ('Brand#12'), ('Brand#2'), ('Brand#33'), ('Bland#45')), d AS (SELECT p_partkey, p_brand, levenshtein(lower(p_brand), lower(n)) AS d, n FROM part, n) SELECT p_partkey, CASE WHEN min(d) <= 1 THEN arg_min(n, (d, n)) END AS match, min(d)::INT AS distance FROM d GROUP BY p_partkey")
def _(spark, sf_dir):
    return best_spelling(table(spark, sf_dir, "part"), "p_brand", ("Brand#12", "Brand#2", "Brand#33", "Bland#45"), 1).select("p_partkey", "match", "distance")


def anchor_groups(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """(key, anchor, n): within a key, a row begins a group unless it lies within `gap` of the group's first row.

    The first row, not the one before, is what counts, so a session window would join too much. A fold over the key's
    sorted times finds the groups; a key's times must fit a row.
    """
    times = df.groupBy(key).agg(F.array_sort(F.collect_list(time)).alias("t"))
    state = F.expr("cast(array() as array<struct<anchor: bigint, n: bigint>>)")

    def step(groups, t):
        last = F.try_element_at(groups, F.lit(-1))
        group = lambda anchor, n: F.array(F.struct(anchor.cast("bigint").alias("anchor"), n.cast("bigint").alias("n")))
        others = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0)))
        return F.when(last["anchor"] >= t - gap, F.concat(others, group(last["anchor"], last["n"] + 1))).otherwise(F.concat(groups, group(t, F.lit(1))))

    return times.select(key, F.explode(F.aggregate("t", state, step)).alias("g")).select(key, "g.anchor", "g.n")


@register("template_groups", "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), g AS (SELECT user_id, t, r, t AS anchor FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.t, e.r, CASE WHEN e.t - g.anchor <= 21600 THEN g.anchor ELSE e.t END FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1) SELECT user_id, anchor, count(*) AS n FROM g GROUP BY ALL")
def _(spark, sf_dir):
    """Captures of one key within six hours of their group's first one."""
    e = table(spark, sf_dir, "events").select("user_id", F.expr("unix_seconds(cast(ts as timestamp))").alias("t"))
    return anchor_groups(e, "user_id", "t", 21600)


@register("template_counts", "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), g AS (SELECT user_id, t, r, t AS anchor FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.t, e.r, CASE WHEN e.t - g.anchor <= 21600 THEN g.anchor ELSE e.t END FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1), c AS (SELECT count(*) AS n FROM g GROUP BY user_id, anchor) SELECT sum(n)::BIGINT AS files, count(*) AS templates, count(*) FILTER (n > 1) AS shared FROM c")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.expr("unix_seconds(cast(ts as timestamp))").alias("t"))
    return anchor_groups(e, "user_id", "t", 21600).agg(F.sum("n").alias("files"), F.count("*").alias("templates"), F.count_if(F.col("n") > 1).alias("shared"))


#: Rectangles in order (number, source x, source y, target x, target y, side).
SPOTS = ((1, 0, 0, 10, 10, 4), (2, 11, 11, 20, 20, 4), (3, 50, 50, 60, 60, 4), (4, 21, 21, 30, 5, 4), (5, 61, 58, 12, 12, 4), (6, 80, 80, 90, 90, 4), (7, 13, 14, 40, 40, 4))
SPOT_VALUES = ", ".join(map(str, SPOTS))


@register("spot_closure", f"WITH RECURSIVE s(id, sx, sy, tx, ty, d) AS (VALUES {SPOT_VALUES}), e AS (SELECT b.id AS id, a.id AS needs FROM s a JOIN s b ON a.id < b.id AND a.tx < b.sx + b.d AND b.sx < a.tx + a.d AND a.ty < b.sy + b.d AND b.sy < a.ty + a.d), c AS (SELECT id, needs FROM e UNION SELECT c.id, e.needs FROM c JOIN e ON e.id = c.needs) SELECT id::INT AS id, needs::INT AS needs FROM c")
def _(spark, sf_dir):
    """Which earlier spots a spot depends on, through others too: a spot needs those whose target its source overlaps."""
    return spark.sql(f"""
        WITH RECURSIVE s(id, sx, sy, tx, ty, d) AS (VALUES {SPOT_VALUES}),
        e AS (SELECT b.id, a.id AS needs FROM s a JOIN s b ON a.id < b.id AND a.tx < b.sx + b.d AND b.sx < a.tx + a.d AND a.ty < b.sy + b.d AND b.sy < a.ty + a.d),
        c(id, needs) AS (SELECT id, needs FROM e UNION ALL SELECT c.id, e.needs FROM c JOIN e ON e.id = c.needs)
        SELECT DISTINCT id, needs FROM c""")


@register("rect_intersection", f"WITH s(id, sx, sy, tx, ty, d) AS (VALUES {SPOT_VALUES}) SELECT id::INT AS id, greatest(sx, 2)::INT AS x0, greatest(sy, 3)::INT AS y0, least(sx + d, 62)::INT AS x1, least(sy + d, 61)::INT AS y1 FROM s WHERE greatest(sx, 2) < least(sx + d, 62) AND greatest(sy, 3) < least(sy + d, 61)")
def _(spark, sf_dir):
    """What of each rectangle lies within the frame."""
    s = spark.createDataFrame(SPOTS, "id int, sx int, sy int, tx int, ty int, d int")
    clip = s.select("id", F.greatest("sx", F.lit(2)).alias("x0"), F.greatest("sy", F.lit(3)).alias("y0"), F.least(F.col("sx") + F.col("d"), F.lit(62)).alias("x1"), F.least(F.col("sy") + F.col("d"), F.lit(61)).alias("y1"))
    return clip.where("x0 < x1 AND y0 < y1")


@register("events_asof", "SELECT p.event_id, e.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') e ON p.user_id = e.user_id AND p.ts >= e.ts")
def _(spark, sf_dir):
    """The last click at or before each purchase: one sort of each run of a user's events, no pairs."""
    e = microseconds(table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')"))
    found = neighbours(e, ["user_id"], "us", F.when(F.col("event_type") == "click", F.col("event_id")), HOURS_6, above=False)
    return found.where("event_type = 'purchase'").select("event_id", F.col("_below").alias("before"))
