"""Catalogue queries: facets, filters, sorts, picks, rule tables, set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..registry import register, table
from .fixtures import CATALOG, catalog


def facets(df: DataFrame) -> DataFrame:
    """Ranges of numbers, where 0 is unknown, and sorted sets of strings. One partial row a task crosses the network."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return df.agg(F.min(known("iso")).alias("iso_min"), F.max(known("iso")).alias("iso_max"), F.min(known("focal")).alias("focal_min"), F.max(known("focal")).alias("focal_max"), text("make").alias("makes"), text("model").alias("models"), F.count("*").alias("n"))


@register("catalog_facets", f"WITH {CATALOG} SELECT min(iso) FILTER (iso <> 0) AS iso_min, max(iso) FILTER (iso <> 0) AS iso_max, min(focal) FILTER (focal <> 0) AS focal_min, max(focal) FILTER (focal <> 0) AS focal_max, string_agg(DISTINCT make, ';' ORDER BY make) AS makes, string_agg(DISTINCT model, ';' ORDER BY model) AS models, count(*) AS n FROM cat")
def _(spark, sf_dir):
    return facets(catalog(spark, sf_dir))


def name_query(name: Column, query: str) -> Column:
    """A comma separates terms of which one must be part of the name, whatever the case; a leading `!=` negates; no term, no filter."""
    negate = query.startswith("!=")
    terms = [t.strip().upper() for t in query.removeprefix("!=").split(",") if t.strip()]
    if not terms:
        return F.lit(True)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.upper(name), F.lit(t))
    return ~hit if negate else hit


@register("catalog_name_query", "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), '1') OR contains(upper(p_name), 'RED')")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").where(name_query(F.col("p_name"), "1, red,")).select("p_partkey", "p_name")


@register("catalog_name_not", "SELECT p_partkey, p_name FROM part WHERE NOT (contains(upper(p_name), '1') OR contains(upper(p_name), '2'))")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").where(name_query(F.col("p_name"), "!=1,2")).select("p_partkey", "p_name")


def tri_state(flag: Column, yes: bool, no: bool) -> Column:
    """Two toggles: they exclude only when exactly one is on."""
    return F.lit(True) if yes == no else (flag if yes else ~flag)


def catalog_filter(df: DataFrame, ranks: Sequence[int], labels: Sequence[int], edited=(False, False), saved=(False, False), trashed: bool | None = None, name: str = "", makes: Sequence[str] = (), iso=None, focal=None, tolerance: float = 0.01) -> DataFrame:
    """All conditions at once, in one filter that reaches the scan. Without valid metadata only the make counts of the last three."""
    full = F.lit(True)
    if iso:
        full = full & F.col("iso").between(*iso)
    if focal:
        full = full & F.col("focal").between(focal[0] - tolerance, focal[1] + tolerance)
    make = F.col("make").isin(*makes) if makes else F.lit(True)
    kept = F.col("rank").isin(*ranks) & F.col("label").isin(*labels) & tri_state(F.col("edited"), *edited) & tri_state(F.col("saved"), *saved) & name_query(F.col("name"), name)
    if trashed is not None:
        kept = kept & (F.col("trashed") == trashed)
    return df.where(kept & make & (~F.col("exif_valid") | full))


@register("catalog_filter", f"WITH {CATALOG} SELECT id, name, make, iso, focal FROM cat WHERE rank IN (0, 1, 2, 3, 4) AND label IN (0, 1, 2, 3) AND edited AND NOT trashed AND make IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#16', 'Brand#17', 'Brand#18') AND (NOT exif_valid OR (iso BETWEEN 5 AND 45 AND focal BETWEEN 900 - 0.01 AND 1900 + 0.01))")
def _(spark, sf_dir):
    df = catalog_filter(catalog(spark, sf_dir), (0, 1, 2, 3, 4), (0, 1, 2, 3), edited=(True, False), saved=(True, True), trashed=False, makes=("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8", "Brand#9", "Brand#10", "Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15", "Brand#16", "Brand#17", "Brand#18"), iso=(5, 45), focal=(900.0, 1900.0))
    return df.select("id", "name", "make", "iso", "focal")


def sort_catalog(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Ties go by name and id; a descending order reverses these too."""
    columns = [F.col(key), F.col("name"), F.col("id")]
    return df.orderBy(*(c.desc() if descending else c.asc() for c in columns))


@register("catalog_sort_top", f"WITH {CATALOG} SELECT id, name, rank FROM cat ORDER BY rank, name, id LIMIT 100")
def _(spark, sf_dir):
    return sort_catalog(catalog(spark, sf_dir), "rank").limit(100).select("id", "name", "rank")


@register("catalog_sort_descending", f"WITH {CATALOG} SELECT id, name, focal FROM cat ORDER BY focal DESC, name DESC, id DESC")
def _(spark, sf_dir):
    return sort_catalog(catalog(spark, sf_dir), "focal", True).select("id", "name", "focal")


def originals(df: DataFrame, base: str, extension: str, order: Sequence[str]) -> DataFrame:
    """Each row with the original of its base: the one whose extension comes first in `order`; an unknown extension comes first of all, then the smaller id.

    The pick is an aggregate of one row a base and task, joined back, not a window over whole groups.
    """
    ext = F.lower(F.col(extension))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), ext), F.lit(0)), F.lit(0))
    rows = df.withColumn("place", place)
    best = rows.groupBy(F.lower(base).alias("_base")).agg(F.min(F.struct("place", "id")).alias("_best"))
    return rows.join(best, F.lower(base) == F.col("_base")).withColumn("original_id", F.col("_best.id")).drop("_base", "_best")


@register("originals", "WITH d AS (SELECT doc_id AS id, source AS base, lang AS ext, list_position(['de', 'en', 'fr'], lower(lang)) AS place FROM documents) SELECT id, base, ext, coalesce(place, 0)::BIGINT AS place, first_value(id) OVER (PARTITION BY lower(base) ORDER BY coalesce(place, 0), id) AS original_id FROM d")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("base"), F.col("lang").alias("ext"))
    return originals(df, "base", "ext", ["de", "en", "fr"])


def evict(df: DataFrame, most: int, time: str, key: str) -> DataFrame:
    """The oldest n - most + most * 5 / 100 rows where there are over `most`. Both counts are known first, so this is a top-k."""
    n = df.count()
    return df.orderBy(time, key).limit(max(0, n - most + most * 5 // 100) if n > most else 0)


@register("cache_evict", "SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events) WHERE n > 800 AND r <= n - 800 + 40")
def _(spark, sf_dir):
    return evict(table(spark, sf_dir, "events").select("event_id", "ts"), 800, "ts", "event_id")


@register("job_priority", "SELECT event_id, value, event_type FROM events ORDER BY CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END DESC, (value > 50)::INT, event_id LIMIT 25")
def _(spark, sf_dir):
    """Priority first, then jobs that are no upgrades, then the order of arrival."""
    priority = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return table(spark, sf_dir, "events").orderBy(priority.desc(), (F.col("value") > 50).cast("int"), "event_id").limit(25).select("event_id", "value", "event_type")


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` with each row's place from 1: a range-partitioned sort, numbered within partitions from where the one before ends."""
    rows = scratch.keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    ends = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    starts = ends.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", place).drop("_part", "_at", "_start")


@register("queue_to_head", "SELECT event_id, event_type = 'error' AS selected, row_number() OVER (ORDER BY (event_type <> 'error')::INT, event_id) AS place FROM events")
def _(spark, sf_dir):
    """Selected jobs move to the head of the queue and keep their order; every job has its place."""
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("selected"))
    return placed(df, (~F.col("selected")).cast("int"), "event_id")


@register("preview_order", "SELECT DISTINCT source AS dir, lang AS name FROM documents ORDER BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("dir"), F.col("lang").alias("name")).distinct().orderBy("dir", "name")


def matcher(value: Column, enabled: bool, pattern: str) -> Column:
    """Off: true. `re:` searches without regard to case; else all of the value must be equal but for case."""
    if not enabled:
        return F.lit(True)
    return value.rlike("(?i)" + pattern[3:]) if pattern.startswith("re:") else F.lower(value) == pattern.lower()


#: Fixed values of the rule query: serial, iso range, focal range, make matcher, profile fields that the rule sets.
RULES = ((1, 0, 50, 0.0, 9999.0, None, 10, None), (2, 10, 30, 0.0, 1500.0, None, None, 5), (3, 0, 50, 900.0, 1200.0, "re:#1", 20, None), (4, 20, 45, 0.0, 9999.0, "brand#3", None, 7), (5, 1, 5, 0.0, 9999.0, None, 30, 9))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """All rules that match, in the order of their numbers; a later one overrides the fields that it sets.

    The rule table is small and known when the plan is made, so it becomes one expression a field: no join at all.
    """
    exposure, contrast = F.lit(None).cast("int"), F.lit(None).cast("int")
    count = F.lit(0)
    for _, low, high, f_low, f_high, make, e, c in sorted(rules):
        hit = F.col("iso").between(low, high) & F.col("focal").between(f_low, f_high) & matcher(F.col("make"), make is not None, make or "")
        exposure = F.when(hit, e).otherwise(exposure) if e is not None else exposure
        contrast = F.when(hit, c).otherwise(contrast) if c is not None else contrast
        count = count + hit.cast("int")
    return df.withColumns({"exposure": exposure, "contrast": contrast, "n_rules": count})


@register("rule_override", f"""WITH {CATALOG}, rules(serial, lo, hi, flo, fhi, make, e, c) AS (VALUES (1, 0, 50, 0.0, 9999.0, NULL, 10, NULL), (2, 10, 30, 0.0, 1500.0, NULL, NULL, 5), (3, 0, 50, 900.0, 1200.0, 're:#1', 20, NULL), (4, 20, 45, 0.0, 9999.0, 'brand#3', NULL, 7), (5, 1, 5, 0.0, 9999.0, NULL, 30, 9))
SELECT id, arg_max(e, serial) FILTER (e IS NOT NULL) AS exposure, arg_max(c, serial) FILTER (c IS NOT NULL) AS contrast, count(serial)::INT AS n_rules FROM cat LEFT JOIN rules r ON iso BETWEEN lo AND hi AND focal BETWEEN flo AND fhi
AND (r.make IS NULL OR CASE WHEN starts_with(r.make, 're:') THEN regexp_matches(cat.make, substr(r.make, 4), 'i') ELSE lower(cat.make) = lower(r.make) END) GROUP BY id""")
def _(spark, sf_dir):
    return apply_rules(catalog(spark, sf_dir)).select("id", "exposure", "contrast", "n_rules")


@register("layered_profile", f"WITH {CATALOG} SELECT id, CASE WHEN edited THEN iso ELSE CASE WHEN saved THEN rank ELSE 100 END END AS exposure, CASE WHEN edited AND rank > 2 THEN focal ELSE 50.0 END AS contrast FROM cat")
def _(spark, sf_dir):
    """Defaults, then a saved profile, then edits: a layer changes what it sets, null elsewhere."""
    saved, edits = F.when(F.col("saved"), F.col("rank")), F.when(F.col("edited"), F.col("iso"))
    return catalog(spark, sf_dir).select("id", F.coalesce(edits, saved, F.lit(100)).alias("exposure"), F.coalesce(F.when(F.col("edited") & (F.col("rank") > 2), F.col("focal")), F.lit(50.0)).alias("contrast"))


@register("profile_migration", "SELECT event_id, k, CASE WHEN k < 300 THEN k * 2 WHEN k < 600 THEN k + 100 ELSE k END AS amount FROM (SELECT event_id, (props->>'k')::INT AS k FROM events)")
def _(spark, sf_dir):
    """A stored value means different units before versions 300 and 600."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k < 300, k * 2).when(k < 600, k + 100).otherwise(k).alias("amount"))


@register("override_by_source", "SELECT p_brand, p_type, arg_max(p_size, p_partkey) AS size, max(p_partkey) AS source, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf_dir):
    """Of records with one key, the one that was loaded last holds."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.max_by("p_size", "p_partkey").alias("size"), F.max("p_partkey").alias("source"), F.count("*").alias("n"))


@register("lookup_equi", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(spark, sf_dir):
    """Constants by key; a miss is null. Spark broadcasts the lookups as their size allows."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


def lookup_fallback(df: DataFrame, exact: DataFrame, general: DataFrame, keys: Sequence[str], fewer: Sequence[str], value: str) -> DataFrame:
    """`value` by all `keys`, else by the `fewer` ones, else null."""
    a, b = exact.withColumnRenamed(value, "_a"), general.withColumnRenamed(value, "_b")
    return df.join(a, list(keys), "left").join(b, list(fewer), "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


@register("lookup_fallback", "WITH e AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS level FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), g AS (SELECT l_partkey, max(l_quantity) AS level FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT k.l_partkey, k.l_suppkey, coalesce(e.level, g.level) AS level FROM k LEFT JOIN e USING (l_partkey, l_suppkey) LEFT JOIN g ON g.l_partkey = k.l_partkey")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    exact = li.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("level"))
    general = li.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_quantity").alias("level"))
    return lookup_fallback(li.select("l_partkey", "l_suppkey").distinct(), exact, general, ["l_partkey", "l_suppkey"], ["l_partkey"], "level")


@register("dir_diff_new", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(spark, sf_dir):
    """Entries that the old listing lacks."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("dir_diff_removed", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def _(spark, sf_dir):
    """Entries that the new listing lacks."""
    now = table(spark, sf_dir, "customer").where("c_nationkey < 20")
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(now, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("dir_monitor_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' ELSE 'drop' END AS change FROM (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey > 10) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def _(spark, sf_dir):
    """Watches to add and to drop, told by one aggregate over both sets."""
    c = table(spark, sf_dir, "customer")
    both = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("k"), F.lit(1).alias("side")).unionAll(c.where("c_nationkey > 10").select("c_custkey", F.lit(2)))
    return both.groupBy("k").agg(F.bit_or("side").alias("sides")).where("sides < 3").select("k", F.when(F.col("sides") == 2, "add").otherwise("drop").alias("change"))


@register("filter_exif_tolerance", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE abs(round(l_discount, 1) - 0.1) <= 1e-8 AND l_quantity BETWEEN 10 - 0.01 AND 20 + 0.01")
def _(spark, sf_dir):
    """Numbers are compared as they are written out, with a tolerance."""
    return table(spark, sf_dir, "lineitem").where((F.abs(F.round("l_discount", 1) - 0.1) <= 1e-8) & F.col("l_quantity").between(10 - 0.01, 20 + 0.01)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("extension_enabled", "SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'org', 'com', 'htm')")
def _(spark, sf_dir):
    ext = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext")).where(F.col("ext").isin("html", "org", "com", "htm"))


@register("json_tag", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT % 2 = 0")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k % 2 = 0")


@register("bitmask_coalesce", "SELECT user_id, bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 ELSE 16 END)::INT AS action, count(*) AS n FROM events GROUP BY user_id")
def _(spark, sf_dir):
    """All changes since the last update as one mask a user."""
    t = F.col("event_type")
    action = F.when(t == "click", 1).when(t == "view", 2).when(t == "purchase", 4).when(t == "error", 8).otherwise(16)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_or(action).alias("action"), F.count("*").alias("n"))
