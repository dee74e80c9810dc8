"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A source's words are taken at most so many times.
MOST = 3
#: A document's inclusion grows by one LEAN-th with each doubling of its size: longer documents are repeated sooner.
LEAN = 8
#: Ranks are counted in so many bins a source; only the bin in which the sample ends is put in order.
BINS = 1 << 16
#: Documents that may close a source's sample, one after another, when the next one in order would not fit.
CLOSING = 3


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share the sum of all sizes by weight. A target stops at `most` times its source's size, and the excess goes
    to the others by weight: with sources in the order of that limit over weight, the first k that stop leave one level
    for all others, and the right k is the first whose level the next source can take. The table has a row a source.
    """
    by_name, by_room = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("room", F.asc_nulls_last("source"))
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(float(most)) * F.col("source_size"))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("place", F.row_number().over(by_room))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("place", "level"))).over(whole)["level"])
    )
    level = F.coalesce(F.col("level") * F.col("weight"), F.col("most"))
    return levels.select("source", "source_size", F.least("most", level).alias("target"))


def shares(words: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, class, whole, p): copies that each document of a source and size class gets for certain, and its chance of one more.

    From the words (source, class, words) of documents by the doubling of their size, and (source, target). Expected copies
    are level * (1 + class / LEAN), `most` at most, with the level at which the source's words are its target; it is found as
    in `targets`, the classes that stop first being the largest. A source has as many rows as sizes have doublings.
    """
    lean = (F.lit(float(LEAN)) + F.col("class")) / float(LEAN)
    by_class = Window.partitionBy("source").orderBy(F.desc("class"))
    before, whole = by_class.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    goals = goals.select(F.col("source").alias("_source"), "target")
    levels = (
        words.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("lean", lean)
        .withColumn("left", F.col("target") - float(most) * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("lent", F.sum(F.col("words") * F.col("lean")).over(whole) - F.coalesce(F.sum(F.col("words") * F.col("lean")).over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("lent") > 0, F.col("left") / F.col("lent")))
        .withColumn("level", F.max(F.when(F.col("level") <= float(most) / F.col("lean"), F.struct("class", "level"))).over(whole)["level"])
    )
    copies = F.round(F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("lean"), F.lit(float(most))))).otherwise(0.0), 9)
    out = levels.withColumn("copies", copies)
    return out.select("source", "class", F.floor("copies").cast("long").alias("whole"), (F.col("copies") - F.floor("copies")).alias("p"))


def random_unit(key) -> F.Column:
    """A number between 0 and 1, both excluded, from the first 52 bits of a digest: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, carry: bool = False, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies, taken); `carry` adds all columns as a struct `doc`.

    Size is the number of words; a null text has none. A document's expected copies come from its source's target and
    its size (`shares`). Their whole part is taken for certain. For the rest each document has its own inclusion
    probability, and the rank random odds / inclusion odds; the sample is the documents of lowest rank, and its size is fixed
    in words: documents are taken in the order of rank while they fit what the target still wants, and up to CLOSING more,
    each the one whose size comes nearest to what is then left, close it as long as that brings the sum nearer.

    A source without words has target 0. Repeated rows share their random number and fate, and count each; null ids
    and sources are ids and sources of their own. An empty table gives an empty result.
    """
    whole = docs.select(F.struct("*").alias("doc"))
    text, id_ = F.coalesce(F.col("doc.text"), F.lit("")), F.col("doc.doc_id").cast("long")
    size = F.regexp_count(text, F.lit(common.WORD)).cast("long")
    unit = random_unit(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    own = whole.select(id_.alias("doc_id"), F.col("doc.source").cast("string").alias("source"), size.alias("size"), unit.alias("_u"), F.xxhash64(text).alias("_h"), "doc")
    own = own.withColumn("_class", F.length(F.bin("size")) - 1)
    # Rows of one rank, id and text are alike: they are taken together or not at all.
    order = ("_rank", "doc_id", "_h")

    def known(rows: DataFrame, facts: DataFrame, *also: str) -> DataFrame:
        """Facts by source; Spark broadcasts them if they are small, and splits a hot source's rows otherwise."""
        facts = facts.withColumnsRenamed({c: f"_of_{c}" for c in ("source", *also)})
        same = F.col("source").eqNullSafe(F.col("_of_source"))
        for c in also:
            same = same & (F.col(c) == F.col(f"_of_{c}"))
        return rows.join(facts, same, "left").drop("_of_source", *(f"_of_{c}" for c in also))

    # Q / (1 + Q) of the rank Q = (u / (1 - u)) / (p / (1 - p)), which keeps the order within 0 and 1.
    odds = F.col("_u") * (1 - F.col("_p"))
    rank = odds / (odds + F.col("_p") * (1 - F.col("_u")))

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return known(rows, plan, "_class").withColumn("_rank", rank).withColumn("_bin", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)))

    stored = common.materialise(own.drop("doc"), "mix")
    with common.Scratch(docs.sparkSession) as scratch:
        classes = scratch.keep(stored.groupBy("source", F.col("_class").alias("class")).agg(F.sum("size").alias("words")), "classes")
        goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
        plan = known(shares(classes, goals, most), goals).select("source", F.col("class").alias("_class"), "source_size", "target", F.col("whole").alias("_whole"), F.col("p").alias("_p"))
        plan = scratch.keep(plan, "plan")
        certain = known(classes, plan.withColumnRenamed("_class", "class"), "class").groupBy("source").agg(F.sum(F.col("_whole") * F.col("words")).alias("_certain"))
        goals = scratch.keep(known(goals, certain).withColumn("_rest", F.col("target") - F.col("_certain")), "goals")
        # Only documents that may be had once more are in the sample.
        open_ = ranked(stored, plan).where("_p > 0").select("source", "size", "_bin", *order)
        bins = known(open_.groupBy("source", "_bin").agg(F.sum("size").alias("_words")), goals.select("source", "_rest"))
        bins = bins.withColumn("_sum", F.sum("_words").over(Window.partitionBy("source").orderBy("_bin")))
        over = bins.where((F.col("_rest") > 0) & (F.col("_sum") > F.col("_rest"))).groupBy("source").agg(F.min("_bin").alias("_last"), F.min(F.col("_sum")).alias("_sum"), F.min_by("_words", "_bin").alias("_in_last"))
        last = scratch.keep(over.select("source", "_last", (F.col("_sum") - F.col("_in_last")).alias("_before")), "bins")
        placed = known(known(open_, last), goals.select("source", "_rest"))

        # Equal rows come together before they are put in order: a document that repeats very often is a row.
        edge = placed.where(F.col("_bin") == F.col("_last")).groupBy("source", *order, "_before", "_rest").agg(F.sum("size").alias("size"))
        edge = edge.withColumn("_sum", F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy(*order)))
        edge = scratch.keep(edge.select("source", "size", *order, "_sum", (F.col("_sum") <= F.col("_rest")).alias("_fits")), "edge")
        cut = edge.where("_fits").groupBy("source").agg(F.max(F.struct(*order)).alias("_cut"), F.max("_sum").alias("_edge"))
        after = placed.where(F.col("_bin") > F.col("_last")).groupBy("source", *order).agg(F.sum("size").alias("size"))
        unused = scratch.keep(after.unionByName(edge.where(~F.col("_fits")).select("source", *order, "size")), "unused")
        facts = known(known(goals, last), cut).withColumn("_missing", F.col("_rest") - F.coalesce("_edge", "_before")).withColumn("_closing", F.expr("cast(array() as array<struct<doc_id: bigint, _h: bigint>>)"))
        facts = scratch.keep(facts, "facts")
        off = F.abs(F.col("size") - F.col("_missing"))
        for _ in range(CLOSING):
            near = known(unused, facts.select("source", "_missing", "_closing")).where((off < F.col("_missing")) & ~F.array_contains("_closing", F.struct("doc_id", "_h")))
            best = near.groupBy("source").agg(F.min(F.struct(off.alias("off"), *order, "size")).alias("_best"))
            facts = known(facts, best).withColumn("_missing", F.col("_missing") - F.coalesce("_best.size", F.lit(0)))
            more = F.concat("_closing", F.array(F.struct("_best.doc_id", "_best._h")))
            facts = scratch.keep(facts.withColumn("_closing", F.when(F.col("_best").isNotNull(), more).otherwise(F.col("_closing"))).drop("_best"), "facts")
        facts = common.materialise(known(plan, facts.select("source", "_last", "_cut", "_closing")), "facts")

    # What a document's source and class are given decides for each document by itself: texts are neither stored nor moved.
    in_order = (F.col("_bin") < F.coalesce("_last", F.lit(BINS))) | F.coalesce((F.col("_bin") == F.col("_last")) & (F.struct(*order) <= F.col("_cut")), F.lit(False))
    closing = F.coalesce(F.array_contains("_closing", F.struct("doc_id", "_h")), F.lit(False))
    copies = F.col("_whole") + ((F.col("_p") > 0) & (in_order | closing)).cast("long")
    rows = ranked(own if carry else stored, facts).withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["doc"] if carry else []))


#: DuckDB: the same ranks put in order as a whole.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             3.0::DOUBLE * source_size AS most FROM s),
r AS (SELECT *, most / weight AS room,
             sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weights
      FROM w),
l AS (SELECT *, arg_min(rest / weights, room) FILTER (rest / weights <= room) OVER () AS level FROM r),
g AS (SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target FROM l),
x AS (SELECT source, length(bin(size)) - 1 AS class, (8.0::DOUBLE + length(bin(size)) - 1) / 8.0 AS lean, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
y AS (SELECT x.*, g.source_size, g.target,
             g.target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY x.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(words * lean) OVER (PARTITION BY x.source) - coalesce(sum(words * lean) OVER (PARTITION BY x.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lent
      FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source),
z AS (SELECT *, CASE WHEN lent > 0 THEN rest / lent END AS own FROM y),
m AS (SELECT *, round(CASE WHEN target > 0 THEN least(3.0::DOUBLE, coalesce(arg_max(own, class) FILTER (own <= 3.0::DOUBLE / lean) OVER (PARTITION BY source) * lean, 3.0)) ELSE 0.0 END, 9) AS copies FROM z),
p AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p, target - sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source) AS wanted FROM m),
k AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.wanted, p.p,
             CASE WHEN p.p > 0 THEN d.u * (1 - p.p) / (d.u * (1 - p.p) + p.p * (1 - d.u)) END AS rank
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(d.size)) - 1 = p.class),
c AS (SELECT *, p > 0 AND wanted > 0 AND sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id) <= wanted AS fits FROM k),
c0 AS (SELECT *, fits AS chosen, wanted - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS missing FROM c),
""" + "".join(
    f"""
b{i} AS (SELECT *, row_number() OVER (PARTITION BY source, NOT chosen AND p > 0 AND abs(size - missing) < missing ORDER BY abs(size - missing), rank, doc_id) = 1
         AND NOT chosen AND p > 0 AND abs(size - missing) < missing AS closes FROM c{i}),
c{i + 1} AS (SELECT * EXCLUDE (chosen, missing, closes), chosen OR closes AS chosen,
         missing - coalesce(sum(CASE WHEN closes THEN size END) OVER (PARTITION BY source), 0) AS missing FROM b{i}),"""
    for i in range(CLOSING)
).rstrip(",") + f"""
SELECT doc_id, source, size, source_size, target, (whole + chosen::BIGINT) * size AS taken, whole + chosen::BIGINT AS copies FROM c{CLOSING}
"""
