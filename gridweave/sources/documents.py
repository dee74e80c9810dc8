"""Text formats: parameter documents, rule tables, bad-pixel lists, job queues, camera constants, catalogue scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str], max_depth: int | None = None) -> DataFrame:
    """(path, dir, base, ext, length, modified) of the files below `root` whose extension, in lower case, is listed.

    Listing is Spark's own, by its parallel file index, which leaves out files that begin with a dot; folders that do
    are left out here. Contents are not read. Depth 0 is the root itself.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    inside = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    df = files.withColumn("_in", inside).withColumn("ext", F.lower(text.extension(F.col("path")))).where(F.col("ext").isin(*[e.lower() for e in extensions]))
    if max_depth is not None:
        df = df.where(F.size(F.split("_in", "/")) - 1 <= max_depth)
    df = df.where(~F.exists(F.split("_in", "/"), lambda p: p.startswith(".")))
    return df.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), text.base_name(F.col("path")).alias("base"), "ext", "length", "modified")


def _quoted(s: str) -> str:
    import re

    return re.escape(s)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, key, value) of `[Section]` and `key=value` files; the last value of a key holds. Whole files are read, so that a file's lines stay in order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("text").rlike(r"^\s*\[.*\]\s*$"), F.regexp_extract("text", r"\[(.*)\]", 1))
    rows = files.withColumn("section", F.last(section, True).over(w)).where(F.col("text").rlike(r"^[^\[#;=][^=]*="))
    pair = rows.select("path", "section", F.trim(F.substring_index("text", "=", 1)).alias("key"), F.trim(F.regexp_replace("text", r"^[^=]*=", "")).alias("value"), "line")
    return pair.groupBy("path", "section", "key").agg(F.max_by("value", "line").alias("value"))


def write_parameters(df: DataFrame, path: str) -> None:
    """Files of (section, key, value) rows, one file: sections in order, keys within them."""
    sections = df.groupBy("section").agg(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("lines")).orderBy("section")
    sections.select(F.concat(F.lit("["), "section", F.lit("]\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def values_list(value: Column) -> Column:
    """`a;b;c;` as an array of numbers."""
    return F.transform(F.filter(F.split(value, ";"), lambda x: F.trim(x) != ""), lambda x: x.try_cast("double"))


def migrate(df: DataFrame, version: Column, changes: Sequence[tuple[int, str, str, str | None]], scale: dict[str, float] | None = None) -> DataFrame:
    """Parameters of older documents as today's: (before version, section, old key, new key), a new key of None drops it; `scale` multiplies a key's number where the version is below the first change's."""
    key = F.col("key")
    drop = F.lit(False)
    for before, section, old, new in changes:
        hit = (version < before) & (F.col("section") == section) & (F.col("key") == old)
        if new is None:
            drop = drop | hit
        else:
            key = F.when(hit, new).otherwise(key)
    out = df.where(~drop).withColumn("key", key)
    for name, factor in (scale or {}).items():
        out = out.withColumn("value", F.when((version < changes[0][0]) & (F.col("key") == name), (F.col("value").cast("double") * factor).cast("string")).otherwise(F.col("value")))
    return out


def read_rules(parameters: DataFrame) -> DataFrame:
    """Rules, a row each, of the groups `rule N`; a range holds only where its ends are in order; rules without a profile are dropped."""
    rules = parameters.where(F.col("section").startswith("rule ")).withColumn("serial", F.regexp_extract("section", r"rule (\d+)", 1).cast("int"))
    wide = rules.groupBy("path", "serial").pivot("key", ["iso_min", "iso_max", "fnumber_min", "fnumber_max", "focallen_min", "focallen_max", "camera_enabled", "camera_value", "lens_enabled", "lens_value", "profilepath"]).agg(F.first("value"))
    for name, low, high in (("iso", 0.0, 819200.0), ("fnumber", 0.0, 100.0), ("focallen", 0.0, 10000.0)):
        a, b = F.col(f"{name}_min").try_cast("double"), F.col(f"{name}_max").try_cast("double")
        ok = a.isNotNull() & b.isNotNull() & (a <= b)
        wide = wide.withColumn("_a", F.when(ok, a).otherwise(low)).withColumn("_b", F.when(ok, b).otherwise(high)).drop(f"{name}_min", f"{name}_max").withColumnsRenamed({"_a": f"{name}_min", "_b": f"{name}_max"})
    return wide.where(F.coalesce("profilepath", F.lit("")) != "").orderBy("serial")


def read_bad_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x): lines `x y`, moved by the number that may stand alone in the first line; other lines don't count."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\r?\n").alias("lines"))
    shift = F.when(F.get("lines", F.lit(0)).rlike(r"^\s*-?\d+\s*$"), F.trim(F.get("lines", F.lit(0))).cast("int")).otherwise(0)
    rows = lines.withColumn("shift", shift).select("path", "shift", F.explode("lines").alias("line")).where(F.col("line").rlike(r"^\s*-?\d+\s+-?\d+\s*$"))
    part = F.split(F.trim("line"), r"\s+")
    return rows.select("path", (F.get(part, F.lit(1)).cast("int") + F.col("shift")).alias("y"), (F.get(part, F.lit(0)).cast("int") + F.col("shift")).alias("x"))


#: Columns of the job queue's file.
QUEUE = "input string, params string, output string, format string, jpeg_quality int, jpeg_subsampling int, png_bits int, tiff_bits int, tiff_float int, tiff_uncompressed int, save_params int, force_format int, fast int, big_tiff int"


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """The job queue: a heading, then `|` between values; columns that older files lack are null."""
    return spark.read.schema(QUEUE).csv(path, sep="|", header=True, enforceSchema=True)


def write_queue(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, sep="|", header=True)


def read_constants(spark: SparkSession, paths: Sequence[str], schema: str = "make_model string, dcraw_matrix array<int>, raw_crop array<int>, white int") -> DataFrame:
    """Camera constants from JSON files; for each key in capitals, the value of the latest file that sets it."""
    out = None
    for rank, path in enumerate(paths):
        df = spark.read.schema(schema).json(path, multiLine=True).withColumn("_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df)
    names = [n for n in out.columns if n not in ("make_model", "_rank")]
    return out.groupBy(F.upper("make_model").alias("key")).agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_rank"))).alias(n) for n in names))


def read_lens_profiles(spark: SparkSession, path: str, row_tag: str = "lens", schema: str = "maker string, model string, mount string, cropfactor double") -> DataFrame:
    """Lens records of an XML database."""
    return spark.read.schema(schema).format("xml").option("rowTag", row_tag).load(path)


def with_sidecars(files: DataFrame, sidecars: DataFrame, merge: bool = True) -> DataFrame:
    """Files with the path of their sidecar: the one of the same folder and base name; null without one, or if merging is off."""
    own = sidecars.select(F.col("dir").alias("_dir"), F.lower("base").alias("_base"), F.col("path").alias("sidecar")).groupBy("_dir", "_base").agg(F.min("sidecar").alias("sidecar"))
    if not merge:
        return files.withColumn("sidecar", F.lit(None).cast("string"))
    return files.join(own, (F.col("dir") == F.col("_dir")) & (F.lower("base") == F.col("_base")), "left").drop("_dir", "_base")


def reuse_cached(files: DataFrame, cache: DataFrame, values: Sequence[str]) -> DataFrame:
    """Files with the cached `values` of their path, null where the file is newer than the cache, or unknown to it; `fresh` says which."""
    held = cache.select(F.col("path").alias("_path"), F.col("modified").alias("_modified"), *(F.col(v).alias(f"_{v}") for v in values))
    joined = files.join(held, F.col("path") == F.col("_path"), "left")
    fresh = F.coalesce(F.col("modified") <= F.col("_modified"), F.lit(False))
    return joined.select(*files.columns, fresh.alias("fresh"), *(F.when(fresh, F.col(f"_{v}")).alias(v) for v in values))
