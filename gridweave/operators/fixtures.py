"""The tables of the queries: images from vectors, a catalogue from parts, capture series from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import table

SIDE = 8
#: DuckDB: pixels of 8 x 8 images, and the same with the mosaic's colour.
PX = "px AS (SELECT vec_id AS img, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, e::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"
MOSAIC = PX + ", mo AS (SELECT *, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 0 WHEN y % 2 = 1 AND x % 2 = 1 THEN 2 ELSE 1 END AS c FROM px)"
CATALOG = "cat AS (SELECT p_partkey AS id, p_name AS name, p_brand AS make, p_type AS model, p_size AS iso, p_retailprice AS focal, (p_partkey % 6)::INT AS rank, (p_partkey % 5)::INT AS label, p_partkey % 11 = 0 AS trashed, p_partkey % 3 = 0 AS edited, p_partkey % 4 = 0 AS saved, p_partkey % 13 <> 0 AS exif_valid FROM part)"


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row. The optimiser would put a plain column's expression into the lambda functions that use it, to be computed for every element; it doesn't move one through a generator."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def planes(spark, sf_dir) -> DataFrame:
    """(img, a): an image a row, its values row by row; operators on it need no shuffle. The generator keeps the cast out of the lambda functions that use `a`."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.explode(F.array(F.col("embedding").cast("array<double>"))).alias("a"))


def explode_plane(df: DataFrame, *columns: str, width: int = SIDE) -> DataFrame:
    """(img, y, x, *columns) from arrays of equal length."""
    zipped = F.arrays_zip(*columns)
    rows = df.select("img", F.posexplode(zipped).alias("i", "z"))
    return rows.select("img", F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).alias("x"), *(F.col("z")[c].alias(c) for c in columns))


def pixels(spark, sf_dir) -> DataFrame:
    return explode_plane(planes(spark, sf_dir).withColumnRenamed("a", "v"), "v")


def mosaic(spark, sf_dir) -> DataFrame:
    even_y, even_x = F.col("y") % 2 == 0, F.col("x") % 2 == 0
    return pixels(spark, sf_dir).withColumn("c", F.when(even_y & even_x, 0).when(~even_y & ~even_x, 2).otherwise(1))


def catalog(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_size").alias("iso"), F.col("p_retailprice").alias("focal"),
        (key % 6).cast("int").alias("rank"), (key % 5).cast("int").alias("label"), (key % 11 == 0).alias("trashed"), (key % 3 == 0).alias("edited"), (key % 4 == 0).alias("saved"), (key % 13 != 0).alias("exif_valid"),
    )
