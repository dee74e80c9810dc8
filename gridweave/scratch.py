"""Tables that cut a plan: written to the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the driver's JVM ends; a temporary folder only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridweave-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get()
    out = f"{root.rstrip('/')}/gridweave-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return out


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
