"""Streams over the events table, run until all that is there has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..registry import register, table
from . import updates


def finished(df: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over what there is. Results and progress are in the shared folder, so the stream can go on after a loss."""
    spark = df.sparkSession
    out = scratch.path(spark, "stream")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/progress").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def events(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # Event time must be an instant: the session's zone is that of the file's times.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def local_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def action() -> F.Column:
    t = F.col("event_type")
    return F.when(t == "click", 1).when(t == "view", 2).when(t == "purchase", 4).when(t == "error", 8).otherwise(16)


ACTION = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 ELSE 16 END"


@register("stream_coalesce", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id, bit_or({ACTION})::INT AS action, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return local_times(finished(updates.coalesce_updates(events(spark, sf_dir), "user_id", "ts", action(), "1 hour", "31 days")))


@register("stream_facets", "SELECT event_type, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return finished(updates.running_facets(events(spark, sf_dir), "event_type"))


@register("stream_drop_stale", "SELECT event_type, min(value) AS least, max(value) AS most, count(*) AS n FROM events WHERE (props->>'k')::INT >= 50 GROUP BY event_type")
def _(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("epoch", F.get_json_object("props", "$.k").cast("int"))
    return finished(updates.running_facets(updates.drop_stale(e, "epoch", 50), "event_type"))


@register("stream_sessions", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, sf_dir):
    return local_times(finished(updates.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours", "31 days")))


@register("sliding_windows", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY ALL")
def _(spark, sf_dir):
    """Two-hour windows that begin every hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
