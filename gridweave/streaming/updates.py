"""Streams of updates: coalescing, debouncing, dropping what is stale, running facets, files as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def arriving_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """New files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def coalesce_updates(df: DataFrame, key: str, time: str, mask: Column, window: str, late: str) -> DataFrame:
    """All changes of a key within a window as one mask; what comes later than `late` is dropped."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.bit_or(mask).alias("action"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "action", "n")


def drop_stale(df: DataFrame, epoch: str, current: int) -> DataFrame:
    """Results of an older epoch don't count."""
    return df.where(F.col(epoch) >= current)


def running_facets(df: DataFrame, key: str) -> DataFrame:
    """Range and count of values so far, by key."""
    return df.groupBy(key).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


def sessions(df: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Runs of events of a key with gaps below `gap`."""
    s = df.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


DEBOUNCED = "key long, fired double, first double, n long, value double"


def debounce(df: DataFrame, key: str, time: str, value: str, quiet: float, most: float, late: str) -> DataFrame:
    """One update a burst of a key: it fires `quiet` seconds after the last call, or `most` after the first, with the last value.

    State is one open burst a key, however many calls it has. Bursts end by event time, so a replay gives the same ones;
    calls that come within `late` may be out of order between batches of one watermark.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else None  # first, last, n, value
        out = []

        def fire() -> None:
            out.append((k[0], min(held[1] + quiet, held[0] + most), held[0], int(held[2]), held[3]))

        if state.hasTimedOut:
            fire()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("t")
            for t, v in zip(rows["t"], rows["v"], strict=True):
                if held and (t >= held[1] + quiet or t >= held[0] + most):
                    fire()
                    held = None
                held = [held[0], max(held[1], t), held[2] + 1, v] if held else [t, t, 1, v]
            state.update(tuple(held))
            end = min(held[1] + quiet, held[0] + most) * 1000
            state.setTimeoutTimestamp(max(int(end), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "fired", "first", "n", "value"])

    seconds = F.expr(f"unix_micros({time}) / 1e6")
    rows = df.withWatermark(time, late).select(F.col(key).cast("long").alias("k"), F.col(time), seconds.alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("k").applyInPandasWithState(step, DEBOUNCED, "first double, last double, n long, value double", "append", GroupStateTimeout.EventTimeTimeout)
