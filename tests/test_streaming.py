import datetime

from pyspark.sql import functions as F

from gridweave.streaming import queries, updates


def stream(spark, tmp_path, rows, files=1):
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + datetime.timedelta(seconds=t), v) for k, t, v in rows], "k long, ts timestamp, v double")
    for i in range(files):
        df.where(F.lit(True)).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in*"))


def test_debounce_fires_after_quiet_or_at_the_cap(spark, tmp_path):
    rows = [(1, 0, 1.0), (1, 3, 2.0), (1, 20, 3.0)] + [(2, t, float(t)) for t in range(0, 40, 4)] + [(9, 1000, 0.0)]
    out = queries.finished(updates.debounce(stream(spark, tmp_path, rows), "k", "ts", "v", quiet=5, most=15, late="1 second"), "append")
    zero = datetime.datetime(2024, 1, 1).timestamp()
    got = sorted((r.key, round(r.first - zero) % 86400, r.n, r.value) for r in out.collect() if r.key != 9)
    assert [(k, n, v) for k, _, n, v in got] == [(1, 2, 2.0), (1, 1, 3.0), (2, 4, 12.0), (2, 4, 28.0), (2, 2, 36.0)]


def test_drop_stale(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "a int, epoch int")
    assert [r.a for r in updates.drop_stale(df, "epoch", 4).collect()] == [2, 3]


def test_arriving_files(spark, tmp_path):
    for i in range(3):
        spark.range(10).write.parquet(str(tmp_path / f"d/{i}"))
    df = updates.arriving_files(spark, str(tmp_path / "d/*"), "id long", per_trigger=1)
    assert queries.finished(df, "append").count() == 30
