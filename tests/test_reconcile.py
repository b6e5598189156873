"""Dual writes reconciled as a stream: the batch answer, with late rows and over a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdigris.sources.tables import parquet_table
from verdigris.streaming.reconcile import catch_up, reconcile, stream_table


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_equals_batch_over_a_restart_with_late_rows(spark, data, tmp_path):
    events = parquet_table(spark, data, "events").withColumnRenamed("value", "status")
    source = events.where("event_id % 17 <> 0")
    target = events.where("event_id % 13 <> 0").withColumn("status", F.when(F.col("event_id") % 11 == 0, F.col("status") + 1).otherwise(F.col("status")))
    target = target.unionByName(events.where("event_id % 29 = 1"))
    args = (["event_id", "user_id"], ["status", "props"], "ts", "2 hours")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    thirds = [first + (last - first) * k / 3 for k in range(4)]
    for name, df in (("s", source), ("t", target)):
        for k in range(3):
            # The target writes each third's last hour with the next third: late, but within the delay.
            late = dt.timedelta(hours=1) if name == "t" else dt.timedelta()
            part = df.where((F.col("ts") >= (thirds[k] - late if k else first)) & (F.col("ts") < thirds[k + 1] - late if k < 2 else F.lit(True)))
            part.orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}{k}")
    streams = lambda k: (stream_table(spark, f"{tmp_path}/{x}[0-{k}]", source.schema) for x in "st")
    seen = []
    for k in range(3):  # started three times, each time with more files
        told = rows(catch_up(reconcile(*streams(k), *args), f"{tmp_path}/out", f"{tmp_path}/state"))
        assert set(seen) <= set(told) and len(told) == len(set(told))
        seen = told
    closed = last - dt.timedelta(hours=2, seconds=1)
    want = [r for r in rows(reconcile(source, target, *args)) if r[2] < closed]
    assert [r for r in seen if r[2] < closed] == want and {r[5] for r in want} >= {"source_only", "target_only", "changed"}
    assert reconcile(source, target, *args).columns == ["event_id", "user_id", "ts", "n_source", "n_target", "status"]


def test_batch_statuses_and_odd_rows(spark):
    at = dt.datetime(2024, 3, 31, 2, 30)
    kind = "status string, t timestamp_ntz, v double"
    a = spark.createDataFrame([("a", at, 1.0), ("b", at, 1.0), ("b", at, 1.0), ("c", at, None), (None, at, 1.0), ("d", None, 1.0), ("e", at, 0.0)], kind)
    b = spark.createDataFrame([("a", at, 2.0), ("b", at, 1.0), ("c", at, None), ("f", at, 1.0), ("e", at, -0.0)], kind)
    found = reconcile(a, b, ["status"], ["v"], "t", "1 hour")
    assert found.columns == ["status", "t", "n_source", "n_target", "status_"]
    assert rows(found) == sorted([("a", at, 1, 1, "changed"), ("b", at, 2, 1, "repeated"), (None, at, 1, 0, "source_only"), ("f", at, 0, 1, "target_only")], key=str)
    assert reconcile(a.limit(0), b.limit(0), ["status"], ["v"], "t", "1 hour").count() == 0
    with pytest.raises(ValueError):
        reconcile(a, b, ["status"], ["t"], "v", "1 hour")
