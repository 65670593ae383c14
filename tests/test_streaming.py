"""Streams give what the same operators give on tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams as T


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/events")
    return df, T.event_stream(spark, f"{tmp_path}/events", df.schema)


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("build", [lambda d: T.tumbling(d, ["event_type"], 3, "value", late="60 days"), lambda d: T.weekly_sums(d, ["event_type"], "value", late="60 days")])
def test_windows(events, tmp_path, build):
    table, stream = events
    assert _rows(T.drain(build(stream), f"w{abs(hash(str(tmp_path)))}", f"{tmp_path}/ck")) == _rows(build(table))


def test_error_sums(events, tmp_path):
    table, stream = events
    build = lambda d: T.error_sums(d.withColumn("p", F.lit(1.0)), ["event_type"], "value", "p")
    assert _rows(T.drain(build(stream), "errors", f"{tmp_path}/ck")) == _rows(build(table))


def test_online_median_keeps_state(events, tmp_path):
    table, stream = events
    got = T.drain(T.online_median(stream, "event_type", "value"), "medians", f"{tmp_path}/ck", mode="update")
    last = {r.event_type: r.n for r in got.groupBy("event_type").agg(F.max("n").alias("n")).collect()}
    assert last == {r.event_type: r["count"] for r in table.groupBy("event_type").count().collect()}


def test_mini_batches(events, tmp_path):
    _, stream = events
    seen = []
    T.each_batch(stream, lambda df, epoch: seen.append((epoch, df.count())), f"{tmp_path}/ck")
    assert [e for e, _ in seen] == list(range(len(seen))) and np.sum([n for _, n in seen]) > 0
