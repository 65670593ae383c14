"""Structured Streaming forms of the time-series operators. Inputs need an event-time column of type timestamp."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", per_trigger: int = 1, name: str | None = None) -> DataFrame:
    """A folder of Parquet files (those called `name`, a glob) as a stream, event time as timestamp."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    reader = reader if name is None else reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(df: DataFrame, keys: Sequence[str], days: int, value: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """n-day windows aligned to the epoch (batch windows align to the last date): n, total. Works on streams and tables."""
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.window(ts, f"{days} days").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.to_date("w.start").alias("start"), "n", "total")


def weekly_sums(df: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Weeks from Monday, named by the Sunday that ends them."""
    src = df.withWatermark(ts, late) if df.isStreaming else df
    return src.groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w"), *keys).agg(F.sum(value).alias("total")).select(*keys, F.date_add(F.to_date("w.start"), 6).alias("week_end"), "total")


def online_median(df: DataFrame, key: str, value: str, eta: float = 0.1, start: float = 0.0) -> DataFrame:
    """Running estimate per key, est += eta * sign(x - est), kept as state between batches: key, estimate, n."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(group: tuple, pdfs, state: GroupState):
        import numpy as np
        import pandas as pd

        estimate, n = state.get if state.exists else (start, 0)
        for pdf in pdfs:
            for x in pdf[value].dropna():
                estimate += eta * np.sign(x - estimate)
                n += 1
        state.update((float(estimate), int(n)))
        yield pd.DataFrame({key: [group[0]], "estimate": [float(estimate)], "n": [int(n)]})

    out = T.StructType([df.schema[key], T.StructField("estimate", T.DoubleType()), T.StructField("n", T.LongType())])
    return df.groupBy(key).applyInPandasWithState(update, out, "estimate double, n long", "update", GroupStateTimeout.NoTimeout)


def online_median_state(df: DataFrame, key: str, value: str, ts: str = "ts", eta: float = 0.1, start: float = 0.0, late: str = "1 day", idle_days: int | None = None) -> DataFrame:
    """`online_median` on the state store with timers: key, estimate, n, ended. Rows of a key are folded by event time inside a
    micro-batch; a restart from the checkpoint continues where it stopped.

    idle_days: a key that has had no row for so long, by the watermark, is told once more with `ended` and forgotten. Needs
    the RocksDB state store (see `use_rocksdb`); the stream must be run in update mode."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    out = T.StructType([df.schema[key], T.StructField("estimate", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("ended", T.BooleanType())])
    idle_ms = None if idle_days is None else idle_days * 86_400_000

    class Median(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("median", "estimate double, n long, timer long")

        def handleInputRows(self, key_, rows, timerValues):
            import numpy as np
            import pandas as pd

            estimate, n, timer = self.state.get() if self.state.exists() else (start, 0, 0)
            pdf = pd.concat(list(rows)).sort_values([ts, value])
            for x in pdf[value].dropna():
                estimate += eta * np.sign(x - estimate)
                n += 1
            if idle_ms is not None:
                if timer:
                    self.handle.deleteTimer(timer)
                timer = int(pdf[ts].max().timestamp() * 1000) + idle_ms
                timer = max(timer, timerValues.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(timer)
            self.state.update((float(estimate), int(n), int(timer)))
            yield pd.DataFrame({key: [key_[0]], "estimate": [float(estimate)], "n": [int(n)], "ended": [False]})

        def handleExpiredTimer(self, key_, timerValues, expiredTimerInfo):
            import pandas as pd

            if self.state.exists():
                estimate, n, _ = self.state.get()
                self.state.clear()
                yield pd.DataFrame({key: [key_[0]], "estimate": [float(estimate)], "n": [int(n)], "ended": [True]})

        def close(self) -> None:
            pass

    marked = df.withWatermark(ts, late)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=Median(), outputStructType=out, outputMode="Update", timeMode="EventTime" if idle_ms is not None else "None")


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams on disk (changelogged to the checkpoint), so that it may outgrow the executors' memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def error_sums(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Accumulated n, squared and absolute error per key: what RMSSE, RMSE and MAE of a stream need."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"))


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over everything available into an in-memory table (tests and small reports)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(df: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Feed micro-batches to a mini-batch learner, such as OnlineDoubleKMeans, or to a table, exactly once per epoch id; a
    restart goes on from the checkpoint."""
    df.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
