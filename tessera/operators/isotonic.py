"""Isotonic regression by a distributed pool-adjacent-violators pass.

Values of equal predictions are pooled first. The points are then range-partitioned by prediction, every task pools its own
stretch (pooling is associative, so this changes nothing in the result), and blocks are cut where no later pooling can
reach across: where no block before has a greater mean than any block after. What lies between two cuts is pooled by
itself, so tasks hold blocks of one stretch and never the whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.sources.scratch import scratch_path

BLOCK = "low double, high double, weight double, total double"
#: Blocks of a calibration map that are sent to the tasks applying it (two numbers each).
MOST = 1 << 20


def pool(blocks: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators of blocks (low, high, weight, total) in rising order."""
    out: list[tuple[float, float, float, float]] = []
    for block in blocks:
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # the mean before is not less
            low, _, weight, total = out.pop()
            block = (low, block[1], weight + block[2], total + block[3])
        out.append(block)
    return out


def isotonic_blocks(df: DataFrame, x: str, y: str, weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """low, high, weight, value: the rising blocks of the isotonic fit of y on x. Rows whose x, y or weight is not finite, or
    whose weight is not positive, are left out; no row left gives no block."""
    spark = df.sparkSession
    w = C.finite(weight) if weight else F.lit(1.0)
    points = df.select(C.finite(x).alias("x"), C.finite(y).alias("y"), w.alias("w")).where("x is not null and y is not null and w > 0")
    points = points.groupBy("x").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def local(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), []
        for pdf in batches:
            held = pool([*held, *zip(pdf["x"], pdf["x"], pdf["weight"], pdf["total"], strict=True)])
        if held:
            yield pd.DataFrame(held, columns=["low", "high", "weight", "total"]).assign(part=part)

    path = scratch_path(spark, "blocks")
    points.repartitionByRange(n, "x").sortWithinPartitions("x").mapInPandas(local, f"{BLOCK}, part int").write.parquet(path)
    blocks = spark.read.parquet(path).withColumn("mean", F.col("total") / F.col("weight"))
    # greatest mean so far and least mean to come, first over the parts (one row each), then inside each part
    parts = blocks.groupBy("part").agg(F.max("mean").alias("most"), F.min("mean").alias("least"))
    order = W.orderBy("part")
    edges = parts.select("part", F.max("most").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.min("least").over(order.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    inside = W.partitionBy("part").orderBy("low")
    seen = F.max("mean").over(inside.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min("mean").over(inside.rowsBetween(1, W.unboundedFollowing))
    cut = F.coalesce(F.greatest(seen, F.col("before")) < F.least(ahead, F.col("after")), F.lit(False))
    cuts = blocks.join(F.broadcast(edges), "part").withColumn("cut", cut)
    # a block's stretch: cuts before it, again over parts and inside them
    per = cuts.groupBy("part").agg(F.count_if("cut").alias("cuts"))
    starts = per.select("part", F.coalesce(F.sum("cuts").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum(F.col("cut").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stretched = cuts.withColumn("own", own).join(F.broadcast(starts), "part").withColumn("stretch", F.col("first") + F.col("own"))

    def whole(pdf):
        pdf = pdf.sort_values("low")
        return pd.DataFrame(pool(list(zip(pdf["low"], pdf["high"], pdf["weight"], pdf["total"], strict=True))), columns=["low", "high", "weight", "total"])

    several = stretched.withColumn("n", F.count("*").over(W.partitionBy("stretch")))
    done = several.where("n = 1").select("low", "high", "weight", "total")
    pooled = several.where("n > 1").groupBy("stretch").applyInPandas(whole, BLOCK)
    return done.unionByName(pooled).select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def apply_isotonic(df: DataFrame, blocks: DataFrame, x: str, name: str) -> DataFrame:
    """df with `name`: the blocks' value at x, linear between blocks and constant beyond the ends (null without blocks or x).

    The blocks go to every task if there are at most MOST; more are refused, since a calibration map of that size has
    learned every row by heart."""
    rows = blocks.orderBy("low").limit(MOST + 1).select("low", "high", "value").toPandas()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} blocks")
    at = [v for pair in zip(rows["low"], rows["high"], strict=True) for v in pair]
    to = [v for v in rows["value"] for _ in range(2)]
    told = df.sparkSession.sparkContext.broadcast((at, to))

    @F.pandas_udf("double")
    def value_at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        xs, ys = (np.array(v) for v in told.value)
        for values in batches:
            got = np.interp(values.to_numpy(float), xs, ys) if len(xs) else np.full(len(values), np.nan)
            yield pd.Series(np.where(np.isnan(values.to_numpy(float)), np.nan, got))

    return df.withColumn(name, C.finite(value_at(F.col(x).cast("double"))))
