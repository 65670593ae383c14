"""Exact quantiles of a whole table without gathering its values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ACCURACY, FEW = 100_000, 1 << 20


def global_quantiles(df: DataFrame, values: dict[str, Column], shares: Sequence[float]) -> DataFrame:
    """One row: per name an array of the linear quantiles of its values at `shares` (null where there is no value).

    A rank is bracketed by approximate quantiles, whose sketches combine before the shuffle; then one pass counts, per value
    inside a bracket, how often it occurs, and how many values lie below. So one task sees the distinct values of a
    bracket, eight in 100,000 of all, or all of at most a million, and never the whole table."""
    names = list(values)
    x = df.select(*[values[n].cast("double").alias(n) for n in names])
    flat = x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{n}`").alias("x")) for i, n in enumerate(names)])).alias("s")).select("s.*").where("x is not null")
    pad = 4.0 / ACCURACY
    ends = [e for q in shares for e in (max(0.0, q - pad), min(1.0, q + pad))]
    known = flat.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", ends, ACCURACY).alias("ends"))
    few = F.col("n") <= FEW
    per = [
        F.struct(
            F.lit(k).alias("k"),
            ((F.col("n") - 1) * float(q)).alias("rank"),
            F.when(few, F.col("least")).otherwise(F.get("ends", F.lit(2 * k))).alias("lo"),
            F.when(few, F.col("most")).otherwise(F.get("ends", F.lit(2 * k + 1))).alias("hi"),
        )
        for k, q in enumerate(shares)
    ]
    brackets = known.select("c", F.explode(F.array(*per)).alias("b")).select("c", "b.*")  # names x shares rows
    met = flat.join(F.broadcast(brackets), "c").where(F.col("x") <= F.col("hi"))
    inside = F.when(F.col("x") >= F.col("lo"), F.col("x"))  # null stands for all below
    counts = met.groupBy("c", "k", "rank", inside.alias("x")).agg(F.count("*").alias("n"))
    by = W.partitionBy("c", "k").orderBy(F.asc_nulls_first("x"))
    placed = counts.withColumn("end", F.sum("n").over(by)).withColumn("start", F.col("end") - F.col("n"))
    holds = lambda r: (F.col("start") <= r) & (r < F.col("end"))
    low, high = F.floor("rank"), F.ceil("rank")
    found = placed.groupBy("c", "k", "rank").agg(F.max(F.when(holds(low), F.col("x"))).alias("a"), F.max(F.when(holds(high), F.col("x"))).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    cell = lambda i, k: F.max(F.when((F.col("c") == i) & (F.col("k") == k), value))
    return found.agg(*[F.array(*[cell(i, k) for k in range(len(shares))]).alias(n) for i, n in enumerate(names)])
