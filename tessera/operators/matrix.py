"""Store x item matrices and tensors in long form: reshaping, imputation and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators.quantiles import global_quantiles


def cells(df: DataFrame, value: str, rows: str = "store", cols: str = "item", how: str = "mean") -> DataFrame:
    """(rows, cols, value, n): one cell per pair that occurs."""
    agg = {"mean": lambda c: F.avg(c), "median": lambda c: F.percentile(c, 0.5), "count": lambda c: F.count(c).cast("double")}[how]
    return df.groupBy(rows, cols).agg(agg(C.finite(value)).alias("value"), F.count(C.finite(value)).alias("n"))


def grid(df: DataFrame, rows: str = "store", cols: str = "item") -> DataFrame:
    """All combinations of the distinct row and column keys (a matrix's index, the smaller side measured by the planner)."""
    return df.select(rows).distinct().crossJoin(df.select(cols).distinct())


def on_grid(matrix: DataFrame, rows: str = "store", cols: str = "item", fill: float | None = 0.0) -> DataFrame:
    """Reindexed to the whole grid; missing cells get `fill`."""
    out = grid(matrix, rows, cols).join(matrix, [rows, cols], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def zscore(matrix: DataFrame, by: str, value: str = "value", epsilon: float = 1e-8, propagate: bool = False) -> DataFrame:
    """Population z-score within rows or columns (`by`), missing cells skipped, or spoiling their line if propagate.

    A constant line is divided by epsilon. Variance is E[x^2] - E[x]^2, not below 0."""
    x, w = C.finite(value), W.partitionBy(by)
    mean, square = F.avg(x).over(w), F.avg(x * x).over(w)
    std = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    z = (x - mean) / F.when(std > 0, std).otherwise(epsilon)
    if propagate:
        z = F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), z)
    return matrix.withColumn(value, z)


def impute_by_column(matrix: DataFrame, rows: str = "store", cols: str = "item", how: str = "median") -> DataFrame:
    """Cells of the grid without observations get their column's mean or median over observed cells."""
    agg = {"mean": F.avg("value"), "median": F.percentile("value", 0.5)}[how]
    stats = matrix.where("n > 0").groupBy(cols).agg(agg.alias("_c"))
    out = grid(matrix, rows, cols).join(matrix, [rows, cols], "left").join(stats, cols, "left")
    return out.select(rows, cols, F.when(F.coalesce("n", F.lit(0)) > 0, F.col("value")).otherwise(F.col("_c")).alias("value"))


def normalise(df: DataFrame, value: str, rows: str = "store", cols: str = "item", how: str = "mean", impute: str = "median", log1p: bool = False) -> DataFrame:
    """Cells, imputed by column, the rest 0, optional log1p, z-score by row, then by column."""
    m = impute_by_column(cells(df, value, rows, cols, how), rows, cols, impute)
    x = F.coalesce("value", F.lit(0.0))
    m = m.withColumn("value", F.log1p(x) if log1p else x)
    return zscore(zscore(m, rows), cols)


def with_normalised(panel: DataFrame, matrix: DataFrame, name: str = "normalised") -> DataFrame:
    return panel.join(matrix.withColumnRenamed("value", name), ["store", "item"], "left")


def minmax_by_column(matrix: DataFrame, col: str, value: str = "value") -> DataFrame:
    """Missing cells 0, then min-max within columns; a constant column is divided by 1."""
    x = F.coalesce(C.finite(value), F.lit(0.0))
    w = W.partitionBy(col)
    span = F.max(x).over(w) - F.min(x).over(w)
    return matrix.withColumn(value, F.greatest((x - F.min(x).over(w)) / F.when(span > 0, span).otherwise(1.0), F.lit(0.0)))


def scale_features(tensor: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Per-feature min-max over present cells, range at least 1e-12; absent cells 0."""
    x, w = C.finite(value), W.partitionBy(feature)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return tensor.withColumn(value, F.coalesce((x - low) / F.greatest(high - low, F.lit(1e-12)), F.lit(0.0)))


def centre_features(tensor: DataFrame, feature: str = "feature", value: str = "value", epsilon: float = 1e-12) -> DataFrame:
    """Per-feature sample z-score, deviation at most epsilon counts as 1; absent cells 0."""
    x, w = C.finite(value), W.partitionBy(feature)
    sd = F.stddev_samp(x).over(w)
    return tensor.withColumn(value, F.coalesce((x - F.avg(x).over(w)) / F.when(sd > epsilon, sd).otherwise(1.0), F.lit(0.0)))


def robust_scale(df: DataFrame, value: str, keys: Sequence[str], train: Column, name: str | None = None) -> DataFrame:
    """(x - median) / IQR per series with statistics of the training rows; IQR 0 counts as 1."""
    x = C.finite(value)
    fit = F.when(train, x)
    stats = df.groupBy(*keys).agg(F.percentile(fit, 0.5).alias("_m"), F.percentile(fit, 0.25).alias("_a"), F.percentile(fit, 0.75).alias("_b"))
    iqr = F.col("_b") - F.col("_a")
    return df.join(stats, list(keys)).withColumn(name or value, (x - F.col("_m")) / F.when(iqr > 0, iqr).otherwise(1.0)).drop("_m", "_a", "_b")


def robust_scale_all(df: DataFrame, value: str, train: Column, name: str | None = None) -> DataFrame:
    """(x - median) / IQR with statistics of all training rows; IQR 0 counts as 1."""
    x = C.finite(value)
    stats = global_quantiles(df, {"q": F.when(train, x)}, [0.25, 0.5, 0.75]).select(*[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("_a", "_m", "_b"))])
    iqr = F.col("_b") - F.col("_a")
    return df.join(F.broadcast(stats)).withColumn(name or value, (x - F.col("_m")) / F.when(iqr > 0, iqr).otherwise(1.0)).drop("_m", "_a", "_b")


def minmax_fit(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """One row of training minima and maxima."""
    return df.agg(*[f(F.when(train, C.finite(c))).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def minmax_apply(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaled by the training range; a constant column becomes 0."""
    out = df.join(F.broadcast(stats))
    for c in columns:
        span = F.col(f"{c}_max") - F.col(f"{c}_min")
        out = out.withColumn(c, (C.finite(c) - F.col(f"{c}_min")) / F.when(span > 0, span).otherwise(1.0))
    return out.drop(*stats.columns)


def minmax_invert(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df.join(F.broadcast(stats))
    for c in columns:
        span = F.col(f"{c}_max") - F.col(f"{c}_min")
        out = out.withColumn(c, F.col(c) * F.when(span > 0, span).otherwise(1.0) + F.col(f"{c}_min"))
    return out.drop(*stats.columns)


def clip_target(df: DataFrame, value: str, train: Column) -> DataFrame:
    """Clipped to [floor of the training 1 % quantile, ceiling of the 99 % one]."""
    x = F.when(train, C.finite(value))
    q = global_quantiles(df, {"q": x}, [0.01, 0.99])
    ends = q.select(F.floor(F.get("q", F.lit(0))).cast("double").alias("_lo"), F.ceil(F.get("q", F.lit(1))).cast("double").alias("_hi"))
    return df.join(F.broadcast(ends)).withColumn(value, C.clip(value, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def to_tensor(df: DataFrame, features: Sequence[str], row: str = "store", col: str = "item", order: str | None = None) -> DataFrame:
    """Long tensor (row, col as text, feature, value); of repeated cells the last by `order` stays."""
    rows = df.select(F.col(row).cast("string").alias(row), F.col(col).cast("string").alias(col), *[C.finite(f).alias(f) for f in features], *([order] if order else []))
    if order:
        rows = rows.groupBy(row, col).agg(F.max_by(F.struct(*features), order).alias("_f")).select(row, col, "_f.*")
    return rows.unpivot([row, col], list(features), "feature", "value")


def to_wide(matrix: DataFrame, row: str, col: str, value: str, names: Sequence, prefix: str = "") -> DataFrame:
    """Pivot with an explicit list of column keys."""
    out = matrix.groupBy(row).pivot(col, list(names)).agg(F.first(value))
    return out.select(row, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def to_long(wide: DataFrame, row: str, columns: Sequence[str], col: str = "item", value: str = "value") -> DataFrame:
    """Unpivot without missing cells."""
    return wide.unpivot([row], list(columns), col, value).where(C.is_finite(value))


def transpose(matrix: DataFrame, row: str = "store", col: str = "item") -> DataFrame:
    swap = {row: col, col: row}
    return matrix.select(*[F.col(c).alias(swap.get(c, c)) for c in matrix.columns])


def reorder(matrix: DataFrame, row_labels: DataFrame, col_labels: DataFrame, row: str = "store", col: str = "item") -> DataFrame:
    """Positions of rows and columns when sorted by their labels, then keys."""
    place = lambda df, k, label, name: df.select(k, (F.row_number().over(W.orderBy(label, k)) - 1).alias(name))  # noqa: E731  labels are one row per key
    return matrix.join(place(row_labels, row, "row_cluster", "row_pos"), row).join(place(col_labels, col, "col_cluster", "col_pos"), col)


def explained_variance(matrix: DataFrame, row: str = "store", col: str = "item") -> list[float]:
    """Cumulative shares of variance of the principal components, missing cells at their column's mean.

    The columns' covariance is aggregated in Spark by a self-join on rows; its eigenvalues are found on the driver (one
    number per column pair of a matrix whose columns are a catalogue)."""
    import numpy as np

    full = impute_by_column(matrix, row, col, "mean").withColumn("value", F.coalesce("value", F.lit(0.0)))
    centred = full.withColumn("x", F.col("value") - F.avg("value").over(W.partitionBy(col))).select(row, col, "x")
    other = centred.select(row, F.col(col).alias("_c"), F.col("x").alias("_x"))
    pairs = centred.join(other, row).groupBy(col, "_c").agg(F.sum(F.col("x") * F.col("_x")).alias("s")).toPandas()
    m = pairs.pivot(index=col, columns="_c", values="s").to_numpy()
    values = np.clip(np.linalg.eigvalsh(m)[::-1], 0, None)
    return (np.cumsum(values) / max(values.sum(), 1e-300)).tolist()
