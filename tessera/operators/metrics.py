"""Forecast and regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C

EPS = 1e-8


def rmse(y: str, p: str) -> Column:
    e = C.finite(y) - C.finite(p)
    return F.sqrt(F.avg(e * e))


def mse(y: str, p: str) -> Column:
    e = C.finite(y) - C.finite(p)
    return F.avg(e * e)


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(C.finite(y) - C.finite(p)))


def smape(y: str, p: str) -> Column:
    """Mean of |e| over the mean of |y| and |p|, at least 1e-8, per cent."""
    a, b = C.finite(y), C.finite(p)
    return F.avg(F.abs(a - b) / F.greatest((F.abs(a) + F.abs(b)) / 2, F.lit(EPS))) * 100


def r2(y: str, p: str) -> Column:
    a, b = C.finite(y), C.finite(p)
    return 1 - F.try_divide(F.sum((a - b) * (a - b)), F.count(a) * F.var_pop(a))


def explained_variance(y: str, p: str) -> Column:
    a, b = C.finite(y), C.finite(p)
    return 1 - F.try_divide(F.var_pop(a - b), F.var_pop(a))


def regression_bundle(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat") -> DataFrame:
    """RMSE, MSE, R2, Pearson, MAE, Median_AE, SMAPE, Explained_Variance per group, over rows with both values."""
    rows = df.where(C.is_finite(y) & C.is_finite(p))
    return rows.groupBy(*by).agg(
        rmse(y, p).alias("RMSE"), mse(y, p).alias("MSE"), r2(y, p).alias("R2"), C.safe_corr(y, p).alias("Pearson"), mae(y, p).alias("MAE"),
        F.percentile(F.abs(F.col(y) - F.col(p)), 0.5).alias("Median_AE"), smape(y, p).alias("SMAPE"), explained_variance(y, p).alias("Explained_Variance"),
    )


def naive_scales(train: DataFrame, keys: Sequence[str], y: str = "y", date: str = "date") -> DataFrame:
    """Per series: root mean square and mean absolute one-step change; NULL with fewer than two rows or a missing value."""
    x = C.finite(y)
    d = x - F.lag(x).over(W.partitionBy(*keys).orderBy(date))
    rows = train.withColumn("_d", d).withColumn("_x", x)
    whole = (F.count("_x") == F.count("*")) & (F.count("*") >= 2)
    return rows.groupBy(*keys).agg(F.when(whole, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rms_diff"), F.when(whole, F.avg(F.abs("_d"))).alias("mean_abs_diff"))


def pooled_scale(train: DataFrame, keys: Sequence[str], y: str = "y", date: str = "date") -> DataFrame:
    """One row: root mean square change over all series without a missing value; 0 counts as 1e-8."""
    x = C.finite(y)
    w = W.partitionBy(*keys)
    rows = train.withColumn("_x", x).withColumn("_ok", F.count(x).over(w) == F.count(F.lit(1)).over(w)).where("_ok")
    rows = rows.withColumn("_d", F.col("_x") - F.lag("_x").over(w.orderBy(date)))
    scale = F.sqrt(F.avg(F.col("_d") * F.col("_d")))
    return rows.agg(F.when(scale == 0, EPS).otherwise(scale).alias("scale"))


def forecast_bundle(actual: DataFrame, forecast: DataFrame, train: DataFrame, keys: Sequence[str], y: str = "y", p: str = "yhat", date: str = "date") -> DataFrame:
    """Per series over the dates both have: RMSE, MAE, SMAPE, OPE, MARRE, RMSSE, MASE. A naive scale of 0 gives NULL."""
    rows = actual.select(*keys, date, C.finite(y).alias("_y")).join(forecast.select(*keys, date, C.finite(p).alias("_p")), [*keys, date])
    e = F.col("_y") - F.col("_p")
    ok = F.count("_y") == F.count("*")
    out = rows.groupBy(*keys).agg(
        F.when(ok, F.sqrt(F.avg(e * e))).alias("RMSE"),
        F.when(ok, F.avg(F.abs(e))).alias("MAE"),
        F.when(ok & (F.min(F.abs("_y") + F.abs("_p")) > 0), 200 * F.avg(F.try_divide(F.abs(e), F.abs("_y") + F.abs("_p")))).alias("SMAPE"),
        (100 * F.abs(F.try_divide(F.sum(e), F.sum("_y")))).alias("OPE"),
        (100 * F.try_divide(F.avg(F.abs(e)), F.max("_y") - F.min("_y"))).alias("MARRE"),
    )
    out = out.join(naive_scales(train, keys, y, date), list(keys), "left")
    scaled = lambda a, b: F.when(F.col(b) > 0, F.col(a) / (F.col(b) + EPS))
    return out.withColumn("RMSSE", scaled("RMSE", "rms_diff")).withColumn("MASE", scaled("MAE", "mean_abs_diff")).drop("rms_diff", "mean_abs_diff")


def nwrmsle(y: str, p: str, weight: str) -> Column:
    """Root of the weighted mean square of differences that are in log space already."""
    d = F.col(y) - F.col(p)
    return F.sqrt(F.try_divide(F.sum(F.col(weight) * d * d), F.sum(weight)))


def percent_mav(y: str, p: str, weight: str) -> Column:
    """Weighted absolute error over weighted absolute value, of rows with y > 0, after expm1."""
    a, b = F.expm1(y), F.expm1(p)
    keep = F.col(y) > 0
    return F.sum(F.when(keep, F.col(weight) * F.abs(a - b))) / (F.sum(F.when(keep, F.col(weight) * F.abs(a))) + EPS)


def mse_original(y: str, p: str, weight: str | None = None) -> Column:
    """Mean square error after expm1 of rows with y > 0, optionally weighted row by row."""
    e = F.expm1(y) - F.expm1(p)
    return F.avg(F.when(F.col(y) > 0, (F.col(weight) if weight else F.lit(1.0)) * e * e))


def hybrid(y: str, p: str, weight: str) -> Column:
    return 0.8 * nwrmsle(y, p, weight) + 0.2 * F.try_divide(F.sum(F.col(weight) * F.abs(F.col(y) - F.col(p))), F.sum(weight))


def original_bundle(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "yhat", zeros: bool = False) -> DataFrame:
    """MAE, MAV and RMSE after expm1; zeros counts rows with y = 0 in the first two; nothing to count gives 0."""
    a, b = F.expm1(y), F.expm1(p)
    keep = F.col(y) >= 0 if zeros else F.col(y) > 0
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        z(F.avg(F.when(keep, F.abs(a - b)))).alias("MAE"), z(F.avg(F.when(keep, F.abs(a)))).alias("MAV"), z(F.sqrt(F.avg(F.when(F.col(y) > 0, (a - b) * (a - b))))).alias("RMSE")
    )


def naive_percent_mav(df: DataFrame, keys: Sequence[str], y: str = "y", date: str = "date") -> DataFrame:
    """The previous value as forecast: 100 * mean absolute change over mean absolute value (1e-12 at least), per series, over
    rows with both values finite and y not negative."""
    before = F.lag(y).over(W.partitionBy(*keys).orderBy(date))
    rows = df.withColumn("_p", C.finite(before)).withColumn("_y", C.finite(y)).where("_p is not null and _y >= 0")
    return rows.groupBy(*keys).agg((100 * F.avg(F.abs(F.col("_p") - F.col("_y"))) / F.greatest(F.avg(F.abs("_y")), F.lit(1e-12))).alias("naive_percent_mav"))


def calibrate_linear(df: DataFrame, split: str = "split", y: str = "y", p: str = "yhat") -> DataFrame:
    """Predictions mapped by the validation rows' least-squares line; left alone with fewer than two distinct predictions."""
    val = F.col(split) == "val"
    a, b = F.when(val, C.finite(p)), F.when(val, C.finite(y))
    slope = F.when(F.min(a) < F.max(a), F.try_divide(F.covar_pop(a, b), F.var_pop(a)))
    stats = df.agg(slope.alias("_s"), F.avg(F.when(b.isNotNull(), a)).alias("_a"), F.avg(F.when(a.isNotNull(), b)).alias("_b"))
    out = df.join(F.broadcast(stats))
    return out.withColumn(p, F.when(F.col("_s").isNotNull(), F.col("_b") + F.col("_s") * (F.col(p) - F.col("_a"))).otherwise(F.col(p))).drop("_s", "_a", "_b")


def calibrate_isotonic(df: DataFrame, split: str = "split", y: str = "y", p: str = "yhat") -> DataFrame:
    """Predictions mapped by an isotonic fit on the validation rows, clamped at its ends."""
    from pyspark.ml.regression import IsotonicRegression

    val = df.where((F.col(split) == "val") & C.is_finite(y) & C.is_finite(p))
    if val.select(p).distinct().limit(2).count() < 2:
        return df
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="_iso").fit(val)
    return model.transform(df).withColumn(p, F.col("_iso")).drop("_iso")


def report_rows(df: DataFrame, split: str = "split", y: str = "y", p: str = "yhat", calibrate: bool = True) -> DataFrame:
    """The regression bundle per Dataset, Units (log as given, original after expm1) and Calibrated (by the validation line)."""
    plain = df.select(F.col(split).alias("split"), C.finite(y).alias("y"), C.finite(p).alias("yhat")).where("y is not null and yhat is not null")
    variants = [(False, plain)] + ([(True, calibrate_linear(plain))] if calibrate else [])
    name = F.when(F.col("split") == "train", "Training").when(F.col("split") == "val", "Validation").otherwise("Test").alias("Dataset")
    parts = [
        rows.select(name, F.lit(units).alias("Units"), F.lit(done).alias("Calibrated"), f("y").alias("y"), f("yhat").alias("yhat"))
        for done, rows in variants
        for units, f in (("log", F.col), ("original", F.expm1))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return regression_bundle(out, ["Dataset", "Units", "Calibrated"])


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings, one row."""
    n_ab = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cells = n_ab.withColumn("na", F.sum("n").over(W.partitionBy(a))).withColumn("nb", F.sum("n").over(W.partitionBy(b)))
    total = n_ab.agg(F.sum("n").alias("t"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    plogp = lambda c: -F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))
    sums = cells.join(F.broadcast(total))
    one = sums.agg(F.sum(two("n")).alias("ab"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.first("t").alias("t"))
    side = lambda k, c, name: sums.select(k, c, "t").distinct().agg(F.sum(two(c)).alias(f"s_{name}"), F.sum(plogp(c)).alias(f"h_{name}"))
    row = one.crossJoin(side(a, "na", "a")).crossJoin(side(b, "nb", "b"))
    expected = F.col("s_a") * F.col("s_b") / (F.col("t") * (F.col("t") - 1) / 2.0)
    ari = F.coalesce(F.try_divide(F.col("ab") - expected, (F.col("s_a") + F.col("s_b")) / 2 - expected), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(F.col("mi"), (F.col("h_a") + F.col("h_b")) / 2), F.lit(1.0))
    return row.select(ari.alias("ari"), nmi.alias("nmi"))
