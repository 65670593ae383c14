"""Per-series statistics and reporting aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators import series as S
from tessera.operators.quantiles import global_quantiles

GROWTH_FEATURES = ("gr_median", "gr_std", "gr_iqr", "frac_up", "frac_sideways", "frac_down", "up_to_down_ratio", "ac_lag1", "ac_lag4", "ac_lag12", "trend_slope", "seasonal_strength")


def value_shares(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each group with their share of the group's rows, per cent."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n_rows"))
    w = W.partitionBy(group)
    ranked = counts.withColumn("percentage", F.col("n_rows") * 100.0 / F.sum("n_rows").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n_rows"), value)))
    return ranked.where(F.col("_r") <= n).drop("_r")


def value_counts(df: DataFrame, value: str, n: int | None = None) -> DataFrame:
    """Counts and shares of the non-NULL values, in order of the value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("_t"))
    out = counts.join(F.broadcast(total)).withColumn("percentage", F.col("n_rows") * 100.0 / F.col("_t")).drop("_t")
    return out.orderBy(value).limit(n) if n else out


def top_count_shares(df: DataFrame, value: str, n: int) -> DataFrame:
    return value_counts(df, value).orderBy(F.desc("n_rows"), value).limit(n)


def tau_diagnostics(weeks: DataFrame, taus: Sequence[float], keys: Sequence[str] = S.KEYS, growth: str = "growth_rate", date: str = "week_end") -> DataFrame:
    """Per tau: shares by direction over all rows, mean |g|, soft-thresholded mean, L1 reduction and variance, and the
    median, P10 and P90 over series of direction churn (opposite consecutive signs among consecutive non-zero pairs).

    The lag is taken once and every tau is a set of conditional aggregates per series: rows are never repeated per tau; what
    is exploded are series x taus partial sums."""
    w = W.partitionBy(*keys).orderBy(date)
    rows = weeks.select(*keys, date, C.finite(growth).alias("g")).withColumn("before", F.lag("g").over(w))

    def of(t: float) -> Column:
        tau = F.lit(float(t))
        sign = lambda c: F.when(F.col(c) > tau, 1).when(F.col(c) < -tau, -1).otherwise(0)
        both = (sign("g") != 0) & (sign("before") != 0)
        soft = C.soft_threshold("g", tau)
        return F.struct(
            tau.alias("tau"),
            F.count_if(F.col("g") > tau).alias("up"),
            F.count_if(F.abs("g") < tau).alias("inside"),
            F.count_if(F.col("g") < -tau).alias("down"),
            F.sum(F.abs(soft)).alias("soft_abs"),
            F.sum(soft).alias("soft_sum"),
            F.sum(soft * soft).alias("soft_sq"),
            F.try_divide(F.count_if(both & (sign("g") != sign("before"))).cast("double"), F.count_if(both)).alias("churn"),
        )

    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("g").alias("n_g"), F.sum(F.abs("g")).alias("abs_g"), F.array(*[of(t) for t in taus]).alias("t"))
    flat = per.select("n", "n_g", "abs_g", F.explode("t").alias("t")).select("n", "n_g", "abs_g", "t.*")
    total = flat.groupBy("tau").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "n_g", "abs_g", "up", "inside", "down", "soft_abs", "soft_sum", "soft_sq")], *[F.percentile("churn", q).alias(f"churn_{c}") for c, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))])
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    mean = share("soft_sum", "n_g")
    return total.select(
        "tau",
        share("up", "n").alias("frac_up"),
        share("inside", "n").alias("frac_sideways"),
        share("down", "n").alias("frac_down"),
        share("abs_g", "n_g").alias("mean_abs"),
        share("soft_abs", "n_g").alias("mean_soft"),
        F.try_divide(F.col("abs_g") - F.col("soft_abs"), F.col("abs_g")).alias("l1_reduction"),
        F.greatest(share("soft_sq", "n_g") - mean * mean, F.lit(0.0)).alias("var_soft"),
        "churn_median",
        "churn_p10",
        "churn_p90",
    )


def _supported(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)


def growth_features(weeks: DataFrame, keys: Sequence[str] = S.KEYS, growth: str = "growth_rate", date: str = "week_end", tau: float = 0.05, smooth: int = 4, period: int = 52) -> DataFrame:
    """One row per series: robust dispersion, direction shares, autocorrelations, trend and seasonality of the smoothed growth.

    ac_lag4 falls back to the lag-1 autocorrelation of the sign when support is 4 or 5 values. Two exchanges on the keys
    at most: the windows and the aggregate share their partitioning."""
    g = C.finite(growth)
    w = W.partitionBy(*keys).orderBy(date)
    rows = weeks.withColumn("g", g).withColumn("s", F.avg("g").over(w.rowsBetween(1 - smooth, 0)))
    rows = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("sign", F.signum("s"))
    for k in (1, 4, 12):
        rows = rows.withColumn(f"s_{k}", F.lag("s", k).over(w))
    rows = rows.withColumn("sign_1", F.lag("sign").over(w))
    angle = F.col("pos") * (2 * math.pi / period)
    rows = rows.withColumn("wave_sin", F.sin(angle)).withColumn("wave_cos", F.cos(angle))
    n, varied = F.count("s"), F.min("s") < F.max("s")
    ac = lambda k: C.safe_corr("s", f"s_{k}", 3)
    sign_ac = C.safe_corr("sign", "sign_1", 3)
    sn, cs = C.safe_corr("s", "wave_sin", 8), C.safe_corr("s", "wave_cos", 8)
    return rows.groupBy(*keys).agg(
        C.safe_median("g").alias("gr_median"),
        C.safe_std("g").alias("gr_std"),
        C.safe_iqr("g").alias("gr_iqr"),
        C.frac_up("g", tau).alias("frac_up"),
        C.frac_sideways("g", tau).alias("frac_sideways"),
        C.frac_down("g", tau).alias("frac_down"),
        C.up_to_down("g").alias("up_to_down_ratio"),
        _supported(n, 4, ac(1)).alias("ac_lag1"),
        F.when((n >= 6) & varied, ac(4)).when(n >= 4, sign_ac).alias("ac_lag4"),
        _supported(n, 14, ac(12)).alias("ac_lag12"),
        _supported(n, 5, C.safe_corr("s", "pos", 5)).alias("trend_slope"),
        _supported(n, 26, F.sqrt(sn * sn + cs * cs)).alias("seasonal_strength"),
    )


def feature_diagnostics(features: DataFrame, columns: Sequence[str], most_missing: float = 0.95) -> DataFrame:
    """feature, nan_frac, support, dropped; nothing is dropped if everything would be."""
    n = features.agg(F.count("*").alias("n"), *[F.count(C.finite(c)).alias(c) for c in columns])
    rows = n.unpivot(["n"], list(columns), "feature", "support").withColumn("nan_frac", 1 - F.try_divide(F.col("support").cast("double"), F.col("n")))
    bad = (F.col("nan_frac") >= most_missing).cast("int")
    w = W.partitionBy("n")
    rows = rows.withColumn("dropped", (bad == 1) & (F.sum(bad).over(w) < F.count("*").over(w)))
    return rows.select("feature", "nan_frac", "support", "dropped")


def impute_medians(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells to their column's median, for which no task gathers a column."""
    stats = global_quantiles(features, {c: C.finite(c) for c in columns}, [0.5]).select(*[F.get(c, F.lit(0)).alias(f"_m_{c}") for c in columns])
    return features.join(F.broadcast(stats)).withColumns({c: F.coalesce(C.finite(c), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def clustering_features(weeks: DataFrame, keys: Sequence[str] = S.KEYS, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(imputed features without near-empty columns, raw features, diagnostics)."""
    raw = growth_features(weeks, keys, **options)
    diag = feature_diagnostics(raw, GROWTH_FEATURES)
    dropped = {r.feature for r in diag.where("dropped").collect()}  # at most 12 rows
    kept = [c for c in GROWTH_FEATURES if c not in dropped]
    return impute_medians(raw.select(*keys, *kept), kept), raw, diag


def mav_by_pair(df: DataFrame, value: str, log1p: bool = False, zeros: bool = True) -> DataFrame:
    return df.groupBy("store", "item").agg(C.mav(value, log1p, zeros).alias("mav"))


def mav_by_cluster(df: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """Per (store_cluster, item_cluster): mean, sample variance and count of the pairs' MAV."""
    pairs = mav_by_pair(df, value).join(labels, ["store", "item"])
    return pairs.groupBy("store_cluster", "item_cluster").agg(F.avg("mav").alias("mav_mean"), F.var_samp("mav").alias("mav_var"), F.count("*").alias("n_pairs"))


def variance_ratio(clusters: DataFrame) -> DataFrame:
    """Between-cluster variance (over n - 1 pairs; NULL for a single cluster), pooled within-cluster variance and their ratio
    from mav_by_cluster rows."""
    total = F.sum("n_pairs")
    mean = clusters.agg(F.try_divide(F.sum(F.col("mav_mean") * F.col("n_pairs")), F.sum("n_pairs").cast("double")).alias("_m"))
    rows = clusters.join(F.broadcast(mean))
    between = F.when(F.count("*") > 1, F.sum(F.col("n_pairs") * F.pow(F.col("mav_mean") - F.col("_m"), 2)) / F.greatest(total - 1, F.lit(1)).cast("double"))
    within = F.try_divide(F.sum((F.col("n_pairs") - 1) * F.coalesce("mav_var", F.lit(0.0))), F.nullif(total - F.count("*"), F.lit(0)).cast("double"))
    return rows.agg(between.alias("between"), within.alias("within"), F.try_divide(between, within).alias("ratio"))


def one_block_per_pair(df: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """One row per (store, item) with its only block_id; a pair with several fails the query (checked in the same aggregate)."""
    agg = {"mean": F.avg, "median": C.safe_median}[how]
    rows = df.groupBy("store", "item").agg(agg(value).alias(value), F.min("block_id").alias("block_id"), F.max("block_id").alias("_most"))
    several = F.raise_error(F.lit("a (store, item) pair has more than one block_id")).cast("boolean")
    return rows.where(F.when(F.col("block_id") < F.col("_most"), several).otherwise(True)).drop("_most")


def compare_models(rows: DataFrame, metrics: Sequence[str], agg: str = "mean", by: Sequence[str] = ("Setting", "Model")) -> DataFrame:
    """Mean or median and sample deviation of each metric per setting and model."""
    centre = {"mean": lambda c: F.avg(C.finite(c)), "median": C.safe_median}[agg]
    return rows.groupBy(*by).agg(*[x for m in metrics for x in (centre(m).alias(f"{m}_{agg}"), F.stddev_samp(C.finite(m)).alias(f"{m}_std"))])


def run_summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Per model: rows with all metrics present, and their means."""
    ok = rows.dropna(subset=list(metrics))
    return ok.groupBy("Model").agg(F.count("*").alias("n_success"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])


def cluster_count_stats(assignments: DataFrame) -> DataFrame:
    """Clusters per item: min, mean, max and IQR per factor, two decimals."""
    n = assignments.groupBy("factor_name", "item_name").agg(F.count("cluster_id").alias("n"))
    iqr = F.percentile("n", 0.75) - F.percentile("n", 0.25)
    return n.groupBy("factor_name").agg(F.min("n").alias("min"), F.round(F.avg("n"), 2).alias("mean"), F.max("n").alias("max"), F.round(iqr, 2).alias("iqr"))


def nan_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing, total and finite counts."""
    flat = df.agg(*[F.struct(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("n_nan"), F.count("*").alias("n_total"), F.count(C.finite(c)).alias("n_finite")).alias(c) for c in columns])
    return flat.unpivot([], list(columns), "column", "s").select("column", "s.*")


def histogram(df: DataFrame, value: str, bins: int = 50, log10: bool = False) -> DataFrame:
    """Equal-width counts between the least and greatest value: bin (from 1), count."""
    x = C.finite(value)
    x = F.when(x > 0, F.log10(x)) if log10 else x
    rows = df.select(x.alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1)
    return rows.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    x = C.finite(value)
    return df.groupBy(*by).agg(F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.75).alias("q3"))


#: 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom (fixed values).
T_975 = (12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041, 2.2621572, 2.2281389, 2.2009852, 2.1788128, 2.1603687, 2.1447867, 2.1314495, 2.1199053, 2.1098156, 2.1009220, 2.0930241, 2.0859634, 2.0796138, 2.0738731, 2.0686576, 2.0638986, 2.0595386, 2.0555294, 2.0518305, 2.0484071, 2.0452296, 2.0422725)


def mean_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and t-based 95 % half-width per group. The t quantile is a table up to 30 degrees of freedom and a
    Cornish-Fisher expansion beyond, both right to 1e-6."""
    z = 1.959963984540054
    v = F.count(value) - 1
    far = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v * v * v) + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / (92160 * v * v * v * v)
    t = F.when(v <= 30, F.get(F.array(*map(F.lit, T_975)), (v - 1).cast("int"))).otherwise(far)
    half = F.when(v >= 1, t * F.stddev_samp(value) / F.sqrt(F.count(value)))
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), half.alias("half_width"))


def with_mav(df: DataFrame, value: str, by: Sequence[str] = S.KEYS, log1p: bool = True, zeros: bool = True, name: str | None = None) -> DataFrame:
    """Adds the group's mean absolute value to each of its rows."""
    means = df.groupBy(*by).agg(C.mav(value, log1p, zeros).alias(name or "_".join([*by, "mav"])))
    return df.join(means, list(by), "left")


def first_present(df: DataFrame, value: str, order: str, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """The earliest non-NULL value per key."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def mode_least(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest modal value per group, -1 where there is none."""
    counts = df.groupBy(*by, value).agg(F.count(value).alias("n"))
    return counts.groupBy(*by).agg(F.coalesce(F.max_by(value, F.struct("n", -F.col(value))), F.lit(-1)).alias("mode"))


def cluster_sizes(labels: DataFrame, label: str, k: int) -> DataFrame:
    """Members of clusters 0..k-1, empty ones included."""
    spark = labels.sparkSession
    return spark.range(k).select(F.col("id").alias(label)).join(labels.groupBy(label).agg(F.count("*").alias("size")), label, "left").fillna(0, ["size"])


def one_to_one(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: whether every key has at most one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).agg((F.max("n") <= 1).alias("unique"))
