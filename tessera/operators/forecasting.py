"""Supervised data sets, per-series classical forecasts and global lag regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import series as S
from tessera.operators.quantiles import global_quantiles
from tessera.sources.scratch import stored

#: model -> where it is fitted (one series, or all at once) and which covariates it takes there
MODELS: dict[str, dict[str, bool]] = {
    "naive": {"local": True, "global": False, "past": False, "future": False, "built": True},
    "exponential_smoothing": {"local": True, "global": False, "past": False, "future": False, "built": True},
    "theta": {"local": True, "global": False, "past": False, "future": False, "built": True},
    "auto_arima": {"local": True, "global": False, "past": False, "future": True, "built": True},
    "kalman": {"local": True, "global": False, "past": False, "future": True, "built": True},
    "linear_regression": {"local": True, "global": True, "past": True, "future": True, "built": True},
    "huber": {"local": False, "global": True, "past": True, "future": True, "built": True},
    "random_forest": {"local": False, "global": True, "past": True, "future": True, "built": True},
    "gradient_boosting": {"local": False, "global": True, "past": True, "future": True, "built": True},
    **{m: {"local": True, "global": True, "past": True, "future": m in ("tft", "tsmixer", "tide"), "built": False} for m in ("nbeats", "tft", "tsmixer", "block_rnn", "tcn", "tide")},
}


def require(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    if not MODELS[model]["built"]:
        raise NotImplementedError(f"{model} needs a deep-learning library")
    return model


def dataset(df: DataFrame, features: Sequence[str], target: str, val_days: int, test_days: int, weight: str | None = None, date: str = "date") -> DataFrame:
    """split, features imputed and min-max scaled on training rows, target clipped and robust-scaled on them, weight 1 if missing."""
    rows = S.split_by_date(df.where(C.is_finite(target)), val_days, test_days, date)
    train = F.col("split") == "train"
    medians = global_quantiles(rows.where(train), {c: C.finite(c) for c in features}, [0.5])
    medians = medians.select(*[F.get(f"`{c}`", F.lit(0)).alias(f"_m_{c}") for c in features])
    rows = rows.join(F.broadcast(medians)).withColumns({c: F.coalesce(C.finite(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in features}).drop(*[f"_m_{c}" for c in features])
    rows = M.minmax_apply(rows, M.minmax_fit(rows, features, train), features)
    rows = M.robust_scale_all(M.clip_target(rows, target, train), target, train)
    return rows.withColumn("weight", F.coalesce(C.finite(weight), F.lit(1.0)) if weight else F.lit(1.0))


def eligible(df: DataFrame, value: str, least_rows: int = 30, least_points: int = 15, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Series with enough rows, enough present values and a positive deviation."""
    x = C.finite(value)
    stats = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(x).alias("n_points"), F.stddev_samp(x).alias("std"))
    return stats.where((F.col("n_rows") >= least_rows) & (F.col("n_points") >= least_points) & (F.col("std") > 0))


def prepared(df: DataFrame, value: str, share: float = 0.8, least_rows: int = 30, least_points: int = 15, keys: Sequence[str] = S.KEYS, date: str = "date") -> DataFrame:
    """All eligible series at once: one row per date (the first), gaps 0, split by fraction."""
    own = df.join(eligible(df, value, least_rows, least_points, keys).select(*keys), list(keys), "left_semi")
    once = own.select(*keys, date, C.finite(value).alias(value)).groupBy(*keys, date).agg(F.min(value).alias(value))
    return S.split_by_fraction(S.fill_days(once, value, keys, date), share, keys, date)


def membership_medians(medians: DataFrame, assignments: DataFrame, factor: str, key: str, pairs: DataFrame, most: int, value: str = "median") -> DataFrame:
    """key, date and `<key>_median_1` .. `<key>_median_<most>`: the medians, by date, of the clusters that a store or item is in, in
    the order of their ids.

    medians: cluster_id, date, value, written by cluster_id. Only the partitions of clusters in which an eligible key is are
    read: the keys of `pairs` meet the assignments first, and these prune the scan while it starts."""
    keys = pairs.select(key).distinct()
    own = assignments.where(F.col("factor_name") == factor).select(F.col("item_name").cast("long").alias(key), "cluster_id").where("cluster_id is not null").distinct()
    own = own.join(F.broadcast(keys), key, "left_semi") if _small(keys) else own.join(keys, key, "left_semi")
    place = F.row_number().over(W.partitionBy(key).orderBy("cluster_id"))
    ranked = own.withColumn("_k", place).where(F.col("_k") <= most)
    met = medians.join(ranked, "cluster_id")
    return met.groupBy(key, "date").agg(*[F.max(F.when(F.col("_k") == k, C.finite(value))).alias(f"{key}_median_{k}") for k in range(1, most + 1)])


def _small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table has at most so many rows (one count that stops there)."""
    return df.limit(rows + 1).count() <= rows


def with_covariates(df: DataFrame, value: str, medians: dict[str, DataFrame], assignments: DataFrame, most: int = 2, past: Sequence[str] = (), share: float = 0.8, least_rows: int = 30, least_points: int = 15, keys: Sequence[str] = S.KEYS, date: str = "date") -> tuple[DataFrame, dict[str, list[str]]]:
    """The prepared series of all eligible pairs at once with their covariates, and these by group.

    Groups: `past` columns (known up to the day before), `future` ones (calendar and cluster medians, known for the day). A
    pair is eligible by its rows (`eligible`) and by its training part: `least_points` present values with a positive
    deviation. Missing or infinite covariates are 0; the target keeps its gaps filled with 0 as `prepared` does.
    medians: "store" and "item" -> table of cluster medians (see membership_medians)."""
    first = df.join(eligible(df, value, least_rows, least_points, keys).select(*keys), list(keys), "left_semi")
    once = first.groupBy(*keys, date).agg(F.min(C.finite(value)).alias(value), *[F.max(C.finite(c)).alias(c) for c in past])
    filled = S.fill_days(once.select(*keys, date, value), value, keys, date)
    series = S.split_by_fraction(filled.join(once.drop(value), [*keys, date], "left") if past else filled, share, keys, date)
    train = F.when(F.col("split") == "train", C.finite(value))
    able = series.groupBy(*keys).agg(F.count(train).alias("n"), F.stddev_samp(train).alias("std")).where((F.col("n") >= least_points) & (F.col("std") > 0)).select(*keys)
    series = series.join(able, list(keys), "left_semi")
    calendar = ["dayofweek", "monthofyear", "paycycle_ratio", "season_ratio"]
    out = series.withColumns({"dayofweek": C.day_of_week(date), "monthofyear": F.month(date), "paycycle_ratio": C.pay_cycle(date), "season_ratio": C.season_phase(date)})
    named: list[str] = []
    for key, factor in (("store", "Store"), ("item", "SKU")):
        if key in medians:
            own = membership_medians(medians[key], assignments, factor, key, able, most)
            out = out.join(own.withColumnRenamed("date", date), [key, date], "left")
            named += [f"{key}_median_{k}" for k in range(1, most + 1)]
    groups = {"past": list(past), "future": [*calendar, *named]}
    covariates = [c for names in groups.values() for c in names]
    return out.withColumns({c: F.coalesce(C.finite(c), F.lit(0.0)) for c in covariates}), groups


#: Lags of the wider and the plain design: of the target and of past covariates, and of future ones (the day itself and before).
DESIGNS = {False: {"steps": 30, "past_steps": 30, "future_steps": 15}, True: {"steps": 60, "past_steps": 60, "future_steps": 15}}


def design_lags(wide: bool = False, past: bool = False, future: bool = False) -> dict[str, tuple[int, ...]]:
    """steps, past_steps, future_steps of `lag_frame` for a design: 30 or 60 lags of target and past covariates, 15 of future ones
    (-15 to -1); groups that are not used have none."""
    d = DESIGNS[wide]
    return {"steps": tuple(range(1, d["steps"] + 1)), "past_steps": tuple(range(1, d["past_steps"] + 1)) if past else (), "future_steps": tuple(range(1, d["future_steps"] + 1)) if future else ()}


# ------------------------------------------------------------------ local models (numpy in grouped Arrow batches)


def _ses(y, alpha):
    level = y[0]
    for v in y[1:]:
        level += alpha * (v - level)
    return level


def _ets(y, horizon: int, period: int):
    """Level, trend (damped or not) and, where there are two periods, an additive season; all parameters of a grid run
    together, the form is chosen by AIC of the one-step errors."""
    import numpy as np

    a, b, g, damp = (x.ravel() for x in np.meshgrid([0.1, 0.2, 0.4, 0.6, 0.8], [0.0, 0.05, 0.2], [0.0, 0.1, 0.3], [0.9, 1.0], indexing="ij"))
    best = (np.inf, None)
    for m in (1, period) if 1 < period <= len(y) // 2 else (1,):
        use = g == 0 if m == 1 else np.ones(len(g), bool)
        aa, bb, gg, phi = a[use], b[use], g[use], damp[use]
        first = y[:m].mean()
        season = np.tile(y[:m] - first if m > 1 else np.zeros(1), (len(aa), 1))
        level, trend, sse = np.full(len(aa), first if m > 1 else y[0]), np.zeros(len(aa)), np.zeros(len(aa))
        for t in range(m if m > 1 else 1, len(y)):
            base = level + phi * trend
            e = y[t] - base - season[:, t % m]
            sse += e * e
            level, trend = base + aa * e, phi * trend + aa * bb * e
            season[:, t % m] += gg * e
        n = max(1, len(y) - m)
        k = int(sse.argmin())
        aic = n * np.log(sse[k] / n + 1e-12) + 2 * (3 + (m if m > 1 else 0))
        if aic < best[0]:
            steps = np.arange(1, horizon + 1)
            ahead = level[k] + trend[k] * np.cumsum(phi[k] ** steps) + season[k, (len(y) + steps - 1) % m]
            best = (aic, ahead)
    return best[1]


def _season(y, period: int):
    """Additive seasonal means by position around a line, zeros where the autocorrelation at the period is not significant (90 %)."""
    import numpy as np

    out = np.zeros(max(1, period))
    if 1 < period <= len(y) // 2:
        t = np.arange(len(y))
        d = y - np.polyval(np.polyfit(t, y, 1), t)
        r = (d[period:] * d[:-period]).sum() / max(1e-12, (d * d).sum())
        if r > 1.645 / np.sqrt(len(y)):
            out = np.array([d[i::period].mean() for i in range(period)])
            out -= out.mean()
    return out


def _arima(y, horizon: int, period: int):
    """ARIMA(p, d, q) with a seasonal lag: d by the smaller deviation, the rest by AIC of two-stage least squares (residuals of
    a long autoregression stand for the innovations)."""
    import numpy as np

    d = int(len(y) > 3 and np.diff(y).std() < y.std())
    w = np.diff(y) if d else y
    bound = 10 * (np.abs(y).max() + 1)
    lagged = lambda x, ks, start: [x[start - k : len(x) - k] for k in ks]
    long = max(0, min(10, len(w) // 4))
    x = np.column_stack([np.ones(len(w) - long), *lagged(w, range(1, long + 1), long)])
    coef, *_ = np.linalg.lstsq(x, w[long:], rcond=None)
    e = np.concatenate([np.zeros(long), w[long:] - x @ coef])
    best = (np.inf, None)
    seasons = ((), (period,)) if 1 < period <= len(w) // 3 else ((),)
    start = min(len(w) - 1, max(long, 3, *(s[0] for s in seasons if s), 0))
    for p in range(0, 4):
        for q in range(0, 3):
            for extra in seasons:
                ar = sorted({*range(1, p + 1), *extra})
                if max([p, q, *extra, 0]) > start:
                    continue
                x = np.column_stack([np.ones(len(w) - start), *lagged(w, ar, start), *lagged(e, range(1, q + 1), start)])
                n = len(x)
                if n <= x.shape[1] + 1:
                    continue
                coef, *_ = np.linalg.lstsq(x, w[start:], rcond=None)
                rss = float(((w[start:] - x @ coef) ** 2).sum())
                aic = n * np.log(rss / n + 1e-12) + 2 * x.shape[1]
                if aic < best[0]:
                    best = (aic, (coef, ar, q))
    if best[1] is None:
        return np.full(horizon, y[-1] if d else y.mean())
    coef, ar, q = best[1]
    past, shocks = list(w), list(e)
    for _ in range(horizon):
        step = coef[0] + sum(c * past[-k] for c, k in zip(coef[1:], ar)) + sum(c * shocks[-k] for c, k in zip(coef[1 + len(ar) :], range(1, q + 1)))
        past.append(float(np.clip(step, -bound, bound)))
        shocks.append(0.0)
    ahead = np.array(past[-horizon:])
    return np.clip(y[-1] + np.cumsum(ahead), -bound, bound) if d else ahead


def _lag_regression(y, horizon: int, lags: int, ridge: float = 1e-3):
    """Least squares on the last values, applied to its own forecasts."""
    import numpy as np

    lags = max(1, min(lags, len(y) // 3))
    x = np.column_stack([np.ones(len(y) - lags), *[y[lags - k : len(y) - k] for k in range(1, lags + 1)]])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0
    coef = np.linalg.lstsq(x.T @ x + penalty * len(x), x.T @ y[lags:], rcond=None)[0]
    past, bound = list(y), 10 * (np.abs(y).max() + 1)
    for _ in range(horizon):
        past.append(float(np.clip(coef[0] + np.dot(coef[1:], past[: -lags - 1 : -1]), -bound, bound)))
    return np.array(past[-horizon:])


def local_forecast(y, horizon: int, model: str, period: int = 7, x=None, x_ahead=None):
    """Point forecasts of one series. x, x_ahead: future covariates of the known and the coming dates, for the models that
    take them (their linear part is fitted first, the model gets what it leaves)."""
    import numpy as np

    if x is not None and MODELS[model]["future"] and x.shape[1]:
        design = np.column_stack([np.ones(len(y)), x])
        coef = np.linalg.lstsq(design.T @ design + 1e-6 * len(y) * np.eye(design.shape[1]), design.T @ y, rcond=None)[0]
        rest = local_forecast(y - x @ coef[1:], horizon, model, period)
        return rest + x_ahead @ coef[1:]
    if model == "naive":
        return np.full(horizon, y[-1])
    if model == "exponential_smoothing":
        return _ets(y, horizon, period)
    if model == "theta":
        season = _season(y, period)
        own = y - season[np.arange(len(y)) % len(season)]
        t = np.arange(len(y))
        slope, intercept = np.polyfit(t, own, 1) if len(y) > 1 else (0.0, y[0])
        line = 2 * own - (intercept + slope * t)
        errors = []
        for a in (0.1, 0.3, 0.5, 0.7, 0.9):
            level, sse = line[0], 0.0
            for v in line[1:]:
                sse += (v - level) ** 2
                level += a * (v - level)
            errors.append((sse, a))
        level = _ses(line, min(errors)[1])
        ahead = len(y) + np.arange(horizon)
        return (level + intercept + slope * ahead) / 2 + season[ahead % len(season)]
    if model == "auto_arima":
        return _arima(y, horizon, period)
    if model == "linear_regression":
        return _lag_regression(y, horizon, 2 * max(1, period))
    if model == "kalman":  # local level, signal-to-noise by likelihood grid
        best = (np.inf, y[-1])
        for q in (0.001, 0.01, 0.1, 1.0):
            m, p, nll = y[0], 1.0, 0.0
            for v in y[1:]:
                p += q
                s = p + 1
                nll += np.log(s) + (v - m) ** 2 / s
                k = p / s
                m, p = m + k * (v - m), (1 - k) * p
            best = min(best, (nll, m), key=lambda b: b[0])
        return np.full(horizon, best[1])
    raise ValueError(model)


def _robust(train, *others):
    """Columns scaled by median and IQR of the training rows (IQR 0 counts as 1): (scaled train, scaled others, median, IQR)."""
    import numpy as np

    middle = np.median(train, axis=0)
    spread = np.subtract(*np.percentile(train, [75, 25], axis=0))
    spread = np.where(spread > 0, spread, 1.0)
    return (train - middle) / spread, [(o - middle) / spread for o in others], middle, spread


def forecast_local(series: DataFrame, value: str, models: Sequence[str], keys: Sequence[str] = S.KEYS, date: str = "date", period: int = 7, future: Sequence[str] = (), scaled: bool = False) -> DataFrame:
    """Model, keys, date, y, yhat over each series' validation rows. One group is one series.

    future: columns known ahead. scaled: every series and covariate is scaled by its own training median and IQR, forecasts
    are scaled back."""
    for m in models:
        if not MODELS[require(m)]["local"]:
            raise ValueError(f"{m} is fitted over all series: see fit_global")
    schema = T.StructType([T.StructField("Model", T.StringType()), *[series.schema[k] for k in keys], series.schema[date], T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType())])
    future = list(future)

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(date)
        train, val = pdf[pdf["split"] == "train"], pdf[pdf["split"] == "val"]
        out = []
        if len(train) and len(val):
            y, middle, spread = train[value].to_numpy(float), 0.0, 1.0
            x, ahead = (np.nan_to_num(p[future].to_numpy(float)) for p in (train, val))
            if scaled:
                y, _, middle, spread = _robust(y)
                x, (ahead,), _, _ = _robust(x, ahead)
            for m in models:
                yhat = local_forecast(y, len(val), m, period, x if future else None, ahead if future else None)
                out.append(val[[*keys, date]].assign(Model=m, y=val[value].astype(float), yhat=yhat * spread + middle))
        names = [f.name for f in schema.fields]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return series.groupBy(*keys).applyInPandas(run, schema)


def evaluate(forecasts: DataFrame, series: DataFrame, value: str, keys: Sequence[str] = S.KEYS, date: str = "date") -> DataFrame:
    """The forecast bundle per model and series."""
    models = forecasts.select("Model").distinct()
    train = models.crossJoin(series.where("split = 'train'").select(*keys, date, F.col(value).alias("y")))
    return E.forecast_bundle(forecasts.select("Model", *keys, date, "y"), forecasts.select("Model", *keys, date, "yhat"), train, ["Model", *keys], date=date)


# ------------------------------------------------------------------ global lag regression (Spark ML)


def lag_frame(series: DataFrame, value: str, steps: Sequence[int] = (1, 2, 7, 14), keys: Sequence[str] = S.KEYS, date: str = "date", past: Sequence[str] = (), past_steps: Sequence[int] = (1,), future: Sequence[str] = (), future_steps: Sequence[int] = (0,)) -> DataFrame:
    """Lags of the value and of covariates: `past` ones are known up to the day before (steps >= 1), `future` ones up to the
    day itself (steps >= 0, never ahead). All lags share one window; rows without every lag of the value go, covariates
    that are missing count as 0."""
    if any(k < 1 for k in [*steps, *past_steps]) or any(k < 0 for k in future_steps):
        raise ValueError("lags must not look ahead")
    w = W.partitionBy(*keys).orderBy(date)
    names = lag_names(value, steps, past, past_steps, future, future_steps)
    own = {f"{value}_lag_{k}": F.lag(value, k).over(w) for k in steps}
    more = {f"{c}_lag_{k}": F.coalesce(F.lag(F.col(c).cast("double"), k).over(w) if k else F.col(c).cast("double"), F.lit(0.0)) for cs, ks in ((past, past_steps), (future, future_steps)) for c in cs for k in ks}
    out = series.withColumns({n: {**own, **more}[n] for n in names})
    return out.dropna(subset=list(own))


def lag_names(value: str, steps: Sequence[int] = (1, 2, 7, 14), past: Sequence[str] = (), past_steps: Sequence[int] = (1,), future: Sequence[str] = (), future_steps: Sequence[int] = (0,)) -> list[str]:
    """The feature columns of lag_frame."""
    return [f"{value}_lag_{k}" for k in steps] + [f"{c}_lag_{k}" for cs, ks in ((past, past_steps), (future, future_steps)) for c in cs for k in ks]


def fit_global(frame: DataFrame, value: str, features: Sequence[str], model: str = "linear_regression", seed: int = 7, early_stop: float | None = None):
    """A Spark ML pipeline fitted on the training rows.

    early_stop: boosting stops once the error of the validation rows falls by less than this share."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if not MODELS[require(model)]["global"]:
        raise ValueError(f"{model} is fitted per series: see forecast_local")
    stop = {} if early_stop is None else {"validationIndicatorCol": "_val", "validationTol": early_stop}
    estimator = {
        "linear_regression": lambda: LinearRegression(labelCol=value, predictionCol="yhat", regParam=1e-3),
        "huber": lambda: LinearRegression(labelCol=value, predictionCol="yhat", loss="huber"),
        "random_forest": lambda: RandomForestRegressor(labelCol=value, predictionCol="yhat", numTrees=20, seed=seed),
        "gradient_boosting": lambda: GBTRegressor(labelCol=value, predictionCol="yhat", maxIter=20, seed=seed, **stop),
    }[model]()
    rows = frame.where("split = 'train'") if model != "gradient_boosting" or early_stop is None else frame.where("split in ('train', 'val')").withColumn("_val", F.col("split") == "val")
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator]).fit(rows)


def benchmark(frame: DataFrame, value: str, features: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Regression metrics per model and split (Dataset). The frame is written once: every fit and every prediction reads it."""
    frame, out = stored(frame.select("split", value, *features), "frame"), None
    for m in models:
        pred = fit_global(frame, value, features, m).transform(frame).select(F.lit(m).alias("Model"), F.col("split").alias("Dataset"), F.col(value).alias("y"), "yhat")
        out = pred if out is None else out.unionByName(pred)
    return E.regression_bundle(out, ["Model", "Dataset"])


def tune(frame: DataFrame, value: str, features: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Ridge strength against validation RMSE."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    spark = frame.sparkSession
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(frame).cache()
    rows = []
    for g in grid:
        model = LinearRegression(labelCol=value, predictionCol="yhat", regParam=float(g)).fit(data.where("split = 'train'"))
        rows.append((float(g), model.transform(data.where("split = 'val'")).agg(E.rmse(value, "yhat")).first()[0]))
    data.unpersist()
    return spark.createDataFrame(rows, "reg double, rmse double")


def wide_to_dates(wide: DataFrame, horizon: int, keys: Sequence[str] = S.KEYS, start: str = "start_date", prefix: str = "y_sales_day_") -> DataFrame:
    """Predicted wide windows to rows: date = start + horizon + i."""
    values = F.array(*[F.col(f"{prefix}{i}") for i in range(1, horizon + 1)])
    return wide.select(*keys, start, F.posexplode(values).alias("i", "unit_sales")).select(*keys, F.date_add(start, F.col("i") + horizon).alias("date"), "unit_sales")


def roll_forward(wide: DataFrame, days: int, keys: Sequence[str] = S.KEYS, start: str = "start_date") -> DataFrame:
    """The next window's input: y_<column> becomes <column>, the start moves on."""
    targets = [c for c in wide.columns if c.startswith("y_")]
    return wide.select(*keys, F.date_add(start, days).alias(start), *[F.col(c).alias(c[2:]) for c in targets])


def batch_predict(df: DataFrame, coefficients: DataFrame, features: Sequence[str]) -> DataFrame:
    """Linear models per (store_cluster, item_cluster) applied to all rows: expm1 of the prediction, at least 1e-6.

    coefficients: store_cluster, item_cluster, intercept, w (array)."""
    dot = sum((F.get("w", F.lit(i)) * F.col(c) for i, c in enumerate(features)), F.col("intercept"))
    return df.join(coefficients, ["store_cluster", "item_cluster"]).withColumn("yhat", F.expm1(F.greatest(dot, F.lit(1e-6)))).drop("w", "intercept")


def suggest_learning_rate(curve: DataFrame, skip_start: int = 10, skip_end: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """curve: by, step, lr, loss. The lr with the steepest fall of the loss by central difference, ends skipped, per curve."""
    w = W.partitionBy(*by).orderBy("step")  # a curve has some hundred points
    n = F.count("*").over(W.partitionBy(*by))
    rows = curve.withColumn("_g", (F.lead("loss").over(w) - F.lag("loss").over(w)) / 2).withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
    rows = rows.where((F.col("_i") > skip_start) & (F.col("_i") <= F.col("_n") - skip_end) & F.col("_g").isNotNull())
    return rows.groupBy(*by).agg(F.min_by("lr", F.struct("_g", "step")).alias("lr"))
