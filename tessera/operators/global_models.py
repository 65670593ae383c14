"""Global regressions over all series: ridge by moments, recursive multi-step forecasts, successive halving, staged
ensembles, out-of-fold predictions.

Least squares needs the products of the features only: one Arrow pass sums them per group in every task, Spark adds up
what the tasks send, and what is solved afterwards has the size of the features and not of the rows. Any number of
strengths, budgets and folds is solved from the same sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators import series as S
from tessera.sources.scratch import scratch_path

# ------------------------------------------------------------------ moments and ridge


def moments(rows: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, i, j, total: sums of products of the columns (1, features, target), numbered in this order, i <= j, over the rows in
    which all of them are finite. A task sends one row per group and pair of columns."""
    columns = [*features, target]
    own = rows.select(*by, *[C.finite(c).alias(f"_{k}") for k, c in enumerate(columns)]).dropna(subset=[f"_{k}" for k in range(len(columns))])
    schema = T.StructType([own.schema[c] for c in by]).add("i", T.IntegerType()).add("j", T.IntegerType()).add("total", T.DoubleType())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(len(by) + k).to_numpy() for k in range(len(columns)))])
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(by))), strict=True)) if by else [()] * batch.num_rows
            names = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            of = np.array([names[k] for k in keys])
            for key, n in names.items():
                own_rows = x[of == n]
                sums[key] = sums.get(key, 0) + own_rows.T @ own_rows
        i, j = np.triu_indices(len(columns) + 1)
        for key, total in sums.items():
            cells = [pa.array([k] * len(i), own_type) for k, own_type in zip(key, kinds, strict=True)]
            yield pa.record_batch([*cells, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=[*by, "i", "j", "total"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(own.schema[c].dataType) for c in by]
    return own.mapInArrow(run, schema).groupBy(*by, "i", "j").agg(F.sum("total").alias("total"))


def packed_moments(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, m: the totals of `moments` as one array by (i, j)."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "j", "total")))  # as many as pairs of columns
    return cells.groupBy(*by).agg(F.transform(ordered, lambda s: s["total"]).alias("m"))


def _matrix(packed, size: int):
    import numpy as np

    m = np.zeros((size, size))
    i, j = np.triu_indices(size)
    m[i, j] = m[j, i] = packed
    return m


def ridge(packed, n_features: int, reg: float):
    """(intercept, coefficients) that minimise half the mean squared error plus reg / 2 times the squared coefficients."""
    import numpy as np

    m = _matrix(packed, n_features + 2)
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    p = n_features
    w = np.linalg.lstsq(cov[:p, :p] + reg * np.eye(p), cov[:p, p], rcond=None)[0]
    return float(mean[p] - mean[:p] @ w), w


def squared_error(packed, intercept: float, w) -> float:
    """Mean squared error of a linear model over the rows that the moments sum up."""
    import numpy as np

    v = np.concatenate([[-intercept], -np.asarray(w), [1.0]])
    m = _matrix(packed, len(v))
    return float(max(0.0, v @ m @ v / m[0, 0]))


@dataclass(frozen=True)
class LinearModel:
    """A fitted linear model; `column` is its prediction, a plain expression."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        return sum((F.lit(w) * F.col(c) for c, w in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))


def fit_ridge(rows: DataFrame, target: str, features: Sequence[str], reg: float = 0.0) -> LinearModel:
    """One pass over the rows; the sums of products are solved on the driver."""
    packed = packed_moments(moments(rows, target, features), []).first()
    if packed is None or not packed.m:
        raise ValueError("no row has all features and the target")
    intercept, w = ridge(packed.m, len(features), reg)
    return LinearModel(tuple(features), tuple(map(float, w)), intercept)


# ------------------------------------------------------------------ recursive forecasts


def scaled_by_key(series: DataFrame, columns: Sequence[str], keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Every column minus its series' training median, over the training interquartile range (1 where that is 0 or unknown);
    `_middle_c` and `_spread_c` stay beside it."""
    train = F.col("split") == "train"
    at = lambda c: F.percentile(F.when(train, C.finite(c)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = series.groupBy(*keys).agg(*[at(c).alias(f"_q_{c}") for c in columns])
    spread = lambda c: F.get(f"_q_{c}", F.lit(2)) - F.get(f"_q_{c}", F.lit(0))
    stats = stats.select(*keys, *[F.coalesce(F.get(f"_q_{c}", F.lit(1)), F.lit(0.0)).alias(f"_middle_{c}") for c in columns], *[F.when(spread(c) > 0, spread(c)).otherwise(1.0).alias(f"_spread_{c}") for c in columns])
    return series.join(stats, list(keys)).withColumns({c: (C.finite(c) - F.col(f"_middle_{c}")) / F.col(f"_spread_{c}") for c in columns})


def forecast_recursive(series: DataFrame, model: LinearModel, value: str, steps: Sequence[int], keys: Sequence[str] = S.KEYS, date: str = "date", future: Sequence[str] = ()) -> DataFrame:
    """keys, date, step, y, yhat over each series' validation rows, all series at once: a fold in the JVM that starts from the
    last training values and feeds every forecast back into the lags.

    steps: the lags that the model's features `<value>_lag_<k>` name; future: columns known ahead, its features
    `<column>_lag_0` (missing ones count 0). A series with fewer training rows than the longest lag, and what follows a
    missing value in the lags, has null forecasts. Only the last training rows and the validation rows are exchanged, once, by key."""
    longest, weight = max(steps), dict(zip(model.features, model.coefficients, strict=True))
    unknown = set(weight) - {f"{value}_lag_{k}" for k in steps} - {f"{c}_lag_0" for c in future}
    if unknown:
        raise ValueError(f"the model needs features that are not known ahead: {sorted(unknown)}")
    is_train = F.col("split") == "train"
    back = F.row_number().over(W.partitionBy(*keys).orderBy((~is_train).cast("int"), F.desc(date)))
    carried = [c for c in (f"_middle_{value}", f"_spread_{value}") if c in series.columns]
    rows = series.where("split in ('train', 'val')").select(*keys, date, "split", C.finite(value).alias("_y"), *[F.coalesce(C.finite(c), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(future)], *carried).withColumn("_back", back)
    rows = rows.where(~is_train | (F.col("_back") <= longest))
    ahead = F.struct(F.col(date).alias("date"), F.col("_y").alias("y"), F.array(*[F.col(f"_x{k}") for k in range(len(future))]).cast("array<double>").alias("x"))
    one = rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(is_train, F.struct(F.col(date).alias("date"), F.struct(F.col("_y").alias("y")).alias("v"))))), lambda s: s["v"]["y"]).alias("_past"),
        F.array_sort(F.collect_list(F.when(~is_train, ahead))).alias("_ahead"),
        *[F.first(c).alias(c) for c in carried],
    )

    def step(acc: Column, row: Column) -> Column:
        guess = F.lit(model.intercept)
        for k in steps:
            if f"{value}_lag_{k}" in weight:
                guess = guess + F.lit(weight[f"{value}_lag_{k}"]) * F.get(acc["past"], F.lit(longest - k))
        for k, c in enumerate(future):
            if f"{c}_lag_0" in weight:
                guess = guess + F.lit(weight[f"{c}_lag_0"]) * F.get(row["x"], F.lit(k))
        return F.struct(F.slice(F.concat(acc["past"], F.array(guess)), 2, longest).alias("past"), F.concat(acc["out"], F.array(guess)).alias("out"))

    start = F.struct(F.col("_past").alias("past"), F.array().cast("array<double>").alias("out"))
    told = F.when(F.size("_past") == longest, F.aggregate("_ahead", start, step, lambda acc: acc["out"]))
    # the fold is bound to its series before the rows go apart: beside the explosion it would run again for every row
    done = one.select(*keys, *carried, "_ahead", told.alias("_out"))
    out = done.select(*keys, *carried, "_out", F.posexplode("_ahead").alias("_i", "_a"))
    back_to = lambda c: c * F.col(f"_spread_{value}") + F.col(f"_middle_{value}") if carried else c
    return out.select(*keys, F.col("_a.date").alias(date), (F.col("_i") + 1).alias("step"), back_to(F.col("_a.y")).alias("y"), back_to(F.get("_out", F.col("_i"))).alias("yhat"))


# ------------------------------------------------------------------ successive halving


def successive_halving(trials: DataFrame, score: Callable[[DataFrame, int], DataFrame], rungs: int, eta: int = 3) -> DataFrame:
    """trial, rung, score, kept of every trial on every rung that it reached, as one plan.

    trials: a column trial and whatever score reads; score(survivors, rung) adds `score` (less is better; null is worst). Of a
    rung's trials the best 1 / eta, at least one, go to the next; `kept` tells them, on the last rung the best of all."""
    left, n, out = trials, trials.count(), None
    for rung in range(rungs):
        last = rung == rungs - 1
        stay = 1 if last else max(1, -(-n // eta))
        place = F.row_number().over(W.orderBy(F.asc_nulls_last("score"), "trial"))  # one row a trial
        ranked = score(left, rung).withColumn("rung", F.lit(rung)).withColumn("kept", place <= stay)
        rows = ranked.select("trial", "rung", "score", "kept")
        out = rows if out is None else out.unionByName(rows)
        left, n = ranked.where("kept").select(*trials.columns), stay
    return out


def halving_ridge(frame: DataFrame, target: str, features: Sequence[str], trials: DataFrame, bucket: Column, rungs: int = 3, eta: int = 3) -> DataFrame:
    """Successive halving of ridge strengths: trials (trial, reg), score the validation RMSE.

    bucket: 0 .. eta ** (rungs - 1) - 1, alike for all rows of a key; rung r sees buckets below eta ** r. The frame is read once, for
    the moments of every bucket; trials are then fitted side by side from the sums of their rung."""
    spark, p = frame.sparkSession, len(features)
    path = scratch_path(spark, "moments")
    moments(frame.where("split in ('train', 'val')").withColumn("_bucket", bucket.cast("int")), target, features, ["_bucket", "split"]).write.parquet(path)
    cells = spark.read.parquet(path)

    def fit(batches: Iterator) -> Iterator:
        for pdf in batches:
            found = []
            for reg, train, val in zip(pdf["reg"], pdf["train"], pdf["val"], strict=True):
                found.append(squared_error(val, *ridge(train, p, reg)) ** 0.5 if train is not None and val is not None else None)
            yield pdf.drop(columns=["train", "val"]).assign(score=found)

    def score(left: DataFrame, rung: int) -> DataFrame:
        seen = cells.where(F.col("_bucket") < eta**rung).groupBy("split", "i", "j").agg(F.sum("total").alias("total"))
        pair = packed_moments(seen, ["split"]).agg(*[F.max(F.when(F.col("split") == s, F.col("m"))).alias(s) for s in ("train", "val")])
        schema = T.StructType([*left.schema.fields, T.StructField("score", T.DoubleType())])
        # one row of sums, whose size is that of the features
        return left.join(F.broadcast(pair)).mapInPandas(fit, schema)

    return successive_halving(trials, score, rungs, eta)


# ------------------------------------------------------------------ staged ensembles


@dataclass(frozen=True)
class Stage:
    """A fitted stage with the assembly of its features; adds `_stage`."""

    assemble: object
    model: object

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.assemble.transform(rows)).drop("_features")


@dataclass
class Staged:
    """A staged ensemble: its members up to the best stage, the curve of all stages that were fitted."""

    members: list
    rate: float
    average: bool
    start: float
    curve: list[tuple[int, float]] = field(default_factory=list)

    @property
    def best(self) -> int:
        return len(self.members)

    def transform(self, rows: DataFrame, name: str = "yhat") -> DataFrame:
        names, rows = rows.columns, rows.withColumn("_sum", F.lit(0.0))
        for member in self.members:
            rows = member.transform(rows).withColumn("_sum", F.col("_sum") + F.col("_stage")).drop("_stage")
        done = F.col("_sum")
        return rows.withColumn(name, done / max(1, len(self.members)) if self.average else self.start + self.rate * done).select(*names, name)


def fit_staged(frame: DataFrame, target: str, features: Sequence[str], model: str = "boosting", stages: int = 20, patience: int = 2, min_delta: float = 1e-4, rate: float = 0.3, trees: int = 5, depth: int = 4, seed: int = 7) -> Staged:
    """Grow an ensemble stage by stage with the validation curve kept; stop once `patience` stages in a row have not lowered the
    validation RMSE by more than `min_delta`, and go back to the best stage.

    boosting: each stage is a tree fitted to what the stages before leave of the training rows. forest: each stage adds `trees`
    trees fitted apart, the ensemble being their mean. The running sum of every row is written after each stage, so a stage
    costs one tree's fit and one pass whatever its number, and no plan grows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    if model not in ("boosting", "forest"):
        raise ValueError(f"unknown staged model: {model}")
    spark, average = frame.sparkSession, model == "forest"
    rows = frame.where("split in ('train', 'val')").select("split", C.finite(target).alias("_y"), *[C.finite(c).alias(c) for c in features]).dropna()
    data = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows).select("split", "_y", "_features")
    start = 0.0 if average else float(data.where("split = 'train'").agg(F.avg("_y")).first()[0] or 0.0)

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stage")
        df.write.parquet(path)
        return spark.read.parquet(path)

    data = kept(data.withColumn("_sum", F.lit(0.0)))
    out = Staged([], rate, average, start)
    best, bad, members = float("inf"), 0, []
    for k in range(1, stages + 1):
        fitted = lambda c: c / max(1, k - 1) if average else F.lit(start) + rate * c  # noqa: E731, B023
        aim = data.where("split = 'train'").withColumn("_aim", F.col("_y") if average else F.col("_y") - fitted(F.col("_sum")))
        options = {"featuresCol": "_features", "labelCol": "_aim", "predictionCol": "_stage", "maxDepth": depth, "seed": seed + k}
        estimator = RandomForestRegressor(numTrees=trees, **options) if average else DecisionTreeRegressor(**options)
        member = estimator.fit(aim)
        members.append(member)
        data = kept(member.transform(data).select("split", "_y", "_features", (F.col("_sum") + F.col("_stage")).alias("_sum")))
        guess = F.col("_sum") / k if average else F.lit(start) + rate * F.col("_sum")
        error = data.where("split = 'val'").agg(F.sqrt(F.avg(F.pow(F.col("_y") - guess, 2)))).first()[0]
        if error is None:
            raise ValueError("no validation rows")
        out.curve.append((k, float(error)))
        if error < best - min_delta:
            best, bad, out.members = error, 0, list(members)
        else:
            bad += 1
        if bad >= patience:
            break
    assemble = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    out.members = [Stage(assemble, m) for m in out.members]
    return out


def curve_rows(spark, staged: Staged) -> DataFrame:
    """stage, rmse, kept of every stage that was fitted."""
    return spark.createDataFrame([(k, e, k <= staged.best) for k, e in staged.curve], "stage long, rmse double, kept boolean")


# ------------------------------------------------------------------ out-of-fold predictions


def out_of_fold_ridge(frame: DataFrame, target: str, features: Sequence[str], fold: Column, folds: int, reg: float = 0.0, name: str = "yhat") -> DataFrame:
    """Rows of the frame with the prediction of the ridge fitted on the other folds' training rows (validation and test rows too
    are predicted by the model that has not seen their fold). fold: 0 .. folds - 1, alike for all rows of a key.

    All folds' models come from one pass: a fold's moments are the whole's without its own."""
    rows = frame.withColumn("_fold", fold.cast("int"))
    cells = moments(rows.where("split = 'train'"), target, features, ["_fold"]).collect()  # folds x pairs of columns
    import numpy as np

    pairs = sorted({(r.i, r.j) for r in cells})
    by = np.zeros((folds, len(pairs)))
    at = {pair: k for k, pair in enumerate(pairs)}
    for r in cells:
        by[r._fold, at[r.i, r.j]] += r.total
    guess = F.lit(None).cast("double")
    for k in range(folds):
        rest = by.sum(axis=0) - by[k]
        if rest.size and rest[0] > 0:
            intercept, w = ridge(rest, len(features), reg)
            guess = F.when(F.col("_fold") == k, LinearModel(tuple(features), tuple(map(float, w)), intercept).column()).otherwise(guess)
    return rows.withColumn(name, guess).drop("_fold")
