"""Global models, calibration, scalers, feature groups, samples, table functions and keyed state."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.operators import blocks as B
from tessera.operators import forecasting as L
from tessera.operators import global_models as G
from tessera.operators import isotonic as I
from tessera.operators import panel as P
from tessera.operators.scalers import PanelScaler, PanelScalerModel
from tessera.plans import pipelines
from tessera.streaming import streams as T

DAY = dt.date(2020, 1, 1)


def long_series(spark, values, split_at):
    """(store, item, date, y, promo, split) of one list of values per store."""
    rows = [(s, 1, DAY + dt.timedelta(days=i), None if v is None else float(v), float((i + s) % 3 == 0), "train" if i < split_at else "val") for s, x in enumerate(values) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "store long, item long, date date, y double, promo double, split string")


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(2, 3, (300, 3)), rng.normal(0, 1, 300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0)], "a double, b double, c double, y double").repartition(5)
    model = G.fit_ridge(df, "y", ["a", "b", "c"], reg=0.7)
    z = x - x.mean(axis=0)
    w = np.linalg.solve(z.T @ z / 300 + 0.7 * np.eye(3), z.T @ (y - y.mean()) / 300)
    assert model.coefficients == pytest.approx(w.tolist()) and model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ w)
    with pytest.raises(ValueError):
        G.fit_ridge(df.where("a > 1e9"), "y", ["a", "b", "c"])


def test_recursive_forecasts_feed_back(spark):
    values = [[1, 2, 3, 5, 8, 13, 21, 1, 1, 1], [2, 1, 4, 3, 6, 5, 8, 0, 0, 0], [7, 7], [1, 2, 3, None, 5, 6, None, 1, 1, 1]]
    df = long_series(spark, values, 7)
    model = G.LinearModel(("y_lag_1", "y_lag_3", "promo_lag_0"), (0.5, 0.25, 2.0), 1.0)
    got = {(r.store, r.step): (r.y, r.yhat) for r in G.forecast_recursive(df, model, "y", (1, 3), future=["promo"]).collect()}
    for s in (0, 1):
        past = [float(v) for v in values[s][:7]]
        for k in range(3):
            past.append(1 + 0.5 * past[-1] + 0.25 * past[-3] + 2 * ((7 + k + s) % 3 == 0))
            assert got[s, k + 1] == (values[s][7 + k], pytest.approx(past[-1]))
    assert {k for k in got if k[0] == 2} == set() and all(got[3, k][1] is None for k in (1, 2, 3))
    with pytest.raises(ValueError):
        G.forecast_recursive(df, model, "y", (1, 3))


def test_a_series_is_forecast_once_and_not_for_each_of_its_rows(spark):
    model = G.LinearModel(("y_lag_1",), (0.5,), 1.0)
    told = G.forecast_recursive(long_series(spark, [[1, 2, 3, 4, 5]], 3), model, "y", (1,))
    above, _, below = told._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert "aggregate(" in below and "aggregate(" not in above


def test_scaled_forecasts_return_to_their_units(spark):
    values = [list(np.arange(40) * 3.0 + 5), list(np.arange(40) * 100.0)]
    df = G.scaled_by_key(long_series(spark, values, 30), ["y"])
    frame = L.lag_frame(df, "y", (1, 2)).where("split = 'train'")
    told = G.forecast_recursive(df, G.fit_ridge(frame, "y", L.lag_names("y", (1, 2)), reg=1e-9), "y", (1, 2)).collect()
    assert len(told) == 20 and all(r.yhat == pytest.approx(r.y, rel=1e-3) for r in told)


def test_halving_keeps_the_best_of_every_rung(spark):
    trials = spark.createDataFrame([(i, float(i)) for i in range(8)], "trial long, reg double")
    seen = []

    def score(left, rung):
        seen.append(rung)
        return left.withColumn("score", F.when(F.col("trial") == 6, F.lit(None)).otherwise(F.abs(F.col("trial") - 3 - rung)))

    rows = {(r.rung, r.trial): (r.score, r.kept) for r in G.successive_halving(trials, score, 3, 2).collect()}
    assert seen == [0, 1, 2] and len(rows) == 8 + 4 + 2
    assert {t for (g, t), (_, k) in rows.items() if g == 0 and k} == {2, 3, 4, 1}
    assert {t for (g, t), (_, k) in rows.items() if g == 1 and k} == {4, 3} and rows[2, 4][1] and not rows[2, 3][1]
    assert rows[0, 6] == (None, False)


@pytest.mark.parametrize("model", ["boosting", "forest"])
def test_staged_fits_stop_and_go_back_to_the_best_stage(spark, model):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (200, 2))
    y = np.where(x[:, 0] > 0.5, 4.0, 0.0) + rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([(float(a), float(b), float(v), "train" if i % 3 else "val") for i, ((a, b), v) in enumerate(zip(x, y))], "a double, b double, y double, split string")
    staged = G.fit_staged(df, "y", ["a", "b"], model, stages=5, patience=1, rate=0.8, trees=2, depth=2)
    errors = [e for _, e in staged.curve]
    assert staged.best == int(np.argmin(errors)) + 1 and 1 <= len(errors) - staged.best <= 1 or len(errors) == 5
    again = staged.transform(df.where("split = 'val'")).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)))).first()[0]
    assert again == pytest.approx(errors[staged.best - 1]) and again < 1.5
    assert [r.kept for r in G.curve_rows(spark, staged).orderBy("stage").collect()] == [k < staged.best for k in range(len(errors))]
    with pytest.raises(ValueError):
        G.fit_staged(df, "y", ["a"], "other")


def plain_isotonic(points):
    """Pool adjacent violators, one pass in one place."""
    by = {}
    for x, y, w in points:
        a = by.setdefault(x, [0.0, 0.0])
        a[0], a[1] = a[0] + w, a[1] + w * y
    out = []
    for x in sorted(by):
        block = [x, x, *by[x]]
        while out and out[-1][3] / out[-1][2] >= block[3] / block[2]:
            low, _, w, t = out.pop()
            block = [low, block[1], w + block[2], t + block[3]]
        out.append(block)
    return [(a, b, w, t / w) for a, b, w, t in out]


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "steps"])
def test_isotonic_blocks_over_many_partitions(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 120, 400).astype(float)
    y = {"noise": x / 40 + rng.integers(-3, 4, 400), "rising": x, "falling": -x, "steps": np.floor(x / 30)}[kind].astype(float)
    w = rng.integers(1, 4, 400).astype(float)
    points = [*zip(x.tolist(), y.tolist(), w.tolist())]
    df = spark.createDataFrame([*points, (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 5.0, 0.0)], "x double, y double, w double").repartition(3)
    blocks = I.isotonic_blocks(df, "x", "y", "w", partitions=7)
    got = sorted(tuple(r) for r in blocks.collect())
    want = plain_isotonic(points)
    assert len(got) == len(want) and all(g == pytest.approx(h) for g, h in zip(got, want))
    at = [-5.0, 3.0, 3.5, 60.25, 500.0, None, float("nan")]
    told = [r.v for r in I.apply_isotonic(spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i long, p double"), blocks, "p", "v").orderBy("i").collect()]
    ends, values = [v for b in want for v in b[:2]], [v for b in want for v in (b[3], b[3])]
    assert told == [None if a is None or np.isnan(a) else pytest.approx(np.interp(a, ends, values)) for a in at]


def test_isotonic_of_nothing(spark):
    empty = spark.createDataFrame([], "x double, y double")
    blocks = I.isotonic_blocks(empty, "x", "y")
    assert blocks.count() == 0
    assert I.apply_isotonic(spark.createDataFrame([(1.0,)], "x double"), blocks, "x", "v").first().v is None


def test_scalers_round_trip_through_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c), 7.0, i) for i, (a, b, c) in enumerate(zip(rng.gamma(2, 9, 80), rng.normal(3, 2, 80), rng.normal(0, 1, 80)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, i long")
    fitted = PanelScaler(groups={"minmax": ["a", "same"], "standard": ["b"], "robust": ["c"]}, logs=["a"], train="i < 60").fit(df)
    fitted.save(f"{tmp_path}/scaler")
    loaded = PanelScalerModel.load(f"{tmp_path}/scaler")
    scaled = loaded.transform(df)
    train = [np.array(c) for c in zip(*[r[:3] for r in rows[:60]])]
    first = scaled.orderBy("i").first()
    la = np.log1p(train[0])
    q = np.quantile(train[2], [0.25, 0.5, 0.75])
    assert (first.a, first.b, first.c, first.same) == pytest.approx(((np.log1p(rows[0][0]) - la.min()) / (la.max() - la.min()), (rows[0][1] - train[1].mean()) / train[1].std(), (rows[0][2] - q[1]) / (q[2] - q[0]), 0.0))
    for back, want in zip(loaded.inverse_transform(scaled).orderBy("i").collect(), rows):
        assert tuple(back)[:4] == pytest.approx(want[:4], abs=1e-9)
    assert loaded.inverse_transform(scaled, only=["b"]).select("a").orderBy("a").first() == scaled.select("a").orderBy("a").first()
    with_gaps = spark.createDataFrame([(None, float("nan"), None, None, 1)], df.schema)
    assert [round(v, 9) for v in tuple(loaded.inverse_transform(loaded.transform(with_gaps)).first())[:4]] == [0, 0, 0, 0]
    for bad in ({"other": ["a"]}, {"minmax": ["a"], "robust": ["a"]}):
        with pytest.raises(ValueError):
            PanelScaler(groups=bad)
    scaler = PanelScaler(groups={"minmax": ["a"]}, train="i < 5")
    scaler.save(f"{tmp_path}/estimator")
    assert PanelScaler.load(f"{tmp_path}/estimator").fit(df).transform(df).first() == scaler.fit(df).transform(df).first()


def test_feature_groups_survive(spark, tmp_path):
    df = R.with_groups(spark.range(3).selectExpr("id", "id * 2 as b", "id * 3 as a"), {"x": ["a", "b"], "log": ["b"]})
    df.write.parquet(f"{tmp_path}/t")
    joined = spark.read.parquet(f"{tmp_path}/t").join(spark.range(3).withColumnRenamed("id", "other"), F.col("id") == F.col("other")).where("id > 0").select("b", "id", "a")
    assert R.groups_of(joined) == {"log": ["b"], "x": ["a", "b"]} and R.positions(joined, "log", "x") == [1]
    assert R.in_order(joined, "x", "log").columns == ["a", "b"] and R.group_names(joined.drop("a"), "x") == ["b"]
    with pytest.raises(ValueError):
        R.with_groups(df, {"x": ["absent"]})


def test_bottom_k_is_the_same_for_every_partitioning(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g")
    pick = lambda d, **o: sorted(r.id for r in P.bottom_k(d, 7, key=["id"], **o).collect())
    for by in ([], ["g"]):
        assert pick(df.repartition(9), by=by) == pick(df.coalesce(1), by=by) != pick(df, by=by, seed=1)
    assert len(pick(df, by=["g"])) == 21 and len(pick(df.limit(4), by=[])) == 4
    assert "WindowGroupLimit" in P.bottom_k(df, 7, by=["g"], key=["id"])._jdf.queryExecution().executedPlan().toString()


def test_hierarchy_keeps_the_largest_of_separated_clusters(spark):
    centres = {1: (0, 0), 2: (0.1, 0), 3: (0, 0.2), 4: (50, 50), 5: (50, 51), 6: (-80, 9)}
    sizes = {1: 2, 2: 5, 3: 1, 4: 1, 5: 3, 6: 2}
    keys = [(c, k) for c, n in sizes.items() for k in range(n)]
    features = spark.createDataFrame([(i, float(centres[c][0]), float(centres[c][1])) for i, (c, _) in enumerate(keys)], "store long, a double, b double")
    members = spark.createDataFrame([("Store", str(i), c) for i, (c, _) in enumerate(keys)], "factor_name string, item_name string, cluster_id long")
    got = B.cluster_profiles(features, members, "Store", "store", ["a", "b"], keep=3, by="hierarchy")
    assert {(r.cluster_id, r["size"]) for r in got.collect()} == {(2, 5), (5, 3), (6, 2)}


def test_median_partitions_are_pruned(spark, tmp_path):
    """Only the clusters of eligible keys are read: the scan has a dynamic pruning filter."""
    medians = spark.range(400).selectExpr("id % 20 as cluster_id", "date_add(date'2020-01-01', cast(id / 20 as int)) as date", "cast(id as double) as median")
    medians.write.partitionBy("cluster_id").parquet(f"{tmp_path}/medians")
    spark.createDataFrame([("Store", str(s), c) for s in range(10) for c in (s, 19 - s)], "factor_name string, item_name string, cluster_id int").write.parquet(f"{tmp_path}/members")
    pairs = spark.createDataFrame([(3, 1)], "store long, item long")
    got = L.membership_medians(spark.read.parquet(f"{tmp_path}/medians"), spark.read.parquet(f"{tmp_path}/members"), "Store", "store", pairs, 2)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.date: (r.store_median_1, r.store_median_2) for r in got.collect()}
    assert len(rows) == 20 and rows[DAY] == (3.0, 16.0)


def test_designs():
    assert L.design_lags(past=True)["past_steps"] == tuple(range(1, 31)) and L.design_lags(True)["steps"][-1] == 60
    assert L.design_lags(future=True)["future_steps"] == tuple(range(1, 16)) and L.design_lags()["future_steps"] == ()


def test_series_windows(spark):
    pipelines.register_series_windows(spark)
    rows = [(1, 1, DAY), (1, 1, DAY + dt.timedelta(days=9)), (1, 1, DAY + dt.timedelta(days=2)), (2, 1, DAY), (2, 1, None)]
    spark.createDataFrame(rows, "store long, item long, date date").createOrReplaceTempView("_dates")
    got = spark.sql("SELECT * FROM series_windows(rows => TABLE(_dates), days => 4)").collect()
    assert sorted((r.store, r.window_id, (r.start_date - DAY).days, (r.end_date - DAY).days, r.n_rows) for r in got) == [(1, 0, 0, 3, 2), (1, 1, 4, 7, 0), (1, 2, 8, 11, 1), (2, 0, 0, 3, 1)]
    for bad in ("rows => TABLE(_dates), days => 0", "rows => 1, days => 4"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT * FROM series_windows({bad})").collect()


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    T.use_rocksdb(spark)
    schema = "k string, ts timestamp, v double"
    base = dt.datetime(2020, 1, 1)
    batch = lambda n, first: spark.createDataFrame([("a", base + dt.timedelta(days=first + i), float(i % 5)) for i in range(n)], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")

    def run():
        told = []
        T.each_batch(T.online_median_state(stream(), "k", "v", eta=0.5), lambda df, epoch: told.extend(df.collect()), f"{tmp_path}/ck", "update")
        return told

    batch(8, 0).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    first = run()
    batch(6, 8).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    second = run()
    estimate = 0.0
    for x in [i % 5 for i in range(8)] + [i % 5 for i in range(6)]:
        estimate += 0.5 * np.sign(x - estimate)
    assert [r.n for r in first] == [8] and [(r.n, r.estimate, r.ended) for r in second] == [(14, estimate, False)]


def test_filters_and_summaries_of_blocks(spark):
    cells = spark.createDataFrame([(s, i, float(5 * (s < 2) + (i == 2))) for s in range(4) for i in range(3)], "store long, item long, value double")
    rows = spark.createDataFrame([(s, int(s >= 2)) for s in range(4)], "store long, r long")
    cols = spark.createDataFrame([(i, 0) for i in range(3)], "item long, c long")
    blocks = spark.createDataFrame([(0, 0, 5.0), (1, 0, 1e-9)], "r long, c long, b double")
    for strategy, options in (("gap", {"keep": 1}), ("top_k", {"keep": 1}), ("quantiles", {"size_quantile": 0.0}), ("delta_then_size", {})):
        allowed, assigned = B.filter_blocks(cells, rows, cols, blocks, strategy, **options)
        assert {r.r for r in allowed.where("allowed").collect()} == ({0} if strategy != "quantiles" else {0, 1}), strategy
        if strategy == "top_k":
            summary = B.fit_summary(blocks, assigned).first()
            assert tuple(summary) == (0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        B.filter_blocks(cells, rows, cols, blocks, "other")
    gaps = cells.withColumn("value", F.when(F.col("item") != 1, F.col("value")))
    assert B.predict_blocks(gaps, rows, cols, blocks, n_cols=1).where("r < 0").count() == 0


def test_silhouette_of_the_other_side(spark):
    cells = spark.createDataFrame([(s, i, float(10 * (i // 2) + s)) for s in range(3) for i in range(4)], "store long, item long, value double")
    lone = cells.select("store").distinct().withColumn("r", F.col("store"))
    cols = cells.select("item").distinct().withColumn("c", F.floor(F.col("item") / 2))
    assert B.safe_silhouette(cells, lone, cols).first().silhouette == pytest.approx(1.0)
    assert B.safe_silhouette(cells, lone, None).first().silhouette is None and B.safe_silhouette(cells, None, None).first().silhouette is None


def test_a_benchmark_computes_its_frame_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rng = np.random.default_rng(2)
    df = long_series(spark, [list(map(float, rng.normal(5, 2, 40))) for _ in range(3)], 30)
    frame = L.lag_frame(df, "y", (1, 2)).withColumn("y", F.udf(counted, "double")("y"))
    got = {(r.Model, r.Dataset) for r in L.benchmark(frame, "y", L.lag_names("y", (1, 2)), ["linear_regression", "huber"]).collect()}
    assert len(got) == 4 and seen.value == 3 * 38
