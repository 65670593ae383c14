"""Hand-computed cases for missing values, ties, alignment and edge rules."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import blocks as B
from tessera.operators import clustering as K
from tessera.operators import forecasting as L
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.operators import statistics as A
from tessera.sources import io

D = dt.date


def series(spark, values, start=D(2020, 1, 1), store=1, item=1):
    rows = [(store, item, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "store long, item long, date date, x double")


def out(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).collect()]


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (int, float, str, dt.date, type(None))) else F.lit(v))
    return df.select(expr.alias("v")).first().v


def test_daily_growth_pads_and_zeroes(spark):
    df = P.daily_growth(series(spark, [10.0, None, 15.0, 0.0, 5.0]), value="x")
    assert out(df, "growth_rate") == [0.0, 0.0, 0.5, -1.0, 0.0]


def test_growth_does_not_pad(spark):
    assert out(S.growth(series(spark, [10.0, None, 15.0, 0.0, 5.0, 5.0]), "x"), "growth_rate") == [None, None, None, -1.0, None, 0.0]


@pytest.mark.parametrize("values", [[None, 1.0, None, None, 5.0, 7.0], [1.0, 2.0, 3.0], [None, None], [4.0]])
def test_ewm_ages_over_gaps(spark, values):
    import pandas as pd

    want = pd.Series(values, dtype=float).ewm(span=3, adjust=False).mean()
    got = out(S.ewm(series(spark, values), "x", 3, "y"), "y")
    grouped = out(S.ewm_grouped(series(spark, values), "x", 3, "y"), "y")
    for a, b, c in zip(got, grouped, want):
        if math.isnan(c):
            assert a is None and (b is None or math.isnan(b))
        else:
            assert a == pytest.approx(c) and b == pytest.approx(c)


def test_rolling_skips_missing(spark):
    df = series(spark, [1.0, None, 3.0, 10.0])
    assert out(S.rolling_median(df, "x", 3, "m"), "m") == [1.0, 1.0, 2.0, 6.5]
    assert out(S.rolling_mean(df, "x", 2, "m"), "m") == [1.0, 1.0, 3.0, 6.5]


def test_weekly_fills_gaps_and_labels_sundays(spark):
    rows = [(1, 1, D(2020, 1, 1), 4.0), (1, 1, D(2020, 1, 5), 1.0), (1, 1, D(2020, 1, 20), 3.0)]
    df = spark.createDataFrame(rows, "store long, item long, date date, unit_sales double")
    got = [(r.week_end, r.sales_wk, r.growth_rate, r.direction, r.growth_down) for r in S.weekly(df).orderBy("week_end").collect()]
    assert got == [(D(2020, 1, 5), 5.0, None, 0, None), (D(2020, 1, 12), 0.0, -1.0, -1, 1), (D(2020, 1, 19), 0.0, None, 0, None), (D(2020, 1, 26), 3.0, None, 0, None)]


@pytest.mark.parametrize("day, want", [(D(2020, 1, 15), 0.0), (D(2020, 1, 14), 14 / 15), (D(2020, 1, 31), 1.0), (D(2020, 2, 29), 1.0), (D(2020, 3, 1), 1 / 15)])
def test_pay_cycle(spark, day, want):
    assert one(spark, C.pay_cycle("d"), d=day) == pytest.approx(want)


@pytest.mark.parametrize("day, want", [(D(2021, 3, 19), 364 / 365), (D(2021, 3, 20), 0.0), (D(2021, 3, 21), 1 / 365), (D(2020, 3, 19), 0.0)])
def test_season(spark, day, want):
    assert one(spark, C.season_phase("d"), d=day) == pytest.approx(want)


def test_guards(spark):
    assert one(spark, C.finite("x"), x=float("nan")) is None and one(spark, C.finite("x"), x=float("inf")) is None
    assert one(spark, C.to_number("x"), x="abc") is None and one(spark, C.to_number("x"), x="1.5") == 1.5
    assert one(spark, C.clip("x", 0.0, 1.0), x=F.lit(None).cast("double")) is None
    assert one(spark, C.direction("x", 0.1), x=F.lit(None).cast("double")) == 0
    assert one(spark, C.gini("x"), x=F.array(F.lit(1.0), F.lit(1.0))) == 0.0
    assert one(spark, C.gini("x"), x=F.array(F.lit(0.0), F.lit(0.0))) == 0.0


def test_robust_statistics_need_support(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in df.groupBy("k").agg(C.safe_std("x").alias("s"), C.safe_iqr("x").alias("i"), C.safe_median("x").alias("m"), C.up_to_down("x").alias("u"), C.mav("x").alias("v")).collect()}
    assert got["a"].s is None and got["a"].i is None and got["b"].s == 1.0 and got["b"].i == 1.0 and got["c"].m is None and got["a"].u is None and got["c"].v == 0.0


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert df.agg(C.safe_corr("a", "b").alias("c")).first().c is None


def test_autocorrelation_matches_numpy(spark):
    x = np.sin(np.arange(30) / 3) + np.arange(30) / 20
    df = S.lags(series(spark, x.tolist()), "x", [4])
    got = df.agg(C.safe_corr("x", "x_lag_4", 3).alias("c")).first().c
    assert got == pytest.approx(np.corrcoef(x[4:], x[:-4])[0, 1])


def test_windows(spark):
    df = series(spark, [float(v) for v in range(100, 110)])
    assert [r.start_date for r in S.wide_windows(df.withColumnRenamed("x", "unit_sales"), 5).orderBy("start_date").collect()] == [D(2020, 1, 1), D(2020, 1, 6)]
    assert S.wide_windows(series(spark, [1.0, 2.0, 3.0]).withColumnRenamed("x", "unit_sales"), 5).count() == 0
    w = S.wide_windows(df.withColumnRenamed("x", "unit_sales"), 5)
    y = S.next_window_targets(w, ["sales_day_1"]).orderBy("start_date").collect()
    assert [r.y_sales_day_1 for r in y] == [105.0, None]
    with pytest.raises(ValueError):
        S.window_ids(df, 0)
    cal = S.window_ids(df, 4, calendar=True)
    assert sorted({r.window_id for r in cal.collect()}) == [0, 1] and cal.count() == 8


def test_cluster_medians_example(spark):
    rows = [(s, 1, D(2020, 1, d), float(v)) for s, base in ((1, 0), (2, 4)) for d, v in enumerate(range(base + 1, base + 5), 1)]
    df = spark.createDataFrame(rows, "store long, item long, date date, growth_rate double").withColumn("k", F.lit(0))
    assert out(P.cluster_medians(df, "k"), "k_median")[0] == 3.0


def test_duplicates_raise(spark):
    df = series(spark, [1.0, 2.0])
    with pytest.raises(ValueError):
        P.assert_unique(df.unionByName(df), ["store", "item", "date"])
    assert P.assert_unique(df, ["store", "item", "date"]) is df


def test_unique_is_checked_inside_the_plan(spark):
    from pyspark.errors import PySparkException

    df = series(spark, [1.0, 2.0])
    keys = ["store", "item", "date"]
    assert sorted(P.unique(df, keys).collect()) == sorted(df.collect())
    twice = P.unique(df.unionByName(df), keys)  # no job yet
    for action in (lambda: twice.count(), lambda: twice.select("store").collect(), lambda: P.many_to_one(df, df.unionByName(df), keys).collect()):
        with pytest.raises(PySparkException, match="duplicate"):
            action()
    one = df.withColumn("block_id", F.lit(1))
    other = one.unionByName(one.withColumn("block_id", F.lit(2)))
    with pytest.raises(PySparkException, match="more than one block_id"):
        A.one_block_per_pair(other, "x").collect()
    with pytest.raises(PySparkException, match="duplicate"):
        P.with_blocks(df.select("store", "item"), other).collect()
    assert P.unique(df.select("store").distinct(), ["store"]).columns == ["store"]


def test_extremes_break_ties_by_key_and_all_zero_means_all(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(6)], "item long, v double")
    assert sorted(r.item for r in P.extreme_and_median_neighbours(df, "v", "item", 1, 0, 1).collect()) == [0, 1, 2]
    assert P.extreme_and_median_neighbours(df, "v", "item", 0, 0, 0).count() == 6


def test_fraction_split_index(spark):
    got = out(S.split_by_fraction(series(spark, [1.0] * 11)), "split")
    assert got == ["train"] * 8 + ["val"] * 3


def test_online_median(spark):
    assert S.online_median(series(spark, [1.0, None, 1.0, -1.0]), "x", eta=0.5).first().online_median == pytest.approx(0.5)


def test_naive_scale_zero_is_null(spark):
    a = series(spark, [2.0, 2.0, 2.0, 4.0]).withColumnsRenamed({"x": "y"})
    f = a.withColumnRenamed("y", "yhat")
    r = E.forecast_bundle(a, f, a.where("y = 2"), ["store", "item"]).first()
    assert r.RMSSE is None and r.MASE is None and r.RMSE == 0.0


def test_log_space_example(spark):
    rows = [(0.0, 0.0), (math.log1p(1), math.log1p(2)), (math.log1p(10), math.log1p(11)), (math.log1p(5), math.log1p(4)), (0.0, math.log1p(1)), (math.log1p(2), math.log1p(2.5))]
    df = spark.createDataFrame(rows, "y double, yhat double").withColumn("k", F.lit(1))
    assert E.original_bundle(df, ["k"]).first().MAE == pytest.approx((1 + 1 + 1 + 0.5) / 4)


def test_normalisation_rules(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 1.0)], "store long, item long, value double")
    z = {(r.store, r.item): r.value for r in M.zscore(df, "store").collect()}
    assert z[1, 1] == 0.0 and z[2, 1] == 0.0
    assert all(r.value == 0.0 for r in M.minmax_by_column(df.where("item = 2"), "item").collect())
    assert M.transpose(df).where("store = 1 and item = 2").first().value == 1.0


def test_gap_mask_and_hard_assignment(spark):
    blocks = spark.createDataFrame([(0, 0, 9.0), (0, 1, -8.0), (0, 2, 1.0), (1, 0, 2.0), (1, 1, 0.5), (1, 2, 0.0)], "r long, c long, b double")
    allowed = lambda mask: {(r.r, r.c) for r in mask.where("allowed").collect()}
    assert allowed(B.mask_by_gap(blocks, min_keep=1)) == {(0, 0), (0, 1)}
    assert allowed(B.mask_by_gap(blocks)) == {(0, 0), (0, 1), (1, 0), (0, 2)}  # four at least
    assert allowed(B.mask_by_gap(blocks.where("r = 1 and c = 2"))) == set()
    assert allowed(B.mask_top_k(blocks, 2)) == {(0, 0), (0, 1)}
    assert allowed(B.mask_top_k(blocks.unionByName(spark.createDataFrame([(2, 0, 8.0)], blocks.schema)), 2)) == {(0, 0), (0, 1), (2, 0)}  # equals stay
    f = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, -3.0), (2, 1, 3.0)], "id long, component long, loading double")
    assert {r.id: r.cluster_id for r in B.hard_assignment(f).collect()} == {1: None, 2: 0}
    assert B.cumulative_threshold(f).where("id = 1").count() == 0
    flat = B.flat_assignments(B.cumulative_threshold(f), f, "k")
    assert flat.where("item_name = '1' and cluster_id is null").count() == 1


def planted(seed=0, noise=0.1):
    rng = np.random.default_rng(seed)
    r, c = rng.permutation(np.arange(30) % 3), rng.permutation(np.arange(24) % 4)
    return rng.normal(0, 3, (3, 4))[np.ix_(r, c)] + rng.normal(0, noise, (30, 24)), r, c


def test_double_kmeans_recovers_blocks_and_never_worsens(spark):
    x, r, c = planted()
    best = min((K.double_kmeans(x, 3, 4, seed=s) for s in range(8)), key=lambda m: m.history[-1])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(r, best.row_labels)], "a int, b int")
    assert E.agreement(df, "a", "b").first().ari == pytest.approx(1.0)
    for norm in ("l2", "l1"):
        h = K.double_kmeans(x, 3, 4, norm, seed=1).history
        assert all(b <= a + 1e-6 for a, b in zip(h, h[1:]))


@pytest.mark.parametrize("features", [1, 2])
def test_tri_factorisation_contract(features):
    x, *_ = planted(3)
    data = x if features == 1 else np.stack([x, 2 * x])
    m = K.binary_tri_factorisation(data, 3, 4, beta=0.01, seed=1)
    assert all(b <= a + 1e-9 for a, b in zip(m.history, m.history[1:]))
    assert (m.u.sum(1) >= 1).all() and (m.v.sum(1) >= 1).all() and (m.u.sum(0) > 0).all()


@pytest.mark.parametrize("divergence", ["frobenius", "kl", "is"])
def test_nmtf_is_monotone(divergence):
    x = np.abs(planted(5)[0]) + 0.1
    h = K.nmtf(x, 3, 4, divergence, iterations=60)[3]
    assert all(b <= a * (1 + 1e-9) + 1e-9 for a, b in zip(h, h[1:]))


def test_tensor_decompositions():
    rng = np.random.default_rng(0)
    t = np.einsum("ir,jr,kr->ijk", *(rng.random((n, 2)) for n in (8, 7, 6)))
    assert K.parafac(t, 2, iterations=500)[1][-1] < 1e-3
    assert K.tucker(t, (2, 2, 2))[2][-1] < 1e-8
    h = K.parafac(t, 2, nonnegative=True)[1]
    assert all(b <= a + 1e-9 for a, b in zip(h, h[1:]))


def test_online_matches_batch_centres():
    x, r, c = planted(noise=0.01)
    batch = min((K.double_kmeans(x, 3, 4, seed=s) for s in range(8)), key=lambda m: m.history[-1])
    online = K.OnlineDoubleKMeans(batch.centres, batch.col_labels)
    labels = np.concatenate([online.partial_fit(x[i : i + 10]) for i in range(0, 30, 10)])
    assert (labels == batch.row_labels).all() and np.allclose(online.centres, batch.centres)


def test_sweep_keeps_failures_as_null_rows(spark):
    def broken(x, r, c, s):
        raise ValueError("no fit")

    rows = K.sweep(spark, planted()[0], [2], [2], names={"double_kmeans": broken}).collect()
    assert len(rows) == 1 and rows[0].pve is None


def test_local_forecasts_of_a_line():
    y = np.arange(40.0)
    for m in ("theta", "exponential_smoothing", "auto_arima"):
        assert len(L.local_forecast(y, 3, m)) == 3 and L.local_forecast(y, 3, m)[0] > 38
    assert L.local_forecast(y, 2, "naive").tolist() == [39.0, 39.0]
    with pytest.raises(NotImplementedError):
        L.require("tft")
    with pytest.raises(ValueError):
        L.require("nope")


def test_feature_pruning_keeps_all_if_all_are_bad(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert {r.feature: r.dropped for r in A.feature_diagnostics(df, ["a", "b"]).collect()} == {"a": True, "b": False}
    assert not any(r.dropped for r in A.feature_diagnostics(df, ["a"]).collect())


def test_sources(spark, tmp_path):
    df = series(spark, [1.0, 2.0]).withColumn("block_id", F.col("store"))
    for suffix in ("parquet", "csv"):
        path = f"{tmp_path}/t.{suffix}"
        io.write_table(df, path)
        assert io.read_table(spark, path).count() == 2
    with pytest.warns(UserWarning):
        io.write_table(None, "x.csv")
    with pytest.raises(ValueError):
        io.read_table(spark, "x.pkl")
    io.write_blocks(df, f"{tmp_path}/blocks")
    assert spark.read.parquet(f"{tmp_path}/blocks").where("block_id = 1").count() == 2
    for model, header in (("rf", "RMSE,MAE\n1,2\n"), ("lr", "RMSE,R2\n3,4\n")):
        (tmp_path / "m" / model).mkdir(parents=True)
        (tmp_path / "m" / model / "metrics.csv").write_text(header)
    got = io.collect_metrics(spark, f"{tmp_path}/m")
    assert {r.model_name for r in got.collect()} == {"rf", "lr"} and {"RMSE", "MAE", "R2"} <= set(got.columns)
    config = tmp_path / "c.json"
    config.write_text('{"theta": {"a": 1}, "other": {}}')
    with pytest.warns(UserWarning):
        assert io.load_model_config(str(config), L.MODELS) == {"theta": {"a": 1}}


def test_filters_reach_the_scan(spark, sf_dir):
    from tessera.plans import fixtures as X

    plan = io.pruned_scan(X.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "store", "l_partkey": "item"}), ["l_quantity"], [1], [2])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(l_suppkey" in plan or "PushedFilters: [IsNotNull(l_suppkey)" in plan or "EqualTo(l_suppkey,1)" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_untied_double_kmeans(spark):
    x, r, _ = planted(7, noise=0.01)
    runs = [K.untied_double_kmeans(x, 3, 4, seed=s) for s in range(12)]
    best = min(runs, key=lambda m: m[3][-1])
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(r, best[0])], "a int, b int")
    assert E.agreement(df, "a", "b").first().ari == pytest.approx(1.0)


def test_cross_validation_prefers_the_planted_size(spark):
    rows = {(r.n_row, r.n_col): r.mse for r in K.cross_validate(spark, planted()[0], [1, 3], [1, 4]).collect()}
    assert rows[3, 4] < rows[1, 1]


def test_cluster_series(spark):
    df = spark.createDataFrame([("a", 0.0, 0.1), ("b", 0.1, 0.0), ("c", 9.0, 9.1), ("d", 9.1, 9.0)], "k string, x double, y double")
    got = {r.k: r.cluster for r in K.cluster_series(df, ["x", "y"], 2).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_cluster_series_keeps_rows_with_missing_cells(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, None), (2, 9.0, 9.0), (3, None, 9.1), (4, float("nan"), 8.9)], "k long, x double, y double")
    got = {r.k: r.cluster for r in K.cluster_series(df, ["x", "y"], 2).collect()}
    assert len(got) == 5 and got[2] == got[3] == got[4] != got[0]


def test_series_clusters_use_every_item(spark, sf_dir, monkeypatch):
    from tessera.plans import fixtures, registry

    seen = []
    fit = K.cluster_series
    monkeypatch.setattr(K, "cluster_series", lambda wide, features, *a: seen.append(features) or fit(wide, features, *a))
    n = registry.queries()["c42_series_clusters"](spark, sf_dir).count()
    cells = fixtures.sales_cells(spark, sf_dir)
    assert n == cells.select("store").distinct().count() and len(seen[0]) == cells.select("item").distinct().count()


def test_block_scores_use_the_residual(spark):
    """One cell of value 4 under blocks 2 and 1: fitted 3, residual 1."""
    cells = spark.createDataFrame([(1, 1, 4.0)], "store long, item long, value double")
    rows = spark.createDataFrame([(1, 0), (1, 1)], "store long, r long")
    cols = spark.createDataFrame([(1, 0)], "item long, c long")
    blocks = spark.createDataFrame([(0, 0, 2.0), (1, 0, 1.0), (2, 0, 5.0)], "r long, c long, b double")
    pick = lambda **o: B.assign_blocks(cells, rows, cols, blocks, n_cols=1, **o).first().r
    assert pick() == 1  # 1 * 2 - 2 = 0 against 1 * 1 - 0.5
    assert pick(score="poisson_delta") == 0  # 4 ln 3 - 2 against 4 (ln 3 - ln 2) - 1
    assert pick(score="dominant") == 0
    only = spark.createDataFrame([(0, 0, True)], "r long, c long, allowed boolean")
    assert pick(allowed=only) == 0
    assert pick(min_abs_b=4.0) == 2  # no allowed block of its own: the dominant one of all
    assert pick(min_abs_b=4.0, on_empty="skip") == -1
    assert pick(min_abs_b=9.0) == 0
    with pytest.raises(Exception, match="no allowed block"):
        pick(min_abs_b=4.0, on_empty="raise")


def test_block_energy_and_component_norms(spark):
    blocks = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r long, c long, b double")
    rows = spark.createDataFrame([(i, 0) for i in range(3)], "store long, r long")
    cols = spark.createDataFrame([(i, 0) for i in range(10)] + [(99, 1)], "item long, c long")
    got = B.energy_elbow(blocks, rows, cols).first()  # energies 30 and 12
    assert got.keep == 1 and got.lead == pytest.approx(30 / 42 - 0.5)
    assert B.energy_elbow(blocks.withColumn("b", F.lit(0.0)), rows, cols).first().keep == 1
    f = spark.createDataFrame([(1, 0, 3.0), (2, 0, 4.0), (1, 1, 0.0), (2, 1, 0.0)], "id long, component long, loading double")
    r = B.component_stats(f).first()
    assert (r.total, r.empty, r["mean"], r.q25, r.q75) == (2, 1, 2.5, 1.25, 3.75)


def test_variance_ratio_and_interval(spark):
    clusters = spark.createDataFrame([(1.0, 0.0, 2), (4.0, 2.0, 2)], "mav_mean double, mav_var double, n_pairs long")
    r = A.variance_ratio(clusters).first()
    assert (r["between"], r.within, r.ratio) == (pytest.approx(3.0), pytest.approx(1.0), pytest.approx(3.0))
    assert A.variance_ratio(clusters.limit(1)).first()["between"] is None
    rows = [("a", 1.0), ("a", 3.0), *[("b", float(i)) for i in range(41)], ("c", 1.0)]
    got = {r.k: r.half_width for r in A.mean_interval(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["a"] == pytest.approx(12.7062047) and got["c"] is None
    assert got["b"] == pytest.approx(2.0210754 * np.std(range(41), ddof=1) / math.sqrt(41), rel=1e-6)


@pytest.mark.parametrize("few", [1 << 20, 50])
def test_global_quantiles(spark, monkeypatch, few):
    from tessera.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 1000 if few == 50 else quantiles.ACCURACY)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=5000), np.full(700, 0.25)])
    df = spark.createDataFrame([(float(v), None, 1.0) for v in x] + [(None, None, 1.0)], "a double, b double, c double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.73, 0.99, 1.0]
    got = quantiles.global_quantiles(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, shares).first()
    assert got.a == pytest.approx(np.quantile(x, shares).tolist())
    assert got.b == [None] * 7 and got.c == [1.0] * 7


def test_long_series_folds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 1, 300)
    x[[0, 5, 6, 299]] = np.nan
    df = spark.createDataFrame([(1, 1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "store long, item long, date long, v double")
    ewm = [r.y for r in S.ewm(df, "v", 7, "y").orderBy("date").collect()]
    want = pd.Series(x).ewm(span=7, adjust=False).mean()
    assert ewm[0] is None and ewm[1:] == pytest.approx(want[1:].tolist())
    med = [r.running_median for r in S.running_median(df, "v").orderBy("date").collect()]
    assert med == pytest.approx(pd.Series(x).expanding().median().fillna(0).tolist())
    ma = {r.date: r.forecast for r in S.ma1_walk_forward(df.where("date between 7 and 60"), "v").collect()}
    grid, y = np.linspace(-0.95, 0.95, 39), x[7:61]
    assert all(ma[k] is None for k in range(7, 14))
    for i in (7, 20, 53):
        d = y[:i] - y[:i].mean()
        e, sse = np.zeros(39), np.zeros(39)
        for v in d:
            e = v - grid * e
            sse += e * e
        assert ma[7 + i] == pytest.approx(y[:i].mean() + grid[sse.argmin()] * e[sse.argmin()])


def test_local_models_follow_seasons_trends_and_covariates():
    t = np.arange(140)
    season = np.array([0, 2, 5, 1, -3, -4, -1.0])[t % 7]
    for model in ("exponential_smoothing", "theta", "auto_arima", "linear_regression"):
        ahead = L.local_forecast(50 + 0.3 * t[:126] + season[:126], 14, model)
        assert np.abs(ahead - (50 + 0.3 * t[126:] + season[126:])).max() < 3.0, model
    x = np.random.default_rng(2).integers(0, 2, (140, 1)).astype(float)
    y = 20 + 8 * x[:, 0]
    for model in ("auto_arima", "kalman"):
        assert np.abs(L.local_forecast(y[:126], 14, model, x=x[:126], x_ahead=x[126:]) - y[126:]).max() < 0.5, model
    for model in ("naive", "exponential_smoothing", "theta", "auto_arima", "kalman", "linear_regression"):
        assert np.isfinite(L.local_forecast(np.array([1.0, 2.0]), 3, model)).all()
    with pytest.raises(ValueError):
        L.forecast_local(None, "y", ["random_forest"])


def test_scaling_does_not_change_equivariant_forecasts(spark):
    rows = [(1, 1, i, float(10 + 3 * i % 11), "train" if i < 40 else "val") for i in range(50)]
    df = spark.createDataFrame(rows, "store long, item long, date long, y double, split string")
    plain, scaled = ([r.yhat for r in L.forecast_local(df, "y", ["naive", "theta"], scaled=s).orderBy("Model", "date").collect()] for s in (False, True))
    assert plain == pytest.approx(scaled)


def test_early_stopping_uses_the_validation_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(rng.normal()), "train" if i % 4 else "val") for i, a in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "a double, y double, split string")  # nothing to learn
    trees = lambda stop: len(L.fit_global(df, "y", ["a"], "gradient_boosting", early_stop=stop).stages[-1].trees)
    assert trees(0.01) < trees(None) == 20


def test_leaf_order_keeps_clusters_together():
    rng = np.random.default_rng(3)
    label = rng.permutation(np.arange(30) % 3)
    order = K.leaf_order(label[:, None] * 10 + rng.normal(0, 0.1, (30, 4)))
    assert sorted(order) == list(range(30)) and (np.diff(label[order]) != 0).sum() == 2


def test_metrics_files_are_read_by_header(spark, tmp_path):
    for name, text in (("m1/metrics.csv", "a,b\n1,2\n"), ("m2/metrics.csv", "b,c\n3,4\n5,6\n"), ("m3/my_metrics_x.csv", "a,b\n7,8\n"), ("m4/metrics.csv", ""), ("m5/other.csv", "a\n9\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.model_name, r.a, r.b, r.c) for r in io.collect_metrics(spark, str(tmp_path)).collect()}
    assert got == {("m1", "1", "2", None), ("m2", None, "3", "4"), ("m2", None, "5", "6"), ("m3", "7", "8", None)}
    with pytest.raises(ValueError):
        io.read_clusters(spark, "x")


def test_sweep_scores_labels_and_small_clusters(spark):
    x, r, c = planted()
    rows = {(k.n_row, k.n_col): k for k in K.sweep(spark, x, [3], [4, 6], restarts=8, least_size=3).collect()}
    best = rows[3, 4]
    v = np.where(x >= 0, x, 0)
    block = pd.Series((best.restart * 0 + r[:, None] * 4 + c[None]).ravel())
    groups = pd.Series(v.ravel()).groupby(block)
    between = (groups.size() * (groups.mean() - v.mean()) ** 2).sum() / (v.size - 1)
    within = (groups.var(ddof=1) * (groups.size() - 1)).sum() / (v.size - len(groups))
    assert best.var_between == pytest.approx(between) and best.var_ratio == pytest.approx(between / within)
    assert best.silhouette > 0.9 and best.least_size == 6 and best.pve > 0.99
    none = K.sweep(spark, x, [3], [4], restarts=1, least_size=25).first()
    assert none.rss is None and none.silhouette is None and none.least_size < 25
    assert K.sweep(spark, x, [2], [2], restarts=1, solver="nmtf").first().silhouette is None


def test_silhouette_matches_the_definition():
    rng = np.random.default_rng(2)
    x, labels = rng.normal(size=(9, 3)), np.array([0, 0, 0, 2, 2, 2, 5, 5, 5])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(9):
        a = d[i, (labels == labels[i]) & (np.arange(9) != i)].mean()
        b = min(d[i, labels == k].mean() for k in {0, 2, 5} - {labels[i]})
        want.append((b - a) / max(a, b))
    assert K.row_silhouette(x, labels) == pytest.approx(np.mean(want))
    assert K.row_silhouette(x[:4], labels[:4]) is None


def test_block_lasso_is_a_minimum():
    rng = np.random.default_rng(0)
    x, u, v = rng.normal(size=(20, 15)), np.eye(3)[rng.integers(0, 3, 20)], np.eye(4)[rng.integers(0, 4, 15)]
    u[0, :2] = 1
    loss = lambda b: 0.5 * ((x - u @ b @ v.T) ** 2).sum() + 5e-4 * (b * b).sum() + 2 * np.abs(b).sum()
    b = K._lasso_blocks(x, u, v, 1e-3, 2.0)
    assert all(loss(b + rng.normal(0, 0.01, b.shape)) >= loss(b) - 1e-9 for _ in range(200))
    assert np.isfinite(K._ridge_blocks(x, np.hstack([u, u]), v, 0.0)).all()  # singular without its diagonal


def test_values_split_with_least_squares():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for _ in range(30):
        x = np.sort(np.round(rng.normal(size=8), 3))
        sse = lambda cuts: sum(((g - g.mean()) ** 2).sum() for g in np.split(x, cuts))
        want = min(sse(c) for c in combinations(range(1, 8), 2))
        ends = B.value_groups(x, 3)
        assert sse([int(np.searchsorted(x, e, "right")) for e in ends[:-1]]) == pytest.approx(want)
    assert B.value_groups([2.0, 2.0, 1.0], 3) == [1.0, 2.0]


def test_submission_rounds_the_exact_value(spark):
    values = [0.00005, 0.00015, 0.00025, 0.12345, 0.03125, 0.09375, 2.00005, 1 / 3, 1e-9, -1.0, None, 2.0**70]
    df = spark.createDataFrame(list(enumerate(values)), "id long, unit_sales double")
    got = out(io.submission(df), "unit_sales", "id")
    assert got == ["0.0001", "0.0001", "0.0003", "0.1235", "0.0312", "0.0938", "2.0000", "0.3333", "0.0000", "0.0000", "0.0000", "1180591620717411303424.0000"]
    import duckdb

    assert got == [duckdb.execute("SELECT printf('%.4f', greatest(?::DOUBLE, 0))", [v]).fetchone()[0] for v in values]
