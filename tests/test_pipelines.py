import datetime as dt

import pytest

from tessera.plans import fixtures as X
from tessera.plans import pipelines as R


def test_parsing():
    assert R.parse_range("2:5") == [2, 3, 4] and R.parse_range("0.1,0.2") == [0.1, 0.2] and R.parse_range("") is None
    assert R.parse_range("0.01:0.013") == [0.01, 0.011, 0.012]
    assert R.parse_flag("Yes") and not R.parse_flag("0")
    with pytest.raises(ValueError):
        R.parse_flag("maybe")


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    df = X.daily(spark, sf_dir).cache()
    yield df
    df.unpersist()


def test_preprocess(spark, sf_dir):
    df = R.preprocess(X.panel(spark, sf_dir), X.stores(spark, sf_dir), X.items(spark, sf_dir), X.transactions(spark, sf_dir), X.holidays(spark), top=3, median=2, bottom=3)
    assert df.select("item").distinct().count() == 10
    assert {"family_code", "class_code", "cluster_code", "growth_rate", "is_national"} <= set(df.columns)


def test_weekly_features(panel):
    imputed, raw, diag = R.weekly_features(panel)
    kept = set(imputed.columns) - {"store", "item"}
    assert kept == {r.feature for r in diag.collect() if not r.dropped}
    assert imputed.count() == raw.count() and imputed.dropna().count() == imputed.count()


def test_supervised(panel):
    df = R.supervised(R.cyclical_features(panel))
    assert df.where("y is null").count() == 0 and "growth_rate_ewm" in df.columns


def test_cluster_and_explain(spark, panel):
    out, scores = R.cluster_panel(spark, panel, [2, 3], [2])
    assert out.count() == panel.count() and scores.count() == 2 and out.where("cluster is null").count() == 0
    cells, blocks = R.explain_panel(spark, panel, 2, 3)
    assert cells.where("block_id < -1").count() == 0 and blocks.count() >= 1


def test_tensor_assignments(spark, panel):
    rows = R.tensor_assignments(spark, panel, ["unit_sales", "growth_rate"], (2, 2, 1))
    assert {r.factor_name for r in rows.select("factor_name").distinct().collect()} == {"Store", "SKU"}


def test_forecast_all(panel):
    got = R.forecast_all(panel, ["naive", "theta"])
    assert {r.Model for r in got.select("Model").distinct().collect()} <= {"naive", "theta"}


def test_window_udtf(spark):
    R.register_udtf(spark)
    q = "select * from generate_windows(date'2020-01-01', date'2020-01-10', 4, {})"
    got = [(r.window_id, r.start_date, r.end_date) for r in spark.sql(q.format("true")).orderBy("window_id").collect()]
    d = lambda n: dt.date(2020, 1, n)
    assert got == [(0, d(7), d(10)), (1, d(3), d(6))]
    assert spark.sql(q.format("false")).count() == 3
