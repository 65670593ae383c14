"""Queries of global models, calibration, scalers, feature groups, covariates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import registry as R
from tessera.operators import blocks as B
from tessera.operators import forecasting as L
from tessera.operators import global_models as G
from tessera.operators import isotonic as I
from tessera.operators import metrics as E
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.operators.scalers import PanelScaler, PanelScalerModel
from tessera.plans import fixtures as X
from tessera.plans import pipelines
from tessera.plans.spec import Query
from tessera.sources.scratch import scratch_path, stored
from tessera.streaming import streams as T

QUERIES: list[Query] = []


def query(name: str, columns: str, sql: str | None = None):
    def add(build):
        QUERIES.append(Query(name, columns, build, sql))
        return build

    return add


def _split(spark, d, *more):
    return S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales", *more), 0.8)


# ------------------------------------------------------------------ global models

_LAGS = """l AS (SELECT store, item, date, split, y, pos, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b FROM split_fc WINDOW w AS (PARTITION BY store, item ORDER BY date)),
  k AS (SELECT * FROM l WHERE a IS NOT NULL AND b IS NOT NULL)"""
_RIDGE = "(ay * (bb + {r}) - by1 * ab) / ((aa + {r}) * (bb + {r}) - ab * ab) AS ca, (by1 * (aa + {r}) - ay * ab) / ((aa + {r}) * (bb + {r}) - ab * ab) AS cb"
_MOMENTS = "avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by1"


@query(
    "l10_recursive_forecasts",
    "store:b item:b date:d step:b y:f yhat:f",
    f"""WITH RECURSIVE {_LAGS}, m AS (SELECT {_MOMENTS} FROM k WHERE split = 'train'), c AS (SELECT *, {_RIDGE.format(r=2.0)} FROM m),
      h AS (SELECT store, item, list_slice(list(y ORDER BY date) FILTER (WHERE split = 'train'), -7, -1) AS hist, count(*) FILTER (WHERE split = 'val') AS n FROM split_fc GROUP BY 1, 2),
      r AS (SELECT store, item, n, 0 AS step, hist, CAST(NULL AS DOUBLE) AS yhat FROM h
        UNION ALL SELECT store, item, n, step + 1, list_append(list_slice(hist, 2, 7), p), p FROM (SELECT r.*, CASE WHEN len(hist) = 7 THEN my + ca * (hist[7] - ma) + cb * (hist[1] - mb) END AS p FROM r, c WHERE step < n)),
      v AS (SELECT store, item, date, y, row_number() OVER (PARTITION BY store, item ORDER BY date) AS step FROM split_fc WHERE split = 'val')
      SELECT store, item, date, step, y, yhat FROM v JOIN r USING (store, item, step)""",
)
def _(spark, d):
    rows = _split(spark, d)
    features = L.lag_names("unit_sales", (1, 7))
    model = G.fit_ridge(L.lag_frame(rows, "unit_sales", (1, 7)).where("split = 'train'"), "unit_sales", features, reg=2.0)
    return G.forecast_recursive(rows, model, "unit_sales", (1, 7))


@query("l10_recursive_covariates", "Model:s store:b item:b RMSE:f MAE:f SMAPE:f RMSSE:f")
def _(spark, d):
    split = stored(_split(spark, d, "onpromotion"), "split")
    rows = G.scaled_by_key(split.join(L.eligible(split, "unit_sales").select("store", "item"), ["store", "item"], "left_semi"), ["unit_sales"])
    lags = (1, 2, 3, 7, 14)
    options = {"steps": lags, "future": ["onpromotion"], "future_steps": (0,)}
    model = G.fit_ridge(L.lag_frame(rows, "unit_sales", **options).where("split = 'train'"), "unit_sales", L.lag_names("unit_sales", **options), reg=0.01)
    told = G.forecast_recursive(rows, model, "unit_sales", lags, future=["onpromotion"]).withColumn("Model", F.lit("ridge"))
    return L.evaluate(stored(told.where("yhat is not null"), "told"), split, "unit_sales")


_TRIALS = [(i, float(10**k)) for i, k in enumerate(range(-3, 6))]


@query(
    "l11_successive_halving",
    "trial:b rung:b score:f kept:s",
    f"""WITH {_LAGS}, t(trial, reg) AS (VALUES {', '.join(f'({i}, {r!r}::DOUBLE)' for i, r in _TRIALS)}), u AS (SELECT *, (store * 7 + item) % 9 AS bucket FROM k),
      m AS (SELECT g.rung, {_MOMENTS} FROM u, (VALUES (0, 1), (1, 3), (2, 9)) g(rung, below) WHERE bucket < below AND split = 'train' GROUP BY 1),
      f AS (SELECT trial, rung, {_RIDGE.format(r='reg')}, ma, mb, my FROM m, t),
      s AS MATERIALIZED (SELECT trial, f.rung, sqrt(avg(pow(y - (my + ca * (a - ma) + cb * (b - mb)), 2))) AS score FROM f JOIN (VALUES (0, 1), (1, 3), (2, 9)) g(rung, below) ON g.rung = f.rung, u WHERE bucket < below AND split = 'val' GROUP BY 1, 2),
      r0 AS (SELECT *, row_number() OVER (ORDER BY score, trial) <= 3 AS kept FROM s WHERE rung = 0),
      r1 AS (SELECT *, row_number() OVER (ORDER BY score, trial) <= 1 AS kept FROM s WHERE rung = 1 AND trial IN (SELECT trial FROM r0 WHERE kept)),
      r2 AS (SELECT *, row_number() OVER (ORDER BY score, trial) <= 1 AS kept FROM s WHERE rung = 2 AND trial IN (SELECT trial FROM r1 WHERE kept))
      SELECT trial, rung, score, CAST(kept AS VARCHAR) AS kept FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""",
)
def _(spark, d):
    frame = L.lag_frame(_split(spark, d), "unit_sales", (1, 7))
    trials = spark.createDataFrame(_TRIALS, "trial long, reg double")
    return G.halving_ridge(frame, "unit_sales", L.lag_names("unit_sales", (1, 7)), trials, (F.col("store") * 7 + F.col("item")) % 9)


@query(
    "l13_out_of_fold",
    "store:b item:b date:d yhat:f",
    f"""WITH {_LAGS}, m AS (SELECT fold, {_MOMENTS} FROM k, range(3) f(fold) WHERE split = 'train' AND (store + item) % 3 <> fold GROUP BY 1), c AS (SELECT *, {_RIDGE.format(r=0.5)} FROM m)
      SELECT store, item, date, my + ca * (a - ma) + cb * (b - mb) AS yhat FROM k JOIN c ON fold = (store + item) % 3""",
)
def _(spark, d):
    frame = L.lag_frame(_split(spark, d), "unit_sales", (1, 7))
    return G.out_of_fold_ridge(frame, "unit_sales", L.lag_names("unit_sales", (1, 7)), (F.col("store") + F.col("item")) % 3, 3, reg=0.5)


@query("l13_calibrated_suite", "Model:s Dataset:s Units:s Calibrated:s RMSE:f MAE:f R2:f")
def _(spark, d):
    return pipelines.calibrated_suite(L.lag_frame(_split(spark, d).withColumn("unit_sales", F.log1p("unit_sales")), "unit_sales", (1, 7, 14)), "unit_sales", L.lag_names("unit_sales", (1, 7, 14)), {"ridge_weak": 1e-3, "ridge_strong": 10.0}, (F.col("store") + F.col("item")) % 3, 3)


@query("l14_staged_boosting", "model:s stage:b rmse:f kept:s")
def _(spark, d):
    frame, features, out = L.lag_frame(_split(spark, d), "unit_sales", (1, 7)), L.lag_names("unit_sales", (1, 7)), None
    for model in ("boosting", "forest"):
        staged = G.fit_staged(frame, "unit_sales", features, model, stages=4)
        own = G.curve_rows(spark, staged).withColumn("model", F.lit(model)).withColumn("kept", F.col("kept").cast("string"))
        out = own if out is None else out.unionByName(own)
    return out


@query("f16_design_lags", "store:b item:b date:d y1:f y30:f promo30:f promo15:f", "SELECT store, item, date, y1, y30, promo30, promo15 FROM (SELECT store, item, date, lag(unit_sales, 1) OVER w AS y1, lag(unit_sales, 30) OVER w AS y30, coalesce(lag(onpromotion, 30) OVER w, 0) AS promo30, coalesce(lag(onpromotion, 15) OVER w, 0) AS promo15 FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY date)) WHERE y30 IS NOT NULL")
def _(spark, d):
    lags = L.design_lags(past=True, future=True)
    frame = L.lag_frame(X.panel(spark, d).withColumn("known", F.col("onpromotion")), "unit_sales", past=["onpromotion"], future=["known"], **lags)
    return frame.withColumnsRenamed({"unit_sales_lag_1": "y1", "unit_sales_lag_30": "y30", "onpromotion_lag_30": "promo30", "known_lag_15": "promo15"})


_MEDIANS = """sm AS (SELECT c, date, quantile_cont(unit_sales, 0.5) AS median FROM panel JOIN store_members USING (store) GROUP BY 1, 2),
  sk AS (SELECT store, c, row_number() OVER (PARTITION BY store ORDER BY c) AS k FROM (SELECT DISTINCT store, c FROM store_members)),
  sw AS (SELECT store, date, max(CASE WHEN k = 1 THEN median END) AS m1, max(CASE WHEN k = 2 THEN median END) AS m2 FROM sm JOIN sk USING (c) GROUP BY 1, 2)"""


@query(
    "l02_covariate_series",
    "store:b item:b split:s n:b unit_sales:f onpromotion:f dayofweek:f store_median_1:f store_median_2:f",
    f"""WITH {_MEDIANS}, e AS (SELECT store, item, min(date) AS a, max(date) AS b FROM panel GROUP BY 1, 2 HAVING count(*) >= 30 AND count(unit_sales) >= 15 AND stddev_samp(unit_sales) > 0),
      g AS (SELECT store, item, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
      f AS (SELECT g.store, g.item, g.date, coalesce(p.unit_sales, 0) AS unit_sales, coalesce(p.onpromotion, 0) AS onpromotion, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g.store, g.item) AS n FROM g LEFT JOIN panel p ON p.store = g.store AND p.item = g.item AND p.date = g.date WINDOW w AS (PARTITION BY g.store, g.item ORDER BY g.date)),
      s AS (SELECT *, CASE WHEN pos >= floor((n - 1) * 0.8) THEN 'val' ELSE 'train' END AS split FROM f),
      ok AS (SELECT store, item FROM s WHERE split = 'train' GROUP BY 1, 2 HAVING count(unit_sales) >= 15 AND stddev_samp(unit_sales) > 0)
      SELECT s.store, s.item, split, count(*) AS n, sum(unit_sales) AS unit_sales, sum(onpromotion) AS onpromotion, sum(isodow(s.date) - 1) AS dayofweek, sum(coalesce(m1, 0)) AS store_median_1, sum(coalesce(m2, 0)) AS store_median_2 FROM s JOIN ok USING (store, item) LEFT JOIN sw ON sw.store = s.store AND sw.date = s.date GROUP BY 1, 2, 3""",
)
def _(spark, d):
    panel, members = X.panel(spark, d), X.assignments(spark, d)
    expanded = P.with_memberships(panel, members, "store", "Store").withColumnRenamed("store_cluster_id", "cluster_id")
    path = scratch_path(spark, "medians")
    P.cluster_medians(expanded, "cluster_id", "unit_sales", "median").write.partitionBy("cluster_id").parquet(path)
    series, groups = L.with_covariates(panel, "unit_sales", {"store": spark.read.parquet(path)}, members, past=["onpromotion"])
    told = ["unit_sales", "onpromotion", *(c for c in groups["future"] if c == "dayofweek" or c.startswith("store_"))]
    return series.groupBy("store", "item", "split").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in told])


# ------------------------------------------------------------------ calibration


@query(
    "m09_isotonic_blocks",
    "low:f high:f weight:f value:f",
    """WITH p AS (SELECT floor(yhat / 4) * 4 AS x, count(*) AS w, sum(y) AS t FROM split_fc WHERE split = 'val' AND yhat IS NOT NULL GROUP BY 1),
      o AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(t) OVER (ORDER BY x) AS ct FROM p),
      ab AS (SELECT a.i AS a, b.i AS b, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) AS m FROM o a JOIN o b ON a.i <= b.i),
      f AS (SELECT i, max(least_m) AS value FROM (SELECT o.i, ab.a, min(m) AS least_m FROM o JOIN ab ON ab.a <= o.i AND ab.b >= o.i GROUP BY 1, 2) GROUP BY 1)
      SELECT min(x) AS low, max(x) AS high, sum(w) AS weight, round(value, 9) AS value FROM o JOIN f USING (i) GROUP BY round(value, 9)""",
)
def _(spark, d):
    rows = X.forecasts(spark, d).where("split = 'val' and yhat is not null").withColumn("x", F.floor(F.col("yhat") / 4) * 4)
    return I.isotonic_blocks(rows, "x", "y")


# ------------------------------------------------------------------ scalers, feature groups, checks, samples

_SCALE = {"minmax": ["unit_sales"], "standard": ["onpromotion"], "robust": ["item"]}


@query(
    "n10_scalers",
    "store:b item:b date:d unit_sales:f onpromotion:f back:f",
    """SELECT store, item, date, (ln(1 + unit_sales) - a) / (b - a) AS unit_sales, (onpromotion - m) / s AS onpromotion, unit_sales AS back
      FROM panel, (SELECT min(ln(1 + unit_sales)) AS a, max(ln(1 + unit_sales)) AS b, avg(onpromotion) AS m, stddev_pop(onpromotion) AS s FROM panel WHERE date < DATE '1998-01-01')""",
)
def _(spark, d):
    panel = X.panel(spark, d)
    fitted = PanelScaler(groups=_SCALE, logs=["unit_sales"], train="date < date'1998-01-01'").fit(panel)
    path = scratch_path(spark, "scaler")
    fitted.save(path)
    scaled = PanelScalerModel.load(path).transform(panel.withColumn("number", F.col("item")))
    back = fitted.inverse_transform(scaled, only=["unit_sales"])
    return scaled.select("store", F.col("number").alias("item"), "date", "unit_sales", "onpromotion").join(back.select("store", F.col("number").alias("item"), "date", F.col("unit_sales").alias("back")), ["store", "item", "date"])


@query("p07_feature_groups", "feature_group:s place:b name:s total:f", "SELECT * FROM (SELECT 'sales' AS feature_group, 0 AS place, 'unit_sales' AS name, sum(unit_sales) AS total FROM panel UNION ALL SELECT 'sales', 1, 'onpromotion', sum(onpromotion) FROM panel UNION ALL SELECT 'dimension', 0, 'cluster', sum(cluster) FROM panel JOIN stores USING (store) UNION ALL SELECT 'all', 0, 'cluster', sum(cluster) FROM panel JOIN stores USING (store) UNION ALL SELECT 'all', 1, 'unit_sales', sum(unit_sales) FROM panel UNION ALL SELECT 'all', 2, 'onpromotion', sum(onpromotion) FROM panel)")
def _(spark, d):
    sales = R.with_groups(X.panel(spark, d), {"sales": ["unit_sales", "onpromotion"]})
    path = scratch_path(spark, "features")
    R.with_groups(sales.join(X.stores(spark, d).select("store", "cluster"), "store"), {"dimension": ["cluster"], "all": ["cluster", "unit_sales", "onpromotion"]} | R.groups_of(sales)).write.parquet(path)
    back = spark.read.parquet(path)
    names = [(g, i, c) for g, columns in R.groups_of(back).items() for i, c in enumerate(columns)]
    cell = lambda g, i, c: F.struct(F.lit(g).alias("feature_group"), F.lit(i).alias("place"), F.lit(c).alias("name"), F.sum(c).cast("double").alias("total"))
    return back.agg(F.array(*[cell(*n) for n in names]).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


@query("j13_many_to_one", "store:b item:b date:d cluster_mean:f", "SELECT store, item, date, m AS cluster_mean FROM daily JOIN labels2 USING (store, item) JOIN (SELECT store_cluster, item_cluster, avg(unit_sales) AS m FROM daily JOIN labels2 USING (store, item) GROUP BY 1, 2) USING (store_cluster, item_cluster)")
def _(spark, d):
    rows = X.daily(spark, d).join(X.labels2(spark, d), ["store", "item"])
    means = rows.groupBy("store_cluster", "item_cluster").agg(F.avg("unit_sales").alias("unit_sales"))
    return P.with_cluster_mean(rows, "unit_sales", means=means)


@query("p21_bottom_k", "store:b item:b date:d unit_sales:f", "SELECT store, item, date, unit_sales FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY md5(concat_ws('|', CAST(store AS VARCHAR), CAST(item AS VARCHAR), CAST(date AS VARCHAR), '5')), store, item, date) AS q FROM panel) WHERE q <= 20")
def _(spark, d):
    return P.bottom_k(X.panel(spark, d), 20, by=["store"], seed=5)


@query("c35_scatter_sample", "feature:b store:b item:b value:f xhat:f", "SELECT c AS feature, store, item, value, xhat FROM (SELECT *, avg(value) OVER (PARTITION BY r, c) AS xhat, row_number() OVER (PARTITION BY c ORDER BY md5(concat_ws('|', CAST(store AS VARCHAR), CAST(item AS VARCHAR), '3')), store, item) AS q FROM blocked) WHERE q <= 15")
def _(spark, d):
    cells = B.block_means(X.blocked(spark, d)).withColumnRenamed("c", "feature")
    return P.bottom_k(cells, 15, by=["feature"], key=["store", "item"], seed=3)


@query("a36_profiles_by_hierarchy", "cluster_id:b size:b a:f b:f")
def _(spark, d):
    x = X.sales_cells(spark, d).select("store", F.col("value").alias("a"), (F.col("value") * F.col("item")).alias("b"))
    return B.cluster_profiles(x, X.assignments(spark, d), "Store", "store", ["a", "b"], keep=3, by="hierarchy")


# ------------------------------------------------------------------ block filters and fit summaries


def _model(spark, d):
    return X.sales_cells(spark, d), X.row_members(spark, d), X.col_members(spark, d), X.blocks(spark, d)


_TOP = "(SELECT r, c FROM blocks WHERE abs(b) >= (SELECT min(a) FROM (SELECT abs(b) AS a FROM blocks ORDER BY a DESC LIMIT 6)))"
_BEST = "row_number() OVER (PARTITION BY store, item ORDER BY (value - fit) * f.b - 0.5 * f.b * f.b DESC, f.r, f.c) AS rn FROM (SELECT *, sum(b) OVER (PARTITION BY store, item) AS fit FROM cand) f"


@query("c20_filter_blocks", "store:b item:b r:b c:b", f"SELECT store, item, coalesce(r, -1) AS r, coalesce(c, -1) AS c FROM sales_cells LEFT JOIN (SELECT * FROM (SELECT store, item, f.r, f.c, {_BEST} JOIN {_TOP} t ON t.r = f.r AND t.c = f.c) WHERE rn = 1) USING (store, item)")
def _(spark, d):
    return B.filter_blocks(*_model(spark, d), strategy="top_k", keep=6, n_cols=5)[1]


@query("c16_predict_blocks", "store:b item:b r:b c:b", f"SELECT store, item, r, c FROM (SELECT store, item, f.r, f.c, {_BEST.replace('FROM cand', 'FROM (SELECT * REPLACE (CASE WHEN item % 5 = 0 THEN 0 ELSE value END AS value) FROM cand)')}) WHERE rn = 1")
def _(spark, d):
    x, *model = _model(spark, d)
    return B.predict_blocks(x.withColumn("value", F.when(F.col("item") % 5 != 0, F.col("value"))), *model, n_cols=5)


@query(
    "c24_fit_summary",
    "sparsity:f weak_fraction:f coverage:f",
    f"""SELECT (SELECT avg(CASE WHEN abs(b) < 0.05 THEN 1.0 ELSE 0.0 END) FROM blocks) AS sparsity, (SELECT avg(CASE WHEN abs(b) < 0.99 * m THEN 1.0 ELSE 0.0 END) FROM blocks, (SELECT max(abs(b)) AS m FROM blocks)) AS weak_fraction,
      (SELECT count(DISTINCT (store, item)) FROM cand JOIN {_TOP} USING (r, c)) / (SELECT CAST(count(*) AS DOUBLE) FROM sales_cells) AS coverage""",
)
def _(spark, d):
    model = _model(spark, d)
    return B.fit_summary(model[3], B.filter_blocks(*model, strategy="top_k", keep=6, n_cols=5)[1], tol=0.05, weak=0.99)


@query(
    "c40_column_silhouette",
    "silhouette:f",
    """SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT item, max(CASE WHEN c = c2 THEN dd END) AS a, min(CASE WHEN c <> c2 THEN dd END) AS b FROM (SELECT item, item % 4 AS c, i2 % 4 AS c2, avg(dist) AS dd FROM (SELECT x.item, y.item AS i2, sum(abs(x.value - y.value)) AS dist FROM sales_cells x JOIN sales_cells y ON x.store = y.store AND x.item <> y.item GROUP BY 1, 2) GROUP BY 1, 2, 3) GROUP BY 1)""",
)
def _(spark, d):
    x = X.sales_cells(spark, d)
    alone = x.select("store").distinct().withColumn("r", F.col("store"))  # every row cluster has one member, so the columns decide
    return B.safe_silhouette(x, alone, x.select("item").distinct().withColumn("c", F.col("item") % 4), "manhattan")


# ------------------------------------------------------------------ table functions and streams


@query("w09_windows_udtf", "store:b item:b window_id:b start_date:d end_date:d n_rows:b", """SELECT store, item, w AS window_id, CAST(a + CAST(w * 30 AS INTEGER) AS DATE) AS start_date, CAST(a + CAST(w * 30 + 29 AS INTEGER) AS DATE) AS end_date, (SELECT count(*) FROM panel p WHERE p.store = s.store AND p.item = s.item AND date_diff('day', s.a, p.date) // 30 = w) AS n_rows FROM
      (SELECT store, item, a, unnest(range(n + 1)) AS w FROM (SELECT store, item, min(date) AS a, date_diff('day', min(date), max(date)) // 30 AS n FROM panel GROUP BY 1, 2)) s""")
def _(spark, d):
    pipelines.register_series_windows(spark)
    X.panel(spark, d).select("store", "item", "date").createOrReplaceTempView("_panel_dates")
    return spark.sql("SELECT * FROM series_windows(rows => TABLE(_panel_dates), days => 30)")


@query("t03_online_median", "event_type:s n:b estimate:f", "SELECT event_type, count(value) AS n, list_reduce(list_prepend(0.0::DOUBLE, list(CAST(value AS DOUBLE) ORDER BY ts, value)), lambda acc, x: acc + 0.01 * sign(x - acc)) AS estimate FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, d):
    T.use_rocksdb(spark)
    schema = X.table(spark, d, "events").schema
    stream = T.event_stream(spark, d, schema, name="events.parquet")
    path = scratch_path(spark, "online")
    table = T.drain(T.online_median_state(stream, "event_type", "value", eta=0.01), f"online_{path[-32:]}", path, "update")
    return table.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by("estimate", "n").alias("estimate"))
