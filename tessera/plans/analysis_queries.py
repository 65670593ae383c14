"""Queries of series statistics, matrices, metrics, block analytics, solvers, forecasts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators import blocks as B
from tessera.operators import clustering as K
from tessera.operators import forecasting as L
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.operators import statistics as A
from tessera.plans import fixtures as X
from tessera.plans.spec import Query
from tessera.streaming import streams as T

QUERIES: list[Query] = []


def query(name: str, columns: str, sql: str | None = None):
    def add(build):
        QUERIES.append(Query(name, columns, build, sql))
        return build

    return add


def _weeks(spark, d):
    return S.weekly(X.panel(spark, d))


# ------------------------------------------------------------------ statistics and reports


@query("a02_value_shares", "state:s type:s n_rows:b percentage:f", "SELECT * FROM (SELECT state, type, count(*) AS n_rows, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY state) AS percentage, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, type) AS rn FROM panel JOIN stores USING (store) GROUP BY 1, 2) WHERE rn <= 2")
def _(spark, d):
    return A.value_shares(P.with_dimension(X.panel(spark, d), X.stores(spark, d), "store", ["state", "type"]), "state", "type", 2)


@query("a03_value_counts", "item:b n_rows:b percentage:f", "SELECT item, count(*) AS n_rows, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM panel GROUP BY 1")
def _(spark, d):
    return A.value_counts(X.panel(spark, d), "item")


@query("a04_top_count_shares", "item:b n_rows:b percentage:f", "SELECT * FROM (SELECT item, count(*) AS n_rows, count(*) * 100.0 / sum(count(*)) OVER () AS percentage FROM panel GROUP BY 1) ORDER BY n_rows DESC, item LIMIT 5")
def _(spark, d):
    return A.top_count_shares(X.panel(spark, d), "item", 5)


@query(
    "a09_robust_stats",
    "store:b item:b med:f std:f iqr:f avg_g:f up:f side:f down:f ud:f",
    """SELECT store, item, quantile_cont(growth_rate, 0.5) AS med, CASE WHEN count(growth_rate) > 1 THEN stddev_pop(growth_rate) END AS std,
      CASE WHEN count(growth_rate) > 1 THEN quantile_cont(growth_rate, 0.75) - quantile_cont(growth_rate, 0.25) END AS iqr, avg(growth_rate) AS avg_g,
      avg(CASE WHEN growth_rate IS NOT NULL THEN CASE WHEN growth_rate > 0.05 THEN 1.0 ELSE 0.0 END END) AS up, avg(CASE WHEN growth_rate IS NOT NULL THEN CASE WHEN abs(growth_rate) <= 0.05 THEN 1.0 ELSE 0.0 END END) AS side,
      avg(CASE WHEN growth_rate IS NOT NULL THEN CASE WHEN growth_rate < -0.05 THEN 1.0 ELSE 0.0 END END) AS down, count(CASE WHEN growth_rate > 0 THEN 1 END) * 1.0 / nullif(count(CASE WHEN growth_rate < 0 THEN 1 END), 0) AS ud FROM weeks GROUP BY 1, 2""",
)
def _(spark, d):
    g = "growth_rate"
    return _weeks(spark, d).groupBy("store", "item").agg(C.safe_median(g).alias("med"), C.safe_std(g).alias("std"), C.safe_iqr(g).alias("iqr"), C.safe_mean(g).alias("avg_g"), C.frac_up(g, 0.05).alias("up"), C.frac_sideways(g, 0.05).alias("side"), C.frac_down(g, 0.05).alias("down"), C.up_to_down(g).alias("ud"))


@query(
    "a18_tau_diagnostics",
    "tau:f frac_up:f frac_sideways:f frac_down:f mean_abs:f mean_soft:f l1_reduction:f var_soft:f churn_median:f churn_p10:f churn_p90:f",
    """SELECT * FROM (WITH g AS (SELECT store, item, week_end, growth_rate AS g, tau FROM weeks, (VALUES (0.01), (0.05), (0.1)) t(tau)),
      r AS (SELECT *, CASE WHEN g > tau THEN 1 WHEN g < -tau THEN -1 ELSE 0 END AS dir, sign(g) * greatest(abs(g) - tau, 0) AS soft FROM g),
      c AS (SELECT *, lag(dir) OVER (PARTITION BY tau, store, item ORDER BY week_end) AS bef FROM r),
      o AS (SELECT tau, avg(CASE WHEN g > tau THEN 1.0 ELSE 0.0 END) AS frac_up, avg(CASE WHEN abs(g) < tau THEN 1.0 ELSE 0.0 END) AS frac_sideways, avg(CASE WHEN g < -tau THEN 1.0 ELSE 0.0 END) AS frac_down,
        avg(abs(g)) AS mean_abs, avg(CASE WHEN g IS NOT NULL THEN abs(soft) END) AS mean_soft, (sum(abs(g)) - sum(CASE WHEN g IS NOT NULL THEN abs(soft) END)) / nullif(sum(abs(g)), 0) AS l1_reduction, var_pop(CASE WHEN g IS NOT NULL THEN soft END) AS var_soft FROM r GROUP BY 1),
      s AS (SELECT tau, store, item, count(CASE WHEN dir <> 0 AND bef <> 0 AND dir <> bef THEN 1 END) * 1.0 / nullif(count(CASE WHEN dir <> 0 AND bef <> 0 THEN 1 END), 0) AS churn FROM c GROUP BY 1, 2, 3)
      SELECT o.*, quantile_cont(churn, 0.5) AS churn_median, quantile_cont(churn, 0.1) AS churn_p10, quantile_cont(churn, 0.9) AS churn_p90 FROM o JOIN s USING (tau) GROUP BY ALL)""",
)
def _(spark, d):
    return A.tau_diagnostics(_weeks(spark, d), [0.01, 0.05, 0.1])


_GF = """WITH s0 AS (SELECT store, item, week_end, growth_rate AS g, avg(growth_rate) OVER (PARTITION BY store, item ORDER BY week_end ROWS 3 PRECEDING) AS s, row_number() OVER (PARTITION BY store, item ORDER BY week_end) - 1 AS pos FROM weeks),
      s1 AS (SELECT *, lag(s, 1) OVER w AS s_1, lag(s, 4) OVER w AS s_4, lag(s, 12) OVER w AS s_12, sign(s) AS sg, lag(sign(s)) OVER w AS sg_1, sin(2*pi()*pos/52) AS sn, cos(2*pi()*pos/52) AS cs FROM s0 WINDOW w AS (PARTITION BY store, item ORDER BY week_end)),
      c AS (SELECT store, item, count(s) AS n, min(s) < max(s) AS varied,
        {ac1} AS ac1, {ac4} AS ac4, {ac12} AS ac12, {sac} AS sac, {tr} AS tr, {sc} AS sc, {cc} AS cc,
        quantile_cont(g, 0.5) AS gr_median, CASE WHEN count(g) > 1 THEN stddev_pop(g) END AS gr_std, CASE WHEN count(g) > 1 THEN quantile_cont(g, 0.75) - quantile_cont(g, 0.25) END AS gr_iqr,
        avg(CASE WHEN g IS NOT NULL THEN CASE WHEN g > 0.05 THEN 1.0 ELSE 0.0 END END) AS frac_up, count(CASE WHEN g > 0 THEN 1 END) * 1.0 / nullif(count(CASE WHEN g < 0 THEN 1 END), 0) AS up_to_down_ratio FROM s1 GROUP BY 1, 2)"""


def _sql_corr(a: str, b: str, least: int) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN count({x}) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


_GF = _GF.format(ac1=_sql_corr("s", "s_1", 3), ac4=_sql_corr("s", "s_4", 3), ac12=_sql_corr("s", "s_12", 3), sac=_sql_corr("sg", "sg_1", 3), tr=_sql_corr("s", "CAST(pos AS DOUBLE)", 5), sc=_sql_corr("s", "sn", 8), cc=_sql_corr("s", "cs", 8))


@query(
    "a19_growth_features",
    "store:b item:b gr_median:f gr_std:f gr_iqr:f frac_up:f up_to_down_ratio:f ac_lag1:f ac_lag4:f ac_lag12:f trend_slope:f seasonal_strength:f",
    f"""SELECT * FROM ({_GF} SELECT store, item, gr_median, gr_std, gr_iqr, frac_up, up_to_down_ratio, CASE WHEN n >= 4 THEN ac1 END AS ac_lag1, CASE WHEN n >= 6 AND varied THEN ac4 WHEN n >= 4 THEN sac END AS ac_lag4,
      CASE WHEN n >= 14 THEN ac12 END AS ac_lag12, CASE WHEN n >= 5 THEN tr END AS trend_slope, CASE WHEN n >= 26 THEN sqrt(sc*sc + cc*cc) END AS seasonal_strength FROM c)""",
)
def _(spark, d):
    return A.growth_features(_weeks(spark, d))


@query("a20_autocorrelation", "store:b item:b ac4:f", f"SELECT store, item, {_sql_corr('x', 'x4', 3)} AS ac4 FROM (SELECT store, item, unit_sales AS x, lag(unit_sales, 4) OVER (PARTITION BY store, item ORDER BY date) AS x4 FROM panel) GROUP BY 1, 2")
def _(spark, d):
    return S.lags(X.panel(spark, d), "unit_sales", [4]).groupBy("store", "item").agg(C.safe_corr("unit_sales", "unit_sales_lag_4", 3).alias("ac4"))


@query(
    "a24_feature_diagnostics",
    "feature:s nan_frac:f support:b dropped:s",
    f"""SELECT * FROM ({_GF} , f AS (SELECT gr_median, CASE WHEN n >= 14 THEN ac12 END AS ac_lag12, CASE WHEN n >= 26 THEN sqrt(sc*sc + cc*cc) END AS seasonal_strength FROM c)
      SELECT 'gr_median' AS feature, 1 - count(gr_median) * 1.0 / count(*) AS nan_frac, count(gr_median) AS support, CASE WHEN 1 - count(gr_median) * 1.0 / count(*) >= 0.95 THEN 'true' ELSE 'false' END AS dropped FROM f
      UNION ALL SELECT 'ac_lag12', 1 - count(ac_lag12) * 1.0 / count(*), count(ac_lag12), CASE WHEN 1 - count(ac_lag12) * 1.0 / count(*) >= 0.95 THEN 'true' ELSE 'false' END FROM f
      UNION ALL SELECT 'seasonal_strength', 1 - count(seasonal_strength) * 1.0 / count(*), count(seasonal_strength), CASE WHEN 1 - count(seasonal_strength) * 1.0 / count(*) >= 0.95 THEN 'true' ELSE 'false' END FROM f)""",
)
def _(spark, d):
    return A.feature_diagnostics(A.growth_features(_weeks(spark, d)), ["gr_median", "ac_lag12", "seasonal_strength"])


@query("a26_imputed_features", "store:b item:b gr_median:f ac_lag12:f", f"SELECT * FROM ({_GF}, f AS (SELECT store, item, gr_median, CASE WHEN n >= 14 THEN ac12 END AS a FROM c) SELECT store, item, coalesce(gr_median, (SELECT quantile_cont(gr_median, 0.5) FROM f)) AS gr_median, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM f)) AS ac_lag12 FROM f)")
def _(spark, d):
    return A.impute_medians(A.growth_features(_weeks(spark, d)), ["gr_median", "ac_lag12"])


@query("a27_mav", "store:b item:b mav:f", "SELECT store, item, coalesce(avg(CASE WHEN growth_rate >= 0 THEN growth_rate END), 0) AS mav FROM daily GROUP BY 1, 2")
def _(spark, d):
    return A.mav_by_pair(X.daily(spark, d), "growth_rate")


_MAVC = "SELECT store_cluster, item_cluster, avg(mav) AS mav_mean, var_samp(mav) AS mav_var, count(*) AS n_pairs FROM (SELECT store, item, coalesce(avg(CASE WHEN growth_rate >= 0 THEN growth_rate END), 0) AS mav FROM daily GROUP BY 1, 2) JOIN labels2 USING (store, item) GROUP BY 1, 2"


@query("a29_mav_by_cluster", "store_cluster:b item_cluster:b mav_mean:f mav_var:f n_pairs:b", _MAVC)
def _(spark, d):
    return A.mav_by_cluster(X.daily(spark, d), "growth_rate", X.labels2(spark, d))


@query(
    "a31_variance_ratio",
    "between:f within:f ratio:f".replace("between", "var_between").replace("within", "var_within"),
    f"""SELECT vb AS var_between, vw AS var_within, vb / vw AS ratio FROM (SELECT sum(n_pairs * (mav_mean - m) * (mav_mean - m)) / (sum(n_pairs) - 1) AS vb, sum((n_pairs - 1) * coalesce(mav_var, 0)) / nullif(sum(n_pairs) - count(*), 0) AS vw
      FROM (SELECT *, sum(mav_mean * n_pairs) OVER () / sum(n_pairs) OVER () AS m FROM ({_MAVC})))""",
)
def _(spark, d):
    return A.variance_ratio(A.mav_by_cluster(X.daily(spark, d), "growth_rate", X.labels2(spark, d))).withColumnsRenamed({"between": "var_between", "within": "var_within"})


@query("a30_block_per_pair", "store:b item:b unit_sales:f block_id:b", "SELECT store, item, avg(unit_sales) AS unit_sales, store % 3 * 4 + item % 4 AS block_id FROM panel GROUP BY 1, 2")
def _(spark, d):
    return A.one_block_per_pair(X.panel(spark, d).withColumn("block_id", F.col("store") % 3 * 4 + F.col("item") % 4), "unit_sales")


def _metric_rows(spark, d):
    f = X.forecasts(spark, d).where("yhat is not null")
    rows = f.groupBy("store", "item").agg(E.rmse("y", "yhat").alias("RMSE"), E.mae("y", "yhat").alias("MAE"))
    return rows.withColumn("Setting", F.concat(F.lit("s"), F.col("store") % 2)).withColumn("Model", F.concat(F.lit("m"), F.col("item") % 3))


_MR = "SELECT 's' || (store % 2) AS Setting, 'm' || (item % 3) AS Model, sqrt(avg((y - yhat) * (y - yhat))) AS RMSE, avg(abs(y - yhat)) AS MAE FROM fc WHERE yhat IS NOT NULL GROUP BY store, item"


@query("a33_compare_models", "Setting:s Model:s RMSE_mean:f RMSE_std:f MAE_mean:f MAE_std:f", f"SELECT Setting, Model, avg(RMSE) AS RMSE_mean, stddev_samp(RMSE) AS RMSE_std, avg(MAE) AS MAE_mean, stddev_samp(MAE) AS MAE_std FROM ({_MR}) GROUP BY 1, 2")
def _(spark, d):
    return A.compare_models(_metric_rows(spark, d), ["RMSE", "MAE"])


@query("a33_compare_models_median", "Setting:s Model:s RMSE_median:f RMSE_std:f", f"SELECT Setting, Model, quantile_cont(RMSE, 0.5) AS RMSE_median, stddev_samp(RMSE) AS RMSE_std FROM ({_MR}) GROUP BY 1, 2")
def _(spark, d):
    return A.compare_models(_metric_rows(spark, d), ["RMSE"], "median")


@query("a34_run_summary", "Model:s n_success:b RMSE_mean:f MAE_mean:f", f"SELECT Model, count(*) AS n_success, avg(RMSE) AS RMSE_mean, avg(MAE) AS MAE_mean FROM ({_MR}) WHERE RMSE IS NOT NULL AND MAE IS NOT NULL GROUP BY 1")
def _(spark, d):
    return A.run_summary(_metric_rows(spark, d), ["RMSE", "MAE"])


@query("a35_clusters_per_item", "factor_name:s lo:b mean:f hi:b iqr:f", "SELECT f AS factor_name, min(n) AS lo, round(avg(n), 2) AS mean, max(n) AS hi, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 2) AS iqr FROM (SELECT 'Store' AS f, store AS k, count(c) AS n FROM store_members GROUP BY 1, 2 UNION ALL SELECT 'SKU', item, count(c) FROM item_members GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return A.cluster_count_stats(X.assignments(spark, d)).withColumnsRenamed({"min": "lo", "max": "hi"})


@query("a36_cluster_profiles", "cluster_id:b size:b unit_sales:f", "SELECT c AS cluster_id, count(*) AS size, avg(m) AS unit_sales FROM (SELECT store, avg(unit_sales) AS m FROM panel GROUP BY 1) JOIN store_members USING (store) GROUP BY 1")
def _(spark, d):
    return B.cluster_profiles(X.panel(spark, d), X.assignments(spark, d), "Store", "store", ["unit_sales"])


@query("a40_gini", "store:b gini:f", "SELECT store, sum((2 * rk - n - 1) * t) / (max(n) * sum(t)) AS gini FROM (SELECT store, t, row_number() OVER (PARTITION BY store ORDER BY t) AS rk, count(*) OVER (PARTITION BY store) AS n FROM (SELECT store, item, sum(unit_sales) AS t FROM panel GROUP BY 1, 2)) GROUP BY 1")
def _(spark, d):
    t = X.panel(spark, d).groupBy("store", "item").agg(F.sum("unit_sales").alias("t"))
    return t.groupBy("store").agg(C.gini(F.collect_list("t")).alias("gini"))


@query("a41_quartiles", "month:b q1:f median:f q3:f", "SELECT month(date) AS month, quantile_cont(unit_sales, 0.25) AS q1, quantile_cont(unit_sales, 0.5) AS median, quantile_cont(unit_sales, 0.75) AS q3 FROM panel GROUP BY 1")
def _(spark, d):
    return A.quartiles(X.panel(spark, d).withColumn("month", F.month("date")), ["month"], "unit_sales")


@query(
    "a42_mean_interval",
    "grp:b mean:f half_width:f",
    """SELECT grp, avg(unit_sales) AS mean, t * stddev_samp(unit_sales) / sqrt(count(*)) AS half_width
      FROM (SELECT *, CAST(least(row_number() OVER (ORDER BY date, store, item) - 1, 27) AS BIGINT) // 4 AS grp FROM panel QUALIFY row_number() OVER (ORDER BY date, store, item) <= 40)
      JOIN (VALUES (0, 3.18244630528371), (1, 3.18244630528371), (2, 3.18244630528371), (3, 3.18244630528371), (4, 3.18244630528371), (5, 3.18244630528371), (6, 2.13144954555978)) q(grp, t) USING (grp) GROUP BY grp, t""",
)
def _(spark, d):
    at = F.row_number().over(W.orderBy("date", "store", "item")) - 1
    few = X.panel(spark, d).orderBy("date", "store", "item").limit(40).withColumn("grp", F.floor(F.least(at, F.lit(27)) / 4))  # six groups of 4 and one of 16
    return A.mean_interval(few, ["grp"], "unit_sales")


@query("a44_histogram", "bin:b n:b", "SELECT least(floor((x - lo) / (hi - lo) * 50) + 1, 50) AS bin, count(*) AS n FROM (SELECT unit_sales AS x FROM panel), (SELECT min(unit_sales) AS lo, max(unit_sales) AS hi FROM panel) GROUP BY 1")
def _(spark, d):
    return A.histogram(X.panel(spark, d), "unit_sales")


@query("a45_nan_stats", "col:s n_nan:b n_total:b n_finite:b", "SELECT 'growth_rate' AS col, count(*) - count(growth_rate) AS n_nan, count(*) AS n_total, count(growth_rate) AS n_finite FROM weeks UNION ALL SELECT 'sales_wk', count(*) - count(sales_wk), count(*), count(sales_wk) FROM weeks")
def _(spark, d):
    return A.nan_stats(_weeks(spark, d), ["growth_rate", "sales_wk"]).withColumnRenamed("column", "col")


@query("a47_one_to_one", "is_unique:s", "SELECT CASE WHEN max(n) <= 1 THEN 'true' ELSE 'false' END AS is_unique FROM (SELECT city, count(DISTINCT state) AS n FROM stores GROUP BY 1)")
def _(spark, d):
    return A.one_to_one(X.stores(spark, d), "city", "state").withColumnRenamed("unique", "is_unique")


@query("a48_first_present", "store:b item:b x:f", "SELECT store, item, arg_min(x, date) AS x FROM (SELECT *, CASE WHEN unit_sales > 30 THEN unit_sales END AS x FROM panel) WHERE x IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return A.first_present(X.panel(spark, d).withColumn("x", F.when(F.col("unit_sales") > 30, F.col("unit_sales"))), "x", "date")


@query("a49_mode", "store:b mode:f", "SELECT store, unit_sales AS mode FROM (SELECT store, unit_sales, row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, unit_sales) AS rn FROM panel GROUP BY 1, 2) WHERE rn = 1")
def _(spark, d):
    return A.mode_least(X.panel(spark, d), ["store"], "unit_sales")


@query("a51_cluster_sizes", "cluster:b size:b", "SELECT k AS cluster, count(store) AS size FROM range(9) t(k) LEFT JOIN stores ON cluster = k GROUP BY 1")
def _(spark, d):
    return A.cluster_sizes(X.stores(spark, d), "cluster", 9)


@query("a53_daily_mean", "day:d mean:f", "SELECT CAST(ts AS DATE) AS day, avg(value) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return X.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"))


# ------------------------------------------------------------------ matrices


@query("r01_cells", "store:b item:b value:f n:b", "SELECT * FROM cells")
def _(spark, d):
    return M.cells(X.daily(spark, d), "growth_rate")


@query("r02_wide_medians", "date:d m_0:f m_1:f m_2:f", "SELECT date, " + ", ".join(f"quantile_cont(CASE WHEN store % 3 = {k} THEN growth_rate END, 0.5) AS m_{k}" for k in range(3)) + " FROM daily GROUP BY 1")
def _(spark, d):
    med = X.daily(spark, d).groupBy("date", (F.col("store") % 3).alias("k")).agg(C.safe_median("growth_rate").alias("m"))
    return M.to_wide(med, "date", "k", "m", [0, 1, 2], "m_")


@query("r03_unpivot", "store:b item:s value:f", "SELECT store, CAST(item AS VARCHAR) AS item, value FROM sales_cells WHERE item IN (1, 2, 3)")
def _(spark, d):
    return M.to_long(M.to_wide(X.sales_cells(spark, d), "store", "item", "value", [1, 2, 3]), "store", ["1", "2", "3"])


@query("r04_on_grid", "store:b item:b value:f", "SELECT s.store, i.item, coalesce(value, 0) AS value FROM (SELECT DISTINCT store FROM sales_cells) s CROSS JOIN (SELECT DISTINCT item FROM sales_cells) i LEFT JOIN sales_cells c ON c.store = s.store AND c.item = i.item")
def _(spark, d):
    return M.on_grid(X.sales_cells(spark, d))


@query("r06_tensor", "store:s item:s feature:s value:f", "SELECT CAST(store AS VARCHAR) AS store, CAST(item AS VARCHAR) AS item, feature, value FROM (SELECT store, item, 'unit_sales' AS feature, arg_max(unit_sales, date) AS value FROM panel GROUP BY 1, 2 UNION ALL SELECT store, item, 'growth_rate', arg_max(growth_rate, date) FROM daily GROUP BY 1, 2)")
def _(spark, d):
    return M.to_tensor(X.daily(spark, d), ["unit_sales", "growth_rate"], order="date")


@query("r07_reorder", "store:b item:b row_pos:b col_pos:b", "SELECT store, item, dense_rank() OVER (ORDER BY store % 3, store) - 1 AS row_pos, dense_rank() OVER (ORDER BY item % 4, item) - 1 AS col_pos FROM sales_cells")
def _(spark, d):
    x = X.sales_cells(spark, d)
    rows = x.select("store").distinct().withColumn("row_cluster", F.col("store") % 3)
    cols = x.select("item").distinct().withColumn("col_cluster", F.col("item") % 4)
    return M.reorder(x, rows, cols)


@query(
    "r08_pattern_order",
    "store:b position:b",
    """WITH b AS (SELECT store, item, store % 3 * 4 + item % 4 AS block_id FROM sales_cells),
      m AS (SELECT store, block_id AS modal FROM (SELECT store, block_id, row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, block_id) AS q FROM b GROUP BY 1, 2) WHERE q = 1),
      p AS (SELECT store, min(block_id) AS least, avg(block_id) AS mean, list(block_id ORDER BY item) AS pattern FROM b GROUP BY 1)
      SELECT store, row_number() OVER (ORDER BY modal, least, mean, pattern, store) - 1 AS position FROM p JOIN m USING (store)""",
)
def _(spark, d):
    return B.row_pattern_order(X.sales_cells(spark, d).select("store", "item", (F.col("store") % 3 * 4 + F.col("item") % 4).alias("block_id")))


def _z(by: str, x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY {by})) / CASE WHEN sqrt(greatest(avg({x}*{x}) OVER (PARTITION BY {by}) - pow(avg({x}) OVER (PARTITION BY {by}), 2), 0)) > 0 THEN sqrt(greatest(avg({x}*{x}) OVER (PARTITION BY {by}) - pow(avg({x}) OVER (PARTITION BY {by}), 2), 0)) ELSE 1e-8 END"


@query("n01_zscore", "store:b item:b value:f", f"SELECT store, item, {_z('store', 'value')} AS value FROM sales_cells")
def _(spark, d):
    return M.zscore(X.sales_cells(spark, d), "store")


_IMP = "SELECT s.store, i.item, CASE WHEN coalesce(n, 0) > 0 THEN value ELSE m END AS value FROM (SELECT DISTINCT store FROM cells) s CROSS JOIN (SELECT DISTINCT item FROM cells) i LEFT JOIN cells c ON c.store = s.store AND c.item = i.item LEFT JOIN (SELECT item AS it, quantile_cont(value, 0.5) AS m FROM cells WHERE n > 0 GROUP BY 1) md ON md.it = i.item"


@query("n02_imputed", "store:b item:b value:f", _IMP)
def _(spark, d):
    return M.impute_by_column(M.cells(X.daily(spark, d), "growth_rate"))


@query("n03_normalised", "store:b item:b value:f", f"SELECT store, item, {_z('item', 'z')} AS value FROM (SELECT store, item, {_z('store', 'v')} AS z FROM (SELECT store, item, coalesce(value, 0) AS v FROM ({_IMP})))")
def _(spark, d):
    return M.normalise(X.daily(spark, d), "growth_rate")


@query("n04_panel_normalised", "store:b item:b date:d normalised:f", f"SELECT p.store, p.item, p.date, value AS normalised FROM panel p LEFT JOIN (SELECT store, item, {_z('item', 'z')} AS value FROM (SELECT store, item, {_z('store', 'v')} AS z FROM (SELECT store, item, coalesce(value, 0) AS v FROM ({_IMP})))) m ON m.store = p.store AND m.item = p.item")
def _(spark, d):
    rows = X.daily(spark, d)
    return M.with_normalised(rows, M.normalise(rows, "growth_rate"))


@query("n05_minmax", "store:b item:b value:f", "SELECT store, item, greatest((value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1 END, 0) AS value FROM sales_cells WINDOW w AS (PARTITION BY item)")
def _(spark, d):
    return M.minmax_by_column(X.sales_cells(spark, d), "item")


_TEN = "SELECT store, item, 'a' AS feature, value FROM sales_cells UNION ALL SELECT store, item, 'b', value * value - 3 FROM sales_cells"


def _tensor(spark, d):
    x = X.sales_cells(spark, d)
    return x.select("store", "item", F.lit("a").alias("feature"), "value").unionByName(x.select("store", "item", F.lit("b").alias("feature"), (F.col("value") * F.col("value") - 3).alias("value")))


@query("n06_feature_range", "store:b item:b feature:s value:f", f"SELECT store, item, feature, (value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-12) AS value FROM ({_TEN}) WINDOW w AS (PARTITION BY feature)")
def _(spark, d):
    return M.scale_features(_tensor(spark, d))


@query("n07_feature_zscore", "store:b item:b feature:s value:f", f"SELECT store, item, feature, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM ({_TEN}) WINDOW w AS (PARTITION BY feature)")
def _(spark, d):
    return M.centre_features(_tensor(spark, d))


@query("n08_robust_scaled", "store:b item:b date:d y:f", "SELECT store, item, date, (y - m) / CASE WHEN b - a > 0 THEN b - a ELSE 1 END AS y FROM split_fc JOIN (SELECT store, item, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM split_fc WHERE split = 'train' GROUP BY 1, 2) USING (store, item)")
def _(spark, d):
    return M.robust_scale(X.forecasts(spark, d), "y", ["store", "item"], F.col("split") == "train")


@query("n09_minmax_train", "store:b item:b date:d yhat:f y:f", """SELECT store, item, date, (yhat - a) / CASE WHEN b > a THEN b - a ELSE 1 END AS yhat, CASE WHEN y IS NOT NULL THEN least(greatest(y, lo), hi) END AS y FROM split_fc,
      (SELECT min(yhat) AS a, max(yhat) AS b, floor(quantile_cont(y, 0.01)) AS lo, ceil(quantile_cont(y, 0.99)) AS hi FROM split_fc WHERE split = 'train')""")
def _(spark, d):
    train = F.col("split") == "train"
    rows = X.forecasts(spark, d)
    return M.clip_target(M.minmax_apply(rows, M.minmax_fit(rows, ["yhat"], train), ["yhat"]), "y", train)


@query("n11_inverse", "store:b item:b date:d yhat:f", "SELECT store, item, date, yhat FROM split_fc")
def _(spark, d):
    rows = X.forecasts(spark, d)
    stats = M.minmax_fit(rows, ["yhat"], F.col("split") == "train")
    return M.minmax_invert(M.minmax_apply(rows, stats, ["yhat"]), stats, ["yhat"])


@query("n13_explained_variance", "k:b share:f")
def _(spark, d):
    shares = M.explained_variance(M.cells(X.daily(spark, d), "growth_rate"))
    return spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(shares)], "k long, share double")


# ------------------------------------------------------------------ metrics

_SM = "avg(abs(y - yhat) / greatest((abs(y) + abs(yhat)) / 2, 1e-8)) * 100"


@query(
    "m07_regression",
    "split:s RMSE:f MSE:f R2:f Pearson:f MAE:f Median_AE:f SMAPE:f Explained_Variance:f",
    f"SELECT split, sqrt(avg((y-yhat)*(y-yhat))) AS RMSE, avg((y-yhat)*(y-yhat)) AS MSE, 1 - sum((y-yhat)*(y-yhat)) / (count(*) * var_pop(y)) AS R2, covar_pop(y, yhat) / (stddev_pop(y) * stddev_pop(yhat)) AS Pearson, avg(abs(y-yhat)) AS MAE, quantile_cont(abs(y-yhat), 0.5) AS Median_AE, {_SM} AS SMAPE, 1 - var_pop(y-yhat) / var_pop(y) AS Explained_Variance FROM split_fc WHERE yhat IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    return E.regression_bundle(X.forecasts(spark, d), ["split"])


_NS = "SELECT store, item, CASE WHEN count(*) >= 2 THEN sqrt(avg(dd*dd)) END AS rms_diff, CASE WHEN count(*) >= 2 THEN avg(abs(dd)) END AS mean_abs_diff FROM (SELECT *, y - lag(y) OVER (PARTITION BY store, item ORDER BY date) AS dd FROM split_fc WHERE split = 'train') GROUP BY 1, 2"


@query("m02_naive_scales", "store:b item:b rms_diff:f mean_abs_diff:f", _NS)
def _(spark, d):
    return E.naive_scales(X.forecasts(spark, d).where("split = 'train'"), ["store", "item"])


@query("m02_pooled_scale", "scale:f", "SELECT sqrt(avg(dd*dd)) AS scale FROM (SELECT y - lag(y) OVER (PARTITION BY store, item ORDER BY date) AS dd FROM split_fc WHERE split = 'train')")
def _(spark, d):
    return E.pooled_scale(X.forecasts(spark, d).where("split = 'train'"), ["store", "item"])


@query(
    "m05_forecast_bundle",
    "store:b item:b RMSE:f MAE:f SMAPE:f OPE:f MARRE:f RMSSE:f MASE:f",
    f"""SELECT *, CASE WHEN rms_diff > 0 THEN RMSE / (rms_diff + 1e-8) END AS RMSSE, CASE WHEN mean_abs_diff > 0 THEN MAE / (mean_abs_diff + 1e-8) END AS MASE FROM (
      SELECT store, item, sqrt(avg((y-yhat)*(y-yhat))) AS RMSE, avg(abs(y-yhat)) AS MAE, 200 * avg(abs(y-yhat) / (abs(y) + abs(yhat))) AS SMAPE, 100 * abs(sum(y-yhat) / sum(y)) AS OPE, 100 * avg(abs(y-yhat)) / nullif(max(y) - min(y), 0) AS MARRE
      FROM split_fc WHERE split = 'val' AND yhat IS NOT NULL GROUP BY 1, 2) LEFT JOIN ({_NS}) USING (store, item)""",
)
def _(spark, d):
    f = X.forecasts(spark, d)
    val = f.where("split = 'val' and yhat is not null")
    return E.forecast_bundle(val.select("store", "item", "date", "y"), val.select("store", "item", "date", "yhat"), f.where("split = 'train'"), ["store", "item"])


@query(
    "m10_log_losses",
    "store:b nwrmsle:f pmav:f mse_o:f hybrid:f",
    """SELECT store, sqrt(sum(weight*(y-yhat)*(y-yhat)) / sum(weight)) AS nwrmsle, sum(CASE WHEN y > 0 THEN weight * abs(exp(y) - exp(yhat)) END) / (sum(CASE WHEN y > 0 THEN weight * abs(exp(y) - 1) END) + 1e-8) AS pmav,
      avg(CASE WHEN y > 0 THEN weight * (exp(y) - exp(yhat)) * (exp(y) - exp(yhat)) END) AS mse_o, 0.8 * sqrt(sum(weight*(y-yhat)*(y-yhat)) / sum(weight)) + 0.2 * sum(weight * abs(y-yhat)) / sum(weight) AS hybrid FROM logs GROUP BY 1""",
)
def _(spark, d):
    return X.logs(spark, d).groupBy("store").agg(E.nwrmsle("y", "yhat", "weight").alias("nwrmsle"), E.percent_mav("y", "yhat", "weight").alias("pmav"), E.mse_original("y", "yhat", "weight").alias("mse_o"), E.hybrid("y", "yhat", "weight").alias("hybrid"))


@query("m14_original_space", "store:b MAE:f MAV:f RMSE:f", "SELECT store, avg(CASE WHEN y > 0 THEN abs(exp(y) - exp(yhat)) END) AS MAE, avg(CASE WHEN y > 0 THEN abs(exp(y) - 1) END) AS MAV, sqrt(avg(CASE WHEN y > 0 THEN pow(exp(y) - exp(yhat), 2) END)) AS RMSE FROM logs GROUP BY 1")
def _(spark, d):
    return E.original_bundle(X.logs(spark, d), ["store"])


@query("m15_naive_percent_mav", "store:b item:b naive_percent_mav:f", "SELECT store, item, 100 * avg(abs(yhat - y)) / greatest(avg(abs(y)), 1e-12) AS naive_percent_mav FROM (SELECT store, item, y - 20 AS y, yhat - 20 AS yhat FROM fc) WHERE yhat IS NOT NULL AND y >= 0 GROUP BY 1, 2")
def _(spark, d):
    return E.naive_percent_mav(X.forecasts(spark, d).drop("yhat").withColumn("y", F.col("y") - 20), ["store", "item"])


@query("m09_linear_calibration", "store:b item:b date:d yhat:f", """SELECT store, item, date, mb + s * (yhat - ma) AS yhat FROM split_fc, (SELECT covar_pop(yhat, y) / var_pop(yhat) AS s, avg(yhat) AS ma, avg(y) AS mb FROM split_fc WHERE split = 'val' AND yhat IS NOT NULL)""")
def _(spark, d):
    return E.calibrate_linear(X.forecasts(spark, d))


@query("m09_isotonic_calibration", "store:b item:b date:d yhat:f")
def _(spark, d):
    return E.calibrate_isotonic(X.forecasts(spark, d).where("yhat is not null"))


@query(
    "m45_agreement",
    "ari:f nmi:f",
    """SELECT (ab - e) / ((sa + sb) / 2 - e) AS ari, mi / ((ha + hb) / 2) AS nmi FROM (SELECT *, sa * sb / (t * (t - 1) / 2) AS e FROM
      (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n / t * ln(n * t / (na * nb))) AS mi, max(t) AS t FROM ab), (SELECT sum(na * (na - 1) / 2.0) AS sa, sum(-na / t * ln(na / t)) AS ha FROM (SELECT DISTINCT a, na, t FROM ab)), (SELECT sum(nb * (nb - 1) / 2.0) AS sb, sum(-nb / t * ln(nb / t)) AS hb FROM (SELECT DISTINCT b, nb, t FROM ab)))"""
    .replace("FROM ab)", "FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM (SELECT cluster AS a, type AS b, count(*) * 1.0 AS n FROM stores GROUP BY 1, 2)))"),
)
def _(spark, d):
    return E.agreement(X.stores(spark, d), "cluster", "type")


# ------------------------------------------------------------------ blocks and factors


def _cand(spark, d):
    return X.sales_cells(spark, d), X.row_members(spark, d), X.col_members(spark, d), X.blocks(spark, d)


_FITTED = "(SELECT *, sum(b) OVER (PARTITION BY store, item) AS fit FROM cand)"
for _name, _score in (("gaussian_delta", "(value - fit) * b - 0.5 * b * b"), ("dominant", "abs(b)"), ("poisson_delta", "value * (ln(greatest(fit, 1e-9)) - ln(greatest(greatest(fit, 1e-9) - b, 1e-9))) - b")):

    @query(f"c15_assign_{_name}", "store:b item:b r:b c:b block_id:b", f"SELECT store, item, r, c, r * 5 + c AS block_id FROM (SELECT *, row_number() OVER (PARTITION BY store, item ORDER BY {_score} DESC, r, c) AS rn FROM {_FITTED}) WHERE rn = 1")
    def _(spark, d, score=_name):
        return B.assign_blocks(*_cand(spark, d), score=score, n_cols=5)


_STRONG = "(SELECT r, c, b FROM blocks ORDER BY abs(b) DESC LIMIT 3)"


@query(
    "c15_assign_allowed",
    "store:b item:b r:b c:b block_id:b",
    f"""SELECT store, item, coalesce(r, gr) AS r, coalesce(c, gc) AS c, coalesce(r, gr) * 5 + coalesce(c, gc) AS block_id FROM sales_cells LEFT JOIN
      (SELECT * FROM (SELECT store, item, f.r, f.c, row_number() OVER (PARTITION BY store, item ORDER BY (value - fit) * f.b - 0.5 * f.b * f.b DESC, f.r, f.c) AS rn FROM {_FITTED} f JOIN {_STRONG} s ON s.r = f.r AND s.c = f.c) WHERE rn = 1) USING (store, item),
      (SELECT r AS gr, c AS gc FROM blocks ORDER BY abs(b) DESC, r, c LIMIT 1)""",
)
def _(spark, d):
    x, r, c, b = _cand(spark, d)
    return B.assign_blocks(x, r, c, b, n_cols=5, allowed=B.mask_top_k(b, 3))


@query("c16_predict_rows", "store:b r:b", """SELECT store, r FROM (SELECT store, r, row_number() OVER (PARTITION BY store ORDER BY round(dot - half, 9) DESC, r) AS rn FROM (SELECT s.store, g.r, sum(value * g) AS dot FROM sales_cells s JOIN (SELECT store % 3 AS r, item, avg(value) AS g FROM sales_cells GROUP BY 1, 2) g USING (item) GROUP BY 1, 2)
      JOIN (SELECT r, sum(g * g) / 2 AS half FROM (SELECT store % 3 AS r, item, avg(value) AS g FROM sales_cells GROUP BY 1, 2) GROUP BY 1) USING (r)) WHERE rn = 1""")
def _(spark, d):
    x = X.sales_cells(spark, d)
    return B.predict_rows(x, x.groupBy((F.col("store") % 3).alias("r"), "item").agg(F.avg("value").alias("g")))


@query(
    "c18_gap_mask",
    "r:b c:b allowed:s",
    """SELECT r, c, CASE WHEN abs(b) >= (SELECT min(a) FROM (SELECT abs(b) AS a, row_number() OVER (ORDER BY abs(b) DESC) AS rk FROM blocks WHERE abs(b) > 1e-12)
        WHERE rk <= greatest(4, (SELECT rk FROM (SELECT rk, a - lead(a) OVER (ORDER BY rk) AS dr FROM (SELECT abs(b) AS a, row_number() OVER (ORDER BY abs(b) DESC) AS rk FROM blocks WHERE abs(b) > 1e-12)) WHERE dr IS NOT NULL ORDER BY dr DESC, rk LIMIT 1))) THEN 'true' ELSE 'false' END AS allowed FROM blocks""",
)
def _(spark, d):
    return B.mask_by_gap(X.blocks(spark, d))


@query("c18_top_k_mask", "r:b c:b allowed:s", "SELECT r, c, CASE WHEN abs(b) >= (SELECT min(a) FROM (SELECT abs(b) AS a FROM blocks ORDER BY a DESC LIMIT 6)) THEN 'true' ELSE 'false' END AS allowed FROM blocks")
def _(spark, d):
    return B.mask_top_k(X.blocks(spark, d), 6)


_BSTATS = """bs AS (SELECT *, abs(b) * sqrt(n_cells) AS effect FROM (SELECT r, c, any_value(b) AS b, sum(pow(value - fit + b, 2) - pow(value - fit, 2)) AS delta, count(*) AS n_cells FROM (SELECT *, sum(b) OVER (PARTITION BY store, item) AS fit FROM cand) GROUP BY 1, 2)),
      sizes AS (SELECT * FROM (SELECT r, count(*) AS n_rows FROM row_m GROUP BY 1), (SELECT c, count(*) AS n_cols FROM col_m GROUP BY 1)),
      jumps AS (SELECT 'n' AS k, n_cells AS x, (lead(n_cells) OVER w - n_cells) / greatest(n_cells, 1e-12) AS j, row_number() OVER w AS pos FROM bs WINDOW w AS (ORDER BY n_cells)
        UNION ALL SELECT 'e', effect, (lead(effect) OVER w - effect) / greatest(effect, 1e-12), row_number() OVER w FROM bs WINDOW w AS (ORDER BY effect)),
      cuts AS (SELECT (SELECT greatest(4, floor(x)) FROM jumps WHERE k = 'n' AND j IS NOT NULL ORDER BY j DESC, pos LIMIT 1) AS by_size, (SELECT greatest(1, floor(x)) FROM jumps WHERE k = 'e' AND j IS NOT NULL ORDER BY j DESC, pos LIMIT 1) AS by_effect,
        (SELECT quantile_cont(delta, 0.5) FROM bs) AS by_delta, (SELECT quantile_cont(n_cells, 0.5) FROM bs) AS by_half, (SELECT quantile_cont(n_cells, 0.6) FROM bs) AS by_q)"""
for _rule, _keep in (("size_gap", "n_cells >= by_size"), ("effect_gap", "effect >= by_effect"), ("delta_then_size", "delta > 0 AND delta >= by_delta AND n_cells >= by_half"), ("quantiles", "n_cells >= by_q")):

    @query(f"c18_{_rule}_mask", "r:b c:b allowed:s n_cells:b effect_score:f delta_loss:f", f"SELECT * FROM (WITH {_BSTATS} SELECT r, c, n_cells, effect AS effect_score, delta AS delta_loss, CASE WHEN {_keep} AND n_rows >= 2 AND n_cols >= 2 THEN 'true' ELSE 'false' END AS allowed FROM bs JOIN sizes USING (r, c), cuts)")
    def _(spark, d, rule=_rule):
        return B.mask_by_stats(B.block_stats(*_cand(spark, d)), rule, size_quantile=0.6 if rule == "quantiles" else 0.5, min_rows=2, min_cols=2)


@query("c19_cell_mask", "store:b item:b", "SELECT DISTINCT store, item FROM cand JOIN (SELECT r, c FROM blocks ORDER BY abs(b) DESC LIMIT 4) USING (r, c)")
def _(spark, d):
    x, r, c, b = _cand(spark, d)
    return B.cell_mask(x, r, c, B.mask_top_k(b, 4))


@query("c20_ablation", "r:b c:b delta_loss:f n_cells:b", "SELECT r, c, sum(pow(value - xhat + b, 2) - pow(value - xhat, 2)) AS delta_loss, count(*) AS n_cells FROM (SELECT *, sum(b) OVER (PARTITION BY store, item) AS xhat FROM cand) GROUP BY 1, 2")
def _(spark, d):
    return B.ablation(*_cand(spark, d))


@query("c21_explain_blocks", "r:b c:b n_cells:b mean:f exclusive_mean:f exclusive_cells:f stores_top:s", """SELECT r, c, n_cells, mean, exclusive_mean, exclusive_cells, stores_top FROM (SELECT r, c, count(*) AS n_cells, avg(value) AS mean, sum(w * value) / sum(w) AS exclusive_mean, sum(w) AS exclusive_cells FROM
      (SELECT cand.*, 1.0 / (rm * cm) AS w FROM cand JOIN (SELECT store, count(*) AS rm FROM row_m GROUP BY 1) USING (store) JOIN (SELECT item, count(*) AS cm FROM col_m GROUP BY 1) USING (item)) GROUP BY 1, 2)
      JOIN (SELECT r, c, string_agg(CAST(store AS VARCHAR), ',' ORDER BY rk) AS stores_top FROM (SELECT r, c, store, row_number() OVER (PARTITION BY r, c ORDER BY round(avg(value), 9) DESC, store) AS rk FROM cand GROUP BY 1, 2, 3) WHERE rk <= 3 GROUP BY 1, 2) USING (r, c)""")
def _(spark, d):
    return B.explain_blocks(*_cand(spark, d)).withColumn("stores_top", F.array_join("top_stores", ","))


@query("c22_explained", "tss:f rss:f pve:f", "SELECT tss, rss, 1 - rss / tss AS pve FROM (SELECT sum(pow(value - m, 2)) AS tss, sum(pow(value - xhat, 2)) AS rss FROM (SELECT *, avg(value) OVER (PARTITION BY item) AS m, avg(value) OVER (PARTITION BY r, c) AS xhat FROM blocked))")
def _(spark, d):
    return B.explained(B.block_means(X.blocked(spark, d)))


@query("c22_explained_grand", "tss:f rss:f pve:f", "SELECT tss, rss, 1 - rss / tss AS pve FROM (SELECT sum(pow(value - m, 2)) AS tss, sum(pow(value - xhat, 2)) AS rss FROM (SELECT *, avg(value) OVER () AS m, avg(value) OVER (PARTITION BY r, c) AS xhat FROM blocked))")
def _(spark, d):
    return B.explained(B.block_means(X.blocked(spark, d)), baseline="grand_mean")


@query("c03_reassign_rows", "store:b r:b loss:f", """SELECT store, r, loss FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY round(loss, 9), r) AS rn FROM (SELECT x.store, p.r, sum(pow(value - m, 2)) AS loss FROM blocked x JOIN (SELECT r, c, avg(value) AS m FROM blocked GROUP BY 1, 2) p ON x.c = p.c GROUP BY 1, 2)) WHERE rn = 1""")
def _(spark, d):
    return B.reassign_rows(X.blocked(spark, d))


@query("c03_reassign_cols", "item:b c:b loss:f", """SELECT item, c, loss FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(loss, 9), c) AS rn FROM (SELECT x.item, p.c, sum(abs(value - m)) AS loss FROM blocked x JOIN (SELECT r, c, quantile_cont(value, 0.5) AS m FROM blocked GROUP BY 1, 2) p ON x.r = p.r GROUP BY 1, 2)) WHERE rn = 1""")
def _(spark, d):
    return B.reassign_cols(X.blocked(spark, d), "l1")


@query("c08_objectives", "l2:f l1:f hub:f", """SELECT sum(pow(value - m, 2)) AS l2, sum(abs(value - md)) AS l1, sum(CASE WHEN abs(value - m) <= 1 THEN 0.5 * pow(value - m, 2) ELSE abs(value - m) - 0.5 END) AS hub FROM (SELECT *, avg(value) OVER (PARTITION BY r, c) AS m FROM blocked) JOIN (SELECT r, c, quantile_cont(value, 0.5) AS md FROM blocked GROUP BY 1, 2) USING (r, c)""")
def _(spark, d):
    x = X.blocked(spark, d)
    one = lambda norm, name: B.objective(x, norm).withColumnRenamed("objective", name)
    return one("l2", "l2").crossJoin(one("l1", "l1")).crossJoin(one("huber", "hub"))


@query("c24_reconstruct", "store:b item:b xhat:f", "SELECT store, item, sum(b) AS xhat FROM cand GROUP BY 1, 2")
def _(spark, d):
    return B.reconstruct(*_cand(spark, d))


@query(
    "c25_elbow",
    "keep:b lead:f",
    """SELECT k AS keep, ld AS lead FROM (SELECT *, row_number() OVER (ORDER BY round(ld, 9) DESC, k) AS q FROM (SELECT k, cum / t - k * 1.0 / n AS ld FROM (SELECT row_number() OVER w AS k, sum(e) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(e) OVER () AS t, count(*) OVER () AS n
      FROM (SELECT r, c, b * b * nr * nc AS e FROM blocks JOIN (SELECT r, count(*) AS nr FROM row_m GROUP BY 1) USING (r) JOIN (SELECT c, count(*) AS nc FROM col_m GROUP BY 1) USING (c)) WINDOW w AS (ORDER BY e DESC, r, c)))) WHERE q = 1""",
)
def _(spark, d):
    return B.energy_elbow(X.blocks(spark, d), X.row_members(spark, d), X.col_members(spark, d))


@query("c26_merge_by_sign", "r:b c:b b:f merged:b", "SELECT r, c, avg(value) - 3 AS b, CASE WHEN avg(value) - 3 < 0 THEN 0 ELSE 1 END AS merged FROM blocked GROUP BY 1, 2")
def _(spark, d):
    return B.merge_by_sign(X.blocked(spark, d).withColumn("value", F.col("value") - 3))


_NORMS = "SELECT component, sqrt(sum(loading * loading)) AS norm, CASE WHEN sqrt(sum(loading * loading)) < 1e-8 THEN 'true' ELSE 'false' END AS is_empty FROM factors GROUP BY 1"


@query("c33_component_norms", "component:b norm:f is_empty:s", _NORMS)
def _(spark, d):
    return B.component_norms(X.factors(spark, d))


@query("c33_component_stats", "total:b empty:b mean:f q25:f q75:f", f"SELECT count(*) AS total, count(CASE WHEN is_empty = 'true' THEN 1 END) AS empty, avg(norm) AS mean, quantile_cont(norm, 0.25) AS q25, quantile_cont(norm, 0.75) AS q75 FROM ({_NORMS})")
def _(spark, d):
    return B.component_stats(X.factors(spark, d))


@query("c34_top_k", "id:b component:b rk:b", "SELECT id, component, rk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(loading) DESC, component) AS rk FROM factors) WHERE rk <= 3")
def _(spark, d):
    return B.top_k(X.factors(spark, d), 3)


_CT = "SELECT id, component FROM (SELECT id, component, sum(abs(loading)) OVER (PARTITION BY id ORDER BY abs(loading) DESC, component ROWS UNBOUNDED PRECEDING) - abs(loading) AS bef, sum(abs(loading)) OVER (PARTITION BY id) AS t FROM factors) WHERE t > 0 AND round(bef, 9) < round(0.9 * t, 9)"


@query("c34_cumulative_threshold", "id:b component:b", _CT)
def _(spark, d):
    return B.cumulative_threshold(X.factors(spark, d))


@query("c34_hard", "id:b cluster_id:b", "SELECT id, component AS cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(loading) DESC, component) AS rk FROM factors) WHERE rk = 1")
def _(spark, d):
    return B.hard_assignment(X.factors(spark, d))


@query("c34_flat_assignments", "factor_name:s item_name:s cluster_id:b", f"SELECT 'vec' AS factor_name, CAST(id AS VARCHAR) AS item_name, component AS cluster_id FROM ({_CT})")
def _(spark, d):
    f = X.factors(spark, d)
    return B.flat_assignments(B.cumulative_threshold(f), f, "vec")


@query("c35_reconstruction_metrics", "feature:b n:b rss:f rmse:f pve:f", "SELECT c AS feature, count(*) AS n, sum(pow(value - xhat, 2)) AS rss, sqrt(avg(pow(value - xhat, 2))) AS rmse, 1 - sum(pow(value - xhat, 2)) / (count(*) * var_pop(value)) AS pve FROM (SELECT *, avg(value) OVER (PARTITION BY r, c) AS xhat FROM blocked) GROUP BY 1")
def _(spark, d):
    return B.reconstruction_metrics(B.block_means(X.blocked(spark, d)).withColumn("feature", F.col("c")))


@query("c37_block_summary", "r:b c:b n_cells:b mean:f median:f coverage:f", "SELECT r, c, count(*) AS n_cells, avg(value) AS mean, quantile_cont(value, 0.5) AS median, 100.0 * count(*) / sum(count(*)) OVER () AS coverage FROM blocked GROUP BY 1, 2")
def _(spark, d):
    return B.block_summary(X.blocked(spark, d))


@query("c38_coverage_matrix", "r:b c0:b c1:b c2:b c3:b", "SELECT r, " + ", ".join(f"count(CASE WHEN c = {k} THEN 1 END) AS c{k}" for k in range(4)) + " FROM blocked GROUP BY 1")
def _(spark, d):
    return B.coverage_matrix(X.blocked(spark, d), 4)


@query("c39_block_quality", "r:b c:b mean:f wcv:f bcv:f silhouette:f", """SELECT r, c, mean, wcv, bcv, (bcv - wcv) / nullif(greatest(bcv, wcv), 0) AS silhouette FROM (SELECT a.r, a.c, any_value(a.mean) AS mean, any_value(a.wcv) AS wcv, min(pow(a.mean - z.mean, 2)) AS bcv FROM (SELECT r, c, avg(value) AS mean, var_pop(value) AS wcv FROM blocked GROUP BY 1, 2) a
      JOIN (SELECT r, c, avg(value) AS mean FROM blocked GROUP BY 1, 2) z ON a.r <> z.r OR a.c <> z.c GROUP BY 1, 2)""")
def _(spark, d):
    return B.block_quality(X.blocked(spark, d))


@query("c40_silhouette", "silhouette:f", """SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT store, max(CASE WHEN r = r2 THEN dd END) AS a, min(CASE WHEN r <> r2 THEN dd END) AS b FROM (SELECT store, store % 3 AS r, s2 % 3 AS r2, avg(dist) AS dd FROM (SELECT x.store, y.store AS s2, sqrt(sum(pow(x.value - y.value, 2))) AS dist FROM sales_cells x JOIN sales_cells y ON x.item = y.item AND x.store <> y.store GROUP BY 1, 2) GROUP BY 1, 2, 3) GROUP BY 1)""")
def _(spark, d):
    x = X.sales_cells(spark, d)
    return B.silhouette(x, x.select("store").distinct().withColumn("r", F.col("store") % 3))


@query("c46_indicators", "r:b c:b n_rows:b n_cols:b", "SELECT r, c, n_rows, n_cols FROM (SELECT store % 3 AS r, count(*) AS n_rows FROM stores GROUP BY 1) CROSS JOIN (SELECT item % 4 AS c, count(*) AS n_cols FROM items GROUP BY 1)")
def _(spark, d):
    return B.indicators(X.stores(spark, d).select((F.col("store") % 3).alias("r")), X.items(spark, d).select((F.col("item") % 4).alias("c")))


@query("c47_membership_histogram", "n_clusters:b n_keys:b", "SELECT n AS n_clusters, count(*) AS n_keys FROM (SELECT store, count(DISTINCT r) AS n FROM row_m GROUP BY 1) GROUP BY 1")
def _(spark, d):
    return B.membership_histogram(X.row_members(spark, d).withColumnRenamed("r", "cluster"), "store")


@query("o02_best_setting", "n_row:b n_col:b mean:f", "SELECT r AS n_row, c AS n_col, value AS mean FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY value DESC, store, item) AS rk FROM blocked) WHERE rk = 1")
def _(spark, d):
    rows = X.blocked(spark, d).select(F.col("r").alias("n_row"), F.col("c").alias("n_col"), F.col("value").alias("mean"), "store", "item")
    return B.best_setting(rows, ["n_row", "n_col"], [F.desc("mean"), F.col("store"), F.col("item")])


@query("o03_best_by_pve", "store:b item:b", "SELECT store, item FROM blocked WHERE value >= (SELECT max(value) FROM blocked) - 0.2 ORDER BY r, c, value DESC, store, item LIMIT 1")
def _(spark, d):
    rows = X.blocked(spark, d).withColumn("pve", F.col("value"))
    return B.best_by_pve(rows, 0.2, [F.col("r"), F.col("c"), F.desc("pve"), F.col("store"), F.col("item")])


@query("j15_top_settings", "store:b item:b n_row:b n_col:b", "SELECT store, item, r AS n_row, c AS n_col FROM blocked WHERE (r, c) IN (SELECT (r, c) FROM (SELECT r, c, max(value) AS m FROM blocked GROUP BY 1, 2 ORDER BY m DESC, r, c LIMIT 3))".replace("SELECT (r, c) FROM", "SELECT r, c FROM"))
def _(spark, d):
    return B.top_settings(X.blocked(spark, d).withColumnsRenamed({"r": "n_row", "c": "n_col"}), "value", 3)


# ------------------------------------------------------------------ solvers, forecasts, streams (rows only)


def _matrix(spark, d):
    return K.collect_matrix(X.sales_cells(spark, d))


@query("c01_double_kmeans", "store:b r:b")
def _(spark, d):
    x, rows, _ = _matrix(spark, d)
    return K.label_frame(spark, rows, K.double_kmeans(x, 3, 4).row_labels, "store", "r")


@query("c09_tri_factorisation", "store:b r:b")
def _(spark, d):
    x, rows, _ = _matrix(spark, d)
    u = K.binary_tri_factorisation(x - x[~(x != x)].mean(), 3, 4, beta=0.01).u
    return spark.createDataFrame([(int(s), int(k)) for s, m in zip(rows, u, strict=True) for k in m.nonzero()[0]], "store long, r long")


@query("c23_sweep", "n_row:b n_col:b rss:f pve:f aic:f bic:f")
def _(spark, d):
    return K.sweep(spark, _matrix(spark, d)[0], [2, 3], [2, 3, 4])


@query("c30_nmtf_sweep", "n_row:b n_col:b rmse:f pve:f")
def _(spark, d):
    return K.sweep(spark, _matrix(spark, d)[0], [2], [2, 3], restarts=1, solver="nmtf")


@query("c32_tune_ranks", "r1:b r2:b r3:b rmse:f pve:f")
def _(spark, d):
    import numpy as np

    x = np.nan_to_num(_matrix(spark, d)[0])
    return K.tune_ranks(spark, np.stack([x, x * x - 3], axis=2), [(2, 2, 1), (2, 3, 2), (3, 4, 2)])


@query("c37_spectral", "store:b r:b")
def _(spark, d):
    x, rows, _ = _matrix(spark, d)
    return K.label_frame(spark, rows, K.spectral_coclusters(x, 3)[0], "store", "r")


@query(
    "l01_dataset",
    "store:b item:b date:d split:s yhat:f y:f",
    """WITH s AS (SELECT store, item, date, y, yhat, CASE WHEN date_diff('day', date, b) < 30 THEN 'test' WHEN date_diff('day', date, b) < 90 THEN 'val' ELSE 'train' END AS split FROM fc, (SELECT max(date) AS b FROM fc)),
      i AS (SELECT s.*, coalesce(yhat, med, 0) AS x FROM s, (SELECT quantile_cont(yhat, 0.5) AS med FROM s WHERE split = 'train')),
      r AS (SELECT min(x) AS lo, max(x) AS hi, floor(quantile_cont(y, 0.01)) AS ql, ceil(quantile_cont(y, 0.99)) AS qh FROM i WHERE split = 'train'),
      c AS (SELECT store, item, date, split, (x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS xs, least(greatest(y, ql), qh) AS yc FROM i, r),
      t AS (SELECT quantile_cont(yc, 0.25) AS a, quantile_cont(yc, 0.5) AS m, quantile_cont(yc, 0.75) AS b FROM c WHERE split = 'train')
      SELECT store, item, date, split, xs AS yhat, (yc - m) / CASE WHEN b > a THEN b - a ELSE 1 END AS y FROM c, t""",
)
def _(spark, d):
    return L.dataset(X.forecasts(spark, d).drop("split"), ["yhat"], "y", 60, 30)


@query("l03_eligible", "store:b item:b n_rows:b n_points:b std:f", "SELECT store, item, count(*) AS n_rows, count(unit_sales) AS n_points, stddev_samp(unit_sales) AS std FROM panel GROUP BY 1, 2 HAVING count(*) >= 30 AND count(unit_sales) >= 15 AND stddev_samp(unit_sales) > 0")
def _(spark, d):
    return L.eligible(X.panel(spark, d), "unit_sales")


@query("l09_local_forecasts", "Model:s store:b item:b RMSE:f SMAPE:f RMSSE:f")
def _(spark, d):
    series = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales"), 0.8).join(L.eligible(X.panel(spark, d), "unit_sales").select("store", "item"), ["store", "item"], "left_semi")
    fc = L.forecast_local(series, "unit_sales", ["naive", "exponential_smoothing", "theta", "auto_arima", "kalman"])
    return L.evaluate(fc, series, "unit_sales")


@query("l10_global_benchmark", "Model:s Dataset:s RMSE:f MAE:f R2:f")
def _(spark, d):
    series = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales"), 0.8)
    frame = L.lag_frame(series, "unit_sales").cache()
    return L.benchmark(frame, "unit_sales", [f"unit_sales_lag_{k}" for k in (1, 2, 7, 14)], ["linear_regression", "random_forest"])


@query("l17_wide_to_dates", "store:b item:b date:d unit_sales:f", f"SELECT store, item, start_date + CAST(3 + i AS INTEGER) AS date, CASE i WHEN 0 THEN a ELSE b END AS unit_sales FROM (SELECT store, item, min(date) AS start_date, arg_min(unit_sales, date) AS a, arg_max(unit_sales, date) AS b FROM panel GROUP BY 1, 2), range(2) t(i)".replace("3 + i", "2 + i"))
def _(spark, d):
    w = X.panel(spark, d).groupBy("store", "item").agg(F.min("date").alias("start_date"), F.min_by("unit_sales", "date").alias("y_sales_day_1"), F.max_by("unit_sales", "date").alias("y_sales_day_2"))
    return L.wide_to_dates(w, 2)


@query("l18_roll_forward", "store:b item:b start_date:d sales:f", "SELECT store, item, min(date) + 16 AS start_date, max(unit_sales) AS sales FROM panel GROUP BY 1, 2")
def _(spark, d):
    return L.roll_forward(X.panel(spark, d).groupBy("store", "item").agg(F.min("date").alias("start_date"), F.max("unit_sales").alias("y_sales")), 16)


@query("l16_batch_predict", "store:b item:b yhat:f", "SELECT store, item, exp(greatest(0.1 * store_cluster + 0.2 + 0.5 * value, 1e-6)) - 1 AS yhat FROM sales_cells JOIN labels2 USING (store, item)")
def _(spark, d):
    coef = spark.range(3).select(F.col("id").alias("store_cluster"), (0.1 * F.col("id") + 0.2).alias("intercept"), F.array(F.lit(0.5)).alias("w")).crossJoin(spark.range(4).select(F.col("id").alias("item_cluster")))
    return L.batch_predict(X.sales_cells(spark, d).join(X.labels2(spark, d), ["store", "item"]), coef, ["value"])


@query("l19_learning_rate", "store:b lr:f", "SELECT store, lr FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY g, step) AS q FROM (SELECT store, step, lr, (lead(loss) OVER w - lag(loss) OVER w) / 2 AS g, row_number() OVER w AS i, count(*) OVER (PARTITION BY store) AS n FROM (SELECT store, date_diff('day', DATE '1992-01-01', date) AS step, pow(10, -5 + date_diff('day', DATE '1992-01-01', date) / 1000.0) AS lr, avg(unit_sales) AS loss FROM panel GROUP BY store, date) WINDOW w AS (PARTITION BY store ORDER BY step)) WHERE i > 10 AND i <= n - 5 AND g IS NOT NULL) WHERE q = 1")
def _(spark, d):
    step = F.datediff("date", F.lit("1992-01-01").cast("date"))
    curves = X.panel(spark, d).groupBy("store", step.alias("step")).agg(F.avg("unit_sales").alias("loss")).withColumn("lr", F.pow(F.lit(10.0), F.col("step") / 1000 - 5))
    return L.suggest_learning_rate(curves, by=["store"])


@query("t01_tumbling", "event_type:s start:d n:b total:f", "SELECT event_type, CAST(DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 3 * 3 AS INTEGER) AS DATE) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return T.tumbling(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], 3, "value")


@query("t02_weekly_sums", "event_type:s week_end:d total:f", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, sum(value) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return T.weekly_sums(X.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "value")


@query("t04_error_sums", "store:b n:b sse:f sae:f", "SELECT store, count(*) AS n, sum((y-yhat)*(y-yhat)) AS sse, sum(abs(y-yhat)) AS sae FROM fc WHERE yhat IS NOT NULL GROUP BY 1")
def _(spark, d):
    return T.error_sums(X.forecasts(spark, d), ["store"], "y", "yhat")


# ------------------------------------------------------------------ joins and reports on top

_BUNDLE = "sqrt(avg((y-yhat)*(y-yhat))) AS RMSE, avg(abs(y-yhat)) AS MAE, quantile_cont(abs(y-yhat), 0.5) AS Median_AE"
_CAL = "SELECT split, y, mb + s * (yhat - ma) AS yhat FROM sp, (SELECT covar_pop(yhat, y) / var_pop(yhat) AS s, avg(yhat) AS ma, avg(y) AS mb FROM sp WHERE split = 'val')"


@query(
    "m08_report_rows",
    "Dataset:s Units:s Calibrated:s RMSE:f MAE:f Median_AE:f",
    f"""SELECT CASE split WHEN 'train' THEN 'Training' WHEN 'val' THEN 'Validation' ELSE 'Test' END AS Dataset, Units, Calibrated, {_BUNDLE} FROM (
      WITH sp AS (SELECT split, ln(1 + y) AS y, ln(1 + yhat) AS yhat FROM split_fc WHERE yhat IS NOT NULL), cal AS ({_CAL})
      SELECT split, 'log' AS Units, 'false' AS Calibrated, y, yhat FROM sp UNION ALL SELECT split, 'original', 'false', exp(y) - 1, exp(yhat) - 1 FROM sp
      UNION ALL SELECT split, 'log', 'true', y, yhat FROM cal UNION ALL SELECT split, 'original', 'true', exp(y) - 1, exp(yhat) - 1 FROM cal) GROUP BY 1, 2, 3""",
)
def _(spark, d):
    f = X.forecasts(spark, d)
    return E.report_rows(f.select("split", F.log1p("y").alias("y"), F.log1p("yhat").alias("yhat")))


@query("j13_cluster_mean", "store:b item:b value:f cluster_mean:f", "SELECT store, item, value, avg(value) OVER (PARTITION BY r, c) AS cluster_mean FROM blocked")
def _(spark, d):
    return P.with_cluster_mean(X.blocked(spark, d), "value", ["r", "c"])


@query("j17_panel_blocks", "store:b item:b date:d block_id:b", "SELECT store, item, date, store % 3 * 4 + item % 4 AS block_id FROM panel WHERE store % 5 <> 0")
def _(spark, d):
    own = X.sales_cells(spark, d).select("store", "item", F.when(F.col("store") % 5 == 0, -1).otherwise(F.col("store") % 3 * 4 + F.col("item") % 4).alias("block_id"))
    return P.with_blocks(X.panel(spark, d), own)


@query(
    "j21_median_columns",
    "store:b item:b date:d store_cluster_median_0:f store_cluster_median_1:f store_cluster_median_2:f",
    "SELECT store, item, date, a AS store_cluster_median_0, c AS store_cluster_median_1, b AS store_cluster_median_2 FROM panel LEFT JOIN (SELECT date, quantile_cont(CASE WHEN store % 3 = 0 THEN growth_rate END, 0.5) AS a, quantile_cont(CASE WHEN store % 3 = 1 THEN growth_rate END, 0.5) AS c, quantile_cont(CASE WHEN store % 3 = 2 THEN growth_rate END, 0.5) AS b FROM daily GROUP BY 1) USING (date)",
)
def _(spark, d):
    med = X.daily(spark, d).withColumn("k", F.col("store") % 3)
    return P.with_median_columns(X.panel(spark, d), P.cluster_medians(med, "k", name="m"), "k", "m", [0, 1, 2], "store_cluster_median_")


@query("a18_sideways_share", "store:b item:b sideways:f", "SELECT store, item, avg(CASE WHEN growth_rate IS NOT NULL THEN CASE WHEN abs(growth_rate) <= 0.01 THEN 1.0 ELSE 0.0 END END) AS sideways FROM weeks GROUP BY 1, 2")
def _(spark, d):
    from tessera.plans.pipelines import sideways_share

    return sideways_share(_weeks(spark, d))


@query("a50_distinct_counts", "n_store:b n_item:b n_date:b", "SELECT count(DISTINCT store) AS n_store, count(DISTINCT item) AS n_item, count(DISTINCT date) AS n_date FROM panel")
def _(spark, d):
    return X.panel(spark, d).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in ("store", "item", "date")])


@query("o01_sorted_top", "store:b item:b total:f n_days:b", "SELECT store, item, sum(unit_sales) AS total, count(*) AS n_days FROM panel GROUP BY 1, 2 ORDER BY n_days DESC NULLS LAST, total ASC, store, item LIMIT 20")
def _(spark, d):
    rows = X.panel(spark, d).groupBy("store", "item").agg(F.sum("unit_sales").alias("total"), F.count("*").alias("n_days"))
    return rows.orderBy(F.desc_nulls_last("n_days"), F.asc("total"), "store", "item").limit(20)


@query("u02_union_missing_columns", "store:b item:b city:s", "SELECT store, CAST(NULL AS BIGINT) AS item, city FROM stores UNION ALL SELECT NULL, item, NULL FROM items")
def _(spark, d):
    return X.stores(spark, d).select("store", "city").unionByName(X.items(spark, d).select("item"), allowMissingColumns=True)


@query("c02_untied_kmeans", "store:b r:b")
def _(spark, d):
    x, rows, _ = _matrix(spark, d)
    return K.label_frame(spark, rows, K.untied_double_kmeans(x, 3, 4)[0], "store", "r")


@query("c05_median_sweep", "n_row:b n_col:b rss:f pve:f")
def _(spark, d):
    return K.sweep(spark, _matrix(spark, d)[0], [2], [2, 3], restarts=1, solver="double_kmedians")


@query("c29_nmf_baseline", "n_row:b n_col:b rmse:f pve:f")
def _(spark, d):
    return K.sweep(spark, _matrix(spark, d)[0], [2, 3], [1], restarts=1, solver="nmf")


@query("c31_parafac", "component:b norm:f")
def _(spark, d):
    import numpy as np

    x = np.nan_to_num(_matrix(spark, d)[0])
    f, _ = K.parafac(np.stack([x, x * x - 3], axis=2), 2)
    return B.component_norms(spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(f[0]) for j, v in enumerate(row)], "id long, component long, loading double"))


@query("c42_series_clusters", "store:b cluster:b")
def _(spark, d):
    cells = X.sales_cells(spark, d)
    items = sorted(r.item for r in cells.select("item").distinct().collect())
    return K.cluster_series(M.to_wide(cells, "store", "item", "value", items), [str(i) for i in items], 3)


@query("c43_cross_validation", "n_row:b n_col:b mse:f")
def _(spark, d):
    return K.cross_validate(spark, _matrix(spark, d)[0], [2, 3], [2, 3])


@query("l11_tuning", "reg:f rmse:f")
def _(spark, d):
    series = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales"), 0.8)
    return L.tune(L.lag_frame(series, "unit_sales"), "unit_sales", [f"unit_sales_lag_{k}" for k in (1, 2, 7, 14)], [0.0, 0.1, 1.0])


@query("c41_cluster_panel", "cluster:s n:b")
def _(spark, d):
    from tessera.plans.pipelines import cluster_panel

    return cluster_panel(spark, X.daily(spark, d), [2, 3], [2, 3])[0].groupBy("cluster").agg(F.count("*").alias("n"))


@query("c27_explain_panel", "r:b c:b n_cells:b mean:f")
def _(spark, d):
    from tessera.plans.pipelines import explain_panel

    return explain_panel(spark, X.daily(spark, d), 3, 4)[1]


@query("l09_prepared_forecasts", "Model:s store:b item:b MAE:f")
def _(spark, d):
    from tessera.plans.pipelines import forecast_all

    return forecast_all(X.panel(spark, d), ["naive", "theta"])
