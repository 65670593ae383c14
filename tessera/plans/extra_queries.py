"""Queries of sources and sinks, window records, streams and the flows' remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import clustering as K
from tessera.operators import forecasting as L
from tessera.operators import matrix as M
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.operators import statistics as A
from tessera.plans import analysis_queries
from tessera.plans import fixtures as X
from tessera.plans import pipelines
from tessera.plans.spec import Query
from tessera.sources import io
from tessera.sources.scratch import scratch_path
from tessera.streaming import streams as T

QUERIES: list[Query] = []


def query(name: str, columns: str, sql: str | None = None):
    def add(build):
        QUERIES.append(Query(name, columns, build, sql))
        return build

    return add


# ------------------------------------------------------------------ sources and sinks


@query("s02_table_round_trip", "store:b n:b total:f", "SELECT store, 2 * count(*) AS n, 2 * sum(unit_sales) AS total FROM panel GROUP BY 1")
def _(spark, d):
    panel, out = X.panel(spark, d).select("store", "item", "unit_sales"), None
    for name in ("panel.parquet", "panel.csv"):
        path = scratch_path(spark, name)
        io.write_table(panel, path)
        back = io.read_table(spark, path, panel.schema)
        out = back if out is None else out.unionByName(back)
    return out.groupBy("store").agg(F.count("*").alias("n"), F.sum("unit_sales").alias("total"))


@query("s03_load_raw", "store_item:s n:b first:d", "SELECT CAST(store AS VARCHAR) || '_' || CAST(item AS VARCHAR) AS store_item, count(*) AS n, min(date) AS first FROM panel GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "raw.csv")
    io.write_table(X.panel(spark, d).withColumn("date", F.col("date").cast("string")), path)
    return io.load_raw(spark, path).groupBy("store_item").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("s04_read_sales", "store:b n:b total:f promo:b", "SELECT store, count(*) AS n, sum(unit_sales) AS total, sum(onpromotion) AS promo FROM panel GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "sales.csv")
    raw = X.panel(spark, d).select(F.xxhash64("store", "item", "date").alias("id"), "date", F.col("store").alias("store_nbr"), F.col("item").alias("item_nbr"), "unit_sales", (F.col("onpromotion") == 1).alias("onpromotion"))
    io.write_table(raw, path)
    return io.read_sales(spark, path).groupBy("store").agg(F.count("*").alias("n"), F.sum("unit_sales").alias("total"), F.count_if("onpromotion").alias("promo"))


@query("s06_read_tensor", "feature:s n:b present:b total:f", "SELECT f.feature, count(*) AS n, count(v) AS present, sum(v) AS total FROM (SELECT DISTINCT store FROM sales_cells) s CROSS JOIN (SELECT DISTINCT item FROM sales_cells) i CROSS JOIN (VALUES ('a'), ('b')) f(feature) LEFT JOIN (SELECT store, item, 'a' AS feature, value AS v FROM sales_cells UNION ALL SELECT store, item, 'b', value * 2 FROM sales_cells WHERE store % 2 = 0) x USING (store, item, feature) GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "tensor.parquet")
    x = X.sales_cells(spark, d)
    long = x.select("store", "item", F.lit("a").alias("feature"), "value").unionByName(x.where("store % 2 = 0").select("store", "item", F.lit("b").alias("feature"), (F.col("value") * 2).alias("value")))
    io.write_table(long, path)
    return io.read_tensor(spark, path).groupBy("feature").agg(F.count("*").alias("n"), F.count_if("mask").alias("present"), F.sum("value").alias("total"))


@query("s07_block_files", "block_id:b n:b total:f", "SELECT r * 4 + c AS block_id, count(*) AS n, sum(value) AS total FROM blocked WHERE r * 4 + c IN (1, 6) GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "blocks")
    io.write_blocks(X.blocked(spark, d).withColumn("block_id", F.col("r") * 4 + F.col("c")), path)
    return spark.read.parquet(path).where("block_id in (1, 6)").groupBy("block_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("s09_single_csv", "store:b total:f files:b", "SELECT store, sum(unit_sales) AS total, 1 AS files FROM panel GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "report")
    io.write_single_csv(X.panel(spark, d).groupBy("store").agg(F.sum("unit_sales").alias("total")), path)
    back = spark.read.csv(path, header=True).withColumn("file", F.col("_metadata.file_name"))
    files = back.agg(F.count_distinct("file").alias("files"))
    return back.crossJoin(F.broadcast(files))  # one row


@query("s10_cluster_files", "store:b item:b value:f", "SELECT store, item, value FROM sales_cells JOIN labels2 USING (store, item) WHERE item_cluster = 2")
def _(spark, d):
    path = scratch_path(spark, "clusters")
    io.write_clusters(X.sales_cells(spark, d).join(X.labels2(spark, d), ["store", "item"]), path)
    return io.read_clusters(spark, path, item_cluster="2")


@query("s12_model_tables", "part:s n:b", "SELECT 'blocks' AS part, count(*) AS n FROM blocks UNION ALL SELECT 'rows', count(*) FROM row_m UNION ALL SELECT 'cols', count(*) FROM col_m")
def _(spark, d):
    path = scratch_path(spark, "model")
    io.write_model({"blocks": X.blocks(spark, d), "rows": X.row_members(spark, d), "cols": X.col_members(spark, d)}, path)
    out = None
    for name, part in io.read_model(spark, path, ["blocks", "rows", "cols"]).items():
        own = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = own if out is None else out.unionByName(own)
    return out


# ------------------------------------------------------------------ window records and panel details


@query("p14_present_target", "store:b item:b date:d y:f", "SELECT store, item, date, y FROM (SELECT store, item, date, lead(growth_rate) OVER (PARTITION BY store, item ORDER BY date) AS y FROM daily) WHERE y IS NOT NULL")
def _(spark, d):
    return pipelines.supervised(X.daily(spark, d))


@query("p25_from_full_week", "store:b item:b date:d unit_sales:f", "SELECT store, item, date, greatest(unit_sales - 20, 0) AS unit_sales FROM panel WHERE date >= (SELECT CAST(date_trunc('week', min(date) + 6) AS DATE) FROM panel)")
def _(spark, d):
    return S.from_full_week(X.panel(spark, d).withColumn("unit_sales", F.col("unit_sales") - 20))


@query("a28_with_mav", "store:b item:b date:d mav:f", "SELECT store, item, date, coalesce(avg(CASE WHEN growth_rate >= 0 THEN growth_rate END) OVER (PARTITION BY store, item), 0) AS mav FROM daily")
def _(spark, d):
    return A.with_mav(X.daily(spark, d), "growth_rate", log1p=False, name="mav")


@query("a25_kept_features", "feature:s", f"SELECT feature FROM ({next(q.sql for q in analysis_queries.QUERIES if q.name == 'a24_feature_diagnostics')}) WHERE dropped = 'false'")
def _(spark, d):
    features, _, _ = pipelines.weekly_features(X.panel(spark, d))
    kept = [c for c in ("gr_median", "ac_lag12", "seasonal_strength") if c in features.columns]
    present = features.agg(*[F.count(c).alias(c) for c in kept])  # after imputation every kept feature is present
    return present.unpivot([], kept, "feature", "n").where("n > 0").select("feature")


_WIN = """WITH z AS (SELECT min(date) AS z FROM panel), e AS (SELECT store, item, date, unit_sales AS s, onpromotion AS p, date_diff('day', z, date) AS pos FROM panel, z),
      w AS (SELECT DISTINCT store, item, pos // 7 AS w FROM e), g AS (SELECT store, item, w, i, CAST(z + CAST(w * 7 AS INTEGER) AS DATE) AS start_date FROM w, range(1, 8) r(i), z),
      f AS (SELECT g.*, coalesce(e.s, 0) AS s, coalesce(e.p, 0) AS p, CASE WHEN i = 1 THEN b.s ELSE coalesce(b.s, 0) END AS prev FROM g LEFT JOIN e ON e.store = g.store AND e.item = g.item AND e.pos = g.w * 7 + g.i - 1 LEFT JOIN e b ON b.store = g.store AND b.item = g.item AND b.pos = g.w * 7 + g.i - 2)"""


@query(
    "w10_sales_windows",
    "store:b item:b start_date:d sales_day_1:f sales_day_7:f promo_day_3:b growth_rate_1:f growth_rate_4:f",
    f"SELECT * FROM ({_WIN} SELECT store, item, start_date, max(CASE WHEN i = 1 THEN s END) AS sales_day_1, max(CASE WHEN i = 7 THEN s END) AS sales_day_7, max(CASE WHEN i = 3 THEN p END) AS promo_day_3, max(CASE WHEN i = 1 THEN (s - prev) / nullif(prev, 0) * 100 END) AS growth_rate_1, max(CASE WHEN i = 4 THEN (s - prev) / nullif(prev, 0) * 100 END) AS growth_rate_4 FROM f GROUP BY 1, 2, 3)",
)
def _(spark, d):
    return S.sales_windows(X.panel(spark, d), 7)


@query("j25_windows_with_calendar", "store:b item:b start_date:d sales_day_1:f dayofweek:b monthofyear:b", f"SELECT * FROM ({_WIN} SELECT store, item, start_date, max(CASE WHEN i = 1 THEN s END) AS sales_day_1, isodow(start_date) - 1 AS dayofweek, month(start_date) AS monthofyear FROM f GROUP BY 1, 2, 3)")
def _(spark, d):
    return S.with_calendar(S.sales_windows(X.panel(spark, d), 7))


# ------------------------------------------------------------------ blocks, matrices, solvers


@query("f22_mav_ratio_silhouette", "silhouette:f", """SELECT avg((b - a) / greatest(a, b)) AS silhouette FROM (SELECT store, max(CASE WHEN r = r2 THEN dd END) AS a, min(CASE WHEN r <> r2 THEN dd END) AS b FROM (SELECT store, store % 3 AS r, s2 % 3 AS r2, avg(dist) AS dd FROM (SELECT x.store, y.store AS s2, avg(abs(x.value - y.value)) / greatest(0.5 * (avg(abs(x.value)) + avg(abs(y.value))), 1e-12) AS dist FROM sales_cells x JOIN sales_cells y ON x.item = y.item AND x.store <> y.store GROUP BY 1, 2) GROUP BY 1, 2, 3) GROUP BY 1)""")
def _(spark, d):
    x = X.sales_cells(spark, d)
    return B.silhouette(x, x.select("store").distinct().withColumn("r", F.col("store") % 3), "mav_ratio")


@query("c26_merge_by_value", "r:b c:b merged:b", "SELECT r, c, CASE WHEN r * 4 + c IN (0, 6, 9) THEN 2 WHEN r * 4 + c IN (1, 4, 11) THEN 0 ELSE 1 END AS merged FROM blocked GROUP BY 1, 2")
def _(spark, d):
    k = F.col("r") * 4 + F.col("c")
    level = F.when(k.isin(0, 6, 9), 9.0).when(k.isin(1, 4, 11), -3.0).otherwise(2.0)
    return B.merge_by_value(X.blocked(spark, d).withColumn("value", level + k / 100), 3)


@query("r05_transpose", "store:b item:b value:f", "SELECT item AS store, store AS item, value FROM sales_cells")
def _(spark, d):
    return M.transpose(X.sales_cells(spark, d))


@query(
    "a36_profiles_by_variance",
    "cluster_id:b size:b a:f b:f",
    """SELECT cluster_id, size, a, b FROM (SELECT *, row_number() OVER (ORDER BY (a - (a + b) / 2) * (a - (a + b) / 2) + (b - (a + b) / 2) * (b - (a + b) / 2) DESC, cluster_id) AS q FROM
      (SELECT c AS cluster_id, count(*) AS size, avg(a) AS a, avg(b) AS b FROM (SELECT store, avg(value) AS a, avg(value * item) AS b FROM sales_cells GROUP BY 1) JOIN store_members USING (store) GROUP BY 1)) WHERE q <= 3""",
)
def _(spark, d):
    x = X.sales_cells(spark, d).select("store", F.col("value").alias("a"), (F.col("value") * F.col("item")).alias("b"))
    return B.cluster_profiles(x, X.assignments(spark, d), "Store", "store", ["a", "b"], keep=3, by="variance")


@query("r10_leaf_order", "store:b position:b")
def _(spark, d):
    x, stores, _ = K.collect_matrix(X.sales_cells(spark, d))
    return spark.createDataFrame([(int(stores[i]), k) for k, i in enumerate(K.leaf_order(x))], "store long, position long")


# ------------------------------------------------------------------ forecasts


@query(
    "l07_lag_frame",
    "store:b item:b date:d y1:f y7:f promo1:f promo0:f",
    "SELECT store, item, date, y1, y7, promo1, promo0 FROM (SELECT store, item, date, lag(unit_sales, 1) OVER w AS y1, lag(unit_sales, 7) OVER w AS y7, coalesce(lag(onpromotion, 1) OVER w, 0) AS promo1, onpromotion AS promo0 FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY date)) WHERE y7 IS NOT NULL",
)
def _(spark, d):
    frame = L.lag_frame(X.panel(spark, d), "unit_sales", (1, 7), past=["onpromotion"], past_steps=(1,), future=["onpromotion"], future_steps=(0,))
    return frame.withColumnsRenamed({"unit_sales_lag_1": "y1", "unit_sales_lag_7": "y7", "onpromotion_lag_1": "promo1", "onpromotion_lag_0": "promo0"})


@query("l10_covariate_benchmark", "Model:s Dataset:s RMSE:f MAE:f R2:f")
def _(spark, d):
    rows = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales", "onpromotion"), 0.8)
    options = {"past": ["onpromotion"], "past_steps": (1, 7), "future": ["onpromotion"], "future_steps": (0,)}
    return L.benchmark(L.lag_frame(rows, "unit_sales", **options), "unit_sales", L.lag_names("unit_sales", **options), ["linear_regression", "huber", "gradient_boosting"])


@query("l09_covariate_forecasts", "Model:s store:b item:b RMSE:f MAE:f")
def _(spark, d):
    rows = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales", "onpromotion"), 0.8)
    rows = rows.join(L.eligible(X.panel(spark, d), "unit_sales").select("store", "item"), ["store", "item"], "left_semi")
    return L.evaluate(L.forecast_local(rows, "unit_sales", ["auto_arima", "linear_regression", "kalman"], future=["onpromotion"], scaled=True), rows, "unit_sales")


@query("l09_naive_forecasts", "store:b item:b date:d y:f yhat:f", "SELECT store, item, date, y, yhat FROM (SELECT store, item, date, split, y, last_value(CASE WHEN split = 'train' THEN y END IGNORE NULLS) OVER (PARTITION BY store, item ORDER BY date ROWS UNBOUNDED PRECEDING) AS yhat FROM split_fc) WHERE split = 'val' AND yhat IS NOT NULL")
def _(spark, d):
    rows = S.split_by_fraction(X.panel(spark, d).select("store", "item", "date", "unit_sales"), 0.8)
    return L.forecast_local(rows, "unit_sales", ["naive"], scaled=True)


# ------------------------------------------------------------------ streams


@query("t01_stream_tumbling", "event_type:s start:d n:b total:f", "SELECT event_type, CAST(DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 3 * 3 AS INTEGER) AS DATE) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    stream = T.event_stream(spark, d, X.table(spark, d, "events").schema, name="events.parquet")
    path = scratch_path(spark, "tumbling")
    return T.drain(T.tumbling(stream, ["event_type"], 3, "value", late="4000 days"), f"tumbling_{path[-32:]}", path)


@query("t05_online_clusters", "n:b", "SELECT count(DISTINCT store) AS n FROM sales_cells")
def _(spark, d):
    import numpy as np

    x, stores, items = K.collect_matrix(X.sales_cells(spark, d))
    start = K.double_kmeans(x, 3, 4, seed=1)
    learner, path = K.OnlineDoubleKMeans(start.centres, start.col_labels), scratch_path(spark, "rows")
    wide = M.to_wide(X.sales_cells(spark, d), "store", "item", "value", items)
    wide.repartition(3).write.parquet(path)
    labels: dict[int, int] = {}

    def fold(batch, epoch):
        pdf = batch.toPandas()  # a micro-batch of a catalogue's rows
        if len(pdf):
            found = learner.partial_fit(pdf[[str(i) for i in items]].to_numpy(float))
            labels.update(zip(pdf["store"].tolist(), np.asarray(found).tolist(), strict=True))

    stream = spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).parquet(path)
    T.each_batch(stream, fold, scratch_path(spark, "fold"))
    return spark.createDataFrame([(len(labels),)], "n long")
