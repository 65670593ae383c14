"""Queries of the panel builder, selections, encodings, sources and window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.plans import fixtures as X
from tessera.plans.spec import Query
from tessera.sources import io

QUERIES: list[Query] = []


def query(name: str, columns: str, sql: str | None = None):
    def add(build):
        QUERIES.append(Query(name, columns, build, sql))
        return build

    return add


@query(
    "p01_cluster_median_growth",
    "date:d state:s growth_median:f",
    "SELECT date, state, quantile_cont(growth_rate, 0.5) AS growth_median FROM daily JOIN stores USING (store) GROUP BY 1, 2",
)
def _(spark, d):
    rows = P.with_dimension(X.daily(spark, d), X.stores(spark, d), "store", ["state"])
    return P.cluster_medians(rows, "state", name="growth_median")


_FLAGS = """hs AS (
  SELECT date, store, locale, type FROM holidays CROSS JOIN stores WHERE locale = 'National'
  UNION SELECT h.date, s.store, h.locale, h.type FROM holidays h LEFT JOIN stores s ON h.locale_name = s.state WHERE h.locale = 'Regional'
  UNION SELECT h.date, s.store, h.locale, h.type FROM holidays h LEFT JOIN stores s ON h.locale_name = s.city WHERE h.locale = 'Local')"""
_FLAGS = _FLAGS.replace("date, store, locale, type FROM holidays CROSS", "date, store, locale, holidays.type FROM holidays CROSS")


@query(
    "p02_build_panel",
    "store:b item:b date:d unit_sales:f onpromotion:b transactions:b is_national:b is_regional:b is_local:b city:s state:s type:s cluster:b family:s class:b perishable:b weight:f store_item:s growth_rate:f",
    f"""SELECT * FROM (WITH {_FLAGS}, f AS (
      SELECT date, store, max(CASE WHEN locale='National' THEN 1 ELSE 0 END) AS is_national, max(CASE WHEN locale='Regional' THEN 1 ELSE 0 END) AS is_regional,
             max(CASE WHEN locale='Local' THEN 1 ELSE 0 END) AS is_local FROM hs WHERE store IS NOT NULL GROUP BY 1, 2)
    SELECT p.store, p.item, p.date, unit_sales, onpromotion, transactions, coalesce(is_national,0) AS is_national, coalesce(is_regional,0) AS is_regional, coalesce(is_local,0) AS is_local,
      city, state, type, cluster, family, class, perishable, CASE WHEN perishable=1 THEN 1.25 ELSE 1.0 END AS weight, p.store || '_' || p.item AS store_item,
      coalesce((unit_sales - lag(unit_sales) OVER w) / nullif(lag(unit_sales) OVER w, 0), 0) AS growth_rate
    FROM panel p LEFT JOIN transactions t ON p.store=t.store AND p.date=t.date LEFT JOIN f ON p.store=f.store AND p.date=f.date
      LEFT JOIN stores s ON p.store=s.store LEFT JOIN items i ON p.item=i.item
    WHERE p.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' WINDOW w AS (PARTITION BY p.store, p.item ORDER BY p.date))""",
)
def _(spark, d):
    return P.build_panel(X.panel(spark, d), X.stores(spark, d), X.items(spark, d), X.transactions(spark, d), X.holidays(spark), "1996-01-01", "1999-12-31")


@query("p03_store_holidays", "date:d store:b locale:s type:s", f"SELECT * FROM (WITH {_FLAGS} SELECT * FROM hs)")
def _(spark, d):
    return P.store_holidays(X.holidays(spark), X.stores(spark, d))


@query(
    "p04_holiday_fan_out",
    "store:b item:b date:d is_national:b is_regional:b is_local:b",
    f"""SELECT * FROM (WITH {_FLAGS} SELECT p.store, p.item, p.date, CASE WHEN locale='National' THEN 1 ELSE 0 END AS is_national,
      CASE WHEN locale='Regional' THEN 1 ELSE 0 END AS is_regional, CASE WHEN locale='Local' THEN 1 ELSE 0 END AS is_local
      FROM panel p LEFT JOIN hs ON p.store=hs.store AND p.date=hs.date)""",
)
def _(spark, d):
    return P.with_holidays(X.panel(spark, d), P.store_holidays(X.holidays(spark), X.stores(spark, d)), fan_out=True)


@query("p05_date_range", "store:b item:b date:d unit_sales:f", "SELECT * FROM panel WHERE date >= DATE '1997-01-01' AND date <= DATE '1997-03-31'")
def _(spark, d):
    return P.date_range(X.panel(spark, d), "1997-01-01", "1997-03-31")


@query("p06_top_items", "item:b total:f", "SELECT item, sum(unit_sales) AS total FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def _(spark, d):
    return P.top_n(X.panel(spark, d), "unit_sales", "item", 7)


@query(
    "p07_extremes_and_medians",
    "item:b",
    """SELECT item FROM (WITH t AS (SELECT item, sum(unit_sales) AS total FROM panel GROUP BY 1),
      e AS (SELECT item FROM (SELECT item FROM t ORDER BY total DESC, item LIMIT 4) UNION SELECT item FROM (SELECT item FROM t ORDER BY total, item LIMIT 4)),
      m AS (SELECT item FROM t, (SELECT quantile_cont(total, 0.5) AS med FROM t) WHERE item NOT IN (SELECT item FROM e) ORDER BY abs(total - med), item LIMIT 6)
      SELECT item FROM e UNION SELECT item FROM m)""",
)
def _(spark, d):
    return P.extreme_and_median_neighbours(X.panel(spark, d), "unit_sales", "item", 4, 4, 3)


@query("p08_member_filter", "store:b item:b date:d", "SELECT store, item, date FROM panel WHERE item IN (SELECT item FROM items WHERE perishable = 1)")
def _(spark, d):
    return P.only_members(X.panel(spark, d), X.items(spark, d).where("perishable = 1"), "item")


@query("p09_anti_filter", "store:b item:b date:d", "SELECT store, item, date FROM panel WHERE store NOT IN (SELECT store FROM stores WHERE type = 'A')")
def _(spark, d):
    return P.without_members(X.panel(spark, d), X.stores(spark, d).where("type = 'A'"), "store")


@query("p10_pairs_cross", "store:b item:b n:b", "SELECT store, item, count(*) AS n FROM panel WHERE store IN (1, 2, 5) AND item IN (3, 4, 9) GROUP BY 1, 2")
def _(spark, d):
    pairs = spark.createDataFrame([(1, 3), (2, 4), (5, 9)], "store long, item long")
    return P.only_pairs(X.panel(spark, d), pairs).groupBy("store", "item").agg(F.count("*").alias("n"))


@query("p11_pairs_exact", "store:b item:b n:b", "SELECT store, item, count(*) AS n FROM panel WHERE (store, item) IN ((1, 3), (2, 4), (5, 9)) GROUP BY 1, 2")
def _(spark, d):
    pairs = spark.createDataFrame([(1, 3), (2, 4), (5, 9)], "store long, item long")
    return P.only_pairs(X.panel(spark, d), pairs, exact=True).groupBy("store", "item").agg(F.count("*").alias("n"))


@query("p12_first_pairs", "store:b item:b", "SELECT DISTINCT store, item FROM panel ORDER BY 1, 2 LIMIT 25")
def _(spark, d):
    return P.sample_pairs(X.panel(spark, d), 25)


@query("p13_sampled_pairs", "store:b item:b", "SELECT store, item FROM (SELECT DISTINCT store, item FROM panel) ORDER BY md5(concat_ws('|', CAST(store AS VARCHAR), CAST(item AS VARCHAR), '7')), store, item LIMIT 25")
def _(spark, d):
    return P.sample_pairs(X.panel(spark, d), 25, seed=7)


@query("p14_categorical_codes", "store:b city:s code:b", "SELECT store, city, dense_rank() OVER (ORDER BY city) - 1 AS code FROM stores")
def _(spark, d):
    return P.codes(X.stores(spark, d), "city", name="code")


@query("p15_text_codes", "store:b code:b", "SELECT store, dense_rank() OVER (ORDER BY CAST(store AS VARCHAR)) - 1 AS code FROM stores")
def _(spark, d):
    return P.codes(X.stores(spark, d), "store", as_text=True, name="code")


@query("p16_dummies", "store:b type_B:b type_C:b type_D:b type_E:b", "SELECT store, " + ", ".join(f"CASE WHEN type='{t}' THEN 1 ELSE 0 END AS type_{t}" for t in "BCDE") + " FROM stores")
def _(spark, d):
    return P.with_dummies(X.stores(spark, d), "type")


@query("p17_split_key", "store:s item:s n:b", "SELECT split_part(k, '_', 1) AS store, split_part(k, '_', 2) AS item, count(*) AS n FROM (SELECT store || '_' || item AS k FROM panel) GROUP BY 1, 2")
def _(spark, d):
    s, i = C.split_store_item("k")
    return X.panel(spark, d).select(C.store_item().alias("k")).select(s, i).groupBy("store", "item").agg(F.count("*").alias("n"))


@query("p18_duplicates", "store:b date:d n_rows:b", "SELECT store, date, count(*) AS n_rows FROM panel GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return P.duplicates(X.panel(spark, d), ["store", "date"])


@query("p19_numeric_coercion", "event_id:b k:f", "SELECT event_id, TRY_CAST(regexp_extract(props, ': *([^}]*)', 1) AS DOUBLE) AS k FROM events")
def _(spark, d):
    return X.table(spark, d, "events").select("event_id", C.to_number(F.regexp_extract("props", ": *([^}]*)", 1)).alias("k"))


@query("p20_fill_medians", "store:b item:b date:d x:f", "SELECT store, item, date, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM q)) AS x FROM (SELECT *, CASE WHEN unit_sales > 20 THEN unit_sales END AS x FROM panel) q".replace("FROM q)", "FROM (SELECT CASE WHEN unit_sales > 20 THEN unit_sales END AS x FROM panel))"))
def _(spark, d):
    return P.fill(X.panel(spark, d).withColumn("x", F.when(F.col("unit_sales") > 20, F.col("unit_sales"))), ["x"])


@query("p21_keep_first", "store:b date:d item:b unit_sales:f", "SELECT store, date, item, unit_sales FROM (SELECT *, row_number() OVER (PARTITION BY store, date ORDER BY item) AS rn FROM panel) WHERE rn = 1")
def _(spark, d):
    return P.keep_first(X.panel(spark, d), ["store", "date"], ["item"])


@query("p22_latest_row", "store:b item:b date:d unit_sales:f", "SELECT store, item, max(date) AS date, arg_max(unit_sales, date) AS unit_sales FROM panel GROUP BY 1, 2")
def _(spark, d):
    return P.latest_row(X.panel(spark, d), ["store", "item"], "date")


@query("p23_two_clusters", "store:b item:b date:d store_cluster:b item_cluster:b", "SELECT store, item, date, store % 3 AS store_cluster, item % 4 AS item_cluster FROM panel")
def _(spark, d):
    s = X.stores(spark, d).select("store", (F.col("store") % 3).alias("store_cluster"))
    i = X.items(spark, d).select("item", (F.col("item") % 4).alias("item_cluster"))
    return P.with_clusters(X.panel(spark, d), s, i)


@query("p24_memberships", "store:b item:b date:d store_cluster_id:b", "SELECT p.store, item, date, c AS store_cluster_id FROM panel p LEFT JOIN store_members USING (store)")
def _(spark, d):
    return P.with_memberships(X.panel(spark, d), X.assignments(spark, d), "store", "Store")


@query("p25_store_cluster_medians", "date:d store_cluster_id:b store_median:f", "SELECT date, c AS store_cluster_id, quantile_cont(growth_rate, 0.5) AS store_median FROM daily JOIN store_members USING (store) GROUP BY 1, 2")
def _(spark, d):
    return P.cluster_medians(P.with_memberships(X.daily(spark, d), X.assignments(spark, d), "store", "Store"), "store_cluster_id", name="store_median")


@query("p26_item_cluster_medians", "date:d item_cluster_id:b item_median:f", "SELECT date, c AS item_cluster_id, quantile_cont(growth_rate, 0.5) AS item_median FROM daily JOIN item_members USING (item) GROUP BY 1, 2")
def _(spark, d):
    return P.cluster_medians(P.with_memberships(X.daily(spark, d), X.assignments(spark, d), "item", "SKU"), "item_cluster_id", name="item_median")


@query(
    "p27_medians_back",
    "store:b item:b date:d store_median:f",
    "SELECT dl.store, dl.item, dl.date, store_median FROM daily dl LEFT JOIN stores s USING (store) LEFT JOIN (SELECT date, state, quantile_cont(growth_rate, 0.5) AS store_median FROM daily JOIN stores USING (store) GROUP BY 1, 2) m ON m.date = dl.date AND m.state = s.state",
)
def _(spark, d):
    rows = P.with_dimension(X.daily(spark, d), X.stores(spark, d), "store", ["state"])
    return rows.join(P.cluster_medians(rows, "state", name="store_median"), ["date", "state"], "left")


@query("p28_with_predictions", "store:b item:b date:d unit_sales:f", "SELECT store, item, date, CASE WHEN item % 2 = 0 THEN unit_sales * 2 ELSE unit_sales END AS unit_sales FROM panel")
def _(spark, d):
    p = X.panel(spark, d)
    return P.with_predictions(p, p.where("item % 2 = 0").withColumn("unit_sales", F.col("unit_sales") * 2), ["store", "item", "date"])


@query("s01_pruned_scan", "date:d unit_sales:f", "SELECT date, unit_sales FROM panel WHERE store IN (1, 2) AND item IN (3, 7)")
def _(spark, d):
    return io.pruned_scan(X.panel(spark, d), ["date", "unit_sales"], [1, 2], [3, 7])


@query("s02_latest_versions", "store_cluster:s item_cluster:s name:s version:b path:s", "SELECT CAST(store AS VARCHAR) AS store_cluster, CAST(item AS VARCHAR) AS item_cluster, 'rf' AS name, max(month(date)) AS version, 'x/model_' || store || '_' || item || '_rf-v' || max(month(date)) || '.ckpt' AS path FROM panel GROUP BY store, item")
def _(spark, d):
    files = X.panel(spark, d).select(F.concat(F.lit("x/model_"), "store", F.lit("_"), "item", F.lit("_rf-v"), F.month("date"), F.lit(".ckpt")).alias("path"))
    return io.latest_versions(files.unionByName(files.select(F.concat("path", F.lit("/notes.txt")).alias("path"))).where("path not like '%notes%'"))


@query("s03_submission", "id:s unit_sales:s", "SELECT store || '_' || item || '_' || date AS id, printf('%.4f', greatest(growth_rate, 0)) AS unit_sales FROM daily")
def _(spark, d):
    rows = X.daily(spark, d).select(F.concat_ws("_", "store", "item", "date").alias("id"), F.col("growth_rate").alias("unit_sales"))
    return io.submission(rows)


# ------------------------------------------------------------------ windows

_W = "WINDOW w AS (PARTITION BY store, item ORDER BY date)"


@query("w01_daily_growth", "store:b item:b date:d growth_rate:f", "SELECT * FROM daily")
def _(spark, d):
    return X.daily(spark, d)


@query(
    "w02_weekly",
    "store:b item:b week_end:d sales_wk:f growth_rate:f direction:b growth_up:b growth_sideways:b growth_down:b",
    """SELECT *, CASE WHEN dir=1 THEN 1 END AS growth_up, CASE WHEN dir=0 THEN 1 END AS growth_sideways, CASE WHEN dir=-1 THEN 1 END AS growth_down, dir AS direction FROM
      (SELECT *, CASE WHEN growth_rate >= 0.05 THEN 1 WHEN growth_rate <= -0.05 THEN -1 ELSE 0 END AS dir FROM weeks)""",
)
def _(spark, d):
    return S.weekly(X.panel(spark, d))


@query(
    "w03_winsorised",
    "store:b item:b week_end:d growth_rate:f",
    "SELECT store, item, week_end, CASE WHEN growth_rate IS NOT NULL THEN least(greatest(growth_rate, lo), hi) END AS growth_rate FROM weeks, (SELECT quantile_cont(growth_rate, 0.01) AS lo, quantile_cont(growth_rate, 0.99) AS hi FROM weeks)",
)
def _(spark, d):
    return S.weekly(X.panel(spark, d), clip=(0.01, 0.99))


@query("w04_rolling_median", "store:b item:b date:d m:f", "SELECT store, item, date, quantile_cont(unit_sales, 0.5) OVER (PARTITION BY store, item ORDER BY date ROWS 6 PRECEDING) AS m FROM panel")
def _(spark, d):
    return S.rolling_median(X.panel(spark, d), "unit_sales", 7, "m")


@query(
    "w05_ewm",
    "store:b item:b date:d y:f",
    """SELECT store, item, date, y FROM (WITH RECURSIVE o AS (SELECT store, item, date, unit_sales AS x, row_number() OVER (PARTITION BY store, item ORDER BY date) AS k FROM panel),
      e AS (SELECT store, item, date, k, x AS y FROM o WHERE k = 1 UNION ALL
        SELECT o.store, o.item, o.date, o.k, e.y * (1 - 2.0/8) + o.x * (2.0/8) FROM e JOIN o ON o.store = e.store AND o.item = e.item AND o.k = e.k + 1) SELECT * FROM e)""",
)
def _(spark, d):
    return S.ewm(X.panel(spark, d), "unit_sales", 7, "y")


@query("w06_rolling_mean", "store:b item:b date:d m:f", "SELECT store, item, date, avg(unit_sales) OVER (PARTITION BY store, item ORDER BY date ROWS 3 PRECEDING) AS m FROM panel")
def _(spark, d):
    return S.rolling_mean(X.panel(spark, d), "unit_sales", 4, "m")


@query("w07_lead_target", "store:b item:b date:d y:f", f"SELECT store, item, date, lead(growth_rate) OVER w AS y FROM daily {_W}")
def _(spark, d):
    return S.lead_target(X.daily(spark, d))


@query("w08_block_lead", "store:b item:b date:d y:f", "SELECT store, item, date, lead(growth_rate) OVER (PARTITION BY store % 3 ORDER BY date, store, item) AS y FROM daily")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = X.daily(spark, d).withColumn("block_id", F.col("store") % 3)
    return rows.withColumn("y", F.lead("growth_rate").over(W.partitionBy("block_id").orderBy("date", "store", "item")))


@query("w09_windows_data", "date:d window_id:b", "SELECT date, floor((row_number() OVER (ORDER BY date) - 1) / 14) AS window_id FROM (SELECT DISTINCT date FROM panel)")
def _(spark, d):
    return S.window_ids(X.panel(spark, d).select("date").distinct(), 14)


@query(
    "w10_windows_calendar",
    "date:d window_id:b",
    "SELECT date, window_id FROM (SELECT date, floor(date_diff('day', date, b) / 14) AS window_id, a, b FROM (SELECT DISTINCT date FROM panel), (SELECT min(date) AS a, max(date) AS b FROM panel)) WHERE (window_id + 1) * 14 <= date_diff('day', a, b) + 1",
)
def _(spark, d):
    return S.window_ids(X.panel(spark, d).select("date").distinct(), 14, calendar=True)


_WIDE = """SELECT store, item, min(date) AS start_date, max(CASE WHEN dd=1 THEN unit_sales END) AS sales_day_1, max(CASE WHEN dd=2 THEN unit_sales END) AS sales_day_2, max(CASE WHEN dd=3 THEN unit_sales END) AS sales_day_3,
      max(CASE WHEN dd=1 THEN g END) AS growth_rate_1, max(CASE WHEN dd=2 THEN g END) AS growth_rate_2, max(CASE WHEN dd=3 THEN g END) AS growth_rate_3 FROM
      (SELECT *, (k // 3) AS wid, k % 3 + 1 AS dd FROM (SELECT *, row_number() OVER w - 1 AS k, 100 * (unit_sales - lag(unit_sales) OVER w) / nullif(lag(unit_sales) OVER w, 0) AS g FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY date)))
      GROUP BY store, item, wid HAVING count(*) = 3"""


@query("w11_wide_windows", "store:b item:b start_date:d sales_day_1:f sales_day_2:f sales_day_3:f growth_rate_1:f growth_rate_2:f growth_rate_3:f", _WIDE)
def _(spark, d):
    return S.wide_windows(X.panel(spark, d), 3)


@query("w12_next_window", "store:b item:b start_date:d y_sales_day_1:f", f"SELECT store, item, start_date, lead(sales_day_1) OVER (PARTITION BY store, item ORDER BY start_date) AS y_sales_day_1 FROM ({_WIDE})")
def _(spark, d):
    return S.next_window_targets(S.wide_windows(X.panel(spark, d), 3), ["sales_day_1"])


@query(
    "w13_ma1_forecast",
    "store:b item:b date:d forecast:f",
    """WITH RECURSIVE g AS (SELECT list(-0.95 + 1.9 * i / 38 ORDER BY i) AS grid FROM range(39) t(i)),
      s AS (SELECT store, item, date, growth_rate AS v, row_number() OVER w AS i, first_value(growth_rate) OVER w AS shift, count(*) OVER (PARTITION BY store, item) AS len FROM daily WINDOW w AS (PARTITION BY store, item ORDER BY date)),
      z AS (SELECT store, item, CAST(0 AS BIGINT) AS i, list_transform(grid, lambda x: 0.0::DOUBLE) AS e, list_transform(grid, lambda x: 0.0::DOUBLE) AS m, list_transform(grid, lambda x: [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS q, 0.0::DOUBLE AS total, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, 0.0::DOUBLE AS shift FROM (SELECT DISTINCT store, item FROM s), g),
      r AS (SELECT * FROM z UNION ALL SELECT store, item, i, e, m, list_transform(range(1, 40), lambda k: [q[k][1] + e[k] * e[k], q[k][2] + e[k] * m[k], q[k][3] + m[k] * m[k]]) AS q, total, low, high, shift FROM
        (SELECT r.store, r.item, s.i, list_transform(range(1, 40), lambda k: (s.v - s.shift) - grid[k] * r.e[k]) AS e, list_transform(range(1, 40), lambda k: 1 - grid[k] * r.m[k]) AS m, r.q, r.total + (s.v - s.shift) AS total, least(coalesce(r.low, s.v), s.v) AS low, greatest(coalesce(r.high, s.v), s.v) AS high, s.shift FROM r JOIN s ON s.store = r.store AND s.item = r.item AND s.i = r.i + 1, g)),
      f AS (SELECT store, item, i, e, m, grid, total / i AS mean, shift, list_transform(q, lambda x: x[1] - 2 * (total / i) * x[2] + (total / i) * (total / i) * x[3]) AS sse FROM r, g WHERE i >= 7 AND high > low),
      b AS (SELECT *, list_position(sse, list_min(sse)) AS k FROM f)
      SELECT s.store, s.item, s.date, b.shift + mean + grid[k] * (e[k] - mean * m[k]) AS forecast FROM s LEFT JOIN b ON b.store = s.store AND b.item = s.item AND b.i = s.i - 1""",
)
def _(spark, d):
    return S.ma1_walk_forward(X.daily(spark, d))


@query("w15_fill_days", "store:b n:b total:f", "SELECT store, sum(date_diff('day', a, b) + 1) AS n, sum(t) AS total FROM (SELECT store, item, min(date) AS a, max(date) AS b, sum(unit_sales) AS t FROM panel GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return S.fill_days(X.panel(spark, d)).groupBy("store").agg(F.count("*").alias("n"), F.sum("unit_sales").alias("total"))


@query("w16_date_split", "split:s n:b", "SELECT CASE WHEN date_diff('day', date, b) < 30 THEN 'test' WHEN date_diff('day', date, b) < 90 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM panel, (SELECT max(date) AS b FROM panel) GROUP BY 1")
def _(spark, d):
    return S.split_by_date(X.panel(spark, d), 60, 30).groupBy("split").agg(F.count("*").alias("n"))


@query("w17_fraction_split", "store:b item:b date:d split:s", "SELECT store, item, date, split FROM split_fc")
def _(spark, d):
    return S.split_by_fraction(X.panel(spark, d), 0.8)


@query("w18_differences", "store:b item:b date:d diff:f", f"SELECT store, item, date, unit_sales - lag(unit_sales) OVER w AS diff FROM panel {_W}")
def _(spark, d):
    return S.difference(X.panel(spark, d), "unit_sales")


@query("w19_running_median", "store:b item:b date:d running_median:f", "SELECT store, item, date, quantile_cont(unit_sales, 0.5) OVER (PARTITION BY store, item ORDER BY date ROWS UNBOUNDED PRECEDING) AS running_median FROM panel")
def _(spark, d):
    return S.running_median(X.panel(spark, d), "unit_sales")


@query("w20_online_median", "store:b item:b online_median:f", "SELECT store, item, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(unit_sales ORDER BY date)), lambda e, x: e + 0.1 * sign(x - e)) AS online_median FROM panel GROUP BY 1, 2")
def _(spark, d):
    return S.online_median(X.panel(spark, d), "unit_sales")


@query("w22_cumulative", "store:b item:b date:d cum:f", "SELECT store, item, date, sum(unit_sales) OVER (PARTITION BY store, item ORDER BY unit_sales DESC, date ROWS UNBOUNDED PRECEDING) AS cum FROM panel")
def _(spark, d):
    return S.cumulative(X.panel(spark, d), "unit_sales", "cum", ["store", "item"], [F.desc("unit_sales"), "date"])


@query("w23_forward_fill", "store:b item:b date:d x:f", "SELECT store, item, date, last_value(x IGNORE NULLS) OVER (PARTITION BY store, item ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT *, CASE WHEN unit_sales > 25 THEN unit_sales END AS x FROM panel)")
def _(spark, d):
    return S.forward_fill(X.panel(spark, d).withColumn("x", F.when(F.col("unit_sales") > 25, F.col("unit_sales"))), "x")


@query("w24_value_gaps", "store:b total:f gap:f jump:f", "SELECT store, total, total - lag(total) OVER w AS gap, (total - lag(total) OVER w) / nullif(lag(total) OVER w, 0) AS jump FROM (SELECT store, item, sum(unit_sales) + item / 1000.0 AS total FROM panel GROUP BY 1, 2) WINDOW w AS (PARTITION BY store ORDER BY total)")
def _(spark, d):
    rows = X.panel(spark, d).groupBy("store", "item").agg(F.sum("unit_sales").alias("t")).select("store", (F.col("t") + F.col("item") / 1000.0).alias("total"))
    return S.value_gaps(rows, "total", ["store"])


@query("w25_lags", "store:b item:b date:d unit_sales_lag_1:f unit_sales_lag_30:f", f"SELECT store, item, date, lag(unit_sales, 1) OVER w AS unit_sales_lag_1, lag(unit_sales, 30) OVER w AS unit_sales_lag_30 FROM panel {_W}")
def _(spark, d):
    return S.lags(X.panel(spark, d), "unit_sales", [1, 30])


@query(
    "f01_calendar",
    "date:d dayofweek:b weekofmonth:b monthofyear:b paycycle_ratio:f season_ratio:f dayofweek_sin:f dayofweek_cos:f weekofmonth_sin:f weekofmonth_cos:f monthofyear_sin:f monthofyear_cos:f paycycle_sin:f season_cos:f",
    """SELECT *, sin(2*pi()*dayofweek/7) AS dayofweek_sin, cos(2*pi()*dayofweek/7) AS dayofweek_cos, sin(2*pi()*weekofmonth/5) AS weekofmonth_sin, cos(2*pi()*weekofmonth/5) AS weekofmonth_cos,
      sin(2*pi()*monthofyear/12) AS monthofyear_sin, cos(2*pi()*monthofyear/12) AS monthofyear_cos, sin(2*pi()*paycycle_ratio) AS paycycle_sin, cos(2*pi()*season_ratio) AS season_cos FROM (
      SELECT date, isodow(date) - 1 AS dayofweek, (day(date) - 1) // 7 + 1 AS weekofmonth, month(date) AS monthofyear,
        CASE WHEN a = b THEN 0 ELSE least(greatest(date_diff('day', a, date) * 1.0 / date_diff('day', a, b), 0), 1) END AS paycycle_ratio,
        (date_diff('day', make_date(y, 3, 20), date) % 365) / 365.0 AS season_ratio FROM (
        SELECT date, CASE WHEN day(date) >= 15 THEN CAST(date_trunc('month', date) AS DATE) + 14 ELSE CAST(date_trunc('month', date) AS DATE) - 1 END AS a,
          CASE WHEN day(date) >= 15 THEN last_day(date) ELSE CAST(date_trunc('month', date) AS DATE) + 14 END AS b,
          year(date) - CASE WHEN date < make_date(year(date), 3, 20) THEN 1 ELSE 0 END AS y FROM (SELECT DISTINCT date FROM panel)))""",
)
def _(spark, d):
    return S.calendar_features(X.panel(spark, d).select("date").distinct())


@query("f02_value_functions", "store:b item:b date:d lg:f hub:f soft:f dir:b clipped:f", """SELECT store, item, date, ln(1 + unit_sales) AS lg, CASE WHEN abs(growth_rate) <= 1 THEN 0.5 * growth_rate * growth_rate ELSE abs(growth_rate) - 0.5 END AS hub,
      sign(growth_rate) * greatest(abs(growth_rate) - 0.1, 0) AS soft, CASE WHEN growth_rate >= 0.1 THEN 1 WHEN growth_rate <= -0.1 THEN -1 ELSE 0 END AS dir, least(greatest(growth_rate, -0.5), 0.5) AS clipped FROM daily""")
def _(spark, d):
    g = "growth_rate"
    return X.daily(spark, d).select("store", "item", "date", F.log1p("unit_sales").alias("lg"), C.huber(g).alias("hub"), C.soft_threshold(g, F.lit(0.1)).alias("soft"), C.direction(g, 0.1).alias("dir"), C.clip(g, -0.5, 0.5).alias("clipped"))
