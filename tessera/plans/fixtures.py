"""The fixture adapter: retail panel tables from the shared star schema, in Spark and as a SQL prefix."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import panel as P

HOLIDAYS = [
    ("1996-01-01", "Holiday", "National", "Country"),
    ("1996-05-01", "Holiday", "National", "Country"),
    ("1996-05-01", "Event", "Regional", "REGION_1"),
    ("1997-03-20", "Holiday", "Regional", "AMERICA"),
    ("1997-06-15", "Holiday", "Local", "NATION_3"),
    ("1997-06-15", "Transfer", "National", "Country"),
    ("1998-02-28", "Additional", "Local", "NATION_7"),
    ("1998-08-10", "Holiday", "Local", "NOWHERE"),
    ("1999-12-24", "Bridge", "Regional", "ASIA"),
]

_VALUES = ", ".join(f"(DATE '{d}', '{t}', '{loc}', '{n}')" for d, t, loc, n in HOLIDAYS)

#: CTEs that give every reference query the same tables; each stands after those it reads.
CTES = {
    "panel": """MATERIALIZED (
  SELECT CAST(s_nationkey AS BIGINT) AS store, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS item,
         CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS unit_sales,
         MAX(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS onpromotion
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)""",
    "stores": """MATERIALIZED (
  SELECT CAST(n_nationkey AS BIGINT) AS store, n_name AS city, r_name AS state, chr(CAST(65 + n_nationkey % 5 AS INTEGER)) AS type,
         CAST(n_nationkey % 7 AS BIGINT) AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "items": """MATERIALIZED (
  SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS item, min(p_type) AS family, CAST(min(p_size) AS BIGINT) AS class,
         CASE WHEN CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 = 0 THEN 1 ELSE 0 END AS perishable FROM part GROUP BY p_brand)""",
    "transactions": """(
  SELECT CAST(s_nationkey AS BIGINT) AS store, CAST(l_shipdate AS DATE) AS date, count(DISTINCT l_orderkey) AS transactions
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)""",
    "holidays": f"""(SELECT * FROM (VALUES {_VALUES}) AS h(date, type, locale, locale_name))""",
    "store_members": """(
  SELECT store, CAST(c AS BIGINT) AS c FROM (SELECT store, unnest([CAST(cluster % 5 AS BIGINT), CAST(10 + store % 3 AS BIGINT)]) AS c FROM stores))""",
    "item_members": """(
  SELECT item, CAST(c AS BIGINT) AS c FROM (SELECT item, unnest([CAST(item % 5 AS BIGINT), CAST(100 + item % 2 AS BIGINT)]) AS c FROM items))""",
    "labels2": """(SELECT s.store, i.item, CAST(s.store % 3 AS BIGINT) AS store_cluster, CAST(i.item % 4 AS BIGINT) AS item_cluster FROM stores s CROSS JOIN items i)""",
    "daily": """MATERIALIZED (
  SELECT *, coalesce((unit_sales - lag(unit_sales) OVER w) / nullif(lag(unit_sales) OVER w, 0), 0) AS growth_rate
  FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY date))""",
    "weeks0": """(
  SELECT store, item, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, sum(unit_sales) AS sales_wk FROM panel GROUP BY 1, 2, 3)""",
    "spans": """(
  SELECT store, item, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM weeks0 GROUP BY 1, 2)""",
    "weeks": """MATERIALIZED (
  SELECT *, (sales_wk - lag(sales_wk) OVER w) / nullif(lag(sales_wk) OVER w, 0) AS growth_rate
  FROM (SELECT s.store, s.item, s.week_end, coalesce(w0.sales_wk, 0) AS sales_wk FROM spans s LEFT JOIN weeks0 w0 USING (store, item, week_end))
  WINDOW w AS (PARTITION BY store, item ORDER BY week_end))""",
    "cells": """(SELECT store, item, avg(growth_rate) AS value, count(growth_rate) AS n FROM daily GROUP BY 1, 2)""",
    "sales_cells": """MATERIALIZED (SELECT store, item, ln(1 + avg(unit_sales)) AS value FROM panel GROUP BY 1, 2)""",
    "blocked": """(SELECT c.store, c.item, value, CAST(c.store % 3 AS BIGINT) AS r, CAST(c.item % 4 AS BIGINT) AS c FROM sales_cells c)""",
    "row_m": """(SELECT store, CAST(store % 3 AS BIGINT) AS r FROM stores UNION SELECT store, 3 FROM stores WHERE store % 2 = 0)""",
    "col_m": """(SELECT item, CAST(item % 4 AS BIGINT) AS c FROM items UNION SELECT item, 4 FROM items WHERE item % 3 = 0)""",
    "blocks": """MATERIALIZED (
  SELECT r, c, avg(value) / 2 + (r - c) * 0.01 AS b FROM sales_cells JOIN row_m USING (store) JOIN col_m USING (item) GROUP BY 1, 2)""",
    "cand": """MATERIALIZED (SELECT s.store, s.item, s.value, r, c, b FROM sales_cells s JOIN row_m USING (store) JOIN col_m USING (item) JOIN blocks USING (r, c))""",
    "fc": """MATERIALIZED (
  SELECT store, item, date, unit_sales AS y, lag(unit_sales) OVER w AS yhat, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY store, item) AS n
  FROM panel WINDOW w AS (PARTITION BY store, item ORDER BY date))""",
    "split_fc": """MATERIALIZED (SELECT *, CASE WHEN pos >= floor((n - 1) * 0.8) THEN 'val' ELSE 'train' END AS split FROM fc)""",
    "logs": """(SELECT store, item, date, ln(1 + y) AS y, ln(1 + yhat) AS yhat, CASE WHEN item % 4 = 0 THEN 1.25 ELSE 1.0 END AS weight FROM fc WHERE yhat IS NOT NULL)""",
    "factors": """MATERIALIZED (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS component, CAST(unnest(embedding) AS DOUBLE) AS loading FROM embeddings)""",
}


def with_tables(sql: str) -> str:
    """The CTEs that sql reads, directly or through others, in their order."""
    used: set[str] = set()
    left = [sql]
    while left:
        words = set(re.findall(r"\w+", left.pop()))
        found = {name for name in CTES if name in words} - used
        used |= found
        left += [CTES[name] for name in found]
    return ", ".join(f"{name} AS {body}" for name, body in CTES.items() if name in used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand(c: str = "p_brand"):
    return F.regexp_extract(c, "([0-9]+)", 1).cast("long")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store, item, date, unit_sales, onpromotion): the fact is scanned for five columns, its dimensions join by measured size."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_discount")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("store"))
    pa = table(spark, sf_dir, "part").select("p_partkey", brand().alias("item"))
    rows = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(pa, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("store", "item", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("unit_sales"), F.max(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("onpromotion"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey").cast("long")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(key.alias("store"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.chr(65 + key % 5).alias("type"), (key % 7).alias("cluster"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(brand().alias("item")).agg(F.min("p_type").alias("family"), F.min("p_size").cast("long").alias("class"))
    return p.withColumn("perishable", F.when(F.col("item") % 4 == 0, 1).otherwise(0))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("store"))
    return li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("store", F.to_date("l_shipdate").alias("date")).agg(F.count_distinct("l_orderkey").alias("transactions"))


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "date string, type string, locale string, locale_name string").withColumn("date", F.to_date("date"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-memberships of stores and items: factor_name, item_name, cluster_id."""
    s = stores(spark, sf_dir).select(F.lit("Store").alias("factor_name"), F.col("store").cast("string").alias("item_name"), F.explode(F.array(F.col("cluster") % 5, 10 + F.col("store") % 3)).alias("cluster_id"))
    i = items(spark, sf_dir).select(F.lit("SKU").alias("factor_name"), F.col("item").cast("string").alias("item_name"), F.explode(F.array(F.col("item") % 5, 100 + F.col("item") % 2)).alias("cluster_id"))
    return s.unionByName(i)


def labels2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-membership clusters of every (store, item)."""
    return stores(spark, sf_dir).select("store", (F.col("store") % 3).alias("store_cluster")).crossJoin(items(spark, sf_dir).select("item", (F.col("item") % 4).alias("item_cluster")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_growth(panel(spark, sf_dir))


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).groupBy("store", "item").agg(F.log1p(F.avg("unit_sales")).alias("value"))


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_cells(spark, sf_dir).withColumn("r", F.col("store") % 3).withColumn("c", F.col("item") % 4)


def row_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stores(spark, sf_dir)
    return s.select("store", (F.col("store") % 3).alias("r")).unionByName(s.where("store % 2 = 0").select("store", F.lit(3).cast("long").alias("r")))


def col_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    return i.select("item", (F.col("item") % 4).alias("c")).unionByName(i.where("item % 3 = 0").select("item", F.lit(4).cast("long").alias("c")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sales_cells(spark, sf_dir).join(row_members(spark, sf_dir), "store").join(col_members(spark, sf_dir), "item")
    return rows.groupBy("r", "c").agg(F.avg("value").alias("m")).select("r", "c", (F.col("m") / 2 + (F.col("r") - F.col("c")) * 0.01).alias("b"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, lag-1 yhat and the 80 % split of every series."""
    from tessera.operators import series as S

    rows = panel(spark, sf_dir).select("store", "item", "date", F.col("unit_sales").alias("y"))
    rows = S.lags(rows, "y", [1]).withColumnRenamed("y_lag_1", "yhat")
    return S.split_by_fraction(rows, 0.8)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forecasts(spark, sf_dir).where("yhat is not null")
    return rows.select("store", "item", "date", F.log1p("y").alias("y"), F.log1p("yhat").alias("yhat"), F.when(F.col("item") % 4 == 0, 1.25).otherwise(1.0).alias("weight"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.posexplode("embedding").alias("component", "loading")).select("id", F.col("component").cast("long").alias("component"), F.col("loading").cast("double").alias("loading"))
