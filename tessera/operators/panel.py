"""Panel builder: filters, selections, holiday expansion, dimension joins, encodings, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators.quantiles import global_quantiles


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Inclusive on both sides; either may be open."""
    if start is not None:
        df = df.where(F.col(date) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(date) <= F.to_date(F.lit(end)))
    return df


def only_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    """Semi join; small member tables are broadcast by their measured size."""
    return df.join(members, on, "left_semi")


def without_members(df: DataFrame, members: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(members, on, "left_anti")


def only_pairs(df: DataFrame, pairs: DataFrame, exact: bool = False) -> DataFrame:
    """Rows whose store and item both occur among the pairs (all combinations), or only the pairs themselves."""
    if exact:
        return df.join(pairs.select("store", "item"), ["store", "item"], "left_semi")
    return df.join(pairs.select("store"), "store", "left_semi").join(pairs.select("item"), "item", "left_semi")


def sample_pairs(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n distinct (store, item) pairs: the first ones, or by a seeded hash."""
    pairs = df.select("store", "item").distinct()
    return pairs.orderBy("store", "item").limit(n) if seed is None else bottom_k(pairs, n, key=["store", "item"], seed=seed)


def bottom_k(df: DataFrame, k: int, by: Sequence[str] = (), key: Sequence[str] = ("store", "item", "date"), seed: int = 0) -> DataFrame:
    """A uniform sample of k rows per group (of all rows without one) that is the same for every partitioning: those of least
    md5 of key and seed, ties by the key. Every task keeps its own k least per group before the exchange."""
    mark = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    marked = df.withColumn("_mark", mark)
    if not by:
        return marked.orderBy("_mark", *key).limit(k).drop("_mark")
    place = F.row_number().over(W.partitionBy(*by).orderBy("_mark", *key))
    return marked.withColumn("_place", place).where(F.col("_place") <= k).drop("_mark", "_place")


def top_n(df: DataFrame, value: str, group: str, n: int) -> DataFrame:
    return df.groupBy(group).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), group).limit(n)


def extreme_and_median_neighbours(df: DataFrame, value: str, group: str, top: int, bottom: int, median: int) -> DataFrame:
    """Groups with the `top` highest and `bottom` lowest totals and, of the rest, the 2 * median nearest the median total.

    All three zero selects every group. Ranks come from bounded top-k sorts, not from a global window."""
    totals = df.groupBy(group).agg(F.sum(value).alias("total"))
    if not (top or bottom or median):
        return totals.select(group)
    high = totals.orderBy(F.desc("total"), group).limit(top).select(group)
    low = totals.orderBy("total", group).limit(bottom).select(group)
    ends = high.unionByName(low).distinct()
    middle = totals.agg(F.percentile("total", 0.5).alias("middle"))
    near = totals.join(ends, group, "left_anti").join(F.broadcast(middle)).orderBy(F.abs(F.col("total") - F.col("middle")), group).limit(2 * median)
    return ends.unionByName(near.select(group)).distinct()


# ------------------------------------------------------------------ holidays and dimensions


def store_holidays(holidays: DataFrame, stores: DataFrame) -> DataFrame:
    """Distinct (date, store, locale, type): national ones for all stores, regional by state, local by city.

    holidays: date, type, locale, locale_name. Regional and local holidays without a store keep a NULL store."""
    hol = holidays.select("date", "type", "locale", "locale_name")
    national = hol.where("locale = 'National'").crossJoin(stores.select("store"))
    regional = hol.where("locale = 'Regional'").join(stores.select("store", F.col("state").alias("locale_name")), "locale_name", "left")
    local = hol.where("locale = 'Local'").join(stores.select("store", F.col("city").alias("locale_name")), "locale_name", "left")
    keep = ["date", "store", "locale", "type"]
    return national.select(keep).unionByName(regional.select(keep)).unionByName(local.select(keep)).distinct()


def with_holidays(panel: DataFrame, store_hols: DataFrame, fan_out: bool = False) -> DataFrame:
    """0/1 flags is_national, is_regional, is_local. fan_out keeps one row per holiday on a day with several."""
    flags = [F.when(F.col("locale") == v, 1).otherwise(0).alias(f"is_{v.lower()}") for v in ("National", "Regional", "Local")]
    rows = store_hols.where("store is not null").select("date", "store", *flags)
    if not fan_out:
        rows = rows.groupBy("date", "store").agg(*[F.max(c).alias(c) for c in ("is_national", "is_regional", "is_local")])
    return panel.join(rows, ["date", "store"], "left").fillna(0, ["is_national", "is_regional", "is_local"])


def with_transactions(panel: DataFrame, transactions: DataFrame) -> DataFrame:
    return panel.join(transactions, ["store", "date"], "left")


def with_dimension(panel: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return panel.join(dimension.select(key, *columns), key, "left")


def codes(df: DataFrame, column: str, as_text: bool = False, name: str | None = None) -> DataFrame:
    """Integer code of a column's rank among its distinct values, NULL -> -1; as_text ranks the values as strings.

    Ranked on the distinct levels and joined back, so the fact table is never put in one partition."""
    value = F.col(column).cast("string") if as_text else F.col(column)
    levels = df.select(value.alias("_level")).where("_level is not null").distinct()
    ranked = levels.select("_level", (F.row_number().over(W.orderBy("_level")) - 1).alias("_code"))
    out = df.join(ranked, value == F.col("_level"), "left")
    return out.withColumn(name or f"{column}_code", F.coalesce("_code", F.lit(-1)).cast("int")).drop("_level", "_code")


def with_dummies(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    levels = levels if levels is not None else sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())  # a category's levels
    return df.select("*", *C.dummies(column, levels, column))


def daily_growth(panel: DataFrame, keys: Sequence[str] = ("store", "item"), value: str = "unit_sales", date: str = "date") -> DataFrame:
    """growth_rate: change to the previous row of the series, values carried over NULLs first; NULL and infinite are 0."""
    w = W.partitionBy(*keys).orderBy(date)
    filled = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = panel.withColumn("_x", filled)
    return df.withColumn("growth_rate", F.coalesce(C.finite(C.change("_x", F.lag("_x").over(w))), F.lit(0.0))).drop("_x")


def build_panel(sales: DataFrame, stores: DataFrame, items: DataFrame, transactions: DataFrame, holidays: DataFrame, start: str | None = None, end: str | None = None, fan_out: bool = False) -> DataFrame:
    """The enriched panel: filter, five joins against small tables, keys, item weight, daily growth.

    Everything but the growth window is one stage; the window needs one exchange on (store, item)."""
    df = date_range(sales, start, end)
    df = with_transactions(df, transactions)
    df = with_holidays(df, store_holidays(holidays, stores), fan_out)
    df = with_dimension(df, stores, "store", ["city", "state", "type", "cluster"])
    df = with_dimension(df, items, "item", ["family", "class", "perishable"])
    df = df.withColumn("weight", C.item_weight("perishable")).withColumn("store_item", C.store_item())
    return daily_growth(df)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raises at plan time when a key repeats (one distributed aggregate); otherwise df itself."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {list(keys)}: {twice[0].asDict()}")
    return df


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the check inside its plan: whatever action runs it fails on a key that repeats. One aggregate by the keys, which a
    join on them reuses, and no job of its own."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(True).alias("_"))
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(row).alias("_row"))
    told = F.concat(F.lit(f"duplicate {list(keys)}: "), F.to_json(F.struct(*keys)))
    once = one.where(F.when(F.col("_n") > 1, F.raise_error(told).cast("boolean")).otherwise(True))
    return once.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join in which no key of the right side may occur twice; checked while it runs."""
    return left.join(unique(right, keys), list(keys), how)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Deterministic drop of duplicates: the first row per key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fill(df: DataFrame, medians: Sequence[str] = (), constants: dict[str, float] | None = None) -> DataFrame:
    """NULLs to a column's median (one-row broadcast) or to a constant."""
    if medians:
        stats = global_quantiles(df, {c: C.finite(c) for c in medians}, [0.5])
        stats = stats.select(*[F.get(f"`{c}`", F.lit(0)).alias(f"_m_{c}") for c in medians])
        df = df.join(F.broadcast(stats))
        df = df.withColumns({c: F.coalesce(C.finite(c), F.col(f"_m_{c}")) for c in medians}).drop(*[f"_m_{c}" for c in medians])
    return df.fillna(constants) if constants else df


def latest_row(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest order value per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def with_clusters(panel: DataFrame, store_clusters: DataFrame, item_clusters: DataFrame) -> DataFrame:
    """Single-membership cluster labels by store and by item."""
    return panel.join(store_clusters, "store", "left").join(item_clusters, "item", "left")


def with_memberships(panel: DataFrame, assignments: DataFrame, key: str, factor: str) -> DataFrame:
    """Multi-membership row expansion: one row per cluster the key belongs to, NULL cluster if none.

    assignments: factor_name, item_name, cluster_id."""
    own = assignments.where(F.col("factor_name") == factor).select(F.col("item_name").cast("long").alias(key), F.col("cluster_id").alias(f"{key}_cluster_id"))
    return panel.join(own, key, "left")


def cluster_medians(expanded: DataFrame, cluster: str, value: str = "growth_rate", name: str | None = None) -> DataFrame:
    """Median of value per (date, cluster), rows without a cluster left out."""
    return expanded.where(F.col(cluster).isNotNull()).groupBy("date", cluster).agg(C.safe_median(value).alias(name or f"{cluster}_median"))


def with_predictions(test: DataFrame, predictions: DataFrame, keys: Sequence[str], value: str = "unit_sales") -> DataFrame:
    """Predicted values where there are any, else the table's own."""
    pred = predictions.select(*keys, F.col(value).alias("_pred"))
    return test.join(pred, list(keys), "left").withColumn(value, F.coalesce("_pred", value)).drop("_pred")


def with_blocks(panel: DataFrame, assigned: DataFrame, keys: Sequence[str] = ("store", "item")) -> DataFrame:
    """block_id by key; a key with several blocks fails the query; rows outside every block (NULL or negative) go."""
    own = assigned.select(*keys, "block_id").distinct()
    return many_to_one(panel, own, keys, "inner").where("block_id >= 0")


def with_cluster_mean(pairs: DataFrame, value: str, clusters: Sequence[str] = ("store_cluster", "item_cluster"), name: str = "cluster_mean", means: DataFrame | None = None) -> DataFrame:
    """The mean of a pair's cluster joined back to it: of the pairs themselves (one row per cluster by construction), or from a
    table of means, in which a cluster that occurs twice fails the query."""
    if means is not None:
        return many_to_one(pairs, means.select(*clusters, F.col(value).alias(name)), clusters)
    return pairs.join(pairs.groupBy(*clusters).agg(F.avg(value).alias(name)), list(clusters), "left")


def with_median_columns(series: DataFrame, medians: DataFrame, cluster: str, value: str, names: Sequence, prefix: str) -> DataFrame:
    """Cluster medians as one column per cluster, joined by date."""
    wide = medians.groupBy("date").pivot(cluster, list(names)).agg(F.first(value))
    return series.join(wide.select("date", *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names]), "date", "left")
