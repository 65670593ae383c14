"""Scans and sinks."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import columns as C

SALES = T.StructType().add("id", "long").add("date", "date").add("store_nbr", "long").add("item_nbr", "long").add("unit_sales", "double").add("onpromotion", "boolean")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV with header, by suffix."""
    kind = PurePosixPath(path).suffix.lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == ".parquet":
        return reader.parquet(path)
    if kind == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    raise ValueError(f"unsupported file type: {path}")


def write_table(df: DataFrame | None, path: str) -> None:
    """Parquet or CSV with header, by suffix; None is skipped with a warning."""
    if df is None:
        warnings.warn(f"nothing to write to {path}", stacklevel=2)
        return
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == ".csv":
        df.write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unsupported file type: {path}")


def read_sales(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw sales with an explicit schema; id dropped, keys renamed, optional row limit (unordered)."""
    df = read_table(spark, path, SALES).drop("id").withColumnsRenamed({"store_nbr": "store", "item_nbr": "item"})
    return df if limit is None else df.limit(limit)


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """A panel with date as DATE and the store_item key. Order belongs to the windows and sinks that need it."""
    df = read_table(spark, path)
    return df.withColumn("date", F.to_date("date")).withColumn("store_item", C.store_item())


def pruned_scan(df: DataFrame, columns: list[str], stores: list[int], items: list[int], dates: list | None = None) -> DataFrame:
    """Membership filters and a projection that reach the Parquet scan."""
    out = df.where(F.col("store").isin(stores) & F.col("item").isin(items))
    if dates is not None:
        out = out.where(F.col("date").isin(dates))
    return out.select(*columns)


def write_blocks(df: DataFrame, path: str) -> None:
    """One partition folder per block_id; reads of some blocks prune the rest."""
    df.repartition("block_id").write.mode("overwrite").partitionBy("block_id").parquet(path)


def collect_metrics(spark: SparkSession, root: str) -> DataFrame:
    """All metrics CSV files below root as text columns, with the model name from the parent folder.

    Files may differ in columns: the union keeps all, in order of first sight. One pass groups the files by their header
    line, then each header is one read of its files, so the plan grows with the number of headers and not of files."""
    every = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*metrics*.csv")
    lines = every.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split_part(F.regexp_replace("value", "\r", ""), F.lit("\n"), F.lit(1)).alias("header"))
    found = lines.where("trim(header) <> ''").groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()  # file names only
    if not found:
        return spark.createDataFrame([], "model_name string, path string")
    frames = [spark.read.csv(r.paths, header=True).withColumn("path", F.col("_metadata.file_path")) for r in sorted(found, key=lambda r: r.paths)]
    own = [f.withColumn("model_name", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def write_single_csv(df: DataFrame, path: str) -> None:
    """A report as one CSV file (reports are small: one row per model and series)."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def load_model_config(path: str, known: Iterable[str]) -> dict[str, dict]:
    """Model parameters by model type; unknown types are skipped with a warning."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = set(known)
    for name in spec.keys() - known:
        warnings.warn(f"unknown model type: {name}", stacklevel=2)
    return {k: v for k, v in spec.items() if k in known}


def read_clusters(spark: SparkSession, path: str, store_cluster: str | None = None, item_cluster: str | None = None) -> DataFrame:
    """A table written by `write_clusters`, of exactly one store or item cluster: the filter prunes folders."""
    if (store_cluster is None) == (item_cluster is None):
        raise ValueError("give either a store cluster or an item cluster")
    key, value = ("store_cluster", store_cluster) if item_cluster is None else ("item_cluster", item_cluster)
    return spark.read.parquet(path).where(F.col(key).cast("string") == str(value))


def write_clusters(df: DataFrame, path: str) -> None:
    """One folder per (store_cluster, item_cluster)."""
    keys = ["store_cluster", "item_cluster"]
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_model(parts: dict[str, DataFrame], path: str) -> None:
    """A model's tables (factors, assignments, settings), one folder each."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    """A long tensor (store, item, feature, value) with a mask column, one row for each cell of the grid; a repeated cell is an
    error when the rows are read."""
    df = spark.read.parquet(path)
    axis = lambda c: df.select(c).distinct()
    cells = df.groupBy("store", "item", "feature").agg(F.count("*").alias("_n"), F.first("value").alias("value"))
    cells = cells.withColumn("value", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated cell")).cast("double")).otherwise(F.col("value"))).drop("_n")
    grid = axis("store").crossJoin(axis("item")).crossJoin(axis("feature"))  # the tensor's own size
    out = grid.join(cells, ["store", "item", "feature"], "left")
    return out.withColumn("mask", F.col("value").isNotNull())


def latest_versions(df: DataFrame, path: str = "path") -> DataFrame:
    """Of model_<store cluster>_<item cluster>_<name>[-v<n>] files the highest version per key."""
    pattern = r"model_([^_]+)_([^_]+)_(.+?)(?:-v(\d+))?(?:\.[a-z]+)?$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    version = F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0))
    rows = df.where(F.col(path).rlike(pattern)).select(part(1).alias("store_cluster"), part(2).alias("item_cluster"), part(3).alias("name"), version.alias("version"), F.col(path).alias("path"))
    return rows.groupBy("store_cluster", "item_cluster", "name").agg(F.max("version").alias("version"), F.max_by("path", F.struct("version", "path")).alias("path"))


def submission(df: DataFrame, key: str = "id", value: str = "unit_sales") -> DataFrame:
    """Rows for a submission file: values clamped at 0, four decimals as text, rounded from the double's exact value as C's printf
    does (ties of that value to even): Spark's rounding starts from the shortest decimal, where 0.00005 is a tie."""
    text = F.udf(lambda x: f"{x:.4f}", "string", useArrow=True)
    return df.select(key, text(F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(value))
