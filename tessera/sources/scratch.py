"""A folder for tables that a flow writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir, else the warehouse; in local mode a temporary
    folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        base = spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tessera-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    stem, dot, suffix = name.partition(".")
    return f"{base.rstrip('/')}/{stem}-{uuid.uuid4().hex}{dot}{suffix}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again in as many parts as there are cores: what is read several times is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartition(max(1, spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.parquet(path)
