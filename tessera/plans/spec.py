"""A query: a Spark builder, its columns with types, and the equivalent SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.fixtures import with_tables

#: b BIGINT, f DOUBLE rounded to 6 digits, d DATE, s VARCHAR
_SPARK = {"b": lambda c: F.col(c).cast("long"), "f": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0), "d": lambda c: F.col(c).cast("date"), "s": lambda c: F.col(c).cast("string")}
_SQL = {"b": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0", "d": "CAST({0} AS DATE)", "s": "CAST({0} AS VARCHAR)"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: str  # "store:b date:d value:f"
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple(c.rsplit(":", 1)) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_SPARK[t](c).alias(c) for c, t in self._columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = ", ".join(f"{_SQL[t].format(c)} AS {c}" for c, t in self._columns())
        tables = with_tables(self.sql)
        return f"WITH {tables}{', ' if tables else ''}answer AS ({self.sql.strip()})\nSELECT {out} FROM answer"
