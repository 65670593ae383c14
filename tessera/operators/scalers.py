"""Scalers as Spark ML stages: fitted in one pass, written and read like other stages, with the inverse in the same object.

Each column of a group is transformed by log1p where the group says so, then by its scaler: `minmax` to [0, 1], `standard`
by mean and population deviation, `robust` by median and interquartile range, `none`. A constant column is only moved."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators.quantiles import global_quantiles

KINDS = ("minmax", "standard", "robust", "none")


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "columns to scale", TypeConverters.toListString)
    kinds = Param(Params._dummy(), "kinds", "scaler of each column", TypeConverters.toListString)
    logs = Param(Params._dummy(), "logs", "columns taken through log1p first", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "value of missing cells before anything else", TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(columns=[], kinds=[], logs=[], fill=0.0)

    def _raw(self, c: str) -> Column:
        """The column filled, and in log space where it belongs there."""
        x = F.coalesce(C.finite(f"`{c}`"), F.lit(self.getOrDefault(self.fill)))
        return F.log1p(x) if c in self.getOrDefault(self.logs) else x


class PanelScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a PanelScalerModel on rows where `train` holds (all rows if it is empty)."""

    train = Param(Params._dummy(), "train", "SQL condition of the rows to fit on", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, groups: dict[str, list[str]] | None = None, logs: list[str] | None = None, train: str = "", fill: float = 0.0):
        """groups: scaler -> its columns."""
        super().__init__()
        self._setDefault(train="")
        pairs = [(c, kind) for kind, names in (groups or {}).items() for c in names]
        if unknown := {kind for _, kind in pairs} - set(KINDS):
            raise ValueError(f"unknown scalers: {sorted(unknown)}")
        if len({c for c, _ in pairs}) < len(pairs):
            raise ValueError("a column is in two groups")
        self._set(columns=[c for c, _ in pairs], kinds=[k for _, k in pairs], logs=logs or [], train=train, fill=fill)

    def _fit(self, dataset: DataFrame) -> PanelScalerModel:
        names, kinds = self.getOrDefault(self.columns), self.getOrDefault(self.kinds)
        condition = self.getOrDefault(self.train)
        rows = dataset.where(condition) if condition else dataset
        raw = rows.select(*[self._raw(c).alias(f"_{i}") for i, c in enumerate(names)])
        plain = {i: k for i, k in enumerate(kinds) if k in ("minmax", "standard")}
        ends = {"minmax": (F.min, F.max), "standard": (F.avg, F.stddev_pop)}
        stats = [f(f"_{i}").alias(f"{j}_{i}") for i, k in plain.items() for j, f in enumerate(ends[k])]
        got = raw.agg(*stats).first().asDict() if stats else {}
        robust = [i for i, k in enumerate(kinds) if k == "robust"]
        quartiles = global_quantiles(raw, {f"_{i}": F.col(f"_{i}") for i in robust}, [0.25, 0.5, 0.75]).first().asDict() if robust else {}
        middle, spread = [], []
        for i, kind in enumerate(kinds):
            a, b = 0.0, 1.0
            if kind == "minmax" and got[f"0_{i}"] is not None:
                a, b = got[f"0_{i}"], got[f"1_{i}"] - got[f"0_{i}"]
            elif kind == "standard" and got[f"0_{i}"] is not None:
                a, b = got[f"0_{i}"], got[f"1_{i}"]
            elif kind == "robust" and (quartiles.get(f"_{i}") or [None])[0] is not None:
                q = quartiles[f"_{i}"]
                a, b = q[1], q[2] - q[0]
            middle.append(float(a))
            spread.append(float(b) if b else 1.0)
        return self._copyValues(PanelScalerModel()._set(middle=middle, spread=spread))


class PanelScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """transform scales the columns in place; inverse_transform gives back what was scaled (missing cells as their fill)."""

    middle = Param(Params._dummy(), "middle", "what is subtracted", TypeConverters.toListFloat)
    spread = Param(Params._dummy(), "spread", "what it is divided by", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(middle=[], spread=[])

    def _parameters(self) -> list[tuple[str, float, float]]:
        return list(zip(*(self.getOrDefault(p) for p in (self.columns, self.middle, self.spread)), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (self._raw(c) - F.lit(a)) / F.lit(b) for c, a, b in self._parameters()})

    def inverse_transform(self, dataset: DataFrame, only: list[str] | None = None) -> DataFrame:
        """The scaled columns back in their own units; only: some of them, such as predictions named like the target."""
        logs = self.getOrDefault(self.logs)
        back = lambda c, a, b: F.expm1(F.col(f"`{c}`") * b + a) if c in logs else F.col(f"`{c}`") * b + a
        return dataset.withColumns({c: back(c, a, b) for c, a, b in self._parameters() if only is None or c in only})
