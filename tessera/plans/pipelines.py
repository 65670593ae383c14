"""End-to-end flows over the operators, and the parsing of their parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import columns as C
from tessera.operators import blocks as B
from tessera.operators import clustering as K
from tessera.operators import forecasting as L
from tessera.operators import global_models as G
from tessera.operators import isotonic as I
from tessera.operators import matrix as M
from tessera.operators import metrics as E
from tessera.operators import panel as P
from tessera.operators import series as S
from tessera.operators import statistics as A

#: Parameters that the flows use unless told otherwise.
DEFAULTS = {"tau": 0.05, "smooth": 4, "assignment_share": 0.9, "items_top": 700, "items_median": 300, "items_bottom": 700, "train_share": 0.8, "least_points": 15}


def parse_range(text: str | None) -> list[float] | list[int] | None:
    """'a:b' of integers counts from a to b, of decimals by 0.001; 'a,b' lists decimals; empty is None."""
    if not text:
        return None
    if ":" in text:
        a, b = (s.strip() for s in text.split(":"))
        if "." not in a + b:
            return list(range(int(a), int(b)))
        n = max(0, -int(-round((float(b) - float(a)) / 0.001, 6) // 1))
        return [round(float(a) + 0.001 * i, 9) for i in range(n)]
    return [float(s) for s in text.split(",")]


def parse_flag(text: str | bool) -> bool:
    if isinstance(text, bool):
        return text
    if text.strip().lower() in ("yes", "true", "t", "y", "1"):
        return True
    if text.strip().lower() in ("no", "false", "f", "n", "0"):
        return False
    raise ValueError(f"not a truth value: {text}")


def preprocess(sales: DataFrame, stores: DataFrame, items: DataFrame, transactions: DataFrame, holidays: DataFrame, start: str | None = None, end: str | None = None, top: int = 700, median: int = 300, bottom: int = 700, fan_out: bool = False) -> DataFrame:
    """Raw tables to panel: date filter, item selection by totals, joins, encodings, growth."""
    rows = P.date_range(sales, start, end)
    chosen = P.extreme_and_median_neighbours(rows, "unit_sales", "item", top, bottom, median)
    rows = P.only_members(rows, chosen, "item")
    panel = P.build_panel(rows, stores, items, transactions, holidays, fan_out=fan_out)
    for column in ("family", "class", "cluster"):
        panel = P.codes(panel, column, as_text=True)
    return panel


def weekly_features(panel: DataFrame, tau: float = 0.05, smooth: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weekly growth and the clustering features (imputed, raw, diagnostics)."""
    weeks = S.weekly(panel, tau=tau)
    return A.clustering_features(weeks, tau=tau, smooth=smooth)


def cyclical_features(panel: DataFrame, window: int = 7) -> DataFrame:
    """Calendar encodings, rolling medians and decayed means of sales and growth."""
    rows = S.calendar_features(panel)
    for value in ("unit_sales", "growth_rate"):
        rows = S.rolling_median(rows, value, window, f"{value}_rolling_median")
        rows = S.ewm(rows, value, window, f"{value}_ewm")
    return rows


def supervised(features: DataFrame) -> DataFrame:
    """Features with the next day's growth as y; rows without it go."""
    return S.lead_target(features).where("y is not null")


def cluster_panel(spark: SparkSession, panel: DataFrame, n_rows: Sequence[int], n_cols: Sequence[int], value: str = "growth_rate", restarts: int = 2) -> tuple[DataFrame, DataFrame]:
    """Normalise, sweep settings, refit the best and join `cluster` = r_c back to the panel: (panel, scores)."""
    matrix = M.normalise(panel, value)
    x, stores, items = K.collect_matrix(matrix)
    scores = K.sweep(spark, x, n_rows, n_cols, restarts)
    best = scores.orderBy("bic", "n_row", "n_col").first()
    fit = K.double_kmeans(x, best.n_row, best.n_col, seed=best.restart)
    rows = K.label_frame(spark, stores, fit.row_labels, "store", "store_cluster")
    cols = K.label_frame(spark, items, fit.col_labels, "item", "item_cluster")
    out = P.with_clusters(panel, rows, cols)
    return out.withColumn("cluster", F.concat_ws("_", "store_cluster", "item_cluster")), scores


def explain_panel(spark: SparkSession, panel: DataFrame, n_row: int, n_col: int, value: str = "growth_rate", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Binary tri-factorisation of the normalised matrix: (cell assignments, explained blocks)."""
    matrix = M.normalise(panel, value).select("store", "item", "value")
    x, stores, items = K.collect_matrix(matrix)
    m = K.binary_tri_factorisation(x, n_row, n_col, seed=seed)
    long = lambda keys, bits, key, name: spark.createDataFrame([(int(k), int(j)) for k, row in zip(keys, bits, strict=True) for j in row.nonzero()[0]], f"{key} long, {name} long")
    rows, cols = long(stores, m.u, "store", "r"), long(items, m.v, "item", "c")
    blocks = spark.createDataFrame([(i, j, float(m.b[i, j])) for i in range(m.b.shape[0]) for j in range(m.b.shape[1])], "r long, c long, b double")
    return B.assign_blocks(matrix, rows, cols, blocks, n_cols=m.b.shape[1]), B.explain_blocks(matrix, rows, cols, blocks)


def tensor_assignments(spark: SparkSession, features: DataFrame, columns: Sequence[str], ranks: tuple[int, int, int], share: float = 0.9) -> DataFrame:
    """Tucker factors of the scaled store x item x feature tensor to multi-memberships: factor_name, item_name, cluster_id."""
    import numpy as np

    tensor = M.centre_features(M.to_tensor(features, columns))
    parts = [K.collect_matrix(tensor.where(F.col("feature") == c).withColumns({k: F.col(k).cast("long") for k in ("store", "item")})) for c in columns]
    stores, items = parts[0][1], parts[0][2]
    t = np.stack([p[0] for p in parts], axis=2)
    _, factors, _ = K.tucker(t, ranks)
    out = None
    for name, keys, f in (("Store", stores, factors[0]), ("SKU", items, factors[1])):
        long = spark.createDataFrame([(int(k), j, float(v)) for k, row in zip(keys, f, strict=True) for j, v in enumerate(row)], "id long, component long, loading double")
        own = B.flat_assignments(B.cumulative_threshold(long, share), long, name)
        out = own if out is None else out.unionByName(own)
    return out


def forecast_all(panel: DataFrame, models: Sequence[str], value: str = "unit_sales", share: float = 0.8) -> DataFrame:
    """Every eligible series, every local model: metrics rows."""
    series = L.prepared(panel, value, share)
    return L.evaluate(L.forecast_local(series, value, models), series, value)


def calibrated_suite(frame: DataFrame, value: str, features: Sequence[str], strengths: dict[str, float], fold: Column, folds: int) -> DataFrame:
    """The benchmark suite: per model (a ridge strength by name) the report rows of M8 for plain predictions, and for predictions
    through an isotonic calibration that was fitted on the training rows' out-of-fold predictions, which no model has seen.

    Everything is fitted from one pass of moments per model; the calibration maps are pooled by `isotonic_blocks`."""
    out = None
    for name, reg in strengths.items():
        model = G.fit_ridge(frame.where("split = 'train'"), value, features, reg)
        plain = frame.select("split", F.col(value).alias("y"), model.column().alias("yhat"))
        unseen = G.out_of_fold_ridge(frame.where("split = 'train'"), value, features, fold, folds, reg).select(F.col(value).alias("y"), "yhat")
        calibrated = I.apply_isotonic(plain, I.isotonic_blocks(unseen, "yhat", "y"), "yhat", "yhat")
        for done, rows in ((False, plain), (True, calibrated)):
            report = E.report_rows(rows, calibrate=False).withColumn("Calibrated", F.lit(done)).withColumn("Model", F.lit(name))
            out = report if out is None else out.unionByName(report)
    return out


def register_udtf(spark: SparkSession) -> None:
    """SQL table function generate_windows(first, last, days, calendar): window_id, start_date, end_date."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="window_id int, start_date date, end_date date")
    class GenerateWindows:
        def eval(self, first, last, days: int, calendar: bool):
            import datetime as dt

            if days <= 0:
                raise ValueError("window size must be positive")
            n = (last - first).days + 1
            step = dt.timedelta(days=days)
            for i in range(n // days if calendar else -(-n // days)):
                if calendar:
                    yield i, last - step * (i + 1) + dt.timedelta(days=1), last - step * i
                else:
                    yield i, first + step * i, min(last, first + step * (i + 1) - dt.timedelta(days=1))

    spark.udtf.register("generate_windows", GenerateWindows)


def register_series_windows(spark: SparkSession) -> None:
    """SQL table function series_windows(rows => TABLE(t) ..., days => n): the windows of n days of every series of a table with
    store, item and date: store, item, window_id, start_date, end_date, n_rows (rows inside). The function itself asks for the
    partitioning by series and the order by date, so the call needs neither, and a series is streamed row by row."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

    @udtf
    class SeriesWindows:
        @staticmethod
        def analyze(rows: AnalyzeArgument, days: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("rows must be a table")
            if days.value is None or days.value <= 0:
                raise ValueError("days must be a positive constant")
            names = {f.name: f.dataType for f in rows.dataType.fields}
            schema = T.StructType().add("store", names["store"]).add("item", names["item"])
            schema = schema.add("window_id", T.IntegerType()).add("start_date", T.DateType()).add("end_date", T.DateType()).add("n_rows", T.LongType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("store"), PartitioningColumn("item")], orderBy=[OrderingColumn("date")])

        def __init__(self):
            self.key = self.first = self.at = None
            self.n = 0

        def _window(self):
            import datetime as dt

            start = self.first + dt.timedelta(days=self.at * self.days)
            return (*self.key, self.at, start, start + dt.timedelta(days=self.days - 1), self.n)

        def eval(self, rows, days: int):
            if rows["date"] is None:
                return
            if self.first is None:
                self.key, self.first, self.at, self.days = (rows["store"], rows["item"]), rows["date"], 0, days
            at = (rows["date"] - self.first).days // days
            while self.at < at:  # windows without a row are there as well
                yield self._window()
                self.at, self.n = self.at + 1, 0
            self.n += 1

        def terminate(self):
            if self.first is not None:
                yield self._window()

    spark.udtf.register("series_windows", SeriesWindows)


def sideways_share(weeks: DataFrame, tau: float = 0.01) -> DataFrame:
    """Share of sideways weeks per series."""
    return weeks.groupBy("store", "item").agg(C.frac_sideways("growth_rate", tau).alias("sideways"))
