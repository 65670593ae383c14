"""Time-series window operators. Windows of one call share a partitioning and order, hence one exchange and one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions import columns as C
from tessera.operators.quantiles import global_quantiles

KEYS = ("store", "item")


def _by(keys: Sequence[str], date: str):
    return W.partitionBy(*keys).orderBy(date)


def _last(keys: Sequence[str], date: str, n: int):
    return _by(keys, date).rowsBetween(1 - n, 0)


def growth(df: DataFrame, value: str, keys: Sequence[str] = KEYS, date: str = "date", name: str = "growth_rate") -> DataFrame:
    """Relative change without carrying over; from 0 it is NULL."""
    return df.withColumn(name, C.finite(C.change(value, F.lag(value).over(_by(keys, date)))))


def winsorise(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, name: str | None = None) -> DataFrame:
    """Clip to global quantiles; (-1, 1) where there is no value at all."""
    ends = global_quantiles(df, {"q": C.finite(value)}, [low, high])
    stats = ends.select(F.coalesce(F.get("q", F.lit(0)), F.lit(-1.0)).alias("_lo"), F.coalesce(F.get("q", F.lit(1)), F.lit(1.0)).alias("_hi"))
    return df.join(F.broadcast(stats)).withColumn(name or value, C.clip(value, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def rolling_median(df: DataFrame, value: str, n: int, name: str, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    return df.withColumn(name, F.percentile(C.finite(value), 0.5).over(_last(keys, date, n)))


def rolling_mean(df: DataFrame, value: str, n: int, name: str, keys: Sequence[str] = KEYS, date: str = "date", least: int = 1) -> DataFrame:
    x, w = C.finite(value), _last(keys, date, n)
    return df.withColumn(name, F.when(F.count(x).over(w) >= least, F.avg(x).over(w)))


def ewm(df: DataFrame, value: str, span: int, name: str, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Exponentially weighted mean, alpha = 2 / (span + 1), seeded by the first value; a NULL carries the mean on and ages its weight.

    One exchange: a fold over each series' ordered array emits all its values, in chunks, so that what a step copies is a
    chunk; ewm_grouped does the same in a grouped Arrow pass."""
    a, size = 2.0 / (span + 1), 128
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("_o"), F.struct(*rest).alias("_r"), C.finite(value).alias("_v")))).alias("_s"))
    step = lambda acc, s: _ewm_step(acc, s["_v"], a)
    nothing = F.array().cast("array<double>")
    begin = lambda acc: F.struct(acc["y"].alias("y"), acc["w"].alias("w"), nothing.alias("out"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / size).cast("int")), lambda i: F.slice("_s", i * size + 1, F.lit(size)))
    fold = F.aggregate(
        chunks,
        F.from_json(F.lit('{"w":1.0,"outs":[]}'), "struct<y:double,w:double,outs:array<array<double>>>"),
        lambda acc, chunk: _ewm_chunk(acc["outs"], F.aggregate(chunk, begin(acc), step)),
        lambda acc: F.flatten(acc["outs"]),
    )
    rows = rows.withColumn("_y", fold)
    pairs = F.arrays_zip(F.transform("_s", lambda s: s["_r"]).alias("r"), F.col("_y").alias("y"))
    return rows.select(*keys, F.explode(pairs).alias("_z")).select(*[F.col(c) if c in keys else F.col(f"_z.r.{c}").alias(c) for c in df.columns], F.col("_z.y").alias(name))


def _ewm_step(acc: Column, v: Column, a: float) -> Column:
    old = acc["w"] * (1 - a)
    y = F.when(v.isNull(), acc["y"]).when(acc["y"].isNull(), v).otherwise((old * acc["y"] + a * v) / (old + a))
    w = F.when(v.isNotNull() | acc["y"].isNull(), 1.0).otherwise(old)
    return F.struct(y.alias("y"), w.alias("w"), F.concat(acc["out"], F.array(y)).alias("out"))


def _ewm_chunk(outs: Column, done: Column) -> Column:
    return F.struct(done["y"].alias("y"), done["w"].alias("w"), F.concat(outs, F.array(done["out"])).alias("outs"))


def ewm_grouped(df: DataFrame, value: str, span: int, name: str, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """The same in one grouped Arrow pass, for series too long for an array fold."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf):
        pdf = pdf.sort_values(date, kind="stable")
        return pdf.assign(**{name: pdf[value].astype("float64").ewm(span=span, adjust=False).mean()})

    return df.groupBy(*keys).applyInPandas(run, schema)


def weekly(df: DataFrame, value: str = "unit_sales", keys: Sequence[str] = KEYS, date: str = "date", tau: float = 0.05, clip: tuple[float, float] | None = None) -> DataFrame:
    """Weeks ending on Sunday: sales_wk (0 in empty weeks within a series' span), growth_rate, direction, indicators.

    clip: quantiles for a global winsorising of the growth."""
    weeks = df.groupBy(*keys, C.week_end(date).alias("week_end")).agg(F.sum(C.finite(value)).alias("sales_wk"))
    span = weeks.groupBy(*keys).agg(F.explode(F.sequence(F.min("week_end"), F.max("week_end"), F.expr("interval 7 days"))).alias("week_end"))
    filled = span.join(weeks, [*keys, "week_end"], "left").withColumn("sales_wk", F.coalesce("sales_wk", F.lit(0.0)))
    out = growth(filled, "sales_wk", keys, "week_end")
    if clip:
        out = winsorise(out, "growth_rate", *clip)
    d = C.direction("growth_rate", tau)
    out = out.withColumn("direction", d.cast("tinyint"))
    return out.withColumns({"growth_up": C.indicator(F.col("direction") == 1), "growth_sideways": C.indicator(F.col("direction") == 0), "growth_down": C.indicator(F.col("direction") == -1)})


def fill_days(df: DataFrame, value: str = "unit_sales", keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Every day of each series' span; missing days are 0."""
    days = df.groupBy(*keys).agg(F.explode(F.sequence(F.min(date), F.max(date))).alias(date))
    return days.join(df.select(*keys, date, value), [*keys, date], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def window_ids(df: DataFrame, size: int, calendar: bool = False, date: str = "date") -> DataFrame:
    """Adds window_id. Data-aligned: chunks of the sorted distinct dates, the tail may be short. Calendar-aligned: blocks of
    days ending at the last date (0 is the latest), incomplete ones dropped. Computed on the distinct dates."""
    if size <= 0:
        raise ValueError("window size must be positive")
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    if calendar:
        ends = dates.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
        placed = dates.join(F.broadcast(ends)).withColumn("window_id", F.floor(F.datediff("_b", date) / size).cast("int")).where((F.col("window_id") + 1) * size <= F.datediff("_b", "_a") + 1).drop("_a", "_b")
    else:
        placed = dates.withColumn("window_id", F.floor((F.row_number().over(W.orderBy(date)) - 1) / size).cast("int"))  # calendar days, not rows of the fact
    return df.join(placed, date)


def wide_windows(df: DataFrame, size: int, value: str = "unit_sales", keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Non-overlapping data-aligned windows per series of exactly `size` days: start_date, sales_day_1.., growth_rate_1.. (per cent)."""
    rows = df.withColumn("_n", F.row_number().over(_by(keys, date)) - 1).withColumn("_g", C.change(value, F.lag(value).over(_by(keys, date))) * 100)
    rows = rows.withColumn("_w", F.floor(F.col("_n") / size)).withColumn("_d", (F.col("_n") % size + 1).cast("int"))
    at = lambda c, i: F.max(F.when(F.col("_d") == i, F.col(c)))
    out = rows.groupBy(*keys, "_w").agg(F.min(date).alias("start_date"), F.count("*").alias("_k"), *[at(value, i).alias(f"sales_day_{i}") for i in range(1, size + 1)], *[at("_g", i).alias(f"growth_rate_{i}") for i in range(1, size + 1)])
    return out.where(F.col("_k") == size).drop("_w", "_k")


def sales_windows(df: DataFrame, size: int, value: str = "unit_sales", promo: str = "onpromotion", weight: str | None = None, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Windows of `size` calendar days from the first date of the table, one row per series and window with any row:
    start_date, sales_day_i (sum, 0 on a missing day), promo_day_i (maximum, 0), growth_rate_i (per cent on the previous day,
    on day 1 the day before the window; NULL where that is absent or 0) and the first weight."""
    if size <= 0:
        raise ValueError("window size must be positive")
    first = df.agg(F.min(date).alias("_first"))
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    days = df.join(F.broadcast(first)).withColumn("_at", F.datediff(date, "_first"))
    days = days.groupBy(*keys, "_first", F.floor(F.col("_at") / size).cast("int").alias("_w"), (F.col("_at") % size + 1).alias("_d")).agg(F.sum(C.finite(value)).alias("_v"), F.max(F.col(promo).cast("int")).alias("_p"), F.min(own).alias("_weight"))
    day = lambda c, i: F.max(F.when(F.col("_d") == i, F.col(c)))
    sums = {f"sales_day_{i}": day("_v", i) for i in range(1, size + 1)} | {f"promo_day_{i}": day("_p", i) for i in range(1, size + 1)}
    wide = days.groupBy(*keys, "_first", "_w").agg(F.min_by("_weight", "_d").alias("weight"), *[c.alias(n) for n, c in sums.items()])
    w = W.partitionBy(*keys).orderBy("_w")
    wide = wide.withColumn("_before", F.when(F.lag("_w").over(w) == F.col("_w") - 1, F.lag(f"sales_day_{size}").over(w)))
    filled = wide.withColumns({n: F.coalesce(n, F.lit(0)) for n in sums})
    growth_of = {f"growth_rate_{i}": C.change(f"sales_day_{i}", F.col("_before") if i == 1 else F.col(f"sales_day_{i - 1}")) * 100 for i in range(1, size + 1)}
    out = filled.withColumns(growth_of).withColumn("start_date", F.date_add("_first", F.col("_w") * size))
    return out.select(*keys, "start_date", "weight", *sums, *growth_of)


def with_calendar(windows: DataFrame, start: str = "start_date") -> DataFrame:
    """Windows joined with the calendar features of their first day: an inner join on the distinct days."""
    days = calendar_features(windows.select(F.col(start).alias("date")).distinct()).withColumnRenamed("date", start)
    return windows.join(days, start)


def from_full_week(df: DataFrame, value: str = "unit_sales", date: str = "date") -> DataFrame:
    """Negative values become 0; rows before the first Monday go, so that weeks are whole from the start."""
    first = df.agg(F.min(date).alias("_first"))
    monday = F.next_day(F.date_sub("_first", 1), "Mon")
    return df.join(F.broadcast(first)).where(F.col(date) >= monday).withColumn(value, F.greatest(F.col(value), F.lit(0.0))).drop("_first")


def next_window_targets(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order: str = "start_date") -> DataFrame:
    """y_<column>: the series' next window, NULL at the last."""
    return df.withColumns({f"y_{c}": F.lead(c).over(_by(keys, order)) for c in columns})


def lead_target(df: DataFrame, value: str = "growth_rate", keys: Sequence[str] = KEYS, date: str = "date", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.lead(value).over(_by(keys, date)))


def lags(df: DataFrame, value: str, steps: Sequence[int], keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(_by(keys, date)) for k in steps})


def difference(df: DataFrame, value: str, name: str = "diff", keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_by(keys, date)))


def split_by_date(df: DataFrame, val_days: int, test_days: int, date: str = "date") -> DataFrame:
    """split: test for the last test_days up to the global last date, val for the val_days before, else train."""
    last = df.agg(F.max(date).alias("_b"))
    back = F.datediff("_b", date)
    return df.join(F.broadcast(last)).withColumn("split", F.when(back < test_days, "test").when(back < test_days + val_days, "val").otherwise("train")).drop("_b")


def split_by_fraction(df: DataFrame, share: float = 0.8, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Validation starts at the row with index int((n - 1) * share) of the series."""
    n = F.count("*").over(W.partitionBy(*keys))
    at = F.row_number().over(_by(keys, date)) - 1
    return df.withColumn("split", F.when(at >= F.floor((n - 1) * share), "val").otherwise("train"))


def running_median(df: DataFrame, value: str, name: str = "running_median", keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Exact median of the series so far; 0 before the first value. Two heaps in a grouped Arrow pass: n log n a series."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf):
        from heapq import heappush, heappushpop
        from math import isfinite

        pdf = pdf.sort_values(date, kind="stable")
        low, high, out = [], [], []  # the lower half negated
        for x in pdf[value].astype("float64"):
            if isfinite(x):
                if len(low) > len(high):
                    heappush(high, -heappushpop(low, -x))
                else:
                    heappush(low, -heappushpop(high, x))
            out.append(0.0 if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
        return pdf.assign(**{name: out})

    return df.groupBy(*keys).applyInPandas(run, schema)


def online_median(df: DataFrame, value: str, start: float = 0.0, eta: float = 0.1, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    """Final estimate of est += eta * sign(x - est) along each series, one row per key."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), C.finite(value).alias("v"))))
    fold = F.aggregate(F.filter(F.transform(ordered, lambda s: s["v"]), lambda v: v.isNotNull()), F.lit(float(start)), lambda e, v: e + eta * F.signum(v - e))
    return df.groupBy(*keys).agg(fold.alias("online_median"))


def cumulative(df: DataFrame, value: str, name: str, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def forward_fill(df: DataFrame, value: str, keys: Sequence[str] = KEYS, date: str = "date") -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(_by(keys, date).rowsBetween(W.unboundedPreceding, 0)))


def value_gaps(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Gap to the next smaller value and the relative jump, in value order."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(value))
    return df.withColumn("gap", F.col(value) - before).withColumn("jump", C.change(value, before))


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    """dayofweek, weekofmonth, monthofyear, pay-cycle and season phases, and their sine and cosine."""
    out = df.withColumns({"dayofweek": C.day_of_week(date), "weekofmonth": C.week_of_month(date), "monthofyear": F.month(date), "paycycle_ratio": C.pay_cycle(date), "season_ratio": C.season_phase(date)})
    waves = [w for name, period in C.PERIODS.items() for w in C.cyclic(F.col(name), period, name)]
    waves += C.cyclic(F.col("paycycle_ratio"), 1, "paycycle") + C.cyclic(F.col("season_ratio"), 1, "season")
    return out.select("*", *waves)


def ma1_walk_forward(df: DataFrame, value: str = "growth_rate", keys: Sequence[str] = KEYS, date: str = "date", least: int = 7) -> DataFrame:
    """One-step forecasts of a constant + MA(1), refitted on every prefix of at least `least` finite, varied values and written
    on the row that follows the prefix; a series of fewer than three values, or of `least` at most, has none.

    Order-dependent and iterative, hence grouped Arrow; theta by a grid on conditional least squares. An error is linear in
    the mean, e = E - mean * M with E and M running over the values, so each prefix costs one step and not a pass."""
    schema = T.StructType([df.schema[k] for k in keys] + [df.schema[date], T.StructField("forecast", T.DoubleType())])

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(date, kind="stable")
        x = pdf[value].to_numpy(float)
        grid = np.linspace(-0.95, 0.95, 39)
        out = np.full(len(x), np.nan)
        shift = x[0] if len(x) else 0.0  # keeps the sums of squares small beside their differences
        e, m, ee, em, mm = np.zeros((5, len(grid)))
        total, least_x, most_x = 0.0, np.inf, -np.inf
        for i, v in enumerate((x - shift)[:-1], 1):  # after i values the next one, row i, is forecast
            if not np.isfinite(v):
                break
            e, m = v - grid * e, 1 - grid * m
            ee, em, mm = ee + e * e, em + e * m, mm + m * m
            total, least_x, most_x = total + v, min(least_x, v), max(most_x, v)
            if i >= least and len(x) >= 3 and most_x > least_x:
                mean = total / i
                k = (ee - 2 * mean * em + mean * mean * mm).argmin()
                out[i] = shift + mean + grid[k] * (e[k] - mean * m[k])
        return pdf[[*keys, date]].assign(forecast=out)

    return df.groupBy(*keys).applyInPandas(run, schema)
