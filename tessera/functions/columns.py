"""Column functions: missing-value guards, robust statistics, calendar encodings. All are plain expressions (no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ guards


def is_finite(c: ColumnLike) -> Column:
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite(c: ColumnLike) -> Column:
    """The value as double, NULL where it is NULL, NaN or infinite."""
    return F.when(is_finite(c), col(c).cast("double"))


def to_number(c: ColumnLike) -> Column:
    """Text to double, NULL where it is no finite number."""
    return finite(col(c).try_cast("double"))


def clip(c: ColumnLike, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Clamp, keeping NULL (greatest and least alone would skip it)."""
    x = out = col(c)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


def change(c: ColumnLike, before: ColumnLike) -> Column:
    """Relative change from `before`, NULL where that is 0 or missing."""
    return F.try_divide(col(c) - col(before), col(before))


def direction(growth: ColumnLike, tau: float) -> Column:
    """1 at growth >= tau, -1 at growth <= -tau, else 0 (also for NULL)."""
    g = col(growth)
    return F.when(g >= tau, 1).when(g <= -tau, -1).otherwise(0)


def indicator(condition: Column) -> Column:
    """1 or NULL."""
    return F.when(condition, 1)


def store_item(store: ColumnLike = "store", item: ColumnLike = "item") -> Column:
    return F.concat_ws("_", col(store), col(item))


def split_store_item(key: ColumnLike) -> tuple[Column, Column]:
    parts = F.split(col(key), "_", 2)
    return F.get(parts, F.lit(0)).alias("store"), F.get(parts, F.lit(1)).alias("item")


def item_weight(perishable: ColumnLike) -> Column:
    return F.when(col(perishable) == 1, 1.25).otherwise(1.0)


def dummies(c: ColumnLike, levels: list[str], prefix: str) -> list[Column]:
    """One 0/1 column per sorted level but the first."""
    return [F.when(col(c) == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in sorted(levels)[1:]]


# ------------------------------------------------------------------ aggregates with missing rules


def safe_median(c: ColumnLike) -> Column:
    return F.percentile(finite(c), 0.5)


def safe_std(c: ColumnLike) -> Column:
    """Population deviation, NULL for fewer than two values."""
    x = finite(c)
    return F.when(F.count(x) > 1, F.stddev_pop(x))


def safe_iqr(c: ColumnLike) -> Column:
    """P75 - P25 with linear interpolation, NULL for fewer than two values."""
    x = finite(c)
    return F.when(F.count(x) > 1, F.percentile(x, 0.75) - F.percentile(x, 0.25))


def safe_mean(c: ColumnLike) -> Column:
    return F.avg(finite(c))


def fraction(condition: Column, of: ColumnLike) -> Column:
    """Share of the finite values of `of` that meet the condition."""
    return F.avg(F.when(is_finite(of), F.when(condition, 1.0).otherwise(0.0)))


def frac_up(c: ColumnLike, tau: float) -> Column:
    return fraction(col(c) > tau, c)


def frac_sideways(c: ColumnLike, tau: float) -> Column:
    return fraction(F.abs(col(c)) <= tau, c)


def frac_down(c: ColumnLike, tau: float) -> Column:
    return fraction(col(c) < -tau, c)


def up_to_down(c: ColumnLike, tau: float = 0.0) -> Column:
    x = finite(c)
    return F.try_divide(F.count_if(x > tau).cast("double"), F.count_if(x < -tau).cast("double"))


def safe_corr(a: ColumnLike, b: ColumnLike, least: int = 2) -> Column:
    """Pearson correlation over complete pairs, NULL for constants or fewer than `least` pairs.

    corr() itself raises on constants under ANSI mode even inside a CASE, as aggregates are evaluated eagerly."""
    x, y = finite(a), finite(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varied = (F.count(x) >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varied, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def mav(c: ColumnLike, log1p: bool = False, zeros: bool = True) -> Column:
    """Mean absolute value over finite values >= 0 (or > 0), optionally after expm1; 0 when there are none."""
    x = finite(c)
    keep = x >= 0 if zeros else x > 0
    return F.coalesce(F.avg(F.abs(F.when(keep, F.expm1(x) if log1p else x))), F.lit(0.0))


def huber(error: ColumnLike, delta: float = 1.0) -> Column:
    a = F.abs(col(error))
    return F.when(a <= delta, 0.5 * a * a).otherwise(delta * (a - 0.5 * delta))


def soft_threshold(x: ColumnLike, tau: ColumnLike) -> Column:
    return F.signum(col(x)) * F.greatest(F.abs(col(x)) - col(tau), F.lit(0.0))


def gini(values: ColumnLike) -> Column:
    """Gini concentration of an array of values: finite ones >= 0; NULL when empty, 0 when they sum to 0."""
    x = F.array_sort(F.filter(col(values), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))))
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    ranked = F.aggregate(F.transform(x, lambda v, i: v * (2 * (i + 1) - n - 1)), F.lit(0.0), lambda a, v: a + v)
    return F.when(n == 0, None).when(total <= 1e-12, 0.0).otherwise(F.try_divide(ranked, n * total))


# ------------------------------------------------------------------ calendar

PERIODS = {"dayofweek": 7, "weekofmonth": 5, "monthofyear": 12}


def day_of_week(d: ColumnLike) -> Column:
    """Monday is 0."""
    return F.weekday(col(d))


def week_of_month(d: ColumnLike) -> Column:
    return (F.floor((F.day(col(d)) - 1) / 7) + 1).cast("int")


def cyclic(value: Column, period: int, name: str) -> list[Column]:
    angle = value * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def pay_cycle(d: ColumnLike) -> Column:
    """Elapsed share of the half-monthly pay cycle: paid on the 15th and on the last day of a month."""
    x = col(d)
    mid = F.date_add(F.trunc(x, "MM"), 14)
    before = F.when(F.day(x) >= 15, mid).otherwise(F.date_sub(F.trunc(x, "MM"), 1))
    after = F.when(F.day(x) >= 15, F.last_day(x)).otherwise(mid)
    return F.coalesce(clip(F.try_divide(F.datediff(x, before).cast("double"), F.datediff(after, before)), 0.0, 1.0), F.when(x.isNotNull(), 0.0))


def season_phase(d: ColumnLike) -> Column:
    """Days since the latest 20 March, modulo 365, as a share of 365."""
    x = col(d)
    year = F.year(x) - F.when(x < F.make_date(F.year(x), F.lit(3), F.lit(20)), 1).otherwise(0)
    return F.pmod(F.datediff(x, F.make_date(year, F.lit(3), F.lit(20))), F.lit(365)) / 365.0


def week_end(d: ColumnLike) -> Column:
    """The Sunday that ends the date's week."""
    return F.next_day(F.date_sub(col(d), 1), "SU")
