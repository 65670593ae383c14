"""Relational block analytics over memberships, assignments and long factor tables.

cells: (store, item, value). rows: (store, r) and cols: (item, c) memberships, several per key allowed. blocks: (r, c, b)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import columns as C


def candidates(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block that covers a cell, with its value b."""
    return cells.join(rows, "store").join(cols, "item").join(blocks, ["r", "c"])


#: score of block value b for a cell of value x whose fitted value (all its blocks together) is fit
SCORES = {
    "gaussian_delta": lambda x, fit, b, eps: (x - fit) * b - 0.5 * b * b,
    "poisson_delta": lambda x, fit, b, eps: x * (F.log(F.greatest(fit, F.lit(eps))) - F.log(F.greatest(F.greatest(fit, F.lit(eps)) - b, F.lit(eps)))) - b,
    "dominant": lambda x, fit, b, eps: F.abs(b),
    "dominant_poisson": lambda x, fit, b, eps: b,
}


def assign_blocks(
    cells: DataFrame,
    rows: DataFrame,
    cols: DataFrame,
    blocks: DataFrame,
    score: str = "gaussian_delta",
    n_cols: int | None = None,
    allowed: DataFrame | None = None,
    min_abs_b: float | None = None,
    on_empty: str = "fallback",
    eps: float = 1e-9,
) -> DataFrame:
    """Best block per cell, lowest (r, c) among equals; cells in no block get r = c = block_id = -1. block_id = r * n_cols + c.

    Delta scores measure how much the loss falls by the block, from the residual of the whole fit. `allowed` (r, c, allowed)
    or min_abs_b narrows the choice; a cell all of whose blocks are ruled out gets the dominant allowed block of all
    (`fallback`, (0, 0) if none is allowed), -1 (`skip`) or an error (`raise`)."""
    if on_empty not in ("fallback", "skip", "raise"):
        raise ValueError(f"on_empty: {on_empty}")
    if allowed is None and min_abs_b is not None:
        allowed = blocks.select("r", "c", (F.abs("b") >= min_abs_b).alias("allowed"))
    cand = candidates(cells, rows, cols, blocks).withColumn("_fit", F.sum("b").over(W.partitionBy("store", "item")))
    if allowed is not None:
        cand = cand.join(allowed.select("r", "c", F.col("allowed").alias("_ok")), ["r", "c"], "left")
    else:
        cand = cand.withColumn("_ok", F.lit(True))
    value = F.when(F.coalesce("_ok", F.lit(False)), SCORES[score](F.col("value"), F.col("_fit"), F.col("b"), eps))
    cand = cand.withColumn("score", value)
    best = cand.groupBy("store", "item").agg(F.max_by(F.when(F.col("score").isNotNull(), F.struct("r", "c")), F.struct("score", -F.col("r"), -F.col("c"))).alias("m"))
    if on_empty != "skip":
        dominant = F.abs("b") if score != "dominant_poisson" else F.col("b")
        open_ = blocks if allowed is None else blocks.join(allowed.where("allowed").select("r", "c"), ["r", "c"], "left_semi")
        first = open_.agg(F.max_by(F.struct("r", "c"), F.struct(dominant, -F.col("r"), -F.col("c"))).alias("_first"))  # one row
        zero = F.lit(0).cast(blocks.schema["r"].dataType).alias("r"), F.lit(0).cast(blocks.schema["c"].dataType).alias("c")
        instead = F.coalesce("_first", F.struct(*zero)) if on_empty == "fallback" else F.raise_error(F.lit("a cell has no allowed block")).cast(best.schema["m"].dataType)
        best = best.join(F.broadcast(first)).select("store", "item", F.when(F.col("m").isNull(), instead).otherwise(F.col("m")).alias("m"))
    width = F.lit(n_cols) if n_cols is not None else None
    if width is None:
        best = best.join(F.broadcast(blocks.agg((F.max("c") + 1).alias("_w"))))
        width = F.col("_w")
    out = cells.select("store", "item").join(best, ["store", "item"], "left")
    r, c = F.coalesce("m.r", F.lit(-1)), F.coalesce("m.c", F.lit(-1))
    return out.select("store", "item", r.alias("r"), c.alias("c"), F.when(F.col("m").isNull(), -1).otherwise(F.col("m.r") * width + F.col("m.c")).cast("long").alias("block_id"))


def reconstruct(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame) -> DataFrame:
    """xhat: the sum of b over all blocks that cover a cell."""
    total = candidates(cells, rows, cols, blocks).groupBy("store", "item").agg(F.sum("b").alias("xhat"))
    return cells.join(total, ["store", "item"], "left").withColumn("xhat", F.coalesce("xhat", F.lit(0.0)))


def ablation(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rise of the squared error when a block is left out: sum over its cells of (x - xhat + b)^2 - (x - xhat)^2."""
    cand = candidates(cells, rows, cols, blocks).withColumn("xhat", F.sum("b").over(W.partitionBy("store", "item")))
    e = F.col("value") - F.col("xhat")
    return cand.groupBy("r", "c").agg(F.sum((e + F.col("b")) * (e + F.col("b")) - e * e).alias("delta_loss"), F.count("*").alias("n_cells"))


def block_stats(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per block with cells: b, n_rows, n_cols, n_cells, delta_loss (of leaving it out) and effect_score = |b| sqrt(n_cells)."""
    n_rows, n_cols = rows.groupBy("r").agg(F.count("*").alias("n_rows")), cols.groupBy("c").agg(F.count("*").alias("n_cols"))
    stats = ablation(cells, rows, cols, blocks).join(blocks.select("r", "c", "b"), ["r", "c"]).join(n_rows, "r").join(n_cols, "c")
    return stats.withColumn("effect_score", F.abs("b") * F.sqrt("n_cells"))


def explained(cells: DataFrame, fitted: str = "xhat", baseline: str = "column_mean") -> DataFrame:
    """TSS, RSS and PVE against column means, the grand mean or zero."""
    base = {"column_mean": F.avg("value").over(W.partitionBy("item")), "grand_mean": None, "zero": F.lit(0.0)}[baseline]
    if base is None:
        mean = cells.agg(F.avg("value").alias("_base"))
        rows = cells.join(F.broadcast(mean))
    else:
        rows = cells.withColumn("_base", base)
    sq = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return rows.agg(sq("value", "_base").alias("tss"), sq("value", fitted).alias("rss")).withColumn("pve", 1 - F.try_divide("rss", "tss"))


def block_means(labelled: DataFrame, how: str = "mean") -> DataFrame:
    """labelled: cells with r and c. Adds xhat, the block's mean or median, from one row per block (means are combined before
    the exchange, so no task holds a block)."""
    own = prototypes(labelled, how).select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("b").alias("xhat"))
    return labelled.join(own, F.col("r").eqNullSafe(F.col("_r")) & F.col("c").eqNullSafe(F.col("_c"))).drop("_r", "_c")


def prototypes(labelled: DataFrame, how: str = "mean") -> DataFrame:
    return labelled.groupBy("r", "c").agg((F.avg("value") if how == "mean" else F.percentile("value", 0.5)).alias("b"))


LOSSES = {"l2": lambda e: e * e, "l1": F.abs, "huber": C.huber}


def reassign_rows(labelled: DataFrame, norm: str = "l2") -> DataFrame:
    """One alternating step: with prototypes fixed, every row goes to the cluster with the least loss (lowest id among equals)."""
    proto = prototypes(labelled, "median" if norm == "l1" else "mean")
    cand = labelled.select("store", "item", "value", "c").join(proto, "c")
    loss = cand.groupBy("store", "r").agg(F.sum(LOSSES[norm](F.col("value") - F.col("b"))).alias("loss"))
    return loss.groupBy("store").agg(F.min_by("r", F.struct(F.round("loss", 9), "r")).alias("r"), F.min("loss").alias("loss"))


def reassign_cols(labelled: DataFrame, norm: str = "l2") -> DataFrame:
    swapped = labelled.select(F.col("item").alias("store"), F.col("store").alias("item"), F.col("c").alias("r"), F.col("r").alias("c"), "value")
    return reassign_rows(swapped, norm).select(F.col("store").alias("item"), F.col("r").alias("c"), "loss")


def objective(labelled: DataFrame, norm: str = "l2") -> DataFrame:
    fitted = block_means(labelled, "median" if norm == "l1" else "mean")
    return fitted.agg(F.sum(LOSSES[norm](F.col("value") - F.col("xhat"))).alias("objective"))


def predict_rows(cells: DataFrame, protos: DataFrame) -> DataFrame:
    """protos: (r, item, g). Row cluster with the greatest x.g - |g|^2 / 2."""
    norm = protos.groupBy("r").agg((F.sum(F.col("g") * F.col("g")) / 2).alias("half"))
    dot = cells.join(protos, "item").groupBy("store", "r").agg(F.sum(F.col("value") * F.col("g")).alias("dot")).join(norm, "r")
    return dot.groupBy("store").agg(F.max_by("r", F.struct(F.round(F.col("dot") - F.col("half"), 9), -F.col("r"))).alias("r"))


def block_quality(labelled: DataFrame) -> DataFrame:
    """Per block: mean, within (population) variance, least squared distance to another block's mean, (between - within) / max."""
    b = labelled.groupBy("r", "c").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("wcv"), F.count("*").alias("n_cells"))
    other = b.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("mean").alias("mean2"))
    near = b.join(other, (F.col("r") != F.col("r2")) | (F.col("c") != F.col("c2"))).groupBy("r", "c").agg(F.min(F.pow(F.col("mean") - F.col("mean2"), 2)).alias("bcv"))  # blocks, not cells
    out = b.join(near, ["r", "c"], "left")
    return out.withColumn("silhouette", F.try_divide(F.col("bcv") - F.col("wcv"), F.greatest("bcv", "wcv")))


def block_summary(labelled: DataFrame) -> DataFrame:
    """n_cells, coverage of all cells in per cent, mean and median per block."""
    total = labelled.agg(F.count("*").alias("_n"))
    b = labelled.groupBy("r", "c").agg(F.count("*").alias("n_cells"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"))
    return b.join(F.broadcast(total)).withColumn("coverage", 100.0 * F.col("n_cells") / F.col("_n")).drop("_n")


def coverage_matrix(labelled: DataFrame, n_cols: int) -> DataFrame:
    out = labelled.groupBy("r").pivot("c", list(range(n_cols))).count().fillna(0)
    return out.select("r", *[F.col(str(c)).alias(f"c{c}") for c in range(n_cols)])


def explain_blocks(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame, k: int = 3) -> DataFrame:
    """Per block: cells, mean, exclusive mean weighted by 1 / (row memberships * column memberships), top stores and items by mean."""
    rw = rows.withColumn("_rm", F.count("*").over(W.partitionBy("store")))
    cw = cols.withColumn("_cm", F.count("*").over(W.partitionBy("item")))
    cand = candidates(cells, rw, cw, blocks).withColumn("w", 1.0 / (F.col("_rm") * F.col("_cm")))
    stats = cand.groupBy("r", "c").agg(F.first("b").alias("b"), F.count("*").alias("n_cells"), F.avg("value").alias("mean"), F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("exclusive_mean"), F.sum("w").alias("exclusive_cells"))

    def top(key: str) -> DataFrame:
        means = cand.groupBy("r", "c", key).agg(F.round(F.avg("value"), 9).alias("m"))
        w = W.partitionBy("r", "c").orderBy(F.desc("m"), key)
        ranked = means.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
        return ranked.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", key))), lambda s: s[key]).alias(f"top_{key}s"))

    return stats.join(top("store"), ["r", "c"]).join(top("item"), ["r", "c"])


def weighted_blocks(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame) -> DataFrame:
    return explain_blocks(cells, rows, cols, blocks, 1).drop("top_stores", "top_items")


def mask_by_gap(blocks: DataFrame, min_keep: int = 4, eps: float = 1e-12) -> DataFrame:
    """Blocks, of all together, with |b| at or above the value before the largest drop in falling order, min_keep at least;
    values up to eps don't count (all of them if there is nothing else: none is allowed)."""
    own = F.abs("b")
    w = W.orderBy(F.desc("a"), "r", "c")  # blocks, not cells
    ranked = blocks.select("r", "c", own.alias("a")).where(F.col("a") > eps).withColumn("rk", F.row_number().over(w)).withColumn("drop", F.col("a") - F.lead("a").over(w))
    keep = ranked.agg(F.greatest(F.coalesce(F.max_by("rk", F.struct("drop", -F.col("rk"))), F.lit(1)), F.lit(min_keep)).alias("_k"))
    cut = ranked.join(F.broadcast(keep)).where("rk <= _k").agg(F.min("a").alias("_cut"))
    return blocks.join(F.broadcast(cut)).withColumn("allowed", F.coalesce(own >= F.col("_cut"), F.lit(False))).drop("_cut")


def mask_top_k(blocks: DataFrame, k: int) -> DataFrame:
    """Blocks, of all together, with |b| at or above the k-th greatest (equals stay)."""
    top = blocks.select(F.abs("b").alias("a")).orderBy(F.desc("a")).limit(k).agg(F.min("a").alias("_cut"))
    return blocks.join(F.broadcast(top)).withColumn("allowed", F.coalesce(F.abs("b") >= F.col("_cut"), F.lit(False))).drop("_cut")


def gap_cutoff(stats: DataFrame, column: str, least: int = 1) -> DataFrame:
    """One row `cut`: the value before the largest relative jump of the rising values, rounded down, `least` at least."""
    w = W.orderBy("x")
    rows = stats.select(C.finite(column).alias("x")).where("x is not null").withColumn("next", F.lead("x").over(w)).withColumn("at", F.row_number().over(w))  # blocks, not cells
    jump = (F.col("next") - F.col("x")) / F.greatest("x", F.lit(1e-12))
    before = F.coalesce(F.max_by(F.when(jump.isNotNull(), F.col("x")), F.struct(jump, -F.col("at"))), F.min("x"))
    return rows.agg(F.greatest(F.coalesce(F.floor(before), F.lit(least)), F.lit(least)).cast("double").alias("cut"))


def mask_by_stats(stats: DataFrame, rule: str = "delta_then_size", size_quantile: float = 0.5, delta_quantile: float = 0.5, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """Blocks of `block_stats` by size_gap, effect_gap, delta_then_size or quantiles (of n_cells), with enough rows and columns."""
    if rule == "size_gap":
        keep, cuts = F.col("n_cells") >= F.col("cut"), gap_cutoff(stats, "n_cells", min_rows * min_cols)
    elif rule == "effect_gap":
        keep, cuts = F.col("effect_score") >= F.col("cut"), gap_cutoff(stats, "effect_score")
    elif rule == "delta_then_size":
        cuts = stats.agg(F.percentile("delta_loss", delta_quantile).alias("cut"), F.percentile("n_cells", size_quantile).alias("cut2"))  # blocks, not cells
        keep = (F.col("delta_loss") > 0) & (F.col("delta_loss") >= F.col("cut")) & (F.col("n_cells") >= F.col("cut2"))
    elif rule == "quantiles":
        keep, cuts = F.col("n_cells") >= F.col("cut"), stats.agg(F.percentile("n_cells", size_quantile).alias("cut"))
    else:
        raise ValueError(f"unknown rule: {rule}")
    allowed = F.coalesce(keep, F.lit(False)) & (F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols)
    return stats.join(F.broadcast(cuts)).withColumn("allowed", allowed).drop(*cuts.columns)


def filter_blocks(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame, strategy: str = "delta_then_size", keep: int = 4, score: str = "gaussian_delta", n_cols: int | None = None, **rule) -> tuple[DataFrame, DataFrame]:
    """(r, c, b, allowed) by a strategy, and every cell's best block among the allowed ones (-1 where it has none).

    strategy: gap (`keep` blocks at least), top_k (`keep` blocks), or a rule of `mask_by_stats` with its options."""
    if strategy == "gap":
        allowed = mask_by_gap(blocks, keep)
    elif strategy == "top_k":
        allowed = mask_top_k(blocks, keep)
    else:
        told = mask_by_stats(block_stats(cells, rows, cols, blocks), strategy, **rule).select("r", "c", "allowed")
        allowed = blocks.join(told, ["r", "c"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    allowed = allowed.select("r", "c", "b", "allowed")
    return allowed, assign_blocks(cells, rows, cols, blocks, score, n_cols, allowed, on_empty="skip")


def predict_blocks(cells: DataFrame, rows: DataFrame, cols: DataFrame, blocks: DataFrame, loss: str = "gaussian", score: str | None = None, **options) -> DataFrame:
    """Every cell's block for data that the model was not fitted on: missing cells count 0, the score follows the loss
    (gaussian_delta or poisson_delta) unless it is given; options as in assign_blocks."""
    known = cells.withColumn("value", F.coalesce(C.finite("value"), F.lit(0.0)))
    return assign_blocks(known, rows, cols, blocks, score or ("gaussian_delta" if loss == "gaussian" else "poisson_delta"), **options)


def fit_summary(blocks: DataFrame, assigned: DataFrame, tol: float = 1e-6, weak: float = 0.1) -> DataFrame:
    """One row: sparsity (share of blocks with |b| below tol), weak_fraction (share below `weak` times the greatest |b|) and
    coverage (share of cells that have a block)."""
    size = F.abs("b")
    top = blocks.agg(F.max(size).alias("_top"))
    share = lambda c: F.avg(c.cast("double"))
    of_blocks = blocks.join(F.broadcast(top)).agg(share(size < tol).alias("sparsity"), share(size < weak * F.col("_top")).alias("weak_fraction"))
    return of_blocks.crossJoin(assigned.agg(share(F.col("r") >= 0).alias("coverage")))  # one row each


def cell_mask(cells: DataFrame, rows: DataFrame, cols: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that some allowed block covers."""
    covered = cells.select("store", "item").join(rows, "store").join(cols, "item").join(mask.where("allowed").select("r", "c"), ["r", "c"], "left_semi").select("store", "item").distinct()
    return cells.join(covered, ["store", "item"], "left_semi")


def energy_elbow(blocks: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Cumulative energy b^2 * rows * columns of the blocks in falling order and the knee: the greatest lead of its share over
    the diagonal (one row: keep, lead; keep 1 where there is no energy)."""
    n_rows, n_cols = rows.groupBy("r").agg(F.count("*").alias("n_rows")), cols.groupBy("c").agg(F.count("*").alias("n_cols"))
    size = F.coalesce("n_rows", F.lit(0)) * F.coalesce("n_cols", F.lit(0))
    e = blocks.join(n_rows, "r", "left").join(n_cols, "c", "left").select("r", "c", (F.col("b") * F.col("b") * size).alias("e"))
    w = W.orderBy(F.desc("e"), "r", "c")  # blocks, not cells
    n = e.agg(F.count("*").alias("_n"), F.sum("e").alias("_t"))
    cum = e.withColumn("k", F.row_number().over(w)).withColumn("cum", F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0))).join(F.broadcast(n))
    lead = F.when(F.col("_t") > 0, F.col("cum") / (F.col("_t") + 1e-12)) - F.col("k") / F.col("_n")
    return cum.agg(F.coalesce(F.max_by("k", F.when(lead.isNotNull(), F.struct(F.round(lead, 9), -F.col("k")))), F.lit(1)).alias("keep"), F.max(lead).alias("lead"))


def merge_by_sign(labelled: DataFrame, how: str = "mean") -> DataFrame:
    """Blocks merged by the sign of their statistic: group 0 (negative) or 1."""
    b = prototypes(labelled, how)
    return b.withColumn("merged", F.when(F.col("b") < 0, 0).otherwise(1))


def value_groups(values: Sequence[float], k: int) -> list[float]:
    """Upper ends of the k intervals that split values with the least sum of squares (exact, by dynamic programming)."""
    import numpy as np

    x = np.sort(np.asarray(values, float))
    n, k = len(x), min(k, len(np.unique(x)))
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda i, j: s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / (j - i)  # noqa: E731  values i..j-1
    best = np.full((k + 1, n + 1), np.inf)
    back = np.zeros((k + 1, n + 1), int)
    best[0, 0] = 0
    for g in range(1, k + 1):
        for j in range(g, n + 1):
            options = [best[g - 1, i] + cost(i, j) for i in range(g - 1, j)]
            back[g, j] = g - 1 + int(np.argmin(options))
            best[g, j] = min(options)
    ends, j = [], n
    for g in range(k, 0, -1):
        ends.append(float(x[j - 1]))
        j = back[g, j]
    return ends[::-1]


def merge_by_value(labelled: DataFrame, k: int, how: str = "mean") -> DataFrame:
    """Blocks merged by their statistic into k groups of least squares: group 0 has the lowest. The blocks' values, rows times
    columns of the cluster grid, are split on the driver."""
    b = prototypes(labelled, how)
    ends = value_groups([r.b for r in b.select("b").where("b is not null").collect()], k)
    group = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        group = F.when(F.col("b") <= ends[i], F.lit(i)).otherwise(group)
    return b.withColumn("merged", F.when(F.col("b").isNotNull(), group))


def membership_histogram(memberships: DataFrame, key: str) -> DataFrame:
    """How many keys belong to how many clusters."""
    return memberships.groupBy(key).agg(F.count_distinct("cluster").alias("n_clusters")).groupBy("n_clusters").agg(F.count("*").alias("n_keys"))


def indicators(row_labels: DataFrame, col_labels: DataFrame) -> DataFrame:
    """All non-empty biclusters (r, c) with their sizes."""
    r = row_labels.groupBy("r").agg(F.count("*").alias("n_rows"))
    c = col_labels.groupBy("c").agg(F.count("*").alias("n_cols"))
    return r.crossJoin(F.broadcast(c))  # cluster counts


# ------------------------------------------------------------------ factors: (id, component, loading)


def top_k(factors: DataFrame, k: int, id: str = "id") -> DataFrame:
    w = W.partitionBy(id).orderBy(F.desc(F.abs("loading")), "component")
    return factors.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def cumulative_threshold(factors: DataFrame, share: float = 0.9, id: str = "id") -> DataFrame:
    """The largest loadings whose running total first reaches `share` of the whole."""
    w = W.partitionBy(id).orderBy(F.desc(F.abs("loading")), "component")
    own = F.abs("loading")
    rows = factors.withColumn("_before", F.sum(own).over(w.rowsBetween(W.unboundedPreceding, 0)) - own).withColumn("_t", F.sum(own).over(W.partitionBy(id)))
    return rows.where((F.col("_t") > 0) & (F.round("_before", 9) < F.round(share * F.col("_t"), 9))).drop("_before", "_t")


def hard_assignment(factors: DataFrame, id: str = "id") -> DataFrame:
    """Component with the greatest |loading|, NULL where all are zero."""
    return factors.groupBy(id).agg(F.when(F.sum(F.abs("loading")) > 0, F.max_by("component", F.struct(F.abs("loading"), -F.col("component")))).alias("cluster_id"))


def flat_assignments(chosen: DataFrame, everything: DataFrame, factor: str, id: str = "id") -> DataFrame:
    """factor_name, item_name, cluster_id: one row per membership, one with NULL for none."""
    return everything.select(id).distinct().join(chosen.select(id, "component"), id, "left").select(F.lit(factor).alias("factor_name"), F.col(id).cast("string").alias("item_name"), F.col("component").alias("cluster_id"))


def component_norms(factors: DataFrame) -> DataFrame:
    """Per component: L2 norm of its loadings and whether it is empty."""
    x = F.col("loading").cast("double")
    norm = F.sqrt(F.sum(x * x))
    return factors.groupBy("component").agg(norm.alias("norm"), (norm < 1e-8).alias("is_empty"))


def component_stats(factors: DataFrame) -> DataFrame:
    """One row: number of components, of empty ones, and mean and quartiles of the components' norms."""
    norms = component_norms(factors)
    return norms.agg(F.count("*").alias("total"), F.count_if("is_empty").alias("empty"), F.avg("norm").alias("mean"), F.percentile("norm", 0.25).alias("q25"), F.percentile("norm", 0.75).alias("q75"))


def reconstruction_metrics(cells: DataFrame, by: Sequence[str] = ("feature",), x: str = "value", fitted: str = "xhat") -> DataFrame:
    """n, RSS, RMSE and PVE (against the group's mean) over finite cells."""
    a, b = C.finite(x), C.finite(fitted)
    rows = cells.where(a.isNotNull() & b.isNotNull())
    rss = F.sum((a - b) * (a - b))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), rss.alias("rss"), F.sqrt(rss / F.count("*")).alias("rmse"), (1 - F.try_divide(rss, F.count(a) * F.var_pop(a))).alias("pve"))


def silhouette(cells: DataFrame, labels: DataFrame, metric: str = "euclid") -> DataFrame:
    """Silhouette of labelled rows (store, r), one row; pairs of rows are compared over shared items. NULL where a cluster has
    fewer than two members. Quadratic in the number of stores, a catalogue."""
    other = cells.select("item", F.col("store").alias("s2"), F.col("value").alias("v2"))
    e = F.col("value") - F.col("v2")
    size = 0.5 * (F.sum(F.abs("value")) + F.sum(F.abs("v2")))
    d = {"euclid": F.sqrt(F.sum(e * e)), "manhattan": F.sum(F.abs(e)), "huber": F.sum(C.huber(e)), "mav_ratio": F.sum(F.abs(e)) / F.greatest(size, F.lit(1e-12))}[metric]
    dist = cells.join(other, "item").where("store <> s2").groupBy("store", "s2").agg(d.alias("d"))
    to = dist.join(labels, "store").join(labels.select(F.col("store").alias("s2"), F.col("r").alias("r2")), "s2").groupBy("store", "r", "r2").agg(F.avg("d").alias("d"))
    per = to.groupBy("store").agg(F.max(F.when(F.col("r") == F.col("r2"), F.col("d"))).alias("a"), F.min(F.when(F.col("r") != F.col("r2"), F.col("d"))).alias("b"))
    small = labels.groupBy("r").agg(F.count("*").alias("n")).agg((F.min("n") >= 2).alias("ok"))
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return per.agg(F.avg(score).alias("s")).crossJoin(small).select(F.when(F.col("ok"), F.col("s")).alias("silhouette"))


def safe_silhouette(cells: DataFrame, row_labels: DataFrame | None, col_labels: DataFrame | None, metric: str = "euclid", prefer: str = "row") -> DataFrame:
    """The silhouette of the preferred side (row_labels: store, r; col_labels: item, c); where it is null or that side has no
    labels, that of the other side; null where neither has one."""
    swapped = cells.select(F.col("item").alias("store"), F.col("store").alias("item"), "value")
    by_col = None if col_labels is None else col_labels.select(F.col("item").alias("store"), F.col("c").alias("r"))
    sides = [(cells, row_labels), (swapped, by_col)]
    found = [silhouette(x, labels, metric) for x, labels in (sides if prefer == "row" else sides[::-1]) if labels is not None]
    if not found:
        return cells.sparkSession.createDataFrame([(None,)], "silhouette double")
    if len(found) == 1:
        return found[0]
    second = found[1].withColumnRenamed("silhouette", "_other")
    return found[0].crossJoin(second).select(F.coalesce("silhouette", "_other").alias("silhouette"))  # one row each


def best_setting(scores: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per (n_row, n_col), then the best of all first: `order` ends in a unique key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return scores.withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk").orderBy(*order)


def best_by_pve(scores: DataFrame, max_drop: float, order: Sequence[Column]) -> DataFrame:
    """The first in order among settings whose pve is within max_drop of the greatest."""
    top = scores.agg(F.max("pve").alias("_m"))
    return scores.join(F.broadcast(top)).where(F.col("pve") >= F.col("_m") - max_drop).drop("_m").orderBy(*order).limit(1)


def top_settings(scores: DataFrame, metric: str, n: int) -> DataFrame:
    """All rows of the n settings with the greatest metric."""
    best = scores.groupBy("n_row", "n_col").agg(F.max(metric).alias("_m")).orderBy(F.desc("_m"), "n_row", "n_col").limit(n)
    return scores.join(best.select("n_row", "n_col"), ["n_row", "n_col"], "left_semi")


def cluster_profiles(features: DataFrame, assignments: DataFrame, factor: str, key: str, columns: Sequence[str], keep: int | None = None, by: str = "size", seed: int = 0) -> DataFrame:
    """Mean feature profile and size per cluster of a factor; keep: so many, by greatest `size`, greatest sample `variance`
    over the profile's features, at `random` (a hash of the cluster and the seed), or by `hierarchy`: profiles are bisected
    into `keep` meta-clusters, of each of which the largest cluster stays (missing features count as the feature's mean)."""
    means = features.groupBy(key).agg(*[F.avg(C.finite(c)).alias(c) for c in columns])
    own = assignments.where(F.col("factor_name") == factor).select(F.col("item_name").cast("long").alias(key), "cluster_id").where("cluster_id is not null")
    out = means.join(own, key).groupBy("cluster_id").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns])
    if keep is None:
        return out
    if by == "hierarchy":
        return _largest_of_each(out, columns, keep, seed)
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    spread = sum((F.coalesce(F.pow(F.col(c) - F.col("_mean"), 2), F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    order = {"size": F.desc("size"), "variance": F.desc_nulls_last("_var"), "random": F.xxhash64("cluster_id", F.lit(seed)).asc()}[by]
    return out.withColumn("_mean", F.try_divide(total, n)).withColumn("_var", spread).orderBy(order, "cluster_id").limit(keep).drop("_mean", "_var")


def _largest_of_each(profiles: DataFrame, columns: Sequence[str], keep: int, seed: int) -> DataFrame:
    """Of each of `keep` meta-clusters of the profiles the largest cluster (then the least id)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    means = profiles.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in columns])
    filled = profiles.join(F.broadcast(means)).select("cluster_id", "size", *columns, *[F.coalesce(c, f"_m_{c}").alias(f"_f_{c}") for c in columns])
    data = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="_x").transform(filled)
    meta = BisectingKMeans(k=keep, featuresCol="_x", predictionCol="_meta", seed=seed).fit(data).transform(data)
    place = F.row_number().over(W.partitionBy("_meta").orderBy(F.desc("size"), "cluster_id"))
    return meta.withColumn("_place", place).where("_place = 1").select("cluster_id", "size", *columns)


def row_pattern_order(labelled: DataFrame) -> DataFrame:
    """Stores in order of modal block, least block, mean block, then the whole pattern of blocks over sorted items."""
    counts = labelled.groupBy("store", "block_id").agg(F.count("*").alias("n"))
    modal = counts.groupBy("store").agg(F.max_by("block_id", F.struct("n", -F.col("block_id"))).alias("modal"))
    rows = labelled.groupBy("store").agg(F.min("block_id").alias("least"), F.avg("block_id").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("item", "block_id"))), lambda s: s["block_id"]).alias("pattern")).join(modal, "store")
    return rows.select("store", (F.row_number().over(W.orderBy("modal", "least", "mean", "pattern", "store")) - 1).alias("position"))  # one row per store
