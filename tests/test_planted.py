"""Solvers on planted blocks, and a regression on a planted series: what they must recover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering as K
from tessera.operators import forecasting as L
from tessera.operators import metrics as E
from tessera.operators import series as S
from tessera.plans import fixtures as X


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """Stores x items in 3 x 4 blocks of distinct levels, with a small disturbance."""
    levels = F.array(*[F.lit(float(v)) for v in (9, 1, 5, 3, 2, 8, 0, 6, 4, 7, 3, 0)])
    block = F.get(levels, (F.col("store_cluster") * 4 + F.col("item_cluster")).cast("int"))
    cells = X.labels2(spark, sf_dir).select("store", "item", (block + (F.col("store") * 7 + F.col("item") * 13) % 11 / 100).alias("value"))
    return K.collect_matrix(cells)


def test_solvers_recover_the_blocks(spark, planted):
    x, stores, items = planted
    truth = {"rows": [s % 3 for s in stores], "cols": [i % 4 for i in items]}
    best = lambda norm: min((K.double_kmeans(x, 3, 4, norm, seed=k) for k in range(12)), key=lambda m: m.history[-1])
    l2, l1 = best("l2"), best("l1")
    untied = min((K.untied_double_kmeans(x, 3, 4, seed=k) for k in range(12)), key=lambda m: m[3][-1])
    found = [("rows", l2.row_labels), ("cols", l2.col_labels), ("rows", l1.row_labels), ("cols", l1.col_labels), ("rows", untied[0]), ("rows", K.spectral_coclusters(x, 3)[0])]
    for side, labels in found:
        pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth[side], labels, strict=True)], "a long, b long")
        got = E.agreement(pairs, "a", "b").first()
        assert (got.ari, got.nmi) == pytest.approx((1.0, 1.0))


def test_factorisations_leave_little(planted):
    x = planted[0]
    rest = lambda fitted, of=x: float(((of - fitted) ** 2).sum() / (of**2).sum())
    cube = np.stack([x, 2 * x], axis=2)
    w, h = K.nmf(x, 4, iterations=2000)
    f, s, g, _ = K.nmtf(x, 3, 4, iterations=2000)
    p, _ = K.parafac(cube, 4)
    core, (a, b, c), _ = K.tucker(cube, (3, 4, 1))
    found = {
        "binary_tri_factorisation": min(rest(K.binary_tri_factorisation(x, 3, 4, seed=k).fitted) for k in range(12)),
        "nmf": rest(w @ h),
        "nmtf": rest(f @ s @ g.T if g.shape[0] == x.shape[1] else f @ s @ g),
        "parafac": rest(np.einsum("ir,jr,kr->ijk", *p), cube),
        "tucker": rest(np.einsum("abc,ia,jb,kc->ijk", core, a, b, c), cube),
    }
    assert all(v < 0.01 for v in found.values()), found


def test_sweeps_choose_the_planted_sizes(spark, planted):
    best = K.sweep(spark, planted[0], [2, 3, 4], [3, 4, 5], restarts=6).orderBy("bic", "n_row", "n_col").first()
    assert (best.n_row, best.n_col) == (3, 4)
    scores = K.cross_validate(spark, planted[0], [2, 3], [3, 4]).orderBy("mse").first()
    assert scores.n_row == 3 and scores.mse < 0.1


def test_regressions_explain_a_planted_series(spark, sf_dir):
    """y = 0.5 y(-1) + weekday, without noise, beside a column that tells nothing."""
    days = X.stores(spark, sf_dir).select("store", F.lit(1).cast("long").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(179))).alias("i"))
    rows = days.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i"))).withColumn("promo", (F.xxhash64("store", "i") % 2).cast("double"))
    at = F.transform(F.sequence(F.lit(0), F.col("i")), lambda k: F.pow(F.lit(0.5), F.col("i") - k) * ((k + F.col("store")) % 7))
    rows = rows.withColumn("y", F.aggregate(at, F.lit(0.0), lambda a, b: a + b))
    frame = L.lag_frame(S.split_by_fraction(rows, 0.8), "y", (1, 7), future=["promo"])
    found = L.benchmark(frame, "y", L.lag_names("y", (1, 7), future=["promo"]), ["linear_regression", "huber"])
    assert all(r.R2 > 0.9 for r in found.where("Dataset = 'val'").collect())
