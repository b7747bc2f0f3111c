"""Metrics with ties, one class and nothing at all; ensembles and histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import ensemble, history, metrics, prep, stats


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, s double")


def curve_values(spark, pairs, rows=1_000_000):
    curve = metrics.score_curve(scored(spark, pairs), "y", "s", rows_per_bucket=rows)
    return metrics.curve_metrics(curve).first().asDict()


def brute(pairs):
    y, s = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    gaps = s[y == 1][:, None] - s[y == 0][None, :]
    auc = ((gaps > 0) + 0.5 * (gaps == 0)).mean()
    points, ap, last = [(0.0, 1.0)], 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        r, p = (y[hit] == 1).sum() / (y == 1).sum(), (y[hit] == 1).mean()
        ap += (r - last) * p
        last = r
        points.append((r, p))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    return auc, area, ap


@pytest.mark.parametrize("rows", [1_000_000, 9])
def test_curves_with_ties(spark, rows):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    pairs = list(zip(y, np.round(rng.normal(size=200) + y, 1)))
    got = curve_values(spark, pairs, rows)
    assert np.allclose([got["roc_auc"], got["pr_auc"], got["average_precision"]], brute(pairs))


def test_one_class(spark):
    got = curve_values(spark, [(1, 0.1), (1, 0.9)])
    assert got["roc_auc"] == 0.0 and got["average_precision"] == 0.0 and got["pr_auc"] == 1.0
    got = curve_values(spark, [(0, 0.1), (0, 0.9)])
    assert got["roc_auc"] == 0.0 and got["pr_auc"] == 0.5


def test_constant_predictions(spark):
    df = scored(spark, [(1, 0.9), (0, 0.9)]).withColumn("p", F.lit(0))
    row = metrics.mcc(metrics.precision_recall(metrics.confusion(df, "y", "p"))).first()
    assert (row["precision"], row["recall"], row["f1"], row["mcc"], row["loss"]) == (0.0, 0.0, 0.0, 0.0, 1.0)
    assert row["accuracy"] == 0.5
    everything = metrics.evaluate(df, "y", "p", "s").first()
    assert everything["roc_auc"] == 0.5


def test_youden(spark):
    df = scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    best = metrics.youden(metrics.score_curve(df, "y", "s"), "s").first()
    assert (best["threshold"], best["j"]) == (0.9, 0.5)
    worst = scored(spark, [(0, 0.9), (1, 0.1)])
    assert metrics.youden(metrics.score_curve(worst, "y", "s"), "s").first()["threshold"] == float("inf")


def test_log_loss_clips(spark):
    row = metrics.log_loss(scored(spark, [(1, 0.0), (0, 0.5)]), "y", "s").first()
    assert row["log_loss"] == pytest.approx((-np.log(1e-7) - np.log(0.5)) / 2)


def test_mean_score(spark):
    df = spark.createDataFrame(
        [(0.2, 0.6, 0.8), (0.2, None, 0.4), (None, None, None), (0.0, 0.0, 0.0)], "a double, b double, c double"
    )
    rows = ensemble.mean_score(df, ["a", "b", "c"]).collect()
    assert round(rows[0]["final_score"], 4) == 0.5333 and rows[0]["final_prediction"] == 1
    assert rows[1]["final_score"] == pytest.approx(0.3)
    assert rows[2]["final_score"] is None and rows[2]["final_prediction"] == 0
    weighted = ensemble.mean_score(df, ["a", "b"], {"a": 3.0, "b": 1.0}).first()
    assert weighted["final_score"] == pytest.approx(0.3)


def test_equal_weights_without_skill(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0)], "model string, y int, score double")
    weights = ensemble.weight_map(ensemble.f1_weights(df, "y"))
    assert weights == {"a": 0.5, "b": 0.5}


def test_vote_without_weights_is_zero(spark):
    df = spark.createDataFrame([(0.9,)], "a double")
    assert ensemble.weighted_vote(df, {"a": "a"}, {"a": 0.0}).first()["vote"] == 0


def test_best_epoch_takes_the_first_minimum(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.1), (1, 3, 0.1)], "fold int, epoch int, val_loss double")
    assert history.best_epoch(df, ["fold"]).first()["epoch"] == 2
    out = history.with_constants(df, {"test_f1": 0.5}).first()
    assert out["test_f1"] == 0.5


def test_best_configuration_needs_a_strictly_better_score(spark):
    df = spark.createDataFrame([(2, 0.5), (5, 0.7), (10, 0.7)], "steps int, f1 double")
    assert history.best_configuration(df, "f1", ["steps"]).first()["steps"] == 5


def sets(spark):
    rng = np.random.default_rng(0)
    a = [(i, float(v), "L" if v > 0 else "M") for i, v in enumerate(rng.normal(size=150).round(2))]
    b = [(i, float(v), "L" if v > 0.3 else "M") for i, v in enumerate(rng.normal(0.2, 1.3, 150).round(2))]
    schema = "i int, x double, t string"
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("rows", [1_000_000, 10])
def test_ks(spark, rows):
    a, b = sets(spark)
    x, y = (np.array([r["x"] for r in d.collect()]) for d in (a, b))
    grid = np.union1d(x, y)
    expected = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    row = stats.ks_2samp(a, b, ["x", "absent"], rows, exact_rows=0).collect()
    assert len(row) == 1 and row[0]["ks"] == pytest.approx(expected)
    lam = expected * np.sqrt(75)
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert row[0]["p_value"] == pytest.approx(series)


def test_identical_samples(spark):
    a, _ = sets(spark)
    assert stats.ks_2samp(a, a, ["x"]).first()["p_value"] == 1.0
    row = stats.t_test(a, a, ["x"]).first()
    assert row["t"] == 0.0 and row["p_value"] == pytest.approx(1.0)


def test_t_and_chi2_against_formulas(spark):
    a, b = sets(spark)
    x, y = (np.array([r["x"] for r in d.collect()]) for d in (a, b))
    pooled = (149 * x.var(ddof=1) + 149 * y.var(ddof=1)) / 298
    row = stats.t_test(a, b, ["x"]).first()
    assert row["t"] == pytest.approx((x.mean() - y.mean()) / np.sqrt(pooled * 2 / 150))
    u, v = ([r["t"] for r in d.orderBy("i").collect()] for d in (a, b))
    table = np.array([[sum(p == c and q == d for p, q in zip(u, v)) for d in "LM"] for c in "LM"])
    fit = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    got = stats.with_chi2_p(stats.chi2_paired(a, b, ["t"], ["i"])).first()
    assert got["chi2"] == pytest.approx(((table - fit) ** 2 / fit).sum()) and got["dof"] == 1


def test_p_value_tables():
    from fleetpulse.functions import distributions as d

    # Points of printed t and chi-square tables.
    assert d.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert d.t_two_sided(63.657, 1) == pytest.approx(0.01, abs=1e-5)
    assert d.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert d.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert d.chi2_upper(0.0, 3) == 1.0


def test_exact_ks_p_value(spark):
    import itertools

    from fleetpulse.functions import distributions as d

    # Points of printed tables of two samples of equal size.
    for n, gap, p in ((5, 5, 2 / 252), (5, 4, 20 / 252), (4, 4, 2 / 70), (8, 6, 0.0186), (10, 7, 0.0123)):
        assert d.ks_exact(gap / n, n, n) == pytest.approx(p, abs=5e-5)
    for m, n in ((3, 4), (5, 2), (4, 6), (1, 5)):
        paths = []
        for ups in itertools.combinations(range(m + n), m):
            i = np.cumsum([k in ups for k in range(m + n)])
            paths.append(np.abs(i * n - (np.arange(1, m + n + 1) - i) * m).max())
        for reach in range(1, m * n + 1):
            assert d.ks_exact(reach / (m * n), m, n) == pytest.approx(np.mean(np.array(paths) >= reach))
    assert 0 < d.ks_exact(0.2, 3000, 2500) < 1e-40
    assert d.ks_exact(0.05, 9000, 9000) == pytest.approx(2 * np.exp(-2 * 0.0025 * 4500), rel=0.1)
    a, b = sets(spark)
    row = stats.ks_2samp(a, b, ["x"]).first()
    assert row["p_value"] == pytest.approx(d.ks_exact(row["ks"], 150, 150))


def test_constant_category_has_no_freedom(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "i int, t string")
    row = stats.with_chi2_p(stats.chi2_paired(df, df, ["t"], ["i"])).first()
    assert (row["dof"], row["chi2"], row["p_value"]) == (0, 0.0, 1.0)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    rows = prep.fit_standard(df, ["a", "c"]).transform(df).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]
    rows = prep.fit_minmax(df, ["a", "c"]).transform(df, "s_").orderBy("a").collect()
    assert [(r["s_a"], r["s_c"]) for r in rows] == [(0.0, 0.0), (1.0, 0.0)]
    assert prep.variance_filter(df, ["a", "c"]).columns == ["a"]


def test_resampling_sizes_and_repeatability(spark):
    df = spark.range(100).select("id", (F.col("id") < 17).cast("int").alias("y"))
    up = prep.upsample_minority(df, "y", "id")
    assert {r["y"]: r["count"] for r in up.groupBy("y").count().collect()} == {0: 83, 1: 83}
    assert up.exceptAll(prep.upsample_minority(df.repartition(7), "y", "id")).isEmpty()
    over = prep.oversample(df, "y", "id")
    assert over.count() == 166 and over.select("id").distinct().count() == 100


def test_folds_and_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    folded = prep.stratified_folds(df, "y", "id", 5)
    counts = {(r["y"], r["fold"]): r["count"] for r in folded.groupBy("y", "fold").count().collect()}
    assert all(n == (20 if y else 180) for (y, _), n in counts.items()) and len(counts) == 10
    train, test = prep.stratified_split(df, "y", "id", 0.2)
    assert test.count() == 200 and test.filter("y = 1").count() == 20
    assert train.count() == 800 and train.join(test, "id").isEmpty()
    plain = prep.stratified_folds(df, "y", "id", 5, seed=None)
    assert plain.filter("y = 1 and id = 50").first()["fold"] == 0
    assert prep.folds(df, "id", 5).select("fold").distinct().count() == 5
    weights = {r["y"]: r["weight"] for r in prep.class_weights(df, "y").select("y", "weight").distinct().collect()}
    assert weights[1] == pytest.approx(5.0) and weights[0] == pytest.approx(1000 / 1800)
