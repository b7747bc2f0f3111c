"""Descriptive statistics and two-sample tests, all columns in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.distributions import EXACT_ROWS, chi2_p_value, ks_p_value, t_p_value
from fleetpulse.operators.ordering import (
    ROWS_PER_BUCKET,
    add_ordinal,
    quantiles,
    running_totals,
    unpivot,
)


def shared_columns(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns both datasets have; the others are skipped by the tests."""
    return [c for c in cols if c in a.columns and c in b.columns]


def _both(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return a.select(F.lit(1).alias("first"), *cols).unionByName(b.select(F.lit(0).alias("first"), *cols))


def _clean(c: str):
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def describe(
    df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    measures = {
        "n": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min_value": F.min,
        "max_value": F.max,
    }
    row = df.agg(*[f(_clean(c)).alias(f"{c}__{m}") for c in cols for m, f in measures.items()])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{m}").alias(m) for m in measures])
            for c in cols
        ]
    )
    moments = row.select(F.explode(cells).alias("cell")).select("cell.*")
    quartiles = quantiles(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, rows_per_bucket)
    return moments.join(quartiles, "feature", "left").select(
        "feature", "n", "mean", "std", "min_value", "p25", "p50", "p75", "max_value"
    )


def mean_std(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation of both datasets, one row per column."""
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp}
    both = _both(a, b, cols)
    row = both.agg(
        *[
            f(F.when(F.col("first") == side, _clean(c))).alias(f"{c}__{m}{2 - side}")
            for c in cols
            for m, f in measures.items()
            for side in (1, 0)
        ]
    )
    names = [f"{m}{i}" for m in measures for i in (1, 2)]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{n}").alias(n) for n in names])
            for c in cols
        ]
    )
    return row.select(F.explode(cells).alias("cell")).select("cell.*")


def t_statistic(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Student t for independent samples with pooled variance: ``t`` and ``dof``."""
    n1, n2 = F.col("n1"), F.col("n2")
    dof = n1 + n2 - 2
    pooled = ((n1 - 1) * F.col("std1") ** 2 + (n2 - 1) * F.col("std2") ** 2) / F.nullif(dof, F.lit(0))
    error = F.sqrt(pooled * (F.lit(1.0) / F.nullif(n1, F.lit(0)) + F.lit(1.0) / F.nullif(n2, F.lit(0))))
    return mean_std(a, b, cols).withColumns(
        {"dof": dof, "t": F.try_divide(F.col("mean1") - F.col("mean2"), error)}
    )


def t_test(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    return t_statistic(a, b, cols).withColumn("p_value", t_p_value(F.col("t"), F.col("dof")))


def ks_2samp(
    a: DataFrame,
    b: DataFrame,
    cols: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per column: exact for samples of up to ``exact_rows`` rows, else asymptotic."""
    cols = shared_columns(a, b, cols)
    long, many = unpivot(_both(a, b, cols), cols, ["first"], rows_per_bucket)
    run = running_totals(
        long,
        "value",
        {"a": F.sum("first"), "b": F.sum(1 - F.col("first"))},
        by=["feature"],
        many=many,
    )
    gap = F.abs(
        F.try_divide(F.col("cum_a"), F.col("all_a")) - F.try_divide(F.col("cum_b"), F.col("all_b"))
    )
    return (
        run.groupBy("feature")
        .agg(F.max(gap).alias("ks"), F.max("all_a").alias("n1"), F.max("all_b").alias("n2"))
        .withColumn("p_value", ks_p_value(F.col("ks"), F.col("n1"), F.col("n2"), exact_rows))
    )


def contingency(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Counts ``(feature, a, b, n)`` for several column pairs in one pass."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(a).cast("string").alias("a"),
                F.col(b).cast("string").alias("b"),
            )
            for name, a, b in pairs
        ]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .dropna("any")
        .groupBy("feature", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi2_from_counts(counts: DataFrame) -> DataFrame:
    """Chi-square of independence (no continuity correction) from contingency counts.

    Uses ``N * (sum n^2 / (row * column) - 1)``, which accounts for empty cells
    without listing them. Totals come from aggregates and equi-joins.
    """
    rows = counts.groupBy("feature", "a").agg(F.sum("n").alias("row_n"))
    cols = counts.groupBy("feature", "b").agg(F.sum("n").alias("col_n"))
    sides = (
        rows.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("r"), F.sum("row_n").alias("n"))
        .join(cols.groupBy("feature").agg(F.count(F.lit(1)).alias("c")), "feature")
    )
    share = (F.col("n").cast("double") / F.col("row_n")) * (F.col("n").cast("double") / F.col("col_n"))
    fit = (
        counts.join(rows, ["feature", "a"])
        .join(cols, ["feature", "b"])
        .groupBy("feature")
        .agg(F.sum(share).alias("share"))
    )
    return fit.join(sides, "feature").select(
        "feature",
        "n",
        ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"),
        F.greatest(F.lit(0.0), F.col("n") * (F.col("share") - 1)).alias("chi2"),
    )


def with_chi2_p(df: DataFrame) -> DataFrame:
    """Add the p-value; a table with one row or column (no freedom) gets 1."""
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_p_value(F.col("chi2"), F.col("dof")))
    return df.withColumn("p_value", p)


def paired(a: DataFrame, b: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row i of one dataset next to row i of the other (``<c>_1``, ``<c>_2``)."""
    left = add_ordinal(a.select(*dict.fromkeys([*order, *cols])), order)
    right = add_ordinal(b.select(*dict.fromkeys([*order, *cols])), order)
    return left.select("ordinal", *[F.col(c).alias(f"{c}_1") for c in cols]).join(
        right.select("ordinal", *[F.col(c).alias(f"{c}_2") for c in cols]), "ordinal"
    )


def chi2_paired(a: DataFrame, b: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Independence of row-aligned values: row i of ``a`` against row i of ``b``."""
    cols = shared_columns(a, b, cols)
    pairs = paired(a, b, cols, order)
    return chi2_from_counts(contingency(pairs, [(c, f"{c}_1", f"{c}_2") for c in cols]))


def chi2_homogeneity(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Equal distribution of a category in both datasets (2 x k table)."""
    cols = shared_columns(a, b, cols)
    return chi2_from_counts(contingency(_both(a, b, cols), [(c, "first", c) for c in cols]))


def compare(
    a: DataFrame, b: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Means, deviations, t-test and KS-test p-values of two datasets per column."""
    ks = ks_2samp(a, b, cols, rows_per_bucket).select("feature", F.col("p_value").alias("ks_p_value"))
    return (
        t_test(a, b, cols)
        .join(ks, "feature")
        .select(
            "feature",
            F.col("mean1").alias("original_mean"),
            F.col("mean2").alias("synthetic_mean"),
            F.col("std1").alias("original_std"),
            F.col("std2").alias("synthetic_std"),
            F.col("p_value").alias("t_test_p_value"),
            "ks_p_value",
        )
    )


def _long(df: DataFrame, dataset: str, test: str, measures: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    )
    return df.select("feature", F.explode(cells).alias("cell")).select(
        F.lit(dataset).alias("dataset"), F.col("feature").alias("column"), F.lit(test).alias("test"), "cell.*"
    )


def validation_report(
    real: DataFrame,
    simulated: DataFrame,
    continuous: Sequence[str],
    categorical: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Long report ``(dataset, column, test, measure, value)`` of all statistics and tests."""
    stats = ["n", "mean", "std", "min_value", "p25", "p50", "p75", "max_value"]
    return (
        _long(describe(real, continuous), "real", "describe", stats)
        .unionByName(_long(describe(simulated, continuous), "simulated", "describe", stats))
        .unionByName(
            _long(ks_2samp(real, simulated, continuous), "both", "ks", ["ks", "p_value"])
        )
        .unionByName(
            _long(
                with_chi2_p(chi2_paired(real, simulated, categorical, order)),
                "both",
                "chi2 paired rows",
                ["chi2", "p_value"],
            )
        )
        .unionByName(
            _long(
                with_chi2_p(chi2_homogeneity(real, simulated, categorical)),
                "both",
                "chi2 homogeneity",
                ["chi2", "p_value"],
            )
        )
    )
