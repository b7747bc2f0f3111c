"""Bucketed order operators equal the plain single-window ones, also under skew and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.operators import ordering, windows


def table(spark, n=600, partitions=5):
    """A third of all rows belong to one machine, and many of those share a time stamp."""
    rng = np.random.default_rng(5)
    machine = np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 6, n))
    at = rng.permutation(n) // 2
    at = np.where((machine == 7) & (np.arange(n) % 2 == 0), 150, at)
    data = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "machine": machine,
            "at": at,
            "x": rng.normal(size=n).round(1),
            "y": rng.integers(0, 2, n),
        }
    )
    return spark.createDataFrame(data).repartition(partitions)


@pytest.mark.parametrize("rows", [1_000_000, 50, 7])
def test_ordinal(spark, rows):
    df = table(spark)
    got = ordering.add_ordinal(df, ["at", "id"], rows_per_bucket=rows)
    plain = F.row_number().over(Window.orderBy("at", "id")) - 1
    assert got.withColumn("e", plain).filter("ordinal <> e").count() == 0
    assert got.count() == 600
    grouped = ordering.add_ordinal(df, ["at", "id"], by=["y"], rows_per_bucket=rows)
    plain = F.row_number().over(Window.partitionBy("y").orderBy("at", "id")) - 1
    assert grouped.withColumn("e", plain).filter("ordinal <> e").count() == 0


def test_tied_values_are_split(spark):
    df = table(spark).withColumn("at", F.when(F.col("id") % 3 == 0, 150).otherwise(F.col("at")))
    placed, many = ordering.bucketed(df, ["at", "id"], 20)
    sizes = [r["count"] for r in placed.groupBy(ordering.BUCKET).count().collect()]
    assert many and max(sizes) < 80


@pytest.mark.parametrize("rows", [1_000_000, 20])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, rows, descending):
    df = table(spark)
    got = ordering.running_totals(
        df, "x", {"n": F.count(F.lit(1)), "s": F.sum("y")}, by=["y"], descending=descending, rows_per_bucket=rows
    ).toPandas()
    data = df.toPandas()
    for r in got.itertuples():
        part = data[data["y"] == r.y]
        upto = part[part["x"] >= r.x] if descending else part[part["x"] <= r.x]
        assert (r.cum_n, r.all_n, r.cum_s) == (len(upto), len(part), upto["y"].sum())


@pytest.mark.parametrize("rows", [1_000_000, 11])
def test_quantiles_are_interpolated(spark, rows):
    df = table(spark)
    got = ordering.quantiles(df, ["x", "at"], {"a": 0.25, "b": 0.5, "c": 0.999, "d": 1.0}, rows).toPandas()
    data = df.toPandas()
    for r in got.itertuples():
        expected = np.percentile(data[r.feature], [25, 50, 99.9, 100])
        assert np.allclose([r.a, r.b, r.c, r.d], expected)


def test_quantiles_skip_gaps(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert ordering.quantiles(df, ["x"], {"m": 0.5}).first()["m"] == 2.0


@pytest.mark.parametrize("rows", [1_000_000, 100, 10])
@pytest.mark.parametrize("by", [["machine"], []])
def test_lags_and_sequences(spark, rows, by):
    df = table(spark)
    window = Window.partitionBy(*by).orderBy("at", "id")
    lagged = windows.lag_features(df, ["x"], by, ["at", "id"], rows_per_group=rows)
    for k in range(1, 6):
        lagged = lagged.withColumn(f"e{k}", F.lag("x", k).over(window))
    wrong = " or ".join(f"not (x_lag_{k} <=> e{k})" for k in range(1, 6))
    assert lagged.count() == 600 and lagged.filter(wrong).count() == 0

    second = windows.lag_of_lag(df, "x", by, ["at", "id"], rows_per_group=rows)
    second = second.withColumn("e", F.lag("x", 8).over(window))
    assert second.filter("not (lag_3_lag_5 <=> e)").count() == 0

    found = windows.sequences(df, ["x", "y"], by, ["at", "id"], rows_per_group=rows)
    found = found.select("id", F.transform("sequence", lambda v: v[0]).alias("got"))
    plain = F.collect_list("x").over(window.rowsBetween(-4, 0))
    expected = df.withColumn("e", plain).filter(F.size("e") == 5).select("id", "e")
    joined = found.join(expected, "id", "full")
    assert joined.filter("not (got <=> e)").count() == 0


def test_sequences_can_keep_short_windows(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "m int, t int, x double")
    out = windows.sequences(df, ["x"], ["m"], ["t"], length=2, complete_only=False)
    assert [r["sequence"] for r in out.orderBy("t").collect()] == [None, [[2.0], [3.0]]]


def test_order_of_input_rows_does_not_matter(spark):
    few, many = table(spark, partitions=1), table(spark, partitions=16)
    a = windows.lag_features(few, ["x"], ["machine"], ["at", "id"], rows_per_group=30)
    b = windows.lag_features(many, ["x"], ["machine"], ["at", "id"], rows_per_group=30)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_zone_free_times_order_like_themselves(spark):
    """A clock change in the session's zone must not disturb the order."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql(
            "select timestamp_ntz'2024-03-10 00:00:00.000001' + make_dt_interval(0, 0, id * 10) as t, id from range(60)"
        )
        rows = df.select(ordering.sort_value(df, "t").alias("v"), "id").orderBy("id").collect()
        gaps = {b["v"] - a["v"] for a, b in zip(rows, rows[1:])}
        assert gaps == {600_000_000.0} and rows[0]["v"] % 10 == 1
        dates = df.select(F.col("t").cast("date").alias("d"))
        assert dates.select(ordering.sort_value(dates, "d")).first()[0] == rows[0]["v"] - 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _with_nulls(spark):
    rows = [(None if i % 4 == 0 else i % 3, None if i % 5 == 0 else float(i % 20), i) for i in range(200)]
    rows += [(1, float("nan"), 500), (None, float("nan"), 501), (2, -0.0, 502), (2, 0.0, 503)]
    return spark.createDataFrame(rows, "grp int, at double, udi long")


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_ordinals_keep_nulls_at_any_bucket_size(spark, by):
    df = _with_nulls(spark)
    one = {r.udi: r.ordinal for r in ordering.add_ordinal(df, ["at", "udi"], by).collect()}
    for size in (10, 40):
        many = {r.udi: r.ordinal for r in ordering.add_ordinal(df, ["at", "udi"], by, rows_per_bucket=size).collect()}
        assert many == one and len(one) == 204


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_keep_null_groups_and_values(spark, descending):
    df = _with_nulls(spark)
    found = []
    for size in (10, 1_000_000):
        run = ordering.running_totals(df, "at", {"n": F.count(F.lit(1))}, ["grp"], descending, rows_per_bucket=size)
        found.append(sorted((str(r.grp), str(r["at"]), r.n, r.cum_n, r.all_n) for r in run.collect()))
    assert found[0] == found[1] and sum(x[2] for x in found[0]) == 204
