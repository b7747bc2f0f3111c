"""Golden values of features, conditions, labels and record checks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import arrays, physics
from fleetpulse.operators import validate
from fleetpulse.schema import (
    COLUMN_ALIASES,
    SENSORS,
    SEQUENCE_FEATURES,
    TABULAR_FEATURES,
    lag_table_schema,
    required_lag_columns,
)

COLUMNS = "udi long, type string, " + ", ".join(f"{c} double" for c in SENSORS)


def readings(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def test_normal_reading(spark):
    row = physics.engineer(readings(spark, ("L", 300.0, 310.0, 1500.0, 40.0, 100.0))).first()
    assert (row["type_code"], row["osf_threshold"]) == (1, 11000)
    assert row["temp_diff"] == pytest.approx(10.0)
    assert row["rotational_speed_rad_s"] == pytest.approx(157.0796, abs=1e-4)
    assert row["power"] == pytest.approx(6283.185, abs=1e-3)
    assert row["tool_torque_product"] == pytest.approx(4000.0)
    assert [row[c] for c in ("twf_condition", "hdf_condition", "pwf_condition", "osf_condition")] == [0] * 4
    assert row["failure_risk"] == 0


@pytest.mark.parametrize("wear,flag", [(199.0, 0), (200.0, 1), (240.0, 1), (241.0, 0)])
def test_wear_limits_are_inclusive(spark, wear, flag):
    row = physics.engineer(readings(spark, ("H", 300.0, 310.0, 1500.0, 40.0, wear))).first()
    assert (row["twf_condition"], row["failure_risk"]) == (flag, flag)


def test_heat_power_and_overstrain_limits_are_strict(spark):
    df = spark.createDataFrame(
        [
            (0, 8.6, 1000.0, 3500.0, 11000.0, 11000),
            (1, 8.5, 1379.0, 3499.9, 11000.1, 11000),
            (2, 8.5, 1380.0, 9000.0, 1.0, 11000),
            (3, 9.0, 1000.0, 9000.1, 1.0, 11000),
        ],
        "udi int, temp_diff double, rotational_speed_rpm double, power double, "
        "tool_torque_product double, osf_threshold int",
    ).withColumn("tool_wear_min", F.lit(0.0))
    rows = physics.add_conditions(df).orderBy("udi").collect()
    assert [r["hdf_condition"] for r in rows] == [0, 1, 0, 0]
    assert [r["pwf_condition"] for r in rows] == [0, 1, 0, 1]
    assert [r["osf_condition"] for r in rows] == [0, 1, 0, 0]


def test_nan_and_null_decide_nothing(spark):
    nan = float("nan")
    rows = physics.engineer(
        readings(spark, ("L", 300.0, 310.0, 1500.0, nan, 210.0), ("L", 300.0, 310.0, 1500.0, None, 10.0))
    ).orderBy("udi").collect()
    assert [r["pwf_condition"] for r in rows] == [0, 0]
    assert [r["osf_condition"] for r in rows] == [0, 0]
    assert rows[0]["failure_risk"] == 1 and rows[0]["power"] is None


def test_unknown_type_is_dropped(spark):
    assert physics.engineer(readings(spark, ("X", 300.0, 310.0, 1500.0, 40.0, 1.0))).count() == 0


def test_labels_are_repeatable_and_near_their_shares(spark):
    df = spark.range(20000).select(
        F.col("id").alias("udi"),
        F.lit("L").alias("type"),
        F.lit(300.0).alias("air_temp_k"),
        F.lit(310.0).alias("process_temp_k"),
        F.lit(1500.0).alias("rotational_speed_rpm"),
        F.lit(40.0).alias("torque_nm"),
        F.lit(220.0).alias("tool_wear_min"),
    )
    once = physics.label_failures(physics.engineer(df))
    again = physics.label_failures(physics.engineer(df.repartition(9)))
    assert once.select("udi", "machine_failure", "rnf").exceptAll(
        again.select("udi", "machine_failure", "rnf")
    ).isEmpty()
    row = once.agg(F.avg("machine_failure").alias("f"), F.avg("rnf").alias("r"), F.min("twf").alias("t")).first()
    assert row["t"] == 1 and abs(row["f"] - 0.57) < 0.02 and abs(row["r"] - 0.001) < 0.001


def messages(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "value string")


def message(**changes):
    values = dict(zip([k for k, v in COLUMN_ALIASES.items() if v in SENSORS], [300.0, 310.0, 1500, 40.0, 100]))
    values = {"UDI": 1, "Type": "L", **values, **changes}
    return {k: v for k, v in values.items() if v is not ...}


def test_bad_messages_are_quarantined_with_a_reason(spark):
    raw = messages(
        spark,
        message(),
        message(Type=...),
        message(**{"Air temperature [K]": "invalid"}),
        message(**{"Torque [Nm]": "40.0"}),
        message(Type="X"),
        message(Type=1),
        message(**{"Torque [Nm]": float("nan")}),
        "not json",
    )
    valid, bad = validate.split_valid(validate.parse_messages(raw))
    assert valid.count() == 2
    reasons = [r["reason"] for r in bad.collect()]
    assert "missing or invalid: Type" in reasons
    assert reasons.count("missing or invalid: Air temperature [K]") == 2
    assert "missing or invalid: Torque [Nm]" in reasons
    assert "unknown type: X" in reasons and "unknown type: 1" in reasons
    kept = physics.engineer(valid).filter(F.col("torque_nm").isNull()).first()
    assert kept["pwf_condition"] == 0


def test_feature_lists_and_schemas():
    assert len(SEQUENCE_FEATURES) == 14 and len(TABULAR_FEATURES) == 15
    assert len(required_lag_columns()) == 151
    assert len(lag_table_schema().fields) == 62


def test_missing_features_are_named(spark):
    with pytest.raises(ValueError, match="torque_nm"):
        physics.select_features(spark.range(1), ["id", "torque_nm"])


def test_positional_names_round_trip(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    there = physics.with_positional_names(df, ["a", "b"])
    assert there.columns == ["column_0", "column_1"]
    assert physics.with_feature_names(there, ["a", "b"]).columns == ["a", "b"]


def test_half_rounds_to_zero(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (0.49,)], "p double")
    assert [r[0] for r in df.select(physics.round_half_even(F.col("p"))).collect()] == [0, 1, 0]


def test_incomplete_rows_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, math.inf), (3, -math.inf), (4, math.nan), (5, None)], "y int, x double"
    )
    assert [r["y"] for r in physics.drop_incomplete(df).collect()] == [1]


def test_fold_steps(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert df.select(arrays.fold_steps(F.col("v"), 4, 2)).first()[0] == [[1.0, 2.0], [3.0, 4.0]]
    assert arrays.foldable_steps(10) == [2, 5, 10]
    with pytest.raises(ValueError):
        arrays.fold_steps(F.col("v"), 4, 3)


def test_complete_windows(spark):
    df = spark.createDataFrame(
        [([[1.0], [2.0]],), ([[1.0], [None]],), ([[1.0], [math.nan]],)], "v array<array<double>>"
    )
    assert [r[0] for r in df.select(arrays.complete(F.col("v"))).collect()] == [True, False, False]


def test_report_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "a int, process_temp_k double").withColumns(
        {"air_temp_k": F.lit(3.0), "torque_nm": F.lit(-1.0)}
    )
    report = {(r["check"], r["subject"]): r["measure"] for r in validate.dataset_report(df, "d", ["a", "z"]).collect()}
    assert report["rows", ""] == 3 and report["missing", "process_temp_k"] == 1
    assert report["duplicate rows", ""] == 1 and report["missing column", "z"] == 1
    assert report["negative torque", ""] == 3 and report["process below air temperature", ""] == 2
    assert report["max", "a"] == 2
    types = {r["column"]: r["type"] for r in validate.column_types(df).collect()}
    assert types["a"] == "int"
    only = validate.null_counts(df, only_missing=True).collect()
    assert {r["column"] for r in only} == {"process_temp_k", "(total)"}
