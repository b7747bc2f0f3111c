"""Lag and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import validate, windows
from fleetpulse.plans.registry import SENSORS, query, sql_over
from fleetpulse.schema import SEQUENCE_FEATURES
from fleetpulse.sources import views

_LAGS = [(c, k) for c in SENSORS for k in range(1, 6)]
_BY_MACHINE = "window w as (partition by machine_id order by event_time, udi)"


@query(
    "lag_features",
    sql_over(
        "readings",
        "select udi, case when event_time < timestamp '2024-01-16' then 'real' else 'synthetic' end as source, "
        + ", ".join(f"round(lag({c}, {k}) over w, 6) as {c}_lag_{k}" for c, k in _LAGS)
        + f" from readings {_BY_MACHINE}",
    ),
)
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    """Five lags of five sensors over the union of both sources."""
    whole = validate.integrate(*views.real_and_synthetic(views.readings(spark, folder)))
    lagged = windows.lag_features(whole, SENSORS, ["machine_id"], ["event_time", "udi"])
    names = [f"{c}_lag_{k}" for c, k in _LAGS]
    return lagged.select("udi", "source", *[F.round(n, 6).alias(n) for n in names])


@query(
    "lag_of_lag",
    sql_over(
        "readings",
        "select udi, "
        + ", ".join(f"lag(torque_nm, {i}) over w as lag_{i}" for i in range(1, 6))
        + ", "
        + ", ".join(f"lag(torque_nm, {i + 5}) over w as lag_{i}_lag_5" for i in range(1, 6))
        + f" from readings {_BY_MACHINE}",
    ),
)
def lag_of_lag(spark: SparkSession, folder: str) -> DataFrame:
    lagged = windows.lag_of_lag(
        views.readings(spark, folder), "torque_nm", ["machine_id"], ["event_time", "udi"]
    )
    return lagged.select(
        "udi", *[f"lag_{i}" for i in range(1, 6)], *[f"lag_{i}_lag_5" for i in range(1, 6)]
    )


_SHOWN = ["air_temp_k", "torque_nm", "power", "failure_risk"]


def steps(df: DataFrame, name: str = "sequence") -> DataFrame:
    """Shown features of every time step as plain columns."""
    cells = []
    for t in range(5):
        for c in _SHOWN:
            value = F.col(name)[t][SEQUENCE_FEATURES.index(c)]
            cells.append(F.round(value, 6).alias(f"{c}_{t}"))
    return df.select("udi", "machine_failure", F.size(F.flatten(name)).alias("width"), *cells)


def steps_sql(window: str) -> str:
    cells = ", ".join(
        f"round(cast(lag({c}, {4 - t}) over w as double), 6) as {c}_{t}" for t in range(5) for c in _SHOWN
    )
    return (
        f"select * exclude (rn) from (select udi, machine_failure, 70 as width, {cells}, "
        f"row_number() over w as rn from labelled window w as ({window})) where rn >= 5"
    )


SEQUENCE_SQL = sql_over("labelled", steps_sql("partition by machine_id order by event_time, udi"))


@query("sequence_windows", SEQUENCE_SQL)
def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the last five readings of a machine, 14 features each."""
    rows = views.labelled_readings(spark, folder)
    return steps(windows.sequences(rows, SEQUENCE_FEATURES, ["machine_id"], ["event_time", "udi"]))


@query("sequence_windows_global", sql_over("labelled", steps_sql("order by udi")))
def sequence_windows_global(spark: SparkSession, folder: str) -> DataFrame:
    """Windows over the order of the whole table, across machines."""
    rows = views.labelled_readings(spark, folder)
    return steps(windows.sequences(rows, SEQUENCE_FEATURES, [], ["udi"]))
