"""Feature, label and projection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import arrays, physics
from fleetpulse.operators import prep
from fleetpulse.operators.ordering import wall_micros
from fleetpulse.plans.registry import SENSORS, query, sql_over
from fleetpulse.schema import CONDITIONS, PHYSICS, TABULAR_FEATURES
from fleetpulse.sources import views


def rounded(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def sql_rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


@query("type_encode", sql_over("physics", "select udi, type, type_code from physics"))
def type_encode(spark: SparkSession, folder: str) -> DataFrame:
    return physics.encode_type(views.readings(spark, folder)).select("udi", "type", "type_code")


@query(
    "osf_threshold",
    sql_over("physics", "select udi, type, osf_threshold, osf_threshold as joined_threshold from physics"),
)
def osf_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The limit by dictionary and by a left join with the three-row limit table."""
    limits = spark.createDataFrame(
        list(physics.OVERSTRAIN_LIMITS.items()), "type string, joined_threshold int"
    )
    return (
        physics.add_threshold(views.readings(spark, folder))
        .join(F.broadcast(limits), "type", "left")
        .select("udi", "type", "osf_threshold", "joined_threshold")
    )


@query(
    "derived_physics",
    sql_over(
        "physics",
        f"""select udi, {sql_rounded(PHYSICS)},
        round(temp_diff, 6) as air_temp_diff,
        round(greatest(torque_nm - cast(40 as double), cast(0 as double)), 6) as torque_above_40
        from physics""",
    ),
)
def derived_physics(spark: SparkSession, folder: str) -> DataFrame:
    return (
        physics.add_physics(views.readings(spark, folder))
        .withColumn("air_temp_diff", F.col("temp_diff"))
        .withColumn("torque_above_40", physics.clip_low(F.col("torque_nm") - F.lit(40.0)))
        .select("udi", *rounded(*PHYSICS, "air_temp_diff", "torque_above_40"))
    )


@query(
    "failure_conditions",
    sql_over("engineered", f"select udi, {', '.join(CONDITIONS)}, failure_risk from engineered"),
)
def failure_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return physics.engineer(views.readings(spark, folder)).select("udi", *CONDITIONS, "failure_risk")


@query(
    "failure_labels",
    sql_over(
        "labelled",
        """select udi, type || lpad(cast(udi % 100000 as varchar), 5, '0') as product_id,
        tool_wear_min + case type when 'L' then 2 when 'M' then 3 else 5 end as tool_wear_min,
        twf, hdf, pwf, osf, rnf, machine_failure from labelled""",
    ),
)
def failure_labels(spark: SparkSession, folder: str) -> DataFrame:
    return (
        physics.worn(views.labelled_readings(spark, folder))
        .withColumn("product_id", physics.product_id(F.col("type"), F.col("udi") % 100000))
        .select("udi", "product_id", "tool_wear_min", "twf", "hdf", "pwf", "osf", "rnf", "machine_failure")
    )


@query(
    "failure_risk_by_type",
    sql_over(
        "labelled",
        """select type, count(*) as n, cast(sum(twf_condition) as bigint) as n_twf,
        cast(sum(hdf_condition) as bigint) as n_hdf, cast(sum(pwf_condition) as bigint) as n_pwf,
        cast(sum(osf_condition) as bigint) as n_osf, cast(sum(failure_risk) as bigint) as n_risk,
        cast(sum(machine_failure) as bigint) as n_failures, round(avg(power), 6) as mean_power
        from labelled group by type""",
    ),
)
def failure_risk_by_type(spark: SparkSession, folder: str) -> DataFrame:
    counted = {
        "n_twf": "twf_condition",
        "n_hdf": "hdf_condition",
        "n_pwf": "pwf_condition",
        "n_osf": "osf_condition",
        "n_risk": "failure_risk",
        "n_failures": "machine_failure",
    }
    return (
        views.labelled_readings(spark, folder)
        .groupBy("type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(n) for n, c in counted.items()],
            F.round(F.avg("power"), 6).alias("mean_power"),
        )
    )


_POSITIONS = {
    "rotational_speed_rpm": 2,
    "torque_nm": 3,
    "temp_diff": 5,
    "power": 7,
    "type_code": 13,
    "osf_condition": 14,
}


@query(
    "feature_select_rename",
    sql_over(
        "labelled",
        "select udi, "
        + ", ".join(
            f"round({c}, 6) as column_{i}" if c in ("temp_diff", "power") else f"{c} as column_{i}"
            for c, i in _POSITIONS.items()
        )
        + " from labelled where machine_failure = 1",
    ),
)
def feature_select_rename(spark: SparkSession, folder: str) -> DataFrame:
    """The failure class under a model's positional column names."""
    failures = views.labelled_readings(spark, folder).filter("machine_failure = 1")
    features = physics.select_features(failures, ["udi", *TABULAR_FEATURES])
    positional = physics.with_positional_names(features, TABULAR_FEATURES)
    return positional.select(
        "udi",
        *[
            F.round(f"column_{i}", 6).alias(f"column_{i}")
            if c in ("temp_diff", "power")
            else F.col(f"column_{i}")
            for c, i in _POSITIONS.items()
        ],
    )


@query(
    "log_features",
    sql_over(
        "readings",
        "select udi, " + ", ".join(f"round(ln(1 + {c}), 6) as log_{c}" for c in SENSORS) + " from readings",
    ),
)
def log_features(spark: SparkSession, folder: str) -> DataFrame:
    return physics.add_logs(views.readings(spark, folder)).select(
        "udi", *rounded(*[f"log_{c}" for c in SENSORS])
    )


@query(
    "zscore_features",
    sql_over(
        "readings",
        "select udi, "
        + ", ".join(
            f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as scaled_{c}" for c in SENSORS
        )
        + " from readings",
    ),
)
def zscore_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.readings(spark, folder).select("udi", *SENSORS)
    scaled = prep.fit_standard(rows, SENSORS).transform(rows, "scaled_")
    return scaled.select("udi", *rounded(*[f"scaled_{c}" for c in SENSORS]))


@query(
    "minmax_features",
    sql_over(
        "readings",
        "select udi, "
        + ", ".join(
            f"round(({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) as {c}"
            for c in SENSORS
        )
        + " from readings",
    ),
)
def minmax_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.readings(spark, folder).select("udi", *SENSORS)
    return prep.fit_minmax(rows, SENSORS).transform(rows).select("udi", *rounded(*SENSORS))


@query(
    "inf_null_clean",
    sql_over(
        "labelled",
        """select udi, torque_nm as ratio, machine_failure from labelled
        where udi % 7 <> 0 and udi % 11 <> 0 and udi % 13 <> 0""",
    ),
)
def inf_null_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Infinite, missing and NaN values go; the label stays in its row."""
    udi = F.col("udi")
    ratio = (
        F.when(udi % 7 == 0, F.lit(float("inf")))
        .when(udi % 11 == 0, F.lit(None))
        .when(udi % 13 == 0, F.lit(float("nan")))
        .otherwise(F.col("torque_nm"))
    )
    rows = views.labelled_readings(spark, folder).select("udi", ratio.alias("ratio"), "machine_failure")
    return physics.drop_incomplete(rows)


_FOLDED = [
    "air_temp_k",
    "process_temp_k",
    "rotational_speed_rpm",
    "torque_nm",
    "tool_wear_min",
    "temp_diff",
    "power",
    "tool_torque_product",
    "twf_condition",
    "hdf_condition",
]


def _fold_sql() -> str:
    rows = []
    for steps in (2, 5, 10):
        width = len(_FOLDED) // steps
        for t in range(steps):
            part = _FOLDED[t * width : (t + 1) * width]
            rows.append(
                f"select udi, {steps} as steps, {t} as step, {width} as width, "
                f"round({part[0]}, 6) as first_value, round({part[-1]}, 6) as last_value from engineered"
            )
    return "\nunion all ".join(rows)


@query("timestep_fold", sql_over("engineered", _fold_sql()))
def timestep_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Ten flat features folded into 2, 5 and 10 time steps, one row per step."""
    flat = F.array(*[F.col(c).cast("double") for c in _FOLDED])
    width = len(_FOLDED)
    folds = F.array(
        *[
            F.struct(F.lit(t).alias("steps"), arrays.fold_steps(F.col("flat"), width, t).alias("rows"))
            for t in arrays.foldable_steps(width)
        ]
    )
    return (
        physics.engineer(views.readings(spark, folder))
        .select("udi", flat.alias("flat"))
        .select("udi", F.explode(folds).alias("f"))
        .select("udi", "f.steps", F.posexplode("f.rows").alias("step", "row"))
        .select(
            "udi",
            "steps",
            "step",
            F.size("row").alias("width"),
            F.round(F.element_at("row", 1), 6).alias("first_value"),
            F.round(F.element_at("row", -1), 6).alias("last_value"),
        )
    )


@query(
    "chart_series",
    sql_over(
        "scored",
        "\nunion all ".join(
            f"select udi, epoch_us(event_time) as event_us, '{c}' as sensor, round({c}, 6) as value, "
            "round(score, 6) as final_score from scored"
            for c in SENSORS
        ),
    ),
)
def chart_series(spark: SparkSession, folder: str) -> DataFrame:
    """Long series for a dashboard: one row per reading and sensor, with the score."""
    scored = views.linear_score(views.labelled_readings(spark, folder))
    cells = F.array(
        *[F.struct(F.lit(c).alias("sensor"), F.round(c, 6).alias("value")) for c in SENSORS]
    )
    return scored.select(
        "udi",
        wall_micros(F.col("event_time")).alias("event_us"),
        F.round("score", 6).alias("final_score"),
        F.explode(cells).alias("cell"),
    ).select("udi", "event_us", "cell.*", "final_score")
