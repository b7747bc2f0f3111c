"""Canonical schemas, column names and table definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetpulse.session import work_path

# External (CSV / JSON) column names and their canonical names.
COLUMN_ALIASES = {
    "UDI": "udi",
    "Product ID": "product_id",
    "Type": "type",
    "Air temperature [K]": "air_temp_k",
    "Process temperature [K]": "process_temp_k",
    "Rotational speed [rpm]": "rotational_speed_rpm",
    "Torque [Nm]": "torque_nm",
    "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
}

SENSORS = [
    "air_temp_k",
    "process_temp_k",
    "rotational_speed_rpm",
    "torque_nm",
    "tool_wear_min",
]
FAILURE_FLAGS = ["machine_failure", "twf", "hdf", "pwf", "osf", "rnf"]
CONDITIONS = ["twf_condition", "hdf_condition", "pwf_condition", "osf_condition"]
PHYSICS = ["temp_diff", "rotational_speed_rad_s", "power", "tool_torque_product"]

# Feature order of the window models (14) and of the tabular models (15).
SEQUENCE_FEATURES = SENSORS + PHYSICS + CONDITIONS + ["failure_risk"]
TABULAR_FEATURES = (
    SENSORS
    + PHYSICS
    + ["twf_condition", "hdf_condition", "pwf_condition", "failure_risk", "type_code", "osf_condition"]
)
# Columns compared by the distribution tests.
CONTINUOUS_COLUMNS = SENSORS + ["air_temp_diff", "power"]
CATEGORICAL_COLUMNS = ["type"] + FAILURE_FLAGS


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _DOUBLE, _STRING, _TIME = (
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.StringType(),
    T.TimestampType(),
)

SENSOR = _struct(
    ("udi", _LONG),
    ("product_id", _STRING),
    ("type", _STRING),
    *[(name, _DOUBLE) for name in SENSORS],
    *[(name, _INT) for name in FAILURE_FLAGS],
)
# The same reading under its external names, as CSV headers and JSON keys carry them.
SENSOR_MESSAGE = T.StructType(
    [
        T.StructField(external, SENSOR[canonical].dataType, True)
        for external, canonical in COLUMN_ALIASES.items()
    ]
)
SCORED = _struct(
    ("udi", _LONG),
    ("machine_id", _LONG),
    ("type", _STRING),
    ("type_code", _INT),
    *[(name, _DOUBLE) for name in SENSORS],
    ("osf_threshold", _INT),
    *[(name, _DOUBLE) for name in PHYSICS],
    *[(name, _INT) for name in CONDITIONS],
    ("failure_risk", _INT),
    ("final_prediction", _INT),
    ("final_score", _DOUBLE),
    ("timestamp", _TIME),
)
ALERT = _struct(
    ("machine_id", _LONG),
    ("udi", _LONG),
    ("predicted_failure_date", _STRING),
    ("risk_score", _DOUBLE),
)
ASSET = _struct(
    ("asset_id", _LONG),
    ("asset_code", _STRING),
    ("asset_description", _STRING),
    ("asset_type", _STRING),
    ("installation_date", _TIME),
    ("warranty_expiration", _TIME),
    ("notes", _STRING),
)
MAINTENANCE = _struct(
    ("maintenance_id", _LONG),
    ("maintenance_code", _STRING),
    ("maintenance_description", _STRING),
    ("asset_id", _LONG),
    ("asset_code", _STRING),
    ("asset_description", _STRING),
    ("process_type", _STRING),
    ("start_date", _TIME),
    ("end_date", _TIME),
    ("notes", _STRING),
    ("status", _STRING),
)
HISTORY = _struct(
    ("fold", _INT),
    ("auc", _DOUBLE),
    ("average_precision", _DOUBLE),
    ("precision", _DOUBLE),
    ("recall", _DOUBLE),
    ("f1_score", _DOUBLE),
    ("accuracy", _DOUBLE),
    ("loss", _DOUBLE),
    ("training_accuracy", _DOUBLE),
    ("validation_accuracy", _DOUBLE),
    ("training_loss", _DOUBLE),
    ("validation_loss", _DOUBLE),
    ("matthews_corrcoef", _DOUBLE),
    ("pr_auc", _DOUBLE),
    ("contamination_level", _DOUBLE),
    ("model_name", _STRING),
)
EPOCH_HISTORY = T.StructType(
    [
        T.StructField(name, T.ArrayType(_DOUBLE), True)
        for name in ("accuracy", "loss", "val_accuracy", "val_loss", "learning_rate")
    ]
)


def lag_table_schema(lags: int = 5) -> T.StructType:
    """Wide reading table: base, derived, log and scaled columns plus sensor lags."""
    fields = [T.StructField("id", _LONG, True)] + list(SENSOR.fields)
    derived = ["air_temp_diff", "power"]
    derived += [f"log_{name}" for name in SENSORS] + [f"scaled_{name}" for name in SENSORS]
    derived += [f"scaled_{name}_lag_{k}" for name in SENSORS for k in range(1, lags + 1)]
    derived += [f"lag_{k}" for k in range(1, lags + 1)]
    derived += [f"lag_{k}_lag_{lags}" for k in range(1, lags + 1)]
    return T.StructType(fields + [T.StructField(name, _DOUBLE, True) for name in derived])


def required_lag_columns(lags: int = 5) -> list[str]:
    """Column names a fully prepared reading table must carry (151 for five lags)."""
    external = list(COLUMN_ALIASES)
    sensors = external[3:8]
    derived = ["air_temp_diff", "power"]
    derived += [f"log_{name}" for name in sensors] + [f"scaled_{name}" for name in sensors]
    lagged = ["UDI"] + external[3:] + derived
    return (
        external
        + derived
        + [f"lag_{k}" for k in range(1, lags + 1)]
        + [f"{name}_lag_{k}" for name in lagged for k in range(1, lags + 1)]
    )


TABLES = {
    "sensor_readings": SENSOR,
    "processed_data": lag_table_schema(),
    "simulated_data": lag_table_schema(),
    "combined_data": lag_table_schema(),
}


def create_tables(
    spark: SparkSession, tables: dict[str, T.StructType] | None = None, database: str | None = None
) -> list[str]:
    """Create the typed tables that do not exist yet; returns their names.

    A table that exists with other columns is an error.
    """
    tables = TABLES if tables is None else tables
    for name, schema in tables.items():
        whole = f"{database}.{name}" if database else name
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {whole} ({columns}) USING parquet")
        if spark.table(whole).columns != schema.fieldNames():
            raise ValueError(f"table {whole} exists with other columns")
    return list(tables)


def private_database(spark: SparkSession, tables: dict[str, T.StructType]) -> str:
    """A new database below the shared work folder with the typed tables; the caller's tables are not touched."""
    path = work_path(spark, "database")
    name = "fleetpulse_" + path.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    create_tables(spark, tables, name)
    return name


def canonical(df: DataFrame) -> DataFrame:
    """Rename external column names to canonical ones; other columns are kept."""
    return df.withColumnsRenamed(COLUMN_ALIASES)


def external(df: DataFrame) -> DataFrame:
    """Inverse of :func:`canonical`."""
    return df.withColumnsRenamed({short: long for long, short in COLUMN_ALIASES.items()})
