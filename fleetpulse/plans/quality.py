"""Dataset checks, integration and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import physics
from fleetpulse.operators import prep, validate
from fleetpulse.plans.registry import SENSORS, query, sql_over
from fleetpulse.schema import SENSOR, TABLES, external, private_database
from fleetpulse.session import work_path
from fleetpulse.sources import readers, sinks, views

_COLUMNS = [
    "udi",
    "machine_id",
    "event_time",
    "type",
    "air_temp_k",
    "process_temp_k",
    "rotational_speed_rpm",
    "torque_nm",
    "tool_wear_min",
    "k",
]
_NUMERIC = ["udi", "machine_id", *SENSORS, "k"]


def _dirty(spark: SparkSession, folder: str) -> DataFrame:
    return views.dirty(views.readings(spark, folder))


@query(
    "null_counts",
    sql_over(
        "dirty",
        "\nunion all ".join(
            f"select '{c}' as \"column\", count(*) - count({c}) as n_missing from dirty" for c in _COLUMNS
        )
        + "\nunion all select '(total)', count(*) - count(torque_nm) from dirty",
    ),
)
def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    return validate.null_counts(_dirty(spark, folder))


@query(
    "value_ranges",
    sql_over(
        "dirty",
        "\nunion all ".join(
            f"select '{c}' as \"column\", round(cast(min({c}) as double), 6) as min_value, "
            f"round(cast(max({c}) as double), 6) as max_value from dirty"
            for c in _NUMERIC
        ),
    ),
)
def value_ranges(spark: SparkSession, folder: str) -> DataFrame:
    return validate.value_ranges(_dirty(spark, folder)).select(
        "column", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value")
    )


@query(
    "inconsistent_records",
    sql_over(
        "dirty",
        """select count(*) filter (where process_temp_k < air_temp_k) as inconsistent_temperature,
        count(*) filter (where torque_nm < 0) as negative_torque from dirty""",
    ),
)
def inconsistent_records(spark: SparkSession, folder: str) -> DataFrame:
    return validate.inconsistent_records(_dirty(spark, folder))


@query(
    "duplicate_rows",
    sql_over(
        "dirty",
        "select (select count(*) from dirty) - (select count(*) from (select distinct * from dirty)) "
        "as duplicate_rows",
    ),
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return validate.duplicate_rows(_dirty(spark, folder))


_REQUIRED = {
    "udi": "bigint",
    "type": "string",
    **{c: "double" for c in SENSORS},
    "product_id": None,
    "machine_failure": None,
}


@query(
    "required_columns",
    sql_over(
        "dirty",
        "\nunion all ".join(
            f"select '{c}' as \"column\", {int(kind is not None)} as present, "
            + (f"'{kind}' as type, count({c}) as n_values from dirty" if kind else "null, 0")
            for c, kind in _REQUIRED.items()
        ),
    ),
)
def required_columns(spark: SparkSession, folder: str) -> DataFrame:
    return validate.required_columns(_dirty(spark, folder), list(_REQUIRED))


def _report_sql() -> str:
    parts = []
    for dataset, test in (("real", "<"), ("synthetic", ">=")):
        source = f"(select * from dirty where event_time {test} timestamp '2024-01-16')"
        cells = [("rows", "", "count(*)")]
        cells += [("missing", c, f"count(*) - count({c})") for c in _COLUMNS]
        cells += [("min", c, f"min({c})") for c in _NUMERIC]
        cells += [("max", c, f"max({c})") for c in _NUMERIC]
        cells += [
            ("process below air temperature", "", "count(*) filter (where process_temp_k < air_temp_k)"),
            ("negative torque", "", "count(*) filter (where torque_nm < 0)"),
            ("duplicate rows", "", f"count(*) - (select count(*) from (select distinct * from {source}))"),
            ("missing column", "product_id", "max(1)"),
            ("missing column", "machine_failure", "max(1)"),
        ]
        parts += [
            f"select '{dataset}' as dataset, '{check}' as \"check\", '{c}' as subject, "
            f"round(cast({value} as double), 6) as measure from {source}"
            for check, c, value in cells
        ]
    return "\nunion all ".join(parts)


@query("dataset_verification", sql_over("dirty", _report_sql()))
def dataset_verification(spark: SparkSession, folder: str) -> DataFrame:
    real, synthetic = views.real_and_synthetic(_dirty(spark, folder))
    report = validate.dataset_report(real, "real", list(_REQUIRED)).unionByName(
        validate.dataset_report(synthetic, "synthetic", list(_REQUIRED))
    )
    return report.withColumn("measure", F.round("measure", 6))


@query(
    "first_rows",
    sql_over("readings", "select udi, type, torque_nm from readings order by udi limit 5"),
)
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first readings: every task keeps five, no table sort."""
    return validate.first_rows(views.readings(spark, folder).select("udi", "type", "torque_nm"), ["udi"])


@query(
    "table_shapes",
    sql_over(
        "dirty",
        """select 'dirty' as "table", count(*) as n_rows, 10 as n_columns from dirty
        union all select 'readings', count(*), 10 from readings
        union all select 'orders', count(*), 6 from orders""",
    ),
)
def table_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return (
        validate.shape(_dirty(spark, folder), "dirty")
        .unionByName(validate.shape(views.readings(spark, folder), "readings"))
        .unionByName(validate.shape(views.table(spark, folder, "orders"), "orders"))
    )


@query(
    "table_profiles",
    sql_over(
        "dirty",
        """select 'dirty' as "table", 'rows' as measure, '' as subject, count(*) as value from dirty
        union all select 'dirty', 'columns', '', 10
        union all select 'dirty', 'missing', 'torque_nm', count(*) - count(torque_nm) from dirty
        union all select 'events', 'rows', '', count(*) from events
        union all select 'events', 'columns', '', 6""",
    ),
)
def table_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return validate.table_profile(_dirty(spark, folder), "dirty").unionByName(
        validate.table_profile(views.table(spark, folder, "events"), "events")
    )


@query(
    "integrate_dropna",
    sql_over(
        "dirty",
        """select udi, case when event_time < timestamp '2024-01-16' then 'real' else 'synthetic' end
        as source, round(air_temp_k, 6) as air_temp_k, torque_nm from dirty where torque_nm is not null""",
    ),
)
def integrate_dropna(spark: SparkSession, folder: str) -> DataFrame:
    real, synthetic = views.real_and_synthetic(_dirty(spark, folder))
    whole = physics.drop_incomplete(validate.integrate(real, synthetic))
    return whole.select("udi", "source", F.round("air_temp_k", 6).alias("air_temp_k"), "torque_nm")


@query(
    "integrate_narrow",
    sql_over(
        "dirty",
        """select 'real' as source, count(torque_nm) as n_kept, count(*) - count(torque_nm) as n_dropped
        from dirty where event_time < timestamp '2024-01-16'
        union all select 'synthetic', 0, count(*) from dirty where event_time >= timestamp '2024-01-16'""",
    ),
)
def integrate_narrow(spark: SparkSession, folder: str) -> DataFrame:
    """A source that lacks a column loses all its rows; the report says so."""
    real, synthetic = views.real_and_synthetic(_dirty(spark, folder))
    return validate.dropped_by_source(validate.integrate(real, synthetic.drop("tool_wear_min")))


@query(
    "load_tables",
    sql_over(
        "labelled",
        "\nunion all ".join(
            f"select '{name}' as \"table\", count(*) as n_rows, "
            "cast(sum(machine_failure) as bigint) as n_failures, "
            "round(avg(torque_nm), 6) as mean_torque, round(max(process_temp_k), 6) as max_process_temp "
            f"from labelled {where}"
            for name, where in (
                ("processed_data", "where event_time < timestamp '2024-01-16'"),
                ("simulated_data", "where event_time >= timestamp '2024-01-16'"),
                ("combined_data", ""),
            )
        ),
    ),
)
def load_tables(spark: SparkSession, folder: str) -> DataFrame:
    """CSV out with external names, CSV in with the fixed schema, tables replaced and read back."""
    readings = views.labelled_readings(spark, folder).withColumn(
        "product_id", physics.product_id(F.col("type"), F.col("udi") % 100000)
    )
    columns = ["udi", "product_id", "type", *SENSORS, "machine_failure", "twf", "hdf", "pwf", "osf", "rnf"]
    real, synthetic = views.real_and_synthetic(readings)
    loaded = {}
    for name, part in (("processed_data", real), ("simulated_data", synthetic)):
        path = work_path(spark, name)
        sinks.write_csv(external(part.select(*columns)), path)
        loaded[name] = readers.read_readings_csv(spark, path)
    loaded["combined_data"] = loaded["processed_data"].unionByName(loaded["simulated_data"])
    database = private_database(spark, TABLES)
    out = None
    for name, rows in loaded.items():
        # into the declared columns; derived ones that were not computed are NULL
        typed = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in TABLES[name].fields
            ]
        )
        sinks.fill_table(typed, f"{database}.{name}")
        counted = readers.read_table(spark, f"{database}.{name}").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("machine_failure").alias("n_failures"),
            F.round(F.avg("torque_nm"), 6).alias("mean_torque"),
            F.round(F.max("process_temp_k"), 6).alias("max_process_temp"),
        )
        line = counted.select(F.lit(name).alias("table"), "*")
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "typed_tables",
    sql_over(
        "readings",
        """select 'sensor_readings' as "table", count(*) as n_rows, 14 as n_columns from readings""",
    ),
)
def typed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Create the typed reading table when it is absent, then load it."""
    database = private_database(spark, TABLES)
    rows = views.labelled_readings(spark, folder).withColumn(
        "product_id", physics.product_id(F.col("type"), F.col("udi") % 100000)
    )
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in SENSOR.fields])
    sinks.fill_table(typed, f"{database}.sensor_readings")
    return validate.shape(readers.read_query(spark, f"select * from {database}.sensor_readings"), "sensor_readings")


@query(
    "class_distribution",
    sql_over(
        "labelled",
        """select machine_failure, count(*) as n,
        round(cast((select count(*) from labelled) as double) / (2 * count(*)), 6) as balanced_weight
        from labelled group by machine_failure""",
    ),
)
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.labelled_readings(spark, folder).select("machine_failure")
    return (
        prep.class_weights(rows, "machine_failure")
        .groupBy("machine_failure")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("balanced_weight"))
    )
