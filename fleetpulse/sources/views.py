"""Sensor, maintenance and model-history views over the star-schema tables.

Each view is a projection of one table, so filters and column pruning reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import physics


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Sensor readings derived from the ``events`` table."""
    k = F.get_json_object("props", "$.k")
    event_id = F.col("event_id")
    air = F.lit(295.0) + (event_id % 97).cast("double") / 10
    kind = (
        F.when(F.col("event_type") == "error", "H")
        .when(F.col("event_type").isin("signup", "purchase"), "M")
        .otherwise("L")
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, folder, "events").select(
        event_id.alias("udi"),
        F.col("user_id").alias("machine_id"),
        F.col("ts").alias("event_time"),
        kind.alias("type"),
        air.alias("air_temp_k"),
        (air + F.lit(7.53) + k.cast("double") / 20).alias("process_temp_k"),
        (1200 + (event_id * 37) % 700).cast("double").alias("rotational_speed_rpm"),
        (F.lit(20.0) + (cents % 4000).cast("double") / 100).alias("torque_nm"),
        ((event_id * 13) % 250).cast("double").alias("tool_wear_min"),
        k.cast("int").alias("k"),
    )


def labelled(df: DataFrame) -> DataFrame:
    """Engineered readings with failure labels drawn from the reading number."""
    return physics.label_failures(
        physics.engineer(df),
        wear_draw=F.col("udi") % 100 < 57,
        random_draw=F.col("udi") % 1000 == 0,
    )


def labelled_readings(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(readings(spark, folder))


def linear_score(df: DataFrame) -> DataFrame:
    """A fixed risk score in [0, 1] from wear x torque and the distance from mid power."""
    raw = F.col("tool_torque_product") / F.lit(28000.0) + F.abs(
        F.col("power") - F.lit(6250.0)
    ) / F.lit(12000.0)
    return df.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))


def before_split() -> Column:
    """Readings before this day are the measured set, later ones the synthetic set."""
    return F.col("event_time") < F.lit("2024-01-16").cast("timestamp_ntz")


def real_and_synthetic(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(before_split()), df.filter(~before_split())


def dirty(df: DataFrame) -> DataFrame:
    """Readings with gaps, swapped temperatures, negative torque and repeated rows."""
    udi = F.col("udi")
    spoiled = df.withColumns(
        {
            "torque_nm": F.when(udi % 17 == 0, None)
            .when(udi % 29 == 0, -F.col("torque_nm"))
            .otherwise(F.col("torque_nm")),
            "process_temp_k": F.when(
                udi % 23 == 0, F.col("process_temp_k") - F.lit(20.0)
            ).otherwise(F.col("process_temp_k")),
        }
    )
    copies = F.when(udi % 50 == 0, F.lit(2)).otherwise(F.lit(1))
    return spoiled.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("copy")


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw asset records; one customer in five has none, so joins meet misses."""
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .filter(key % 5 != 0)
        .select(
            key.alias("Id"),
            F.col("c_name").alias("Code"),
            F.concat(F.lit("Asset "), key.cast("string")).alias("Description"),
            F.col("c_mktsegment").alias("Type"),
            F.when(F.col("c_acctbal") > 0, "A").otherwise("N").alias("Status"),
            F.lit(None).cast("timestamp_ntz").alias("InstallationDate"),
            F.lit(None).cast("timestamp_ntz").alias("WarrantyEnd"),
            F.col("c_mktsegment").alias("Notes"),
        )
    )


def corrective(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("Id"),
        F.concat(F.lit("CM-"), key.cast("string")).alias("Code"),
        F.col("o_orderpriority").alias("Description"),
        F.col("o_custkey").alias("CI"),
        F.col("o_orderpriority").alias("ProcessType"),
        F.col("o_orderdate").alias("OpeningDate"),
        F.lit(None).cast("timestamp_ntz").alias("ClosureDate"),
        F.lit(None).cast("string").alias("Notes"),
        F.when(F.col("o_orderstatus") == "O", "A").otherwise("N").alias("Status"),
    )


def preventive(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("l_orderkey")
    return table(spark, folder, "lineitem").select(
        key.alias("Id"),
        F.concat(F.lit("PM-"), key.cast("string")).alias("Code"),
        F.col("l_returnflag").alias("Description"),
        F.col("l_partkey").alias("CI"),
        F.col("l_returnflag").alias("ProcessType"),
        F.col("l_shipdate").alias("OpeningDate"),
        F.lit(None).cast("timestamp_ntz").alias("ClosureDate"),
        F.lit(None).cast("string").alias("Notes"),
        F.when(F.col("l_linestatus") == "O", "A").otherwise("N").alias("Status"),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.col("n_nationkey").cast("string").alias("code"),
        F.col("n_name").alias("description"),
    )


def staff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_suppkey").cast("string").alias("code"),
        F.col("s_name").alias("description"),
    )


def priorities(spark: SparkSession, folder: str) -> DataFrame:
    """Priority dimension: the code is the leading digit, the id is a hundredfold."""
    code = F.substring("o_orderpriority", 1, 1)
    return (
        table(spark, folder, "orders")
        .select("o_orderpriority")
        .distinct()
        .select(
            (code.cast("bigint") * 100).alias("id"),
            code.alias("code"),
            F.col("o_orderpriority").alias("description"),
        )
    )


def work_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"),
        F.col("r_regionkey").cast("string").alias("code"),
        F.col("r_name").alias("description"),
    )
