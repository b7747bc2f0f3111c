"""Training-set preparation queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import prep, windows
from fleetpulse.plans.registry import SENSORS, query, sql_over
from fleetpulse.sources import views

_LABEL = "machine_failure"


@query(
    "stratified_folds",
    sql_over(
        "labelled",
        """select udi, machine_failure, cast((row_number() over (partition by machine_failure
        order by (udi * 7919) % 10007, udi) - 1) % 5 as int) as fold from labelled""",
    ),
)
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Folds of equal class shares, taken in a scrambled order of the reading number."""
    rows = views.labelled_readings(spark, folder).select("udi", _LABEL)
    mixed = rows.withColumn("mixed", (F.col("udi") * 7919) % 10007)
    return prep.stratified_folds(mixed, _LABEL, "udi", 5, order=["mixed", "udi"]).select(
        "udi", _LABEL, "fold"
    )


@query(
    "stratified_split",
    sql_over(
        "labelled",
        """with c as (select machine_failure, count(*) as n from labelled group by 1)
        select machine_failure, part, case part when 'test' then cast(round(n * 0.2) as bigint)
          else n - cast(round(n * 0.2) as bigint) end as n
        from c, (values ('train'), ('test')) p(part)""",
    ),
)
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts of an 80/20 split in hash order."""
    rows = views.labelled_readings(spark, folder).select("udi", _LABEL)
    train, test = prep.stratified_split(rows, _LABEL, "udi")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy(_LABEL, "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "upsample_minority",
    sql_over(
        "labelled",
        """with m as (select max(n) as top from (select count(*) as n from labelled group by machine_failure))
        select machine_failure, top as n, 0 as n_wrong_rows from (select distinct machine_failure
        from labelled), m""",
    ),
)
def upsample_minority(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts after the bootstrap, and drawn rows that are not rows of the table."""
    rows = views.labelled_readings(spark, folder).select("udi", _LABEL)
    drawn = prep.upsample_minority(rows, _LABEL, "udi")
    known = rows.select("udi", F.col(_LABEL).alias("true_label"))
    checked = drawn.join(known, "udi", "left")
    wrong = F.coalesce(F.col("true_label") != F.col(_LABEL), F.lit(True))
    return checked.groupBy(_LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).cast("int").alias("n_wrong_rows")
    )


@query(
    "oversample_all",
    sql_over(
        "labelled",
        """with c as (select machine_failure, count(*) as n from labelled group by machine_failure)
        select machine_failure, (select max(n) from c) as n, n as n_originals from c""",
    ),
)
def oversample_all(spark: SparkSession, folder: str) -> DataFrame:
    """Class counts after adding copies; every original row is kept."""
    rows = views.labelled_readings(spark, folder).select("udi", _LABEL)
    copies = prep.oversample(rows, _LABEL, "udi").groupBy(_LABEL, "udi").agg(F.count(F.lit(1)).alias("m"))
    return copies.groupBy(_LABEL).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_originals"))


@query(
    "variance_filter",
    sql_over("readings", "select udi, rotational_speed_rpm, torque_nm, tool_wear_min from readings"),
)
def variance_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The constant column goes, the varying ones stay."""
    rows = views.readings(spark, folder).select(
        "udi", "rotational_speed_rpm", "torque_nm", "tool_wear_min", F.lit(7.0).alias("constant")
    )
    return prep.variance_filter(rows, rows.columns[1:])


@query("pca20")
def pca20(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled lag matrix reduced to 20 components, fitted on four folds and applied to the fifth."""
    lagged = windows.lag_features(
        views.readings(spark, folder), SENSORS, ["machine_id"], ["event_time", "udi"]
    ).dropna()
    cols = SENSORS + [f"{c}_lag_{k}" for c in SENSORS for k in range(1, 6)]
    lagged = prep.folds(lagged, "udi", 5)
    train, validation = lagged.filter("fold <> 0"), lagged.filter("fold = 0")
    _, reduced = prep.scale_and_reduce(train, validation, cols, 20)
    parts = vector_to_array("components")
    return reduced.select("udi", *[parts[i].alias(f"pc{i + 1}") for i in range(20)])
