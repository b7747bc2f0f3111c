"""Maintenance-system queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import cmms, ensemble
from fleetpulse.plans.registry import query, sql_over
from fleetpulse.schema import ASSET, MAINTENANCE
from fleetpulse.session import work_path
from fleetpulse.sources import readers, views


@query(
    "assets_active",
    sql_over(
        "asset",
        """select Id as asset_id, Code as asset_code, Description as asset_description,
        Type as asset_type, Type as notes from asset where Status = 'A'""",
    ),
)
def assets_active(spark: SparkSession, folder: str) -> DataFrame:
    return cmms.active_assets(views.assets(spark, folder)).drop(
        "installation_date", "warranty_expiration"
    )


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("start_date", F.date_format("start_date", "yyyy-MM-dd")).drop("end_date", "notes")


@query(
    "corrective_left_join",
    sql_over(
        "asset",
        """select o_orderkey as maintenance_id, 'CM-' || o_orderkey as maintenance_code,
        o_orderpriority as maintenance_description, o_custkey as asset_id, asset.Code as asset_code,
        asset.Description as asset_description, o_orderpriority as process_type,
        strftime(o_orderdate, '%Y-%m-%d') as start_date, 'A' as status
        from orders left join asset on o_custkey = asset.Id where o_orderstatus = 'O'""",
    ),
)
def corrective_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return _text_dates(cmms.maintenance(views.corrective(spark, folder), views.assets(spark, folder)))


@query(
    "preventive_left_join",
    sql_over(
        "asset",
        """select l_orderkey as maintenance_id, 'PM-' || l_orderkey as maintenance_code,
        l_returnflag as maintenance_description, l_partkey as asset_id, asset.Code as asset_code,
        asset.Description as asset_description, l_returnflag as process_type,
        strftime(l_shipdate, '%Y-%m-%d') as start_date, 'A' as status
        from lineitem left join asset on l_partkey = asset.Id where l_linestatus = 'O'""",
    ),
)
def preventive_left_join(spark: SparkSession, folder: str) -> DataFrame:
    return _text_dates(cmms.maintenance(views.preventive(spark, folder), views.assets(spark, folder)))


@query(
    "maintenance_extraction",
    sql_over(
        "asset",
        """select 'assets' as name, count(*) as n_rows, count(Code) as n_codes from asset where Status = 'A'
        union all select 'corrective_maintenance', count(*), count(asset.Code)
          from orders left join asset on o_custkey = asset.Id where o_orderstatus = 'O'
        union all select 'preventive_maintenance', count(*), count(asset.Code)
          from lineitem left join asset on l_partkey = asset.Id where l_linestatus = 'O'""",
    ),
)
def maintenance_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Three CSV extracts, read back with their schemas."""
    written = cmms.extract(
        views.assets(spark, folder),
        views.corrective(spark, folder),
        views.preventive(spark, folder),
        work_path(spark, "extract"),
    )
    out = None
    for name, path in written.items():
        rows = readers.read_csv(spark, path, ASSET if name == "assets" else MAINTENANCE)
        line = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count("asset_code").alias("n_codes")).select(
            F.lit(name).alias("name"), "*"
        )
        out = line if out is None else out.unionByName(line)
    return out


def site_of(machine: str = "machine_id"):
    return (F.col(machine) % 30).cast("string")


def requester_of(machine: str = "machine_id"):
    """Staff by name for even machines, by code for odd ones; both are valid lookups."""
    number = F.col(machine) % 10
    by_name = F.concat(F.lit("Supplier#"), F.lpad(number.cast("string"), 9, "0"))
    return F.when(F.col(machine) % 2 == 0, by_name).otherwise(number.cast("string"))


def orders_for(spark: SparkSession, folder: str, alerts: DataFrame, opened=None) -> DataFrame:
    return cmms.work_orders(
        alerts,
        views.priorities(spark, folder),
        views.work_types(spark, folder),
        views.sites(spark, folder),
        views.staff(spark, folder),
        priority="3",
        kind="ASIA",
        site=site_of(),
        requester=requester_of(),
        opened=opened,
    )


def flat_orders(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        "machine_id",
        "udi",
        "short_descr",
        "priority",
        *keep,
        "process_notes",
        "type",
        F.col("requester.id").alias("requester_id"),
        F.col("requester.type").alias("requester_type"),
        F.col("site.id").alias("site_id"),
        F.col("site.type").alias("site_type"),
    )


ORDER_SQL = """
select machine_id, udi, 'Anomaly Detected' as short_descr, cast(300 as bigint) as priority,
  '{"PredictedFailureDate":"' || strftime(event_time, '%Y-%m-%d %H:%M:%S') || '","RiskScore":'
    || cast(round(score, 2) as varchar) || '}' as process_notes,
  cast((select r_regionkey from region where r_name = 'ASIA') as bigint) as type,
  machine_id % 10 as requester_id, 'InternalEmployee' as requester_type,
  machine_id % 30 as site_id, 'Site' as site_type
"""


@query(
    "workorder_enrichment",
    sql_over(
        "scored",
        ORDER_SQL.replace(
            "'Site' as site_type",
            "'Site' as site_type, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') as opening_date",
        )
        + " from scored where round(score, 2) >= cast(0.6 as double) and machine_id % 30 < 25",
    ),
)
def workorder_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.linear_score(views.labelled_readings(spark, folder))
    raised = ensemble.alerts(scored.withColumn("final_score", F.round("score", 2)), time="event_time")
    opened = F.to_timestamp("predicted_failure_date")
    orders = orders_for(spark, folder, raised, opened)
    return flat_orders(orders, "opening_date")


@query(
    "first_open_activity",
    """select user_id as work_order, min(event_id) as activity_id,
    arg_min(case event_type when 'error' then 'open' else 'running' end, event_id) as status
    from events where event_type in ('error', 'click') group by user_id""",
)
def first_open_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events as activities of work orders: errors are open, clicks running, the rest done."""
    status = (
        F.when(F.col("event_type") == "error", "open")
        .when(F.col("event_type") == "click", "running")
        .otherwise("done")
    )
    activities = views.table(spark, folder, "events").select(
        F.col("user_id").alias("work_order"), F.col("event_id").alias("activity_id"), status.alias("status")
    )
    return cmms.first_open_activity(activities, ["work_order"], "activity_id")
