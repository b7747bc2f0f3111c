"""Maintenance-system joins: active assets, maintenance records, work orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.sources.sinks import write_csv

# Constants of a work order and of the activity check.
SHORT_DESCRIPTION = "Anomaly Detected"
NOTES = "An anomaly was detected in the sensor readings."
REQUESTER_TYPE = "InternalEmployee"
SITE_TYPE = "Site"
OPEN_STATES = ("open", "running")


def active_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("Status") == "A").select(
        F.col("Id").alias("asset_id"),
        F.col("Code").alias("asset_code"),
        F.col("Description").alias("asset_description"),
        F.col("Type").alias("asset_type"),
        F.col("InstallationDate").alias("installation_date"),
        F.col("WarrantyEnd").alias("warranty_expiration"),
        F.col("Notes").alias("notes"),
    )


def maintenance(records: DataFrame, assets: DataFrame) -> DataFrame:
    """Active maintenance records with their asset's code and description, if there is one.

    No join hint: the asset table is broadcast only while its measured size is
    below the session threshold; beyond it the adaptive sort-merge join splits
    the partitions of an asset with very many records.
    """
    own = assets.select(
        F.col("Id").alias("CI"),
        F.col("Code").alias("asset_code"),
        F.col("Description").alias("asset_description"),
    )
    return (
        records.filter(F.col("Status") == "A")
        .join(own, "CI", "left")
        .select(
            F.col("Id").alias("maintenance_id"),
            F.col("Code").alias("maintenance_code"),
            F.col("Description").alias("maintenance_description"),
            F.col("CI").alias("asset_id"),
            "asset_code",
            "asset_description",
            F.col("ProcessType").alias("process_type"),
            F.col("OpeningDate").alias("start_date"),
            F.col("ClosureDate").alias("end_date"),
            F.col("Notes").alias("notes"),
            F.col("Status").alias("status"),
        )
    )


def extract(
    assets: DataFrame, corrective: DataFrame, preventive: DataFrame, folder: str
) -> dict[str, str]:
    """Write active assets and both kinds of maintenance as CSV; empty results are skipped.

    Returns the folder of each file set that was written.
    """
    results = {
        "assets": active_assets(assets),
        "corrective_maintenance": maintenance(corrective, assets),
        "preventive_maintenance": maintenance(preventive, assets),
    }
    out = {}
    for name, df in results.items():
        if not df.isEmpty():
            out[name] = f"{folder}/{name}"
            write_csv(df, out[name])
    return out


def lookup_keys(dim: DataFrame) -> DataFrame:
    """Dimension ``(id, code, description)`` as ``(lookup, id)``: one row per code or description.

    The first id wins when a text names several entries. Matching on code OR
    description becomes an equi-join on ``lookup``.
    """
    texts = F.array_distinct(F.array("code", "description"))
    return (
        dim.select("id", F.explode(texts).alias("lookup"))
        .filter(F.col("lookup").isNotNull())
        .groupBy("lookup")
        .agg(F.min("id").alias("id"))
    )


def resolve(df: DataFrame, dim: DataFrame, key: Column | str, name: str, how: str = "left") -> DataFrame:
    """Add the id of the dimension entry whose code or description equals ``key``."""
    key = F.col(key) if isinstance(key, str) else key
    ids = lookup_keys(dim).select(
        F.col("lookup").alias(f"__{name}_lookup"), F.col("id").alias(name)
    )
    return df.join(ids, key == F.col(f"__{name}_lookup"), how).drop(f"__{name}_lookup")


def lookup_id(dim: DataFrame, text: str) -> int | None:
    """Id of the entry whose code or description is ``text``; the smallest if there are several."""
    hit = (F.col("code") == text) | (F.col("description") == text)
    return dim.filter(hit).agg(F.min("id").alias("id")).first()["id"]


def _with_id(df: DataFrame, dim: DataFrame, key: Column | str, name: str) -> DataFrame:
    """Id for a fixed text (looked up once) or a key column (joined); misses are dropped."""
    if isinstance(key, Column):
        return resolve(df, dim, key, name, "inner")
    found = lookup_id(dim, key)
    return df.filter(F.lit(found is not None)).withColumn(name, F.lit(found).cast("bigint"))


def work_orders(
    alerts: DataFrame,
    priorities: DataFrame,
    types: DataFrame,
    sites: DataFrame,
    staff: DataFrame,
    priority: Column | str,
    kind: Column | str,
    site: Column | str,
    requester: Column | str,
    opened: Column | None = None,
) -> DataFrame:
    """One work order per alert; alerts with an unknown id on any side are skipped.

    Each key is a fixed text or a column of the alerts.
    """
    ids = _with_id(alerts, priorities, priority, "priority_id")
    ids = _with_id(ids, types, kind, "type_id")
    ids = _with_id(ids, sites, site, "site_id")
    ids = _with_id(ids, staff, requester, "requester_id")
    opened = F.current_timestamp() if opened is None else opened
    message = F.to_json(
        F.struct(
            F.col("predicted_failure_date").alias("PredictedFailureDate"),
            F.col("risk_score").alias("RiskScore"),
        )
    )
    return ids.select(
        "machine_id",
        "udi",
        F.lit(SHORT_DESCRIPTION).alias("short_descr"),
        F.col("priority_id").alias("priority"),
        F.date_format(opened, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("opening_date"),
        F.lit(None).cast("string").alias("closure_date"),
        F.lit(NOTES).alias("notes"),
        message.alias("process_notes"),
        F.col("type_id").alias("type"),
        F.struct(
            F.col("requester_id").alias("id"), F.lit(REQUESTER_TYPE).alias("type")
        ).alias("requester"),
        F.struct(F.col("site_id").alias("id"), F.lit(SITE_TYPE).alias("type")).alias("site"),
    )


def first_open_activity(
    activities: DataFrame, by: Sequence[str], order: str, status: str = "status"
) -> DataFrame:
    """The first open or running activity of each work order (map-side combined, no sort)."""
    rest = [c for c in activities.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.col(order))
    return (
        activities.filter(F.col(status).isin(*OPEN_STATES))
        .groupBy(*by)
        .agg(first.alias("a"))
        .select(*by, "a.*")
    )
