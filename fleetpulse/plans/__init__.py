"""Registered queries: each has a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.plans import (
    evaluation,
    features,
    learning,
    maintenance,
    ordered,
    preparation,
    quality,
    served,
    statistics,
    streams,
)
from fleetpulse.plans.registry import QUERIES, SQL

Plan = Callable[[SparkSession, str], DataFrame]

__all__ = ["QUERIES", "SQL", "Plan"]
