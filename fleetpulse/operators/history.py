"""Tables of training histories: best epochs, fold summaries, best configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_epoch(history: DataFrame, by: Sequence[str], loss: str = "val_loss") -> DataFrame:
    """The epoch with the lowest validation loss, the earliest among equals."""
    rest = [c for c in history.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(F.col(loss), F.col("epoch")))
    return history.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def fold_summary(history: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, best and spread (max - min) over folds of each metric."""
    aggregates = []
    for m in metrics:
        aggregates += [
            F.avg(m).alias(f"mean_{m}"),
            F.max(m).alias(f"max_{m}"),
            (F.max(m) - F.min(m)).alias(f"spread_{m}"),
        ]
    return history.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *aggregates)


def with_constants(history: DataFrame, metrics: dict[str, float]) -> DataFrame:
    """Append fold-level test metrics as constant columns to an epoch history."""
    return history.withColumns({name: F.lit(value) for name, value in metrics.items()})


def best_configuration(
    results: DataFrame, score: Column | str, tie: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The configuration with the highest score; the first in ``tie`` order among equals."""
    score = F.col(score) if isinstance(score, str) else score
    rest = [c for c in results.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(-score, *tie))
    return results.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
