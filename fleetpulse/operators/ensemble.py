"""Combining model scores and turning them into decisions and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Decision and alert cuts on the combined score.
DECISION_CUT = 0.5
ALERT_CUT = 0.6


def mean_of(scores: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of the scores that are present; NULL when none is."""
    weights = [1.0] * len(scores) if weights is None else [float(w) for w in weights]
    total, weight = F.lit(0.0), F.lit(0.0)
    for score, w in zip(scores, weights):
        known = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
        total = total + F.coalesce(known, F.lit(0.0)) * F.lit(w)
        weight = weight + F.when(known.isNull(), F.lit(0.0)).otherwise(F.lit(w))
    return F.try_divide(total, weight)


def mean_score(
    df: DataFrame, score_cols: Sequence[str], weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Add ``final_score`` and ``final_prediction`` (score at least one half, 0 without a score)."""
    score = mean_of(
        [F.col(c) for c in score_cols], [weights[c] for c in score_cols] if weights else None
    )
    return df.withColumn("final_score", score).withColumn(
        "final_prediction",
        F.coalesce(F.col("final_score") >= DECISION_CUT, F.lit(False)).cast("int"),
    )


def alerts(df: DataFrame, time: str = "timestamp", cut: float = ALERT_CUT) -> DataFrame:
    """Readings whose combined score reaches the alert cut, in alert form.

    Rows are picked by ``explode``: a filter would be pushed below the score's
    definition and the whole chain of features computed a second time in it.
    """
    alert = F.struct(
        "machine_id",
        "udi",
        F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("predicted_failure_date"),
        F.col("final_score").alias("risk_score"),
    )
    picked = F.explode(F.when(F.col("final_score") >= cut, F.array(alert)))
    return df.select(picked.alias("alert")).select("alert.*")


def long_scores(df: DataFrame, key: Sequence[str], models: Mapping[str, str]) -> DataFrame:
    """One row per (row, model): ``key..., model, score``."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("score"))
            for name, c in models.items()
        ]
    )
    return df.select(*key, F.explode(cells).alias("cell")).select(*key, "cell.*")


def f1_weights(
    scored: DataFrame, label: str, cut: float = 0.5, by: Sequence[str] = (), model: str = "model"
) -> DataFrame:
    """Model weights from validation F1, equal when no model scores at all."""
    hit, truth = F.col("score") > cut, F.col(label) == 1
    tp, fp, fn = (F.count_if(c) for c in (hit & truth, hit & ~truth, ~hit & truth))
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))
    per_model = scored.groupBy(*by, model).agg(f1.alias("f1"))
    # One row per model: a window over them is small whatever was scored.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    total, count = F.sum("f1").over(group), F.count(F.lit(1)).over(group)
    weight = F.when(total == 0, F.lit(1.0) / count).otherwise(F.try_divide(F.col("f1"), total))
    return per_model.withColumn("weight", weight)


def weight_map(weights: DataFrame, model: str = "model") -> dict[str, float]:
    """Weights of a handful of models, for use as literals."""
    return {r[model]: r["weight"] for r in weights.select(model, "weight").collect()}


def weighted_vote(df: DataFrame, models: Mapping[str, str], weights: Mapping[str, float], cut: float = 0.5) -> DataFrame:
    """Add ``vote_score``, the weighted mean over positive-weight models, and ``vote``.

    Scores of one reading sit in one row, so the vote is a projection.
    """
    used = [(c, weights[name]) for name, c in models.items() if weights.get(name, 0.0) > 0]
    total = sum(w for _, w in used) or 1.0
    score = F.lit(0.0)
    for c, w in used:
        score = score + F.col(c).cast("double") * F.lit(float(w))
    return df.withColumn("vote_score", score / F.lit(total)).withColumn(
        "vote", F.coalesce(F.col("vote_score") > cut, F.lit(False)).cast("int")
    )


def weighted_vote_long(
    scored: DataFrame, weights: DataFrame, key: Sequence[str], cut: float = 0.5
) -> DataFrame:
    """The same vote over a long ``(key, model, score)`` table."""
    used = weights.filter(F.col("weight") > 0).select("model", "weight")
    total = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return (
        scored.join(used, "model")
        .groupBy(*key)
        .agg(total.alias("vote_score"))
        .withColumn("vote", (F.col("vote_score") > cut).cast("int"))
    )
