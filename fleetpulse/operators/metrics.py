"""Classifier metrics over (label, prediction, score) tables.

Threshold metrics are conditional sums in one aggregation; curve metrics run on
the running totals over distinct scores and handle ties exactly. They make
several passes over the table, so store the scores of an expensive model first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import ROWS_PER_BUCKET, running_totals


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and loss = 1 - F1 from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": f1,
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "loss": 1 - f1,
        }
    )


def mcc(counts: DataFrame) -> DataFrame:
    """Matthews correlation; 0 when labels or predictions are constant."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    # Factors are rooted one by one: their product would lose digits for large tables.
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumn("mcc", _ratio(tp * tn - fp * fn, scale))


def score_curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct score, highest first, with cumulative true and false positives."""
    return running_totals(
        df.select(*by, label, F.col(score).cast("double").alias(score)),
        score,
        {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) != 1)},
        by=by,
        descending=True,
        rows_per_bucket=rows_per_bucket,
    )


def _rates() -> dict[str, Column]:
    cum_pos, cum_neg = F.col("cum_pos"), F.col("cum_neg")
    before = cum_pos - F.col("pos")
    seen_before = before + cum_neg - F.col("neg")
    return {
        "recall": F.when(F.col("all_pos") == 0, 1.0).otherwise(
            F.try_divide(cum_pos.cast("double"), F.col("all_pos").cast("double"))
        ),
        "recall_before": F.when(
            F.col("all_pos") == 0, F.when(seen_before == 0, 0.0).otherwise(1.0)
        ).otherwise(F.try_divide(before.cast("double"), F.col("all_pos").cast("double"))),
        "precision": cum_pos / (cum_pos + cum_neg),
        "precision_before": F.coalesce(F.try_divide(before, seen_before), F.lit(1.0)),
    }


def _one_class() -> Column:
    return F.max((F.col("all_pos") == 0) | (F.col("all_neg") == 0))


def roc_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 if only one class is present."""
    area = F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")) / 2
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return curve.groupBy(*by).agg(_ratio(F.sum(area), pairs).alias("roc_auc"))


def pr_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area under the precision-recall curve that ends at (0, 1)."""
    step = F.col("recall") - F.col("recall_before")
    area = F.sum(step * (F.col("precision") + F.col("precision_before")) / 2)
    return curve.withColumns(_rates()).groupBy(*by).agg(area.alias("pr_auc"))


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall; 0 if only one class is present."""
    area = F.sum((F.col("recall") - F.col("recall_before")) * F.col("precision"))
    return (
        curve.withColumns(_rates())
        .groupBy(*by)
        .agg(F.when(_one_class(), 0.0).otherwise(area).alias("average_precision"))
    )


def curve_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, PR-AUC and average precision in one aggregation over the curve."""
    roc = F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")) / 2
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    step = F.col("recall") - F.col("recall_before")
    return (
        curve.withColumns(_rates())
        .groupBy(*by)
        .agg(
            _ratio(F.sum(roc), pairs).alias("roc_auc"),
            F.sum(step * (F.col("precision") + F.col("precision_before")) / 2).alias("pr_auc"),
            F.when(_one_class(), 0.0)
            .otherwise(F.sum(step * F.col("precision")))
            .alias("average_precision"),
        )
    )


def roc_points(curve: DataFrame) -> DataFrame:
    """Curve points ``(threshold = score, fpr, tpr)`` plus Youden's ``j``."""
    tpr, fpr = _ratio(F.col("cum_pos"), F.col("all_pos")), _ratio(F.col("cum_neg"), F.col("all_neg"))
    return curve.withColumns({"tpr": tpr, "fpr": fpr, "j": tpr - fpr})


def youden(curve: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest ``tpr - fpr``; the highest one among equals.

    The curve starts at (0, 0) with an infinite threshold, so that is the answer
    when no threshold does better than chance.
    """
    best = F.max_by(F.struct(score, "j"), F.struct("j", score))
    out = roc_points(curve).groupBy(*by).agg(best.alias("best"))
    better = F.col("best.j") > 0
    return out.select(
        *by,
        F.when(better, F.col(f"best.{score}")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(better, F.col("best.j")).otherwise(F.lit(0.0)).alias("j"),
    )


def log_loss(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary cross-entropy (probabilities clipped at 1e-7) and accuracy at one half."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    hit = ((F.col(score) > 0.5) == (F.col(label) == 1)).cast("double")
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.avg(hit).alias("accuracy"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support, with macro and weighted averages."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # Each (label, prediction) count adds to its label's and its prediction's class.
    per_class = (
        pairs.select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("y").alias("class"),
                        F.col("n").alias("support"),
                        F.lit(0).cast("bigint").alias("predicted"),
                        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits"),
                    ),
                    F.struct(
                        F.col("p").alias("class"),
                        F.lit(0).cast("bigint").alias("support"),
                        F.col("n").alias("predicted"),
                        F.lit(0).cast("bigint").alias("hits"),
                    ),
                )
            ).alias("cell")
        )
        .select("cell.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    scored = per_class.select(
        F.col("class").cast("string").alias("class"),
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hits",
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = scored.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures],
        _ratio(F.sum("hits"), total).alias("accuracy"),
        total.alias("support"),
    )
    lines = F.array(
        F.struct(
            F.lit("accuracy").alias("class"),
            *[F.col("accuracy").alias(m) for m in measures],
            F.col("support").alias("support"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("class"),
                *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                F.col("support").alias("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    averages = summary.select(F.explode(lines).alias("cell")).select("cell.*")
    return scored.drop("hits").unionByName(averages)


def evaluate(
    df: DataFrame,
    label: str,
    pred: str,
    score: str,
    by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """All nine metrics per group: threshold metrics and curve metrics, stacked and folded.

    Each group has one row of either kind, so a maximum picks the value and no
    join is needed.
    """
    by = list(by)
    flat = mcc(precision_recall(confusion(df, label, pred, by))).drop("tp", "fp", "fn", "tn")
    curves = curve_metrics(score_curve(df, label, score, by, rows_per_bucket), by)
    wanted = ["precision", "recall", "f1", "accuracy", "loss", "mcc", "roc_auc", "pr_auc", "average_precision"]
    both = flat.unionByName(curves, allowMissingColumns=True)
    return both.groupBy(*by).agg(*[F.max(m).alias(m) for m in wanted])
