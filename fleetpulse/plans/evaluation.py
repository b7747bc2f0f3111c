"""Metrics, ensembles and training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import physics
from fleetpulse.operators import ensemble, history, metrics
from fleetpulse.plans.registry import query, sql_over
from fleetpulse.sources import readers, views

_LABEL = "machine_failure"


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled readings with a score, its decision and a fold."""
    scored = views.linear_score(views.labelled_readings(spark, folder))
    return scored.withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn(
        "fold", (F.col("udi") % 5).cast("int")
    )


def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Three model scores per reading: the rule flag, the linear score, a noisy label."""
    flipped = F.when(F.col("udi") % 11 == 0, 1 - F.col(_LABEL)).otherwise(F.col(_LABEL))
    return decided(spark, folder).select(
        "udi",
        "machine_id",
        "event_time",
        "fold",
        _LABEL,
        F.col("failure_risk").cast("double").alias("rule"),
        F.col("score").alias("linear"),
        flipped.cast("double").alias("tree"),
    )


MODELS = {"rule": "rule", "linear": "linear", "tree": "tree"}


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


_COUNTS = """select fold, count(*) filter (where machine_failure = 1 and pred = 1) as tp,
    count(*) filter (where machine_failure = 0 and pred = 1) as fp,
    count(*) filter (where machine_failure = 1 and pred = 0) as fn,
    count(*) filter (where machine_failure = 0 and pred = 0) as tn from decided group by fold"""


@query(
    "confusion_matrix",
    sql_over("decided", _COUNTS.replace("pred = ", "cast(round_even(score, 0) as int) = ")),
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of the probability rounded half to even."""
    rows = decided(spark, folder).withColumn("pred", physics.round_half_even(F.col("score")))
    return metrics.confusion(rows, _LABEL, "pred", ["fold"])


@query(
    "prf_accuracy",
    sql_over(
        "decided",
        f"""with c as ({_COUNTS}) select fold,
        round(coalesce(cast(tp as double) / nullif(tp + fp, 0), 0), 6) as precision,
        round(coalesce(cast(tp as double) / nullif(tp + fn, 0), 0), 6) as recall,
        round(coalesce(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
        round(cast(tp + tn as double) / (tp + fp + fn + tn), 6) as accuracy,
        round(1 - coalesce(cast(2 * tp as double) / nullif(2 * tp + fp + fn, 0), 0), 6) as loss from c""",
    ),
)
def prf_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    counts = metrics.confusion(decided(spark, folder), _LABEL, "pred", ["fold"])
    return _round(metrics.precision_recall(counts).drop("tp", "fp", "fn", "tn"))


@query(
    "mcc",
    sql_over(
        "decided",
        f"""with c as ({_COUNTS}) select fold, round(coalesce(
        (cast(tp as double) * tn - cast(fp as double) * fn)
        / nullif(sqrt(cast(tp + fp as double)) * sqrt(cast(tp + fn as double))
          * sqrt(cast(tn + fp as double)) * sqrt(cast(tn + fn as double)), 0), 0), 6) as mcc from c""",
    ),
)
def mcc(spark: SparkSession, folder: str) -> DataFrame:
    counts = metrics.confusion(decided(spark, folder), _LABEL, "pred", ["fold"])
    return _round(metrics.mcc(counts).select("fold", "mcc"))


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.score_curve(decided(spark, folder), _LABEL, "score", ["fold"])


@query(
    "roc_auc",
    sql_over(
        "running",
        """select fold, round(sum(cast(neg as double) * (2 * cum_pos - pos) / 2)
        / max(cast(all_pos as double) * all_neg), 6) as roc_auc from running group by fold""",
    ),
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.roc_auc(_curve(spark, folder), ["fold"]))


_PR = """with pr as (select fold, score, cast(pos as double) / all_pos as step,
    cast(cum_pos as double) / (cum_pos + cum_neg) as p,
    coalesce(cast(cum_pos - pos as double) / nullif(cum_pos - pos + cum_neg - neg, 0), 1) as p0
    from running)"""


@query(
    "pr_auc",
    sql_over(
        "running", _PR + " select fold, round(sum(step * (p + p0) / 2), 6) as pr_auc from pr group by fold"
    ),
)
def pr_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.pr_auc(_curve(spark, folder), ["fold"]))


@query(
    "average_precision",
    sql_over("running", _PR + " select fold, round(sum(step * p), 6) as average_precision from pr group by fold"),
)
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.average_precision(_curve(spark, folder), ["fold"]))


@query(
    "youden_threshold",
    sql_over(
        "running",
        """with j as (select fold, score,
          cast(cum_pos as double) / all_pos - cast(cum_neg as double) / all_neg as j from running)
        select fold, round(score, 6) as threshold, round(j, 6) as j from j
        qualify row_number() over (partition by fold order by j desc, score desc) = 1""",
    ),
)
def youden_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.youden(_curve(spark, folder), "score", ["fold"]))


@query(
    "log_loss",
    sql_over(
        "decided",
        """with p as (select *, least(greatest(score, cast(1e-7 as double)), 1 - cast(1e-7 as double)) as q
        from decided) select fold,
        round(avg(-case when machine_failure = 1 then ln(q) else ln(1 - q) end), 6) as log_loss,
        round(avg(case when (score > cast(0.5 as double)) = (machine_failure = 1) then 1.0 else 0.0 end), 6)
          as accuracy from p group by fold""",
    ),
)
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.log_loss(decided(spark, folder), _LABEL, "score", ["fold"]))


@query(
    "classification_report",
    sql_over(
        "decided",
        """with per as (select cls,
          (select count(*) from decided where machine_failure = cls) as support,
          (select count(*) from decided where pred = cls) as predicted,
          (select count(*) from decided where pred = cls and machine_failure = cls) as hits
          from (values (0), (1)) v(cls)),
        s as (select cast(cls as varchar) as "class", cast(hits as double) / predicted as precision,
          cast(hits as double) / support as recall, cast(2 * hits as double) / (predicted + support) as f1,
          support, hits from per),
        a as (select sum(cast(hits as double)) / sum(support) as acc from s),
        u as (select "class", precision, recall, f1, support from s
        union all select 'accuracy', acc, acc, acc, (select sum(support) from s) from a
        union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from s
        union all select 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from s)
        select "class", round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
          cast(support as bigint) as support from u""",
    ),
)
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return _round(metrics.classification_report(decided(spark, folder), _LABEL, "pred"))


_WEIGHTS = """f as (select model, coalesce(
      2.0 * count(*) filter (where score > 0.5 and machine_failure = 1)
      / nullif(2 * count(*) filter (where score > 0.5 and machine_failure = 1)
        + count(*) filter (where score > 0.5 and machine_failure = 0)
        + count(*) filter (where score <= 0.5 and machine_failure = 1), 0), 0) as f1
    from long_models group by model),
    w as (select model, f1, case when sum(f1) over () = 0 then cast(1 as double) / count(*) over ()
      else f1 / sum(f1) over () end as weight from f)"""


@query(
    "model_weights",
    sql_over(
        "long_models",
        "with "
        + _WEIGHTS
        + " select model, round(cast(f1 as double), 6) as f1, round(weight, 6) as weight from w",
    ),
)
def model_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = ensemble.long_scores(model_scores(spark, folder), ["udi", _LABEL], MODELS)
    return _round(ensemble.f1_weights(rows, _LABEL))


@query(
    "weighted_vote",
    sql_over(
        "long_models",
        "with "
        + _WEIGHTS
        + """, v as (select udi, sum(score * weight) / sum(weight) as vote_score
        from long_models join w using (model) where weight > 0 group by udi)
        select udi, round(vote_score, 6) as vote_score,
          cast(vote_score > cast(0.5 as double) as int) as vote from v""",
    ),
)
def weighted_vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = model_scores(spark, folder)
    weights = ensemble.f1_weights(ensemble.long_scores(rows, ["udi", _LABEL], MODELS), _LABEL)
    voted = ensemble.weighted_vote(rows, MODELS, ensemble.weight_map(weights))
    return _round(voted.select("udi", "vote_score", "vote"))


@query(
    "weighted_vote_long",
    sql_over(
        "long_models",
        "with "
        + _WEIGHTS
        + """, v as (select udi, sum(score * weight) / sum(weight) as vote_score
        from long_models join w using (model) where weight > 0 group by udi)
        select udi, round(vote_score, 6) as vote_score,
          cast(vote_score > cast(0.5 as double) as int) as vote from v""",
    ),
)
def weighted_vote_long(spark: SparkSession, folder: str) -> DataFrame:
    """The vote over a long score table, for models that are scored in separate jobs."""
    rows = ensemble.long_scores(model_scores(spark, folder), ["udi", _LABEL], MODELS)
    weights = ensemble.f1_weights(rows, _LABEL)
    return _round(ensemble.weighted_vote_long(rows, weights, ["udi"]))


ALERT_SQL = """with m as (select *, (rule + linear + tree) / 3 as final_score from models)
    select machine_id, udi, strftime(event_time, '%Y-%m-%d %H:%M:%S') as predicted_failure_date,
      round(final_score, 6) as risk_score from m where final_score >= cast(0.6 as double)"""


@query("ensemble_mean_alerts", sql_over("models", ALERT_SQL))
def ensemble_mean_alerts(spark: SparkSession, folder: str) -> DataFrame:
    scored = ensemble.mean_score(model_scores(spark, folder), list(MODELS))
    return _round(ensemble.alerts(scored, time="event_time"))


@query(
    "ensemble_mean",
    sql_over(
        "models",
        """select udi, round((rule + linear + tree) / 3, 6) as final_score,
        cast((rule + linear + tree) / 3 >= cast(0.5 as double) as int) as final_prediction from models""",
    ),
)
def ensemble_mean(spark: SparkSession, folder: str) -> DataFrame:
    scored = ensemble.mean_score(model_scores(spark, folder), list(MODELS))
    return _round(scored.select("udi", "final_score", "final_prediction"))


def epoch_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Histories by fold with one array entry per day of readings, as training writes them."""
    daily = (
        decided(spark, folder)
        .withColumn("day", F.dayofmonth("event_time"))
        .groupBy("fold", "day")
        .agg(
            F.avg((F.col("pred") == F.col(_LABEL)).cast("double")).alias("accuracy"),
            F.round(F.avg(F.abs(F.col("score") - F.col(_LABEL))), 9).alias("val_loss"),
        )
    )
    arrays = daily.groupBy("fold").agg(
        F.array_sort(F.collect_list(F.struct("day", "accuracy", "val_loss"))).alias("d")
    )
    return arrays.select(
        "fold",
        F.col("d.accuracy").alias("accuracy"),
        F.col("d.val_loss").alias("loss"),
        F.col("d.accuracy").alias("val_accuracy"),
        F.col("d.val_loss").alias("val_loss"),
        F.col("d.val_loss").alias("learning_rate"),
    )


_DAILY = """daily as (select fold, day(event_time) as day,
    avg(cast(pred = machine_failure as int)) as accuracy,
    round(avg(abs(score - machine_failure)), 9) as val_loss from decided group by 1, 2),
    epoch as (select *, row_number() over (partition by fold order by day) as epoch from daily)"""


@query(
    "best_epoch",
    sql_over(
        "decided",
        "with "
        + _DAILY
        + """ select fold, cast(epoch as int) as epoch, round(val_loss, 6) as val_loss,
        round(accuracy, 6) as val_accuracy from epoch
        qualify row_number() over (partition by fold order by val_loss, epoch) = 1""",
    ),
)
def best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.epochs(epoch_histories(spark, folder), "fold")
    best = history.best_epoch(rows, ["fold"]).select("fold", "epoch", "val_loss", "val_accuracy")
    return _round(best)


_F1_BY_FOLD = """f as (select model, fold, coalesce(
      2.0 * count(*) filter (where score > 0.5 and machine_failure = 1)
      / nullif(2 * count(*) filter (where score > 0.5 and machine_failure = 1)
        + count(*) filter (where score > 0.5 and machine_failure = 0)
        + count(*) filter (where score <= 0.5 and machine_failure = 1), 0), 0) as f1,
      avg(cast((score > 0.5) = (machine_failure = 1) as int)) as accuracy
    from long_models group by model, fold),
    s as (select model, count(*) as folds, avg(f1) as mean_f1, max(f1) as max_f1,
      max(f1) - min(f1) as spread_f1, avg(accuracy) as mean_accuracy, max(accuracy) as max_accuracy,
      max(accuracy) - min(accuracy) as spread_accuracy from f group by model)"""


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = ensemble.long_scores(model_scores(spark, folder), ["udi", "fold", _LABEL], MODELS)
    rows = rows.withColumn("pred", (F.col("score") > 0.5).cast("int"))
    counts = metrics.confusion(rows, _LABEL, "pred", ["model", "fold"])
    return metrics.precision_recall(counts)


@query(
    "fold_summary",
    sql_over(
        "long_models",
        "with "
        + _F1_BY_FOLD
        + " select model, folds, "
        + ", ".join(
            f"round(cast({k}_{m} as double), 6) as {k}_{m}"
            for m in ("f1", "accuracy")
            for k in ("mean", "max", "spread")
        )
        + " from s",
    ),
)
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _round(history.fold_summary(fold_metrics(spark, folder), ["model"], ["f1", "accuracy"]))


@query(
    "best_configuration",
    sql_over(
        "long_models",
        "with "
        + _F1_BY_FOLD
        + """ select model, round(cast(mean_f1 as double), 6) as mean_f1 from s
        order by mean_f1 desc, model limit 1""",
    ),
)
def best_configuration(spark: SparkSession, folder: str) -> DataFrame:
    summary = history.fold_summary(fold_metrics(spark, folder), ["model"], ["f1"])
    return _round(history.best_configuration(summary.select("model", "mean_f1"), "mean_f1", ["model"]))


@query(
    "evaluate_all",
    sql_over(
        "running",
        f"""with c as ({_COUNTS}),
        pr as (select fold, cast(pos as double) / all_pos as step,
          cast(cum_pos as double) / (cum_pos + cum_neg) as p,
          coalesce(cast(cum_pos - pos as double) / nullif(cum_pos - pos + cum_neg - neg, 0), 1) as p0,
          cast(neg as double) * (2 * cum_pos - pos) / 2 as area,
          cast(all_pos as double) * all_neg as pairs from running),
        a as (select fold, round(sum(area) / max(pairs), 6) as roc_auc,
          round(sum(step * (p + p0) / 2), 6) as pr_auc, round(sum(step * p), 6) as average_precision
          from pr group by fold)
        select c.fold, round(cast(tp as double) / (tp + fp), 6) as precision,
          round(cast(tp as double) / (tp + fn), 6) as recall,
          round(cast(2 * tp as double) / (2 * tp + fp + fn), 6) as f1,
          round(cast(tp + tn as double) / (tp + fp + fn + tn), 6) as accuracy,
          round(1 - cast(2 * tp as double) / (2 * tp + fp + fn), 6) as loss,
          round((cast(tp as double) * tn - cast(fp as double) * fn)
            / (sqrt(cast(tp + fp as double)) * sqrt(cast(tp + fn as double))
              * sqrt(cast(tn + fp as double)) * sqrt(cast(tn + fn as double))), 6) as mcc,
          roc_auc, pr_auc, average_precision from c join a on c.fold = a.fold""",
    ),
)
def evaluate_all(spark: SparkSession, folder: str) -> DataFrame:
    """The nine metrics of one model per fold."""
    return _round(metrics.evaluate(decided(spark, folder), _LABEL, "pred", "score", ["fold"]))
