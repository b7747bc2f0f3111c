"""Supervised models on MLlib: fitting, scoring, search, cross-validation, registry."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetpulse.functions import arrays
from fleetpulse.operators import anomaly, ensemble, history, metrics, prep
from fleetpulse.operators.ordering import add_ordinal
from fleetpulse.schema import HISTORY
from fleetpulse.session import written

# Ensemble settings and search ranges.
FOREST = {"numTrees": 100, "maxDepth": 10}
BOOSTED = {"maxIter": 100, "maxDepth": 10, "stepSize": 0.1}
SEARCH_TREES = (100, 500)
SEARCH_DEPTH = (3, 20)
SEARCH_RATE = (0.01, 0.3)
MOST_DEPTH = 30
IMPORTANCE_CUT = 0.01
MIN_AUC, MAX_SPREAD = 0.7, 0.1
FAILURE_WEIGHTS = {0: 1.0, 1: 3.0}


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def spread(train: DataFrame) -> DataFrame:
    """Training rows over all shuffle partitions: learners make many passes over them.

    Rows that come out of a per-class step would otherwise sit in a few tasks.
    """
    return train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def random_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = FOREST["numTrees"],
    depth: int = FOREST["maxDepth"],
    weight: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    if depth > MOST_DEPTH:
        raise ValueError(f"MLlib trees have at most {MOST_DEPTH} levels, not {depth}")
    forest = RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    used = train.select(*features, label, *([weight] if weight else []))
    return Pipeline(stages=[_assembler(features), forest]).fit(spread(used))


def boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    rounds: int = BOOSTED["maxIter"],
    depth: int = BOOSTED["maxDepth"],
    rate: float = BOOSTED["stepSize"],
    weight: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    if weight:
        trees = trees.setWeightCol(weight)
    used = train.select(*features, label, *([weight] if weight else []))
    return Pipeline(stages=[_assembler(features), trees]).fit(spread(used))


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add the failure probability of one model as ``name``."""
    used = ["features", "rawPrediction", "probability", "prediction"]
    kept = [c for c in df.columns if c not in used]
    out = model.transform(df)
    return out.select(*kept, vector_to_array("probability")[1].alias(name))


def soft_vote(models: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Probability of every model, their mean and its decision; one projection after the other."""
    for name, model in models.items():
        df = score(model, df, name)
    return ensemble.mean_score(df, list(models))


def importances(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """``(feature, importance)``, most important first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def select_by_importance(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    cut: float = IMPORTANCE_CUT,
    trees: int = 100,
    seed: int = 42,
) -> tuple[list[str], DataFrame]:
    """Features whose forest importance reaches ``cut``, and the importance table."""
    model = random_forest(train, features, label, trees=trees, seed=seed)
    values = model.stages[-1].featureImportances.toArray()
    kept = [f for f, v in zip(features, values) if v >= cut]
    return kept, importances(model, features, train.sparkSession)


def random_settings(trials: int, seed: int = 42, trees: tuple[int, int] = SEARCH_TREES) -> list[dict]:
    """Repeatable random settings of forests and boosted trees."""
    rng = random.Random(seed)
    out = []
    for trial in range(trials):
        setting = {
            "trial": trial,
            "model": rng.choice(["random_forest", "boosted_trees"]),
            "trees": rng.randint(*trees),
            "depth": rng.randint(*SEARCH_DEPTH),
            "rate": rng.uniform(*SEARCH_RATE),
        }
        out.append(setting)
    return out


def random_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    settings: Sequence[dict],
    folds: int = 5,
    fold_col: str = "fold",
    parallelism: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Mean F1 over given folds for each setting: ``trial, model, trees, depth, rate, mean_f1``."""
    rows = _assembler(features).transform(spread(df)).select("features", label, fold_col)
    scored = []
    for kind in ("random_forest", "boosted_trees"):
        chosen = [s for s in settings if s["model"] == kind]
        if not chosen:
            continue
        if kind == "random_forest":
            learner = RandomForestClassifier(labelCol=label, featureSubsetStrategy="sqrt", seed=seed)
            maps = [{learner.numTrees: s["trees"], learner.maxDepth: s["depth"]} for s in chosen]
        else:
            learner = GBTClassifier(labelCol=label, seed=seed)
            maps = [
                {learner.maxIter: s["trees"], learner.maxDepth: s["depth"], learner.stepSize: s["rate"]}
                for s in chosen
            ]
        f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
        fitted = CrossValidator(
            estimator=learner,
            estimatorParamMaps=maps,
            evaluator=f1,
            numFolds=folds,
            foldCol=fold_col,
            parallelism=parallelism,
            seed=seed,
        ).fit(rows)
        scored += [
            (s["trial"], s["model"], s["trees"], s["depth"], float(s["rate"]), float(v))
            for s, v in zip(chosen, fitted.avgMetrics)
        ]
    return df.sparkSession.createDataFrame(
        scored, "trial int, model string, trees int, depth int, rate double, mean_f1 double"
    )


#: A rung of a halving search: trial, the rung, trees grown in it, mean F1.
RUNGS = "trial int, rung int, grown int, mean_f1 double"


def halving_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    settings: Sequence[dict],
    path: str,
    folds: int = 5,
    fold_col: str = "fold",
    factor: int = 3,
    rungs: int = 3,
    parallelism: int = 4,
    seed: int = 42,
) -> DataFrame:
    """Successive halving over random settings: ``trial, model, trees, depth, rate, rung, grown, mean_f1``.

    In the first rung every setting grows one in ``factor ** (rungs - 1)`` of its trees (at least one); of each
    rung the best one in ``factor`` (at least one; ties: smaller trial) goes on with ``factor`` times the trees, in
    the last rung with all of them. Finished trials are appended to the table at ``path`` and not fitted again, so
    a search that was stopped goes on from there. The table must belong to the same data and settings. One row
    per setting, of the last rung it reached; the winner is the best one of the last rung. The rows are made once
    for all trials.
    """
    spark = df.sparkSession
    rows = written(spread(df.select(*features, label, fold_col)), "search-rows")
    places = {s["trial"]: s for s in settings}

    def finished() -> DataFrame:
        try:
            return spark.read.schema(RUNGS).parquet(path).groupBy("trial", "rung").agg(
                F.max("grown").alias("grown"), F.max("mean_f1").alias("mean_f1")
            )
        except AnalysisException:
            return spark.createDataFrame([], RUNGS)

    active = sorted(places)
    for rung in range(rungs):
        # at most one row for each trial of the search
        known = {r["trial"]: r["mean_f1"] for r in finished().filter(F.col("rung") == rung).collect()}
        share = factor ** (rungs - 1 - rung)
        for trial in [t for t in active if t not in known]:
            grown = max(1, places[trial]["trees"] // share)
            setting = {**places[trial], "trees": grown}
            value = random_search(rows, features, label, [setting], folds, fold_col, parallelism, seed).first()["mean_f1"]
            spark.createDataFrame([(trial, rung, grown, value)], RUNGS).coalesce(1).write.mode("append").parquet(path)
            known[trial] = value
        ranked = sorted(active, key=lambda t: (-known[t], t))
        active = sorted(ranked[: max(1, len(active) // factor)])
    reached = finished().filter(F.col("trial").isin(list(places))).groupBy("trial").agg(
        F.max(F.struct("rung", "grown", "mean_f1")).alias("last")
    )
    listed = spark.createDataFrame(
        [(s["trial"], s["model"], s["trees"], s["depth"], float(s["rate"])) for s in settings],
        "trial int, model string, trees int, depth int, rate double",
    )
    return listed.join(reached, "trial").select(*listed.columns, "last.rung", "last.grown", "last.mean_f1")


def best_setting(results: DataFrame) -> DataFrame:
    return history.best_configuration(results, "mean_f1", ["trial"])


# Sequence models


def sequence_model(
    train: DataFrame,
    label: str,
    kind: str = "logistic",
    sequence: str = "sequence",
    width: int = 70,
    rounds: int = 50,
    rate: float = 0.03,
    size: int = 32,
    weight: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Classifier over flattened windows: ``logistic``, ``boosted`` or ``perceptron``.

    Only the first two take row weights; give the perceptron resampled rows.
    ``rate`` is the step size of boosting and sets the logistic model's penalty;
    ``size`` is the perceptron's hidden layer and sets the depth of boosted trees.
    """
    rows = train.select(
        arrays.flat_vector(F.col(sequence)).alias("features"), label, *([weight] if weight else [])
    )
    if kind == "perceptron":
        learner = MultilayerPerceptronClassifier(
            labelCol=label, layers=[width, size, 2], maxIter=rounds, seed=seed
        )
    elif kind == "boosted":
        depth = max(1, size.bit_length() - 1)  # 32 leaves are five levels
        learner = GBTClassifier(labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed)
    else:
        learner = LogisticRegression(labelCol=label, maxIter=rounds, regParam=rate / 300)
    if weight and kind != "perceptron":
        learner = learner.setWeightCol(weight)
    return Pipeline(stages=[learner]).fit(rows)


def sequence_score(
    model: PipelineModel, df: DataFrame, name: str, sequence: str = "sequence", width: int = 70
) -> DataFrame:
    """Add a window model's probability; NULL where the window is short or has gaps."""
    usable = F.coalesce(arrays.complete(F.col(sequence)) & (F.size(F.flatten(sequence)) == width), F.lit(False))
    flat = F.when(usable, F.flatten(sequence)).otherwise(F.array_repeat(F.lit(0.0), width))
    rows = df.withColumn("features", array_to_vector(flat)).withColumn("__usable", usable)
    scored = score(model, rows, "__p")
    return scored.withColumn(name, F.when(F.col("__usable"), F.col("__p"))).drop("__p", "__usable")


Fit = Callable[[DataFrame, dict], Callable[[DataFrame, str], DataFrame]]


def cross_validated_auc(df: DataFrame, fold_col: str, folds: int, label: str, fit: Fit, config: dict) -> DataFrame:
    """Fit on all other folds, score each fold, and evaluate all folds in one job."""
    scored = None
    for fold in range(folds):
        apply = fit(df.filter(F.col(fold_col) != fold), config)
        part = apply(df.filter(F.col(fold_col) == fold), "score").select(fold_col, label, "score")
        scored = part if scored is None else scored.unionByName(part)
    # Evaluation makes several passes, so the models score every row once.
    scored = written(scored, "fold-scores")
    decided = scored.withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return metrics.evaluate(decided, label, "pred", "score", [fold_col])


def adaptive_cross_validate(
    df: DataFrame,
    fold_col: str,
    folds: int,
    label: str,
    fit: Fit,
    config: dict,
    max_rounds: int = 3,
) -> tuple[DataFrame, dict]:
    """Cross-validate, and retry with a slower, larger model while results are poor.

    Poor means a mean AUC below 0.7 or a spread above 0.1. Returns one row per
    round and fold, and the last settings. The number of rounds is bounded.
    """
    config, out = dict(config), None
    # Every fold of every round reads the rows, so they are computed once.
    df = written(df, "fold-rows")
    for attempt in range(max_rounds):
        result = written(cross_validated_auc(df, fold_col, folds, label, fit, config), "folds")
        line = result.select(F.lit(attempt).alias("round"), "*")
        out = line if out is None else out.unionByName(line)
        row = result.agg(
            F.avg("roc_auc").alias("mean"), (F.max("roc_auc") - F.min("roc_auc")).alias("spread")
        ).first()
        if row["mean"] >= MIN_AUC and row["spread"] <= MAX_SPREAD:
            break
        # How a retry changes the settings.
        config["rate"] = config.get("rate", 0.03) * 0.5
        config["size"] = config.get("size", 32) + 32
    return out, config


def step_view(features: Column, width: int, steps: int) -> tuple[Column, int]:
    """The whole folded vector and the change from each time step to the next, as one array; and its length."""
    rows = arrays.fold_steps(features, width, steps)
    per_step = width // steps
    changes = F.transform(
        F.sequence(F.lit(2), F.lit(steps)),
        lambda i: F.zip_with(F.element_at(rows, i), F.element_at(rows, i - 1), lambda a, b: a - b),
    )
    return F.concat(F.flatten(rows), F.flatten(changes)) if steps > 1 else F.flatten(rows), width + (steps - 1) * per_step


def select_time_steps(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold_col: str,
    folds: int,
    steps: Sequence[int] = arrays.TIME_STEPS,
    rounds: int = 50,
) -> DataFrame:
    """Mean cross-validated F1 for every foldable number of time steps; ``best`` marks the one to take (ties: fewer steps)."""
    flat = F.array(*[F.col(c).cast("double") for c in features])
    width, out = len(features), None
    df = written(df.select(fold_col, label, flat.alias("__flat")), "fold-rows")
    flat = F.col("__flat")
    for t in arrays.foldable_steps(width, tuple(steps)):
        view, size = step_view(flat, width, t)
        rows = df.select(fold_col, label, F.array(view).alias("sequence"))

        def fit(train: DataFrame, config: dict, size: int = size):
            model = sequence_model(train, label, width=size, rounds=rounds)
            return lambda part, name: sequence_score(model, part, name, width=size)

        result = cross_validated_auc(rows, fold_col, folds, label, fit, {})
        line = result.agg(F.avg("f1").alias("mean_f1")).select(F.lit(t).alias("steps"), "mean_f1")
        out = line if out is None else out.unionByName(line)
    # one row per number of steps
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mean_f1"), "steps")
    return written(out, "step-scores").withColumn("best", (F.row_number().over(first) == 1).cast("int"))


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    seed: int = 42,
) -> DataFrame:
    """Loss of ROC-AUC when one feature is replaced by another row's value.

    Every row gets one donor row (its neighbour in hash order), so a single join
    serves all features; the variants are scored and evaluated together.
    """
    rows = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    total = rows.count()
    mixed = rows.withColumn("__h", prep.hash_order(key, seed))
    numbered = add_ordinal(mixed, ["__h", key], name="__at")
    donor = numbered.select(
        F.pmod(F.col("__at") + 1, F.lit(total)).alias("__at"),
        *[F.col(c).alias(f"__donor_{c}") for c in features],
    )
    joined = numbered.join(donor, "__at")
    variants = [
        F.struct(F.lit(v).alias("variant"), *[F.col(f"__donor_{c}" if c == v else c).alias(c) for c in features])
        for v in ["", *features]
    ]
    long = joined.select(label, F.explode(F.array(*variants)).alias("v")).select(label, "v.*")
    scored = written(score(model, long, "score").select("variant", label, "score"), "variant-scores")
    curve = metrics.score_curve(scored, label, "score", ["variant"])
    auc = metrics.roc_auc(curve, ["variant"])
    # One row per feature from here on.
    base = F.max(F.when(F.col("variant") == "", F.col("roc_auc"))).over(Window.partitionBy(F.lit(0)))
    return (
        auc.select(F.col("variant").alias("feature"), (base - F.col("roc_auc")).alias("importance"))
        .filter("feature <> ''")
        .orderBy(F.desc("importance"), "feature")
    )


# Anomaly ensemble with cross-validation


@dataclass(frozen=True)
class AnomalySettings:
    contamination: float = 0.01
    trees: int = 100
    neighbors: int = 20
    components: int = 20
    forest_depth: int = 30
    eps: float = 0.5
    min_points: int = 5
    cut: float = 0.0
    detectors: tuple[str, ...] = ("IsolationForest", "LOF", "OneClassSVM", "RandomForest", "DBSCAN")


def anomaly_fold(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    settings: AnomalySettings = AnomalySettings(),
    seed: int = 42,
) -> DataFrame:
    """Fit all detectors on one fold; ``(part, key, label, model, score, pred)`` incl. the vote."""
    train_r, validation_r = prep.scale_and_reduce(train, validation, features, settings.components)
    k = min(settings.components, len(features))
    cols = [f"c{i}" for i in range(k)]

    def flat(df: DataFrame) -> DataFrame:
        parts = vector_to_array("components")
        return written(
            df.select(key, F.col(label).cast("int").alias(label), *[parts[i].alias(c) for i, c in enumerate(cols)]),
            "fold",
        )

    sets = {"train": flat(train_r), "validation": flat(validation_r)}
    fit_rows = sets["train"]
    appliers: dict[str, Callable[[DataFrame], DataFrame]] = {}
    if "IsolationForest" in settings.detectors:
        forest = anomaly.isolation_forest(fit_rows, cols, key, settings.contamination, settings.trees, seed)
        appliers["IsolationForest"] = lambda df: forest.score(df, "score")
    if "LOF" in settings.detectors:
        lof = anomaly.local_outlier_factor(fit_rows, cols, key, settings.contamination, settings.neighbors)
        appliers["LOF"] = lambda df: lof.score(df, key, "score")
    if "OneClassSVM" in settings.detectors:
        svm = anomaly.one_class_svm(fit_rows, cols, settings.contamination, seed=seed)
        appliers["OneClassSVM"] = lambda df: svm.score(df, "score")
    if "RandomForest" in settings.detectors:
        grown = prep.class_weights(anomaly.smote(fit_rows, cols, label, key, seed=seed), label)
        trees = random_forest(
            grown, cols, label, settings.trees, settings.forest_depth, "weight", seed
        )
        appliers["RandomForest"] = lambda df: score(trees, df, "score")
    if "DBSCAN" in settings.detectors:
        appliers["DBSCAN"] = lambda df: anomaly.density_noise(
            df, cols, key, settings.eps, settings.min_points, "score"
        )

    long = None
    for part, rows in sets.items():
        for name, apply in appliers.items():
            cut = settings.cut if name in ("IsolationForest", "LOF", "OneClassSVM") else 0.5
            # With the strict cut density noise decides, but is ranked by a constant score.
            constant = name == "DBSCAN" and settings.cut == 0.5
            got = apply(rows).select(
                F.lit(part).alias("part"),
                key,
                label,
                F.lit(name).alias("model"),
                (F.lit(0.0) if constant else F.col("score").cast("double")).alias("score"),
                F.coalesce(F.col("score") > cut, F.lit(False)).cast("int").alias("pred"),
            )
            long = got if long is None else long.unionByName(got)
    long = written(long, "fold-scores")

    # Weights come from validation F1 of the scoring models; density noise has no score to vote with.
    voters = long.filter(F.col("model") != "DBSCAN")
    weights = ensemble.f1_weights(
        voters.filter("part = 'validation'").withColumn("score", F.col("pred").cast("double")), label
    )
    vote = ensemble.weighted_vote_long(
        voters.withColumn("score", F.col("pred").cast("double"))
        if settings.cut != 0.5
        else voters,
        weights,
        ["part", key, label],
    ).select(
        "part",
        key,
        label,
        F.lit("Ensemble").alias("model"),
        F.col("vote").cast("double").alias("score"),
        F.col("vote").alias("pred"),
    )
    return long.unionByName(vote)


def anomaly_cross_validate(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    folds: int = 3,
    settings: AnomalySettings = AnomalySettings(),
    seed: int = 42,
) -> DataFrame:
    """History table: one row per fold and model with training and validation metrics."""
    rows = df.select(key, label, *features)
    folded = written(prep.stratified_folds(rows, label, key, folds, seed), "fold-rows")
    out = None
    for fold in range(folds):
        scored = anomaly_fold(
            folded.filter(F.col("fold") != fold).drop("fold"),
            folded.filter(F.col("fold") == fold).drop("fold"),
            features,
            label,
            key,
            settings,
            seed,
        )
        got = metrics.evaluate(scored, label, "pred", "score", ["part", "model"])
        val, fit = got.filter("part = 'validation'"), got.filter("part = 'train'")
        line = val.join(
            fit.select("model", F.col("accuracy").alias("train_accuracy"), F.col("loss").alias("train_loss")),
            "model",
        ).select(
            F.lit(fold + 1).alias("fold"),
            F.col("roc_auc").alias("auc"),
            "average_precision",
            "precision",
            "recall",
            F.col("f1").alias("f1_score"),
            "accuracy",
            "loss",
            F.col("train_accuracy").alias("training_accuracy"),
            F.col("accuracy").alias("validation_accuracy"),
            F.col("train_loss").alias("training_loss"),
            F.col("loss").alias("validation_loss"),
            F.col("mcc").alias("matthews_corrcoef"),
            "pr_auc",
            F.lit(settings.contamination).alias("contamination_level"),
            F.col("model").alias("model_name"),
        )
        out = line if out is None else out.unionByName(line)
    return out.select(*HISTORY.fieldNames())


# Registry


def save_registry(models: Mapping[str, tuple[PipelineModel, Sequence[str]]], path: str, spark: SparkSession) -> None:
    """Save fitted models below ``path`` with a table of names and feature lists."""
    for name, (model, _) in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    rows = [(name, list(features)) for name, (_, features) in models.items()]
    spark.createDataFrame(rows, "name string, features array<string>").write.mode("overwrite").parquet(
        f"{path}/registry"
    )


def load_registry(spark: SparkSession, path: str) -> dict[str, tuple[PipelineModel, list[str]]]:
    """All models of a registry by name, with their feature lists."""
    rows = spark.read.parquet(f"{path}/registry").orderBy("name").collect()
    return {r["name"]: (PipelineModel.load(f"{path}/models/{r['name']}"), list(r["features"])) for r in rows}


def check_features(model: PipelineModel, features: Sequence[str]) -> dict:
    """Number of features a model was trained on against a feature list."""
    trained = int(model.stages[-1].numFeatures)
    named = [list(s.getInputCols()) for s in model.stages if isinstance(s, VectorAssembler)]
    names = named[0] if named else None
    return {
        "trained": trained,
        "listed": len(features),
        "matches": trained == len(features) and (names is None or names == list(features)),
    }
