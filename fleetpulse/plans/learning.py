"""Model and detector queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import physics
from fleetpulse.operators import anomaly, metrics, models, prep, windows
from fleetpulse.plans.registry import query, sql_over
from fleetpulse.schema import SEQUENCE_FEATURES, TABULAR_FEATURES
from fleetpulse.session import work_path, written
from fleetpulse.sources import views

_LABEL = "machine_failure"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return views.labelled_readings(spark, folder).select("udi", *TABULAR_FEATURES, _LABEL)


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return prep.stratified_split(_rows(spark, folder), _LABEL, "udi")


@query("feature_selection")
def feature_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Forest importances on scaled, balanced training rows, with the selected ones marked."""
    train, _ = _sets(spark, folder)
    balanced = prep.upsample_minority(train, _LABEL, "udi")
    scaled = prep.fit_standard(balanced, TABULAR_FEATURES).transform(balanced)
    kept, table = models.select_by_importance(scaled, TABULAR_FEATURES, _LABEL)
    return table.withColumn("selected", F.col("feature").isin(kept).cast("int"))


@query("random_forest_scores")
def random_forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows scored by a forest that went through the model registry."""
    train, test = _sets(spark, folder)
    weighted = prep.class_weights(train, _LABEL)
    fitted = models.random_forest(weighted, TABULAR_FEATURES, _LABEL, weight="weight")
    path = work_path(spark, "registry")
    models.save_registry({"forest": (fitted, TABULAR_FEATURES)}, path, spark)
    loaded, features = models.load_registry(spark, path)["forest"]
    if not models.check_features(loaded, features)["matches"]:
        raise ValueError("the stored model does not match its feature list")
    return models.score(loaded, test, "score").select("udi", _LABEL, "score")


@query("gbt_scores")
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _sets(spark, folder)
    fitted = models.boosted_trees(train, TABULAR_FEATURES, _LABEL)
    return models.score(fitted, test, "score").select("udi", _LABEL, "score")


@query("soft_voting")
def soft_voting(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of a forest, boosted trees and their mean probability on test rows."""
    train, test = _sets(spark, folder)
    fitted = {
        "forest": models.random_forest(train, TABULAR_FEATURES, _LABEL),
        "boosted": models.boosted_trees(train, TABULAR_FEATURES, _LABEL),
    }
    voted = models.soft_vote(fitted, test)
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("model"), F.col(c).alias("score"))
            for name, c in (("forest", "forest"), ("boosted", "boosted"), ("vote", "final_score"))
        ]
    )
    long = written(voted.select(_LABEL, F.explode(cells).alias("c")).select(_LABEL, "c.*"), "votes")
    decided = long.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.evaluate(decided, _LABEL, "pred", "score", ["model"])


@query("model_search")
def model_search(spark: SparkSession, folder: str) -> DataFrame:
    """Mean F1 of random settings over stratified folds, with the best one marked."""
    folded = prep.stratified_folds(_rows(spark, folder), _LABEL, "udi", 3)
    settings = models.random_settings(4, trees=(5, 10))
    results = models.random_search(folded, TABULAR_FEATURES, _LABEL, settings, folds=3)
    best = models.best_setting(results).select("trial", F.lit(1).alias("best"))
    return results.join(best, "trial", "left").fillna(0, ["best"])


def _windows(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    rows = views.labelled_readings(spark, folder)
    scaled = prep.fit_minmax(rows.filter("udi % 5 <> 0"), SEQUENCE_FEATURES).transform(rows)
    found = windows.sequences(scaled, SEQUENCE_FEATURES, ["machine_id"], ["event_time", "udi"])
    return found.select("udi", _LABEL, "sequence", (F.col("udi") % folds).cast("int").alias("fold"))


@query("sequence_classifier")
def sequence_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-validated window models with weighted failures, retried while they are poor."""

    def fit(train: DataFrame, config: dict):
        weighted = prep.class_weights(train, _LABEL, models.FAILURE_WEIGHTS)
        fitted = models.sequence_model(
            weighted, _LABEL, config["kind"], rate=config["rate"], size=config["size"], weight="weight"
        )
        return lambda part, name: models.sequence_score(fitted, part, name)

    rows = _windows(spark, folder, 3)
    out, _ = models.adaptive_cross_validate(
        rows, "fold", 3, _LABEL, fit, {"kind": "logistic", "rate": 0.03, "size": 32}
    )
    return out


@query("sequence_perceptron")
def sequence_perceptron(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out window scores of a small perceptron trained on oversampled windows."""
    rows = _windows(spark, folder)
    train = prep.oversample(rows.filter("fold <> 0"), _LABEL, "udi")
    fitted = models.sequence_model(train, _LABEL, "perceptron")
    return models.sequence_score(fitted, rows.filter("fold = 0"), "score").select("udi", _LABEL, "score")


@query("time_step_selection")
def time_step_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Mean F1 per foldable number of time steps of the flat feature vector."""
    rows = views.labelled_readings(spark, folder)
    features = [*SEQUENCE_FEATURES, "type_code"]
    scaled = prep.fit_minmax(rows, features).transform(rows)
    folded = prep.folds(scaled, "udi", 3)
    return models.select_time_steps(folded, features, _LABEL, "fold", 3)


@query("permutation_importance")
def permutation_importance(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _sets(spark, folder)
    fitted = models.random_forest(train, TABULAR_FEATURES, _LABEL)
    return models.permutation_importance(fitted, test, TABULAR_FEATURES, _LABEL, "udi")


_DETECTED = SEQUENCE_FEATURES


def _scaled(spark: SparkSession, folder: str, cols: list[str] = _DETECTED) -> DataFrame:
    rows = views.labelled_readings(spark, folder).select("udi", _LABEL, *cols)
    return prep.fit_standard(rows, cols).transform(rows)


@query("isolation_forest")
def isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    fitted = anomaly.isolation_forest(rows, TABULAR_FEATURES, "udi", 0.01)
    scored = fitted.score(rows, "score")
    return scored.select("udi", "score", anomaly.flagged(F.col("score")).alias("anomaly"))


# The scaled columns, and the squared distance of two rows, as plain SQL.
_STANDARD = ", ".join(
    f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as x{i}" for i, c in enumerate(_DETECTED)
)
_GAP = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(_DETECTED)))


@query(
    "lof",
    sql_over(
        "labelled",
        f"""with p as materialized (select udi, {_STANDARD} from labelled),
        near as materialized (select a.udi,
            unnest(min({{'d': sqrt({_GAP}), 'id': b.udi}}, 20)) as n
          from p a join p b on a.udi <> b.udi group by a.udi),
        kd as materialized (select udi, max(n.d) as kdist from near group by udi),
        lrd as materialized (select near.udi, 1 / (avg(greatest(kd.kdist, n.d)) + 1e-10) as lrd
          from near join kd on kd.udi = n.id group by near.udi)
        select near.udi, round(avg(o.lrd) / max(s.lrd), 5) as factor
        from near join lrd o on o.udi = n.id join lrd s on s.udi = near.udi group by near.udi""",
    ),
)
def lof(spark: SparkSession, folder: str) -> DataFrame:
    """Outlier factor of every reading among all readings (20 neighbours, all features)."""
    rows = _scaled(spark, folder)
    cells, _, factor = anomaly.local_outlier_factors(rows, _DETECTED, "udi", 20)
    found = cells.refs.select("vid", "vec").join(factor, "vid").select(F.col("vec").alias("v"), "factor")
    keyed = rows.select("udi", anomaly.vector(_DETECTED).alias("v"))
    return keyed.join(found, "v").select("udi", F.round("factor", 5).alias("factor"))


@query("lof_novelty")
def lof_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of one fold scored against the others."""
    rows = prep.folds(_scaled(spark, folder), "udi", 5)
    fitted = anomaly.local_outlier_factor(rows.filter("fold <> 0"), _DETECTED, "udi", 0.01)
    scored = fitted.score(rows.filter("fold = 0"), "udi", "score")
    return scored.select("udi", "score", anomaly.flagged(F.col("score")).alias("anomaly"))


# Rows with five or more rows within the radius, themselves included.
_CORE = f"""core as materialized (select a.* from p a join (select a.udi from p a join p b
    on {_GAP} <= cast(0.25 as double) group by a.udi having count(*) >= 5) c using (udi))"""


@query(
    "dbscan",
    sql_over(
        "labelled",
        f"""with p as materialized (select udi, {_STANDARD} from labelled), {_CORE},
        touched as (select distinct a.udi from p a join core b on {_GAP} <= cast(0.25 as double))
        select udi, cast(udi not in (select udi from touched) as int) as noise from p""",
    ),
)
def dbscan(spark: SparkSession, folder: str) -> DataFrame:
    """Noise of density clustering with radius 0.5 and five rows, on all features."""
    rows = _scaled(spark, folder)
    return anomaly.density_noise(rows, _DETECTED, "udi", 0.5, 5).select("udi", "noise")


@query(
    "dbscan_labels",
    sql_over(
        "labelled",
        f"""with p as materialized (select udi, {_STANDARD} from labelled), {_CORE},
        link as materialized (select a.udi as src, b.udi as dst from core a join core b on {_GAP} <= cast(0.25 as double)),
        reached(udi, label) using key (udi) as (
          select udi, udi from core
          union
          select l.dst, min(n.label) from reached n join link l on l.src = n.udi
            join recurring.reached o on o.udi = l.dst where n.label < o.label group by l.dst),
        border as (select a.udi, min(r.label) as label from p a anti join core using (udi)
          join core b on {_GAP} <= cast(0.25 as double) join reached r on r.udi = b.udi group by a.udi),
        placed as (select * from reached union all select * from border)
        select udi, coalesce(label, -1) as cluster, cast(label is null as int) as anomaly
        from p left join placed using (udi)""",
    ).replace("with ", "with recursive ", 1),
)
def dbscan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Density cluster of every reading over its principal components, and the flag made of it.

    All components are kept: they turn the scaled features, so distances are theirs.
    """
    rows = views.labelled_readings(spark, folder).select("udi", *_DETECTED)
    reduced, _ = prep.scale_and_reduce(rows, rows.limit(0), _DETECTED, len(_DETECTED))
    parts = vector_to_array("components")
    flat = reduced.select("udi", *[parts[i].alias(f"c{i}") for i in range(len(_DETECTED))])
    found = anomaly.dbscan_labels(flat, [f"c{i}" for i in range(len(_DETECTED))], "udi", 0.5, 5)
    return found.select("udi", "cluster", physics.cluster_anomaly(F.col("cluster")).alias("anomaly"))


@query("ocsvm")
def ocsvm(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scaled(spark, folder)
    fitted = anomaly.one_class_svm(rows, _DETECTED, 0.01)
    scored = fitted.score(rows, "score")
    return scored.select("udi", "score", anomaly.flagged(F.col("score")).alias("anomaly"))


def _draw(tag: str, sides: str) -> str:
    return f"(cast('0x' || substr(md5('42:{tag}:' || id), 1, 8) as bigint) % {sides})"


@query(
    "smote",
    sql_over(
        "labelled",
        f"""with p as materialized (select udi, machine_failure, {_STANDARD} from labelled),
        few as materialized (select *, row_number() over (order by udi) - 1 as place from p where machine_failure = 1),
        near as materialized (select a.udi, unnest(min({{'d': sqrt({_GAP}), 'id': b.udi}}, 5)) as n
          from few a join few b on a.udi <> b.udi group by a.udi),
        edge as (select udi, list(n.id order by n.d, n.id) as ids from near group by udi),
        size as (select count(*) filter (where machine_failure = 1) as n1, count(*) filter (where machine_failure = 0) as n0 from p),
        draws as (select {_draw("place", "n1")} as place, {_draw("turn", "1048576")} as turn,
            cast({_draw("step", "1073741824")} as double) / 1073741824 as u
          from (select unnest(range(n0 - n1)) as id, n1 from size))
        select machine_failure, 0 as synthetic, {", ".join(f"round(x{i}, 5) as {c}" for i, c in enumerate(_DETECTED))} from p
        union all select 1, 1, {", ".join(f"round(a.x{i} + u * (b.x{i} - a.x{i}), 5)" for i in range(len(_DETECTED)))}
        from draws join few a using (place) join edge on edge.udi = a.udi join few b on b.udi = ids[turn % len(ids) + 1]""",
    ),
)
def smote(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled readings and new failure rows, each between a failure and one of its five nearest."""
    made = anomaly.smote(_scaled(spark, folder), _DETECTED, _LABEL, "udi")
    return made.select(_LABEL, "synthetic", *[F.round(c, 5).alias(c) for c in _DETECTED])


@query("anomaly_cross_validation")
def anomaly_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Training history of three detectors and their vote over two folds, on all features.

    Smaller than the library's settings: five detectors on 14 components over three
    folds did not end in four minutes on 1,000 rows.
    """
    rows = views.labelled_readings(spark, folder)
    settings = models.AnomalySettings(
        trees=20, components=3, forest_depth=6, detectors=("IsolationForest", "RandomForest", "DBSCAN")
    )
    return models.anomaly_cross_validate(rows, SEQUENCE_FEATURES, _LABEL, "udi", 2, settings)
