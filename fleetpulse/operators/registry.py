"""Versioned registry: models with the scaler and the feature list they were fitted with.

A version is one folder with a manifest table (one row an artefact) and the
stored models, published by one rename. What reads a version therefore never
sees a model beside the scaler of another.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import models, prep
from fleetpulse.sources import snapshots

TABULAR, SEQUENCE = "tabular", "sequence"
_MANIFEST = (
    "name string, kind string, features array<string>, selected array<string>, "
    "center map<string, double>, scale map<string, double>"
)


@dataclass(frozen=True)
class Artefact:
    """A fitted model and what its input must go through.

    ``features``: columns as they arrive, in the model's order. ``selected``: those the model reads
    (all if empty). ``scaler`` is applied before; a sequence model has its windows scaled entry by entry.
    """

    model: PipelineModel
    features: tuple[str, ...]
    kind: str = TABULAR
    scaler: prep.Scaler | None = None
    selected: tuple[str, ...] = field(default=())

    @property
    def used(self) -> list[str]:
        return list(self.selected or self.features)


def publish(spark: SparkSession, root: str, artefacts: Mapping[str, Artefact]) -> int:
    """Store artefacts as the next version; a model that does not match its feature list is an error."""
    for name, a in artefacts.items():
        if a.kind == TABULAR and not models.check_features(a.model, a.used)["matches"]:
            raise ValueError(f"{name} was not fitted on its feature list")

    def write(staged: str) -> None:
        rows = []
        for name, a in sorted(artefacts.items()):
            a.model.write().save(f"{staged}/models/{name}")
            scaler = (a.scaler.center, a.scaler.scale) if a.scaler else (None, None)
            rows.append((name, a.kind, list(a.features), list(a.selected), *scaler))
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{staged}/manifest")

    return snapshots.publish(spark, root, write)


def load(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Artefact]:
    """All artefacts of a version (the last one by default) by name."""
    version = snapshots.latest(spark, root) if version is None else version
    path = snapshots.location(root, version)
    out = {}
    for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("name").collect():
        scaler = prep.Scaler(dict(r["center"]), dict(r["scale"])) if r["center"] is not None else None
        model = PipelineModel.load(f"{path}/models/{r['name']}")
        out[r["name"]] = Artefact(model, tuple(r["features"]), r["kind"], scaler, tuple(r["selected"]))
    return out


Scorer = Callable[[DataFrame], DataFrame]


def scorer(artefact: Artefact, name: str) -> Scorer:
    """Adds the model's vote as ``name``: the class of a reading, or the probability of a window.

    A reading or window with a gap has no vote. The input columns stay as they are.
    """
    if artefact.kind == SEQUENCE:

        def windowed(df: DataFrame) -> DataFrame:
            kept = df.columns
            scaled = df
            if artefact.scaler is not None:
                low = F.array(*[F.lit(artefact.scaler.center[c]) for c in artefact.features])
                span = F.array(*[F.lit(artefact.scaler.scale[c]) for c in artefact.features])
                steps = F.transform(
                    "sequence",
                    lambda v: F.transform(v, lambda x, i: (x - F.get(low, i)) / F.get(span, i)),
                )
                scaled = df.withColumn("__raw", F.col("sequence")).withColumn("sequence", steps)
            out = models.sequence_score(artefact.model, scaled, "__vote")
            sequence = F.col("__raw") if artefact.scaler is not None else F.col("sequence")
            rest = [sequence.alias(c) if c == "sequence" else F.col(c) for c in kept]
            return out.select(*rest, F.col("__vote").alias(name))

        return windowed

    def single(df: DataFrame) -> DataFrame:
        kept = df.columns
        # the raw row travels as one struct, so that scaling and filling cannot touch it
        rows = df.select(F.struct(*kept).alias("__row"), *[F.col(c).cast("double").alias(c) for c in artefact.features])
        whole = F.lit(True)
        for c in artefact.features:
            whole = whole & F.col(c).isNotNull()
        rows = rows.withColumn("__whole", whole)
        scaled = artefact.scaler.transform(rows) if artefact.scaler else rows
        filled = scaled.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in artefact.used})
        out = models.score(artefact.model, filled, "__p")
        return out.select("__row.*", F.when(F.col("__whole"), (F.col("__p") > 0.5).cast("double")).alias(name))

    return single


class Current:
    """Scorers of the last published version, loaded anew only when there is a newer one.

    Called with a session by the stream before each micro-batch.
    """

    def __init__(self, root: str):
        self.root = root
        self.version: int | None = None
        self.scorers: dict[str, Scorer] = {}

    def __call__(self, spark: SparkSession) -> tuple[dict[str, Scorer], int]:
        newest = snapshots.latest(spark, self.root)
        if newest != self.version:
            self.scorers = {name: scorer(a, name) for name, a in load(spark, self.root, newest).items()}
            self.version = newest
        return self.scorers, newest
