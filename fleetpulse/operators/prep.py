"""Training-set preparation: scaling, splits, folds, resampling, reduction.

All randomness is a hash of the row key, so a task that runs again produces the
same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.ordering import add_ordinal


@dataclass(frozen=True)
class Scaler:
    """Per-column ``(x - center) / scale``; a constant column keeps scale 1."""

    center: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scale in place, or into ``<prefix><c>`` columns."""
        return df.withColumns(
            {
                prefix + c: (F.col(c).cast("double") - F.lit(self.center[c]))
                / F.lit(self.scale[c])
                for c in self.center
            }
        )


def _one_row(df: DataFrame, cols: Sequence[str], functions: dict) -> dict[str, dict[str, float]]:
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    row = df.agg(*[f(v).alias(f"{c}__{m}") for c, v in clean.items() for m, f in functions.items()])
    got = row.first()
    return {m: {c: got[f"{c}__{m}"] for c in cols} for m in functions}


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Zero mean and unit population deviation."""
    got = _one_row(df, cols, {"mean": F.avg, "std": F.stddev_pop})
    return Scaler(
        {c: m or 0.0 for c, m in got["mean"].items()}, {c: s or 1.0 for c, s in got["std"].items()}
    )


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """Smallest value to 0, largest to 1; a constant column becomes 0."""
    got = _one_row(df, cols, {"low": F.min, "high": F.max})
    low = {c: v if v is not None else 0.0 for c, v in got["low"].items()}
    span = {c: (got["high"][c] or 0.0) - (got["low"][c] or 0.0) for c in cols}
    return Scaler(low, {c: s or 1.0 for c, s in span.items()})


def varying_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with more than one value."""
    got = _one_row(df, cols, {"low": F.min, "high": F.max})
    return [c for c in cols if got["low"][c] != got["high"][c]]


def variance_filter(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the constant columns among ``cols``."""
    keep = set(varying_columns(df, cols))
    return df.drop(*[c for c in cols if c not in keep])


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="error").transform(df)


def scale_and_reduce(
    train: DataFrame, validation: DataFrame, cols: Sequence[str], k: int = 20, output: str = "components"
) -> tuple[DataFrame, DataFrame]:
    """Standard scaling then PCA, both fitted on the training rows only."""
    scaler = fit_standard(train, cols)
    train_v = assemble(scaler.transform(train), cols, "__scaled")
    validation_v = assemble(scaler.transform(validation), cols, "__scaled")
    pca = PCA(k=min(k, len(cols)), inputCol="__scaled", outputCol=output).fit(train_v)
    return pca.transform(train_v).drop("__scaled"), pca.transform(validation_v).drop("__scaled")


def hash_order(key: str, seed: int = 42) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Repeatable random order: the ordering column ``shuffle_key`` (sort by it if order shows)."""
    return df.withColumn("shuffle_key", hash_order(key, seed))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled folds of near-equal size; no shuffle, the fold is a hash of the key."""
    return df.withColumn("fold", F.pmod(hash_order(key, seed), F.lit(k)).cast("int"))


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    seed: int | None = 42,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Folds with equal class shares: position inside the class modulo ``k``.

    Rows are taken in hash order (``seed``), in key order (``seed=None``) or in
    a given order.
    """
    if order is None and seed is not None:
        df, order = df.withColumn("__order", hash_order(key, seed)), ["__order", key]
    numbered = add_ordinal(df, order or [key], by=[label], name="__place")
    return numbered.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place", "__order")


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same class shares, in hash order inside each class."""
    limit = F.lit(0)
    for value, n in class_counts(df, label).items():
        limit = F.when(F.col(label) == value, F.lit(round(test_share * n))).otherwise(limit)
    mixed = df.withColumn("__order", hash_order(key, seed))
    numbered = add_ordinal(mixed, ["__order", key], by=[label], name="__place")
    test = F.col("__place") < limit
    return tuple(numbered.filter(t).drop("__place", "__order") for t in (~test, test))


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; classes are few, so this is a small result."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[label]: r["n"] for r in rows}


def draw_with_replacement(df: DataFrame, key: str, available: int, draws: int, seed: int = 42) -> DataFrame:
    """Exactly ``draws`` rows of ``df``, chosen evenly with replacement.

    Rows are numbered and joined with drawn numbers. Draws are first counted per
    number, so a row drawn often is shuffled once.
    """
    numbered = add_ordinal(df, key, name="__place")
    drawn = (
        df.sparkSession.range(draws)
        .select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(available)).cast("bigint").alias("__place"))
        .groupBy("__place")
        .agg(F.count(F.lit(1)).cast("int").alias("__times"))
    )
    return (
        numbered.join(drawn, "__place")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*df.columns)
    )


def upsample_minority(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Replace every smaller class by a bootstrap of the largest class's size."""
    counts = class_counts(df, label)
    top = max(counts.values(), default=0)
    parts = [df.filter(F.col(label).isin([c for c, n in counts.items() if n == top]))]
    for value, n in sorted(counts.items()):
        if n < top:
            parts.append(draw_with_replacement(df.filter(F.col(label) == value), key, n, top, seed))
    return _union(parts)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Keep every row and add drawn copies until all classes have the largest class's size."""
    counts = class_counts(df, label)
    top = max(counts.values(), default=0)
    parts = [df]
    for value, n in sorted(counts.items()):
        if n < top:
            parts.append(
                draw_with_replacement(df.filter(F.col(label) == value), key, n, top - n, seed)
            )
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_weights(
    df: DataFrame, label: str, weights: dict[int, float] | str = "balanced", name: str = "weight"
) -> DataFrame:
    """Row weights per class: given ones, or ``n / (classes * n_class)``."""
    if weights == "balanced":
        counts = class_counts(df, label)
        total = sum(counts.values())
        weights = {c: total / (len(counts) * n) for c, n in counts.items()}
    case = F.lit(1.0)
    for value, weight in weights.items():
        case = F.when(F.col(label) == value, F.lit(float(weight))).otherwise(case)
    return df.withColumn(name, case)
