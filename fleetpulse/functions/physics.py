"""Sensor features, failure conditions and failure labels as column expressions.

Every function is ``DataFrame -> DataFrame`` and only adds projections, so a
chain of them collapses into one whole-stage-codegen projection over the scan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.schema import CONDITIONS, SENSORS

# Product type codes, overstrain limits and wear increments.
TYPE_CODES = {"H": 0, "L": 1, "M": 2}
OVERSTRAIN_LIMITS = {"L": 11000, "M": 12000, "H": 13000}
WEAR_INCREMENTS = {"L": 2, "M": 3, "H": 5}
# Failure condition limits.
WEAR_RANGE = (200.0, 240.0)
HEAT_MAX_DIFF = 8.6
HEAT_MAX_RPM = 1380.0
POWER_RANGE = (3500.0, 9000.0)
# Share of worn tools that fail, share of random failures.
WEAR_FAILURE_SHARE = 0.57
RANDOM_FAILURE_SHARE = 0.001
RAD_PER_SECOND = 2 * math.pi / 60


def lookup(key: Column, mapping: Mapping[str, int]) -> Column:
    """Dictionary lookup; NULL for an unknown key."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def type_code(kind: Column) -> Column:
    return lookup(kind, TYPE_CODES)


def encode_type(df: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Add ``type_code``; readings with an unknown type are dropped by default."""
    coded = df.withColumn("type_code", type_code(F.col("type")))
    return coded.filter(F.col("type_code").isNotNull()) if drop_unknown else coded


def nan_to_null(df: DataFrame, cols: Sequence[str] = SENSORS) -> DataFrame:
    """Make NaN and NULL one thing, so that comparisons treat both as unknown."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def flag(condition: Column) -> Column:
    """0/1 flag that is 0 when the condition cannot be decided."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def add_threshold(df: DataFrame) -> DataFrame:
    return df.withColumn("osf_threshold", lookup(F.col("type"), OVERSTRAIN_LIMITS))


def add_physics(df: DataFrame) -> DataFrame:
    """Temperature difference, angular speed, power and wear x torque."""
    speed = F.col("rotational_speed_rpm") * F.lit(RAD_PER_SECOND)
    return df.withColumns(
        {
            "temp_diff": F.col("process_temp_k") - F.col("air_temp_k"),
            "rotational_speed_rad_s": speed,
            "power": F.col("torque_nm") * speed,
            "tool_torque_product": F.col("tool_wear_min") * F.col("torque_nm"),
        }
    )


def add_conditions(df: DataFrame) -> DataFrame:
    """The four failure conditions and their union."""
    conditions = {
        "twf_condition": F.col("tool_wear_min").between(*WEAR_RANGE),
        "hdf_condition": (F.col("temp_diff") < HEAT_MAX_DIFF)
        & (F.col("rotational_speed_rpm") < HEAT_MAX_RPM),
        "pwf_condition": (F.col("power") < POWER_RANGE[0]) | (F.col("power") > POWER_RANGE[1]),
        "osf_condition": F.col("tool_torque_product") > F.col("osf_threshold"),
    }
    flagged = df.withColumns({name: flag(test) for name, test in conditions.items()})
    return flagged.withColumn("failure_risk", F.greatest(*[F.col(c) for c in CONDITIONS]))


def engineer(df: DataFrame) -> DataFrame:
    """All features of a valid reading: code, threshold, physics and conditions."""
    return df.transform(nan_to_null).transform(encode_type).transform(add_threshold).transform(
        add_physics
    ).transform(add_conditions)


def share_bucket(key: Column, seed: int, buckets: int = 1_000_000) -> Column:
    """Repeatable pseudo-random integer in ``[0, buckets)`` derived from a row key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets))


def label_failures(
    df: DataFrame,
    key: str = "udi",
    seed: int = 42,
    wear_draw: Column | None = None,
    random_draw: Column | None = None,
) -> DataFrame:
    """Failure-mode labels and ``machine_failure`` for engineered readings.

    Heat, power and overstrain failures always stop the machine, worn tools do
    so for a share of readings, and a small share fails at random. The draws are
    hashes of the row key, hence stable when a task is run again.
    """
    scale = 1_000_000
    if wear_draw is None:
        wear_draw = share_bucket(F.col(key), seed) < int(WEAR_FAILURE_SHARE * scale)
    if random_draw is None:
        random_draw = share_bucket(F.col(key), seed + 1) < int(RANDOM_FAILURE_SHARE * scale)
    modes = df.withColumns(
        {
            "twf": F.col("twf_condition"),
            "hdf": F.col("hdf_condition"),
            "pwf": F.col("pwf_condition"),
            "osf": F.col("osf_condition"),
            "rnf": flag(random_draw),
        }
    )
    stopped = (
        (F.col("hdf") == 1)
        | (F.col("pwf") == 1)
        | (F.col("osf") == 1)
        | (F.col("rnf") == 1)
        | ((F.col("twf") == 1) & wear_draw)
    )
    return modes.withColumn("machine_failure", flag(stopped))


def product_id(kind: Column, number: Column) -> Column:
    """Type letter followed by a five digit number."""
    return F.concat(kind, F.lpad(number.cast("string"), 5, "0"))


def worn(df: DataFrame) -> DataFrame:
    """Tool wear after one more use of the tool; the increment depends on the type."""
    return df.withColumn(
        "tool_wear_min", F.col("tool_wear_min") + lookup(F.col("type"), WEAR_INCREMENTS)
    )


def clip_low(col: Column, low: float = 0.0) -> Column:
    """Lower clip that keeps NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def add_logs(df: DataFrame, cols: Sequence[str] = SENSORS) -> DataFrame:
    """``log_<c>`` = ln(1 + c); values at or below -1 give NULL."""
    return df.withColumns({f"log_{c}": F.when(F.col(c) > -1, F.log1p(F.col(c))) for c in cols})


def finite_or_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities and NaN become NULL."""
    bad = (float("inf"), float("-inf"), float("nan"))
    return df.withColumns({c: F.when(~F.col(c).isin(*bad), F.col(c)) for c in cols})


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Clean infinities in the double columns among ``cols``, then drop rows with any NULL."""
    cols = df.columns if cols is None else list(cols)
    kinds = dict(df.dtypes)
    doubles = [c for c in cols if kinds[c] in ("double", "float")]
    return finite_or_null(df, doubles).dropna("any", subset=list(cols))


def select_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Projection onto a model's feature list; names missing columns when it fails."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    return df.select(*names)


def positional_names(names: Sequence[str], prefix: str = "column_") -> dict[str, str]:
    """Feature name -> positional name, for models trained on unnamed matrices."""
    return {name: f"{prefix}{i}" for i, name in enumerate(names)}


def with_positional_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(positional_names(names))


def with_feature_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in positional_names(names).items()})


def round_half_even(probability: Column) -> Column:
    """0/1 decision from a probability; exactly one half gives 0."""
    return F.bround(probability).cast("int")


def cluster_anomaly(label: Column) -> Column:
    """Noise label -1 becomes anomaly 1, any cluster becomes 0."""
    return flag(label == -1)
