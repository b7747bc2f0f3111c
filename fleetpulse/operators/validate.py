"""Record checks, dataset checks and their reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.functions.physics import TYPE_CODES
from fleetpulse.schema import COLUMN_ALIASES, SENSOR_MESSAGE, SENSORS, canonical

# The fields a message must carry, under their external names.
REQUIRED_FIELDS = [name for name, short in COLUMN_ALIASES.items() if short in [*SENSORS, "type"]]


def parse_messages(raw: DataFrame, extra: T.StructType | None = None) -> DataFrame:
    """Decode JSON ``value`` into typed reading columns, keeping ``value`` as ``raw``."""
    schema = T.StructType(SENSOR_MESSAGE.fields + (extra.fields if extra else []))
    parsed = raw.select(F.col("value").alias("raw"), F.from_json("value", schema).alias("m"))
    return canonical(parsed.select("raw", "m.*"))


def reject_reason(cols: Sequence[str] | None = None) -> Column:
    """Why a parsed reading is rejected; NULL for a valid one.

    A required field that is absent or of the wrong type is NULL after the typed
    parse. This must run before NaN is turned into NULL: a NaN reading is valid.
    """
    cols = [*SENSORS, "type"] if cols is None else list(cols)
    long_names = {short: name for name, short in COLUMN_ALIASES.items()}
    reason = F.when(F.lit(False), F.lit(""))
    for c in cols:
        reason = reason.when(F.col(c).isNull(), F.lit(f"missing or invalid: {long_names.get(c, c)}"))
    unknown = ~F.col("type").isin(*TYPE_CODES)
    return reason.when(unknown, F.concat(F.lit("unknown type: "), F.col("type")))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid readings, and the quarantine with a ``reason`` column."""
    checked = df.withColumn("reason", reject_reason())
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(
        F.col("reason").isNotNull()
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _missing(df: DataFrame, col: str) -> Column:
    test = F.col(col).isNull()
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(col)
    return test


def _rows(row: DataFrame, cells: Sequence[Column]) -> DataFrame:
    """Unpivot a one-row aggregate into report rows."""
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def null_counts(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Missing values per column, with a ``(total)`` row, from one aggregation."""
    cols = df.columns
    row = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in cols])
    total = sum((F.col(c) for c in cols), F.lit(0))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in cols]
    cells.append(F.struct(F.lit("(total)").alias("column"), total.alias("n_missing")))
    out = _rows(row, cells)
    return out.filter(F.col("n_missing") > 0) if only_missing else out


def column_types(df: DataFrame) -> DataFrame:
    """Column names and types, taken from the schema alone."""
    return df.sparkSession.createDataFrame(
        [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)],
        "position int, column string, type string",
    )


def value_ranges(df: DataFrame) -> DataFrame:
    """Minimum and maximum of every numeric column, NaN left out."""
    cols = numeric_columns(df)
    clean = {c: F.when(~_missing(df, c), F.col(c).cast("double")) for c in cols}
    row = df.agg(
        *[F.min(v).alias(f"{c}_min") for c, v in clean.items()],
        *[F.max(v).alias(f"{c}_max") for c, v in clean.items()],
    )
    return _rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"{c}_min").alias("min_value"),
                F.col(f"{c}_max").alias("max_value"),
            )
            for c in cols
        ],
    )


def inconsistent_records(df: DataFrame) -> DataFrame:
    """Readings that are cooler inside than outside, and with negative torque."""
    return df.agg(
        F.count_if(F.col("process_temp_k") < F.col("air_temp_k")).alias("inconsistent_temperature"),
        F.count_if(F.col("torque_nm") < 0).alias("negative_torque"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one. Copies collapse map-side before the shuffle."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: present or not, its type, and how many values it holds."""
    kinds = dict(df.dtypes)
    present = [c for c in required if c in kinds]
    row = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(~_missing(df, c)).alias(c) for c in present]
    )
    return _rows(
        row,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(int(c in kinds)).alias("present"),
                F.lit(kinds.get(c)).cast("string").alias("type"),
                (F.col(c) if c in kinds else F.lit(0).cast("bigint")).alias("n_values"),
            )
            for c in required
        ],
    )


def dataset_report(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    """All dataset checks as ``(dataset, check, subject, measure)`` rows.

    Column-wise checks share one scan; only the duplicate check shuffles rows.
    """
    numeric = numeric_columns(df)
    parts: dict[tuple[str, str], Column] = {("rows", ""): F.count(F.lit(1))}
    for c in df.columns:
        parts["missing", c] = F.count_if(_missing(df, c))
    for c in numeric:
        clean = F.when(~_missing(df, c), F.col(c).cast("double"))
        parts["min", c], parts["max", c] = F.min(clean), F.max(clean)
    parts["process below air temperature", ""] = F.count_if(
        F.col("process_temp_k") < F.col("air_temp_k")
    )
    parts["negative torque", ""] = F.count_if(F.col("torque_nm") < 0)
    row = df.agg(*[v.cast("double").alias(f"m{i}") for i, v in enumerate(parts.values())])
    cells = [
        F.struct(F.lit(check).alias("check"), F.lit(c).alias("subject"), F.col(f"m{i}").alias("measure"))
        for i, (check, c) in enumerate(parts)
    ]
    absent = [("missing column", c, 1.0) for c in missing_columns(df, required)]
    repeated = duplicate_rows(df).select(
        F.lit("duplicate rows").alias("check"),
        F.lit("").alias("subject"),
        F.col("duplicate_rows").cast("double").alias("measure"),
    )
    report = _rows(row, cells).unionByName(repeated)
    if absent:
        report = report.unionByName(
            df.sparkSession.createDataFrame(absent, "check string, subject string, measure double")
        )
    return report.select(F.lit(dataset).alias("dataset"), "*")


def first_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first rows in a stated order (a top-n, not a sort of the table)."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """Row and column count and the columns with gaps, as ``(table, measure, subject, value)``."""
    row = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(_missing(df, c)).alias(c) for c in df.columns]
    )

    def cell(measure: str, subject: str, value: Column) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"),
            F.lit(subject).alias("subject"),
            value.cast("bigint").alias("value"),
        )

    cells = [
        cell("rows", "", F.col("__rows")),
        cell("columns", "", F.lit(len(df.columns))),
        *[cell("missing", c, F.col(c)) for c in df.columns],
    ]
    lines = _rows(row, cells).filter((F.col("measure") != "missing") | (F.col("value") > 0))
    return lines.select(F.lit(name).alias("table"), "*")


def integrate(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both sets by column name with a ``source`` column; absent columns become NULL."""
    return real.withColumn("source", F.lit("real")).unionByName(
        synthetic.withColumn("source", F.lit("synthetic")), allowMissingColumns=True
    )


def dropped_by_source(df: DataFrame) -> DataFrame:
    """How many rows dropping incomplete ones keeps and loses, per source."""
    cols = [c for c in df.columns if c != "source"]
    gap = F.lit(False)
    for c in cols:
        gap = gap | _missing(df, c)
    return df.groupBy("source").agg(
        F.count_if(~gap).alias("n_kept"), F.count_if(gap).alias("n_dropped")
    )
