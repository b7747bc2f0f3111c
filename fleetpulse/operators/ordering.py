"""Order-dependent work without a single-task sort.

A global ``Window.orderBy`` puts all rows into one task. Here the ordering
column is cut at approximate quantiles into buckets of bounded size; work runs
inside the buckets and small per-bucket totals carry the running state across
them. The cut points only place rows, so results are exact whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
BUCKET = "__bucket"


def wall_micros(time: Column) -> Column:
    """Microseconds of a zone-free time stamp, whatever the session's time zone is."""
    seconds = F.unix_date(time.cast("date")).cast("bigint") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def sort_value(df: DataFrame, name: str) -> Column:
    """A double that grows with the ordering column (numbers, dates, timestamps).

    Adding zero makes one value of 0.0 and -0.0, which bucketing would tell apart.
    """
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        return F.unix_micros(name).cast("double")
    if kind in ("timestamp_ntz", "date"):
        return wall_micros(F.col(name).cast("timestamp_ntz")).cast("double")
    return F.col(name).cast("double") + F.lit(0.0)


def quantile_cuts(
    df: DataFrame,
    values: Mapping[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> dict[str, list[float]]:
    """Approximate quantiles of each value, in order; empty when one bucket is enough.

    At most ``max_buckets`` doubles per value reach the driver, whatever the
    size of the data. A value that is listed twice fills a bucket by itself.
    """
    rows = df.count()
    buckets = min(max_buckets, -(-rows // rows_per_bucket))
    if buckets <= 1:
        return {name: [] for name in values}
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    finite = {
        name: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for name, v in values.items()
    }
    row = df.agg(
        *[
            F.approx_percentile(v, shares, F.lit(10 * max(buckets, 1000))).alias(name)
            for name, v in finite.items()
        ]
    ).first()
    return {name: sorted(row[name] or []) for name in values}


def cut_points(
    df: DataFrame,
    values: Mapping[str, Column],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
) -> dict[str, list[float]]:
    """The different values among :func:`quantile_cuts`."""
    found = quantile_cuts(df, values, rows_per_bucket, max_buckets)
    return {name: sorted(set(cuts)) for name, cuts in found.items()}


def with_buckets(df: DataFrame, columns: Mapping[str, list[float]]) -> DataFrame:
    """Add ``<name>__bucket`` for each double column: its place among the cut points."""
    names = [name for name, cuts in columns.items() if cuts]
    flat = df.withColumns(
        {f"{n}{BUCKET}": F.lit(0.0) for n, cuts in columns.items() if not cuts}
    )
    if not names:
        return flat
    bucketizer = Bucketizer(
        splitsArray=[[float("-inf"), *columns[n], float("inf")] for n in names],
        inputCols=names,
        outputCols=[f"{n}{BUCKET}" for n in names],
        handleInvalid="keep",
    )
    return bucketizer.transform(flat)


def bucketed(
    df: DataFrame,
    order: Sequence[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
    among: Column | None = None,
) -> tuple[DataFrame, bool]:
    """Add a bucket number that grows with ``order``; says whether there are several.

    Buckets are cut on the first ordering column. A single value of it that fills
    whole buckets (one time stamp on a third of all rows) gets a bucket of its
    own, which is cut further on the second column. ``among`` limits the rows the
    cuts are taken from.
    """
    keyed = df.withColumn("__sort", sort_value(df, order[0]))
    some = keyed if among is None else keyed.filter(among)
    found = quantile_cuts(some, {"__sort": F.col("__sort")}, rows_per_bucket, max_buckets)["__sort"]
    repeated = sorted({a for a, b in zip(found, found[1:]) if a == b})
    cuts = sorted({*found, *[math.nextafter(v, math.inf) for v in repeated]})
    placed = with_buckets(keyed, {"__sort": cuts}).withColumnRenamed(f"__sort{BUCKET}", BUCKET)
    if cuts:
        # A NULL has no place among the cuts; like in a window it comes first.
        placed = placed.withColumn(BUCKET, F.when(F.col("__sort").isNull(), F.lit(-1.0)).otherwise(F.col(BUCKET)))
    if not repeated or len(order) < 2:
        return placed.drop("__sort"), bool(cuts)
    tied = F.col("__sort").isin(repeated)
    second = placed.withColumn("__next", sort_value(df, order[1]))
    some = second if among is None else second.filter(among)
    inner = cut_points(some.filter(tied), {"__next": F.col("__next")}, rows_per_bucket, max_buckets)
    step = F.when(F.col("__next").isNull(), F.lit(0.0)).otherwise(F.col(f"__next{BUCKET}") + 1)
    part = F.when(tied, step / F.lit(len(inner["__next"]) + 3.0)).otherwise(F.lit(0.0))
    out = with_buckets(second, inner).withColumn(BUCKET, F.col(BUCKET) + part)
    return out.drop("__sort", "__next", f"__next{BUCKET}"), True


def join_blocks(rows: DataFrame, totals: DataFrame, block: Sequence[str]) -> DataFrame:
    """Inner join on the block columns in which NULL equals NULL, so that no row is lost."""
    renamed = totals.withColumnsRenamed({c: f"__right_{c}" for c in block})
    same = F.lit(True)
    for c in block:
        same = same & F.col(c).eqNullSafe(F.col(f"__right_{c}"))
    return rows.join(renamed, same).drop(*[f"__right_{c}" for c in block])


def add_ordinal(
    df: DataFrame,
    order: str | Sequence[str],
    by: Sequence[str] = (),
    name: str = "ordinal",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Dense 0-based position of each row in ``order``, per group if ``by`` is given.

    Later columns of ``order`` break ties; all of them together must be unique
    for the result to be defined.
    """
    order = [order] if isinstance(order, str) else list(order)
    placed, many = bucketed(df, order, rows_per_bucket)
    block = [*by, BUCKET]
    within = F.row_number().over(Window.partitionBy(*block).orderBy(*order)) - 1
    if not many:
        return placed.withColumn(name, within.cast("bigint")).drop(BUCKET)
    ahead = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*block, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    )
    return (
        join_blocks(placed.withColumn("__within", within), offsets, block)
        .withColumn(name, (F.col("__within") + F.col("__before")).cast("bigint"))
        .select(*df.columns, name)
    )


def unpivot(
    df: DataFrame,
    cols: Sequence[str],
    keep: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> tuple[DataFrame, bool]:
    """Long form ``(keep..., feature, value, bucket)`` of double columns, NULL and NaN left out.

    The buckets are cut per column before unpivoting, in one pass for all columns.
    """
    doubles = df.select(*keep, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols])
    cuts = cut_points(doubles, {c: F.col(c) for c in cols}, rows_per_bucket)
    placed = with_buckets(doubles, cuts)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).alias("value"),
                F.col(f"{c}{BUCKET}").alias(BUCKET),
            )
            for c in cols
        ]
    )
    long = (
        placed.select(*keep, F.explode(cells).alias("cell"))
        .select(*keep, "cell.*")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    return long, any(cuts.values())


def running_totals(
    df: DataFrame,
    value: str,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    many: bool | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Cumulative totals over the distinct values of a column.

    Equal values are combined before anything is sorted, so ties are one step
    and a value that fills a third of the table is one row. Returns ``by``,
    ``value`` and, for each total ``x``, ``x`` (at this value), ``cum_x`` (up to
    and including it) and ``all_x`` (whole group). ``df`` may already carry
    buckets (from :func:`unpivot`); then ``many`` says if there are several.
    """
    if many is None:
        df, many = bucketed(df, [value], rows_per_bucket)
    block = [*by, BUCKET]
    steps = df.groupBy(*block, value).agg(*[agg.alias(x) for x, agg in totals.items()])
    way = F.desc if descending else F.asc
    upto = (Window.unboundedPreceding, Window.currentRow)
    inside = Window.partitionBy(*block).orderBy(way(value)).rowsBetween(*upto)
    steps_run = steps.withColumns({f"cum_{x}": F.sum(x).over(inside) for x in totals})
    if not many:
        group = Window.partitionBy(*block)
        return steps_run.withColumns({f"all_{x}": F.sum(x).over(group) for x in totals}).drop(
            BUCKET
        )
    group = Window.partitionBy(*by)
    ahead = group.orderBy(way(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    # Straight from the rows: at most one partial row per block leaves a task.
    offsets = (
        df.groupBy(*block)
        .agg(*[agg.alias(f"__{x}") for x, agg in totals.items()])
        .select(
            *block,
            *[F.coalesce(F.sum(f"__{x}").over(ahead), F.lit(0)).alias(f"__off_{x}") for x in totals],
            *[F.sum(f"__{x}").over(group).alias(f"all_{x}") for x in totals],
        )
    )
    return (
        join_blocks(steps_run, offsets, block)
        .withColumns({f"cum_{x}": F.col(f"cum_{x}") + F.col(f"__off_{x}") for x in totals})
        .drop(BUCKET, *[f"__off_{x}" for x in totals])
    )


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    shares: Mapping[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per column.

    ``percentile`` keeps all distinct values of a column in one task; this reads
    the wanted ranks off the running counts instead.
    """
    long, many = unpivot(df, cols, rows_per_bucket=rows_per_bucket)
    run = running_totals(long, "value", {"n": F.count(F.lit(1))}, by=["feature"], many=many)
    edges, picks = [], []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("all_n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            edges.append(F.min(F.when(F.col("cum_n") > rank, F.col("value"))).alias(f"{name}_{side}"))
        edges.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        picks.append((low + (high - low) * F.col(f"{name}_part")).alias(name))
    return run.groupBy("feature").agg(*edges).select("feature", *picks)
