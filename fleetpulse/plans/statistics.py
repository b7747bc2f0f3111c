"""Descriptive statistics and two-sample tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import stats
from fleetpulse.plans.registry import query, sql_over
from fleetpulse.schema import CATEGORICAL_COLUMNS, CONTINUOUS_COLUMNS
from fleetpulse.sources import views

_CONTINUOUS = {c: "temp_diff" if c == "air_temp_diff" else c for c in CONTINUOUS_COLUMNS}
_DIRTY = ["air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"]


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = views.labelled_readings(spark, folder).withColumn("air_temp_diff", F.col("temp_diff"))
    return views.real_and_synthetic(rows)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


@query(
    "describe_numeric",
    sql_over(
        "dirty",
        "\nunion all ".join(
            f"select '{c}' as feature, count({c}) as n, round(avg({c}), 6) as mean, "
            f"round(stddev_samp({c}), 6) as std, round(min({c}), 6) as min_value, "
            f"round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, "
            f"round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max_value from dirty"
            for c in _DIRTY
        ),
    ),
)
def describe_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.describe(views.dirty(views.readings(spark, folder)), _DIRTY))


_SPLIT = "event_time < timestamp '2024-01-16'"


def _moments_sql(c: str, source: str) -> str:
    return (
        f"select '{c}' as feature, count({source}) filter (where {_SPLIT}) as n1, "
        f"count({source}) filter (where not {_SPLIT}) as n2, "
        f"avg({source}) filter (where {_SPLIT}) as mean1, "
        f"avg({source}) filter (where not {_SPLIT}) as mean2, "
        f"stddev_samp({source}) filter (where {_SPLIT}) as std1, "
        f"stddev_samp({source}) filter (where not {_SPLIT}) as std2 from labelled"
    )


_MOMENTS_SQL = "\nunion all ".join(_moments_sql(c, s) for c, s in _CONTINUOUS.items())


@query(
    "mean_std_compare",
    sql_over(
        "labelled",
        f"""with m as ({_MOMENTS_SQL}) select feature, n1, n2, round(mean1, 6) as mean1,
        round(mean2, 6) as mean2, round(std1, 6) as std1, round(std2, 6) as std2 from m""",
    ),
)
def mean_std_compare(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.mean_std(*_sets(spark, folder), CONTINUOUS_COLUMNS))


@query(
    "t_statistic",
    sql_over(
        "labelled",
        f"""with m as ({_MOMENTS_SQL}) select feature, n1 + n2 - 2 as dof,
        round((mean1 - mean2) / sqrt(((n1 - 1) * std1 * std1 + (n2 - 1) * std2 * std2) / (n1 + n2 - 2)
          * (cast(1 as double) / n1 + cast(1 as double) / n2)), 6) as t from m""",
    ),
)
def t_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.t_statistic(*_sets(spark, folder), CONTINUOUS_COLUMNS).select("feature", "dof", "t"))


_KS_LONG = "\nunion all ".join(
    f"select '{c}' as feature, {s} as value, cast({_SPLIT} as int) as first from labelled"
    for c, s in _CONTINUOUS.items()
)


@query(
    "ks_statistic",
    sql_over(
        "labelled",
        f"""with long as ({_KS_LONG}),
        steps as (select feature, value, sum(first) as a, sum(1 - first) as b from long group by 1, 2),
        run as (select feature, sum(a) over w as ca, sum(b) over w as cb,
          sum(a) over (partition by feature) as ta, sum(b) over (partition by feature) as tb
          from steps window w as (partition by feature order by value)),
        d as (select feature, max(abs(cast(ca as double) / ta - cast(cb as double) / tb)) as ks,
          cast(max(ta) as bigint) as n1, cast(max(tb) as bigint) as n2 from run group by feature),
        l as (select *, ks * ks * (cast(n1 as double) * n2 / (n1 + n2)) as lam2 from d)
        select feature, n1, n2, round(ks, 6) as ks, round(case when lam2 < cast(0.04 as double) then 1.0
          else greatest(0.0, least(1.0, 2 * (select sum((case when k % 2 = 1 then 1 else -1 end)
            * exp(greatest(cast(-2 as double) * k * k * lam2, cast(-700 as double))))
            from range(1, 101) terms(k)))) end, 6)
          as p_value from l""",
    ),
)
def ks_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.ks_2samp(*_sets(spark, folder), CONTINUOUS_COLUMNS, exact_rows=0))


def _chi2_sql(cells: str) -> str:
    return f"""with cells as ({cells}),
    counts as (select feature, a, b, count(*) as n from cells group by 1, 2, 3),
    r as (select feature, a, sum(n) as rn from counts group by 1, 2),
    c as (select feature, b, sum(n) as cn from counts group by 1, 2),
    t as (select feature, sum(n) as tn from counts group by 1),
    grid as (select r.feature, cast(coalesce(counts.n, 0) as double) as o,
        cast(rn as double) * cn / tn as e
      from r join c on r.feature = c.feature join t on t.feature = r.feature
      left join counts on counts.feature = r.feature and counts.a = r.a and counts.b = c.b)
    select grid.feature, cast((select tn from t where t.feature = grid.feature) as bigint) as n,
      ((select count(*) from r where r.feature = grid.feature) - 1)
        * ((select count(*) from c where c.feature = grid.feature) - 1) as dof,
      round(sum((o - e) * (o - e) / e), 6) as chi2 from grid group by grid.feature"""


_PAIR_CELLS = "\nunion all ".join(
    f"select '{c}' as feature, cast(x.{c} as varchar) as a, cast(y.{c} as varchar) as b "
    "from first_set x join second_set y on x.rn = y.rn"
    for c in CATEGORICAL_COLUMNS
)
_PAIR_SETS = f"""first_set as (select *, row_number() over (order by udi) as rn from labelled where {_SPLIT}),
    second_set as (select *, row_number() over (order by udi) as rn from labelled where not {_SPLIT}),
    """


@query("chi2_paired", sql_over("labelled", "with " + _PAIR_SETS + _chi2_sql(_PAIR_CELLS)[5:]))
def chi2_paired(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.chi2_paired(*_sets(spark, folder), CATEGORICAL_COLUMNS, ["udi"]))


@query(
    "chi2_homogeneity",
    sql_over(
        "labelled",
        _chi2_sql(
            "\nunion all ".join(
                f"select '{c}' as feature, cast({_SPLIT} as varchar) as a, cast({c} as varchar) as b "
                "from labelled"
                for c in CATEGORICAL_COLUMNS
            )
        ),
    ),
)
def chi2_homogeneity(spark: SparkSession, folder: str) -> DataFrame:
    return _round(stats.chi2_homogeneity(*_sets(spark, folder), CATEGORICAL_COLUMNS))


@query("dataset_comparison")
def dataset_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return stats.compare(*_sets(spark, folder), CONTINUOUS_COLUMNS)


@query("validation_report")
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return stats.validation_report(
        *_sets(spark, folder), CONTINUOUS_COLUMNS, CATEGORICAL_COLUMNS, ["udi"]
    )
