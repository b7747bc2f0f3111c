"""Registry of queries and the SQL views their twins are written over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SENSORS = ["air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"]

VIEWS = {
    "readings": """
select event_id as udi, user_id as machine_id, ts as event_time,
  case event_type when 'error' then 'H' when 'signup' then 'M' when 'purchase' then 'M'
    else 'L' end as type,
  cast(295 as double) + cast(event_id % 97 as double) / 10 as air_temp_k,
  cast(295 as double) + cast(event_id % 97 as double) / 10 + cast(7.53 as double)
    + cast(json_extract_string(props, '$.k') as double) / 20 as process_temp_k,
  cast(1200 + (event_id * 37) % 700 as double) as rotational_speed_rpm,
  cast(20 as double) + cast(cast(round(value * 100) as bigint) % 4000 as double) / 100 as torque_nm,
  cast((event_id * 13) % 250 as double) as tool_wear_min,
  cast(json_extract_string(props, '$.k') as int) as k
from events""",
    "physics": """
select *,
  case type when 'H' then 0 when 'L' then 1 when 'M' then 2 end as type_code,
  case type when 'L' then 11000 when 'M' then 12000 when 'H' then 13000 end as osf_threshold,
  process_temp_k - air_temp_k as temp_diff,
  rotational_speed_rpm * (2 * pi() / 60) as rotational_speed_rad_s,
  torque_nm * (rotational_speed_rpm * (2 * pi() / 60)) as power,
  tool_wear_min * torque_nm as tool_torque_product
from readings""",
    "conditions": """
select *,
  cast(tool_wear_min between 200 and 240 as int) as twf_condition,
  cast(temp_diff < cast(8.6 as double) and rotational_speed_rpm < 1380 as int) as hdf_condition,
  cast(power < 3500 or power > 9000 as int) as pwf_condition,
  cast(tool_torque_product > osf_threshold as int) as osf_condition
from physics""",
    "engineered": """
select *, greatest(twf_condition, hdf_condition, pwf_condition, osf_condition) as failure_risk
from conditions""",
    "labelled": """
select *, twf_condition as twf, hdf_condition as hdf, pwf_condition as pwf, osf_condition as osf,
  cast(udi % 1000 = 0 as int) as rnf,
  cast(hdf_condition = 1 or pwf_condition = 1 or osf_condition = 1
    or (twf_condition = 1 and udi % 100 < 57) or udi % 1000 = 0 as int) as machine_failure
from engineered""",
    "scored": """
select *, least(cast(1 as double), greatest(cast(0 as double),
  tool_torque_product / cast(28000 as double)
  + abs(power - cast(6250 as double)) / cast(12000 as double))) as score
from labelled""",
    "dirty_once": """
select udi, machine_id, event_time, type, air_temp_k,
  case when udi % 23 = 0 then process_temp_k - cast(20 as double) else process_temp_k end
    as process_temp_k,
  rotational_speed_rpm,
  case when udi % 17 = 0 then null when udi % 29 = 0 then -torque_nm else torque_nm end as torque_nm,
  tool_wear_min, k
from readings""",
    "dirty": """
select * from dirty_once union all select * from dirty_once where udi % 50 = 0""",
    "decided": """
select *, cast(score >= cast(0.5 as double) as int) as pred, cast(udi % 5 as int) as fold from scored""",
    "curve": """
select fold, score, sum(case when machine_failure = 1 then 1 else 0 end) as pos,
  sum(case when machine_failure = 1 then 0 else 1 end) as neg
from decided group by fold, score""",
    "running": """
select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg,
  sum(pos) over (partition by fold) as all_pos, sum(neg) over (partition by fold) as all_neg
from curve window w as (partition by fold order by score desc)""",
    "asset": """
select c_custkey as Id, c_name as Code, 'Asset ' || c_custkey as Description, c_mktsegment as Type,
  case when c_acctbal > 0 then 'A' else 'N' end as Status
from customer where c_custkey % 5 <> 0""",
    "models": """
select udi, machine_id, event_time, fold, machine_failure, cast(failure_risk as double) as rule,
  score as linear,
  cast(case when udi % 11 = 0 then 1 - machine_failure else machine_failure end as double) as tree
from decided""",
    "long_models": """
select udi, fold, machine_failure, 'rule' as model, rule as score from models
union all select udi, fold, machine_failure, 'linear', linear from models
union all select udi, fold, machine_failure, 'tree', tree from models""",
}
NEEDS = {
    "readings": [],
    "physics": ["readings"],
    "conditions": ["physics"],
    "engineered": ["conditions"],
    "labelled": ["engineered"],
    "scored": ["labelled"],
    "dirty_once": ["readings"],
    "dirty": ["dirty_once"],
    "decided": ["scored"],
    "curve": ["decided"],
    "running": ["curve"],
    "asset": [],
    "models": ["decided"],
    "long_models": ["models"],
}


def sql_over(view: str | list[str], body: str) -> str:
    """SQL text with the named views (and those they need) in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in [view] if isinstance(view, str) else view:
        visit(name)
    parts = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}" if parts else body


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with its SQL twin if there is one."""

    def register(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register
