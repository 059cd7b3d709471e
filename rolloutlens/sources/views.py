"""The shared views that queries read, derived from the given tables. The SQL runs unchanged in Spark and in DuckDB; @name is a table or view."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from rolloutlens.functions import grading as G

VIEWS = {
    "rollouts": """
with ranked as (
  select l_partkey, l_linenumber, l_quantity, row_number() over (partition by l_partkey
    order by l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_quantity, l_discount, l_shipdate) as r from @lineitem),
rolled as (
  select l_partkey + 10000000000 * cast(floor((r - 1) / 16) as bigint) as problem_id, p_type as concept, l_partkey % 97 + 100 as gold_n, case when (r - 1) % 16 < 8 then 'base' else 'trained' end as arm,
    (r - 1) % 8 as rollout_idx, l_linenumber as ln, cast(l_quantity as int) as n_tokens,
    case when l_quantity <= (l_partkey % 13) * 5 - 5 + (case when (r - 1) % 16 >= 8 then 6 else 0 end) then l_partkey % 97 + 100 else l_partkey % 97 + 101 + l_linenumber end as ans
  from ranked join @part on p_partkey = l_partkey)
select problem_id, concept, cast(gold_n as string) as gold, arm, rollout_idx, n_tokens,
  case (ln + rollout_idx) % 7
    when 0 then concat('First try ', chr(92), 'boxed{7}, then ', chr(92), 'boxed{ ', cast(ans as string), '}')
    when 1 then concat('Half of it: ', chr(92), 'boxed{', chr(92), 'frac{', cast(ans * 2 as string), '}{2}}')
    when 2 then concat('steps #### ', cast(ans as string))
    when 3 then concat('Therefore, the answer is $', cast(ans as string), '.')
    when 4 then concat('The result is **', cast(ans as string), '**.')
    when 5 then cast(ans as string)
    else concat('Could be ', cast(ans as string), ', or 9999') end as response
from rolled""",
    "pool": """
select event_id as row_id, concat(event_type, ':', cast(event_id % 600 as string)) as problem,
  case when event_id % 97 = 0 then 'n/a' when event_id % 50 = 0 then '21' else cast(event_id % 600 % 20 as string) end as answer,
  event_type as concept, cast(regexp_extract(props, '[0-9]+', 0) as int) % 5 as knob_k from @events""",
    "steps": "select cast(floor(event_id / 8) as bigint) as step, event_id as seq, case when value >= 100 then 1e0 else 0e0 end as reward from @events",
    "calib": """
select problem_id, concept, arm, count(*) as n, count(*) filter (where ok) as correct, cast(count(*) filter (where ok) as double) / count(*) as pass_rate,
  case when count(*) filter (where ok) = 0 then 'too_hard' when count(*) filter (where ok) = count(*) then 'too_easy'
    when 4 * count(*) filter (where ok) between count(*) and 3 * count(*) then 'goldilocks' else 'borderline' end as zone
from @graded group by problem_id, concept, arm""",
    "runs": "select problem_id * 8 + rollout_idx as idx, arm, concept, gold, ok as is_correct, method, pred, response, n_tokens from @graded",
    "paired": """
select b.idx, b.concept, b.gold, b.is_correct as base_ok, t.is_correct as trained_ok, b.method as base_method, t.method as trained_method, b.pred as base_pred,
  t.pred as trained_pred, b.n_tokens as base_tokens, t.n_tokens as trained_tokens, b.response as base_response
from @runs b join @runs t on b.idx = t.idx where b.arm = 'base' and t.arm = 'trained'""",
}

#: The grader for the oracle, in DuckDB's dialect.
DUCKDB_GRADED = rf"""
with named as (select *, case when regexp_matches(response, '{G.BOXED}') then 'boxed' when regexp_matches(response, '{G.HASHES}') then '####' when regexp_matches(response, '{G.ANSWER_IS}') then 'the_answer_is'
  when regexp_matches(response, '{G.BOLD}') then 'bold' when len(regexp_extract_all(response, '{G.NUMBER}', 0)) = 1 then 'single_number_fallback' else 'no_answer' end as method from @rollouts),
picked as (select *, case method when 'boxed' then regexp_extract(response, '(?s).*{G.BOXED}', 1) when '####' then regexp_extract(response, '{G.HASHES}', 1) when 'the_answer_is' then regexp_extract(response, '{G.ANSWER_IS}', 1)
  when 'bold' then regexp_extract(response, '(?s).*{G.BOLD}', 1) when 'single_number_fallback' then regexp_extract(response, '{G.NUMBER}', 0) end as raw from named),
plain as (select *, case when regexp_matches(raw, '{G.FRACTION}') then concat(cast(case when regexp_extract(raw, '{G.FRACTION}', 1) = '-' then -1 else 1 end * cast(regexp_extract(raw, '{G.FRACTION}', 2) as bigint) as varchar), '/',
  cast(cast(regexp_extract(raw, '{G.FRACTION}', 3) as bigint) as varchar)) else replace(raw, ',', '') end as pred from picked),
valued as (select *, case when pred like '%/%' then try_cast(split_part(pred, '/', 1) as double) / nullif(try_cast(split_part(pred, '/', 2) as double), 0) else try_cast(pred as double) end as v, try_cast(replace(gold, ',', '') as double) as g from plain)
select problem_id, concept, gold, arm, rollout_idx, n_tokens, response, pred, method, coalesce(abs(v - g) < 1e-6, false) as ok from valued"""

_NAME = re.compile(r"@(\w+)")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over it."""
    if name == "graded":
        return G.grade(frame(spark, sf_dir, "rollouts"))
    return query(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL in which @name is a table or view. The names that Spark sees are this call's own and gone after it."""
    own, names = uuid.uuid4().hex, sorted(set(_NAME.findall(sql)))
    for name in names:
        frame(spark, sf_dir, name).createOrReplaceTempView(f"{name}_{own}")
    try:
        return spark.sql(_NAME.sub(rf"\1_{own}", sql))
    finally:
        for name in names:
            spark.catalog.dropTempView(f"{name}_{own}")


def oracle(sql: str) -> str:
    """The same query for DuckDB: the views that it needs as common table expressions."""
    needed: dict[str, str] = {}

    def need(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            body = DUCKDB_GRADED if name == "graded" else VIEWS.get(name)
            if body and name not in needed:
                need(body)
                needed[name] = _NAME.sub(r"\1", body)

    need(sql)
    body = _NAME.sub(r"\1", sql)
    return f"with {', '.join(f'{k} as materialized ({v})' for k, v in needed.items())} select * from ({body})" if needed else body
