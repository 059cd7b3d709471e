"""Reports over graded rollouts, pools and runs, as SQL that Catalyst plans: aggregates first, then windows and joins over what they leave."""

from __future__ import annotations

_RATE = "cast(count(*) filter (where {}) as double) / count(*)".format
_DEDUPED = "select * from (select *, row_number() over (partition by problem order by row_id {}) as rn from @pool) x where rn = 1".format
_DRAW = "md5(concat('42:', cast({} as string)))".format

QUERIES: dict[str, str] = {
    # grading
    "grade_method_counts": "select method, count(*) as n, count(*) filter (where ok) as n_correct from @graded group by method",
    "grade_rollouts": "select problem_id, arm, rollout_idx, pred, method, case when ok then 1e0 else 0e0 end as reward from @graded",
    "calib_zones": "select concept, arm, zone, count(*) as n from @calib group by concept, arm, zone",
    # calibration
    "calib_problem": """select problem_id, arm, concept, count(*) as n, count(*) filter (where ok) as correct, avg(case when ok then 1e0 else 0e0 end) as mean_reward,
      max(case when ok then 1e0 else 0e0 end) - avg(case when ok then 1e0 else 0e0 end) as max_advantage, round(stddev_pop(case when ok then 1e0 else 0e0 end), 6) as advantage_std from @graded group by problem_id, arm, concept""",
    "advantages": "select problem_id, arm, rollout_idx, round(case when ok then 1e0 else 0e0 end - avg(case when ok then 1e0 else 0e0 end) over (partition by problem_id, arm), 9) as advantage from @graded",
    "zone_frac": f"""select coalesce(concept, '(all)') as concept, count(*) as n, {", ".join(f"round({_RATE(f"zone = '{z}'")}, 4) as {z}" for z in ("too_hard", "borderline", "goldilocks", "too_easy"))}
      from @calib group by grouping sets ((concept), ())""",
    "pass_hist": """select g.arm, g.c as correct, count(k.problem_id) as n from (select distinct arm, rollout_idx + 1 as c from @rollouts union select distinct arm, 0 as c from @rollouts) g left join @calib k on k.correct = g.c and k.arm = g.arm group by g.arm, g.c""",
    "top3_share": """select concept, cast(sum(n) filter (where r <= 3) as double) / sum(n) as share from (select concept, answer, count(*) as n, row_number() over (partition by concept order by count(*) desc, answer) as r from @pool group by concept, answer) x group by concept""",
    "truncation_rate": f"select concept, arm, count(*) as n, {_RATE("position(concat(chr(92), 'boxed') in response) = 0")} as truncation from @rollouts group by concept, arm",
    "answer_entropy": """select concept, round(-sum(n / total * log2(n / total)), 6) as bits from (select concept, answer, cast(count(*) as double) as n, cast(sum(count(*)) over (partition by concept) as double) as total from @pool group by concept, answer) x group by concept""",
    "ghost_frac": f"select concept, arm, {_RATE("correct = 0 or correct = n")} as ghost from @calib group by concept, arm",
    "calib_overall": """select arm, round(avg(pass_rate), 9) as mean_reward, round(median(2 * pass_rate * (1 - pass_rate)), 9) as median_abs_advantage, round(avg(2 * pass_rate * (1 - pass_rate)), 9) as mean_abs_advantage,
      count(*) filter (where 2 * pass_rate * (1 - pass_rate) < 0.05) as n_small from @calib group by arm""",
    "concept_table": """select concept, count(*) as n, round(avg(pass_rate), 9) as mean_pass, count(*) filter (where zone = 'too_hard') as too_hard, count(*) filter (where zone = 'borderline') as borderline,
      count(*) filter (where zone = 'goldilocks') as goldilocks, count(*) filter (where zone = 'too_easy') as too_easy from @calib group by concept order by mean_pass, concept""",
    "parse_rate": f"select concept, arm, {_RATE('pred is not null')} as parsed from @graded group by concept, arm",
    "capability_order": "select arm, round(avg(pass_rate), 9) as mean_reward, row_number() over (order by avg(pass_rate)) as place from @calib group by arm",
    "calib_report": f"""select c.concept, c.n, c.mean_pass, c.ghost, t.truncation, s.share as top3_share, s.bits as answer_bits from
      (select concept, count(*) as n, round(avg(pass_rate), 9) as mean_pass, {_RATE("correct = 0 or correct = n")} as ghost from @calib group by concept) c
      join (select concept, {_RATE("position(concat(chr(92), 'boxed') in response) = 0")} as truncation from @rollouts group by concept) t on t.concept = c.concept
      join (select concept, cast(sum(n) filter (where r <= 3) as double) / sum(n) as share, round(-sum(n / total * log2(n / total)), 6) as bits from (select concept, gold, cast(count(*) as double) as n, cast(sum(count(*)) over (partition by concept) as double) as total,
        row_number() over (partition by concept order by count(*) desc, gold) as r from @rollouts group by concept, gold) x group by concept) s on s.concept = c.concept""",
    "env_report": f"""select arm, count(*) as n, count(*) filter (where zone in ('goldilocks', 'borderline')) as useful, {_RATE("zone in ('goldilocks', 'borderline')")} as useful_frac, round(avg(sqrt(pass_rate * (1 - pass_rate))), 6) as mean_std,
      round(coalesce(avg(sqrt(pass_rate * (1 - pass_rate))) filter (where zone = 'goldilocks'), 0), 6) as goldilocks_std from @calib group by arm""",
    "run_meta": """select arm, cast(sum(correct) as double) / sum(n) as overall_pass, count(*) as n_problems, count(*) filter (where zone = 'too_hard') as too_hard, count(*) filter (where zone = 'borderline') as borderline,
      count(*) filter (where zone = 'goldilocks') as goldilocks, count(*) filter (where zone = 'too_easy') as too_easy from @calib group by arm""",
    "pass_at_k": f"""select arm, count(*) as n, {_RATE('correct > 0')} as pass_at_k, cast(sum(correct) as double) / sum(n) as mean_pass_rate from @calib group by arm""",
    "checkpoint_matrix": """select concept, c0, c1, c2, c3, round(c3 - c0, 9) as trend from (select concept, round(avg(r) filter (where label = 0), 9) as c0, round(avg(r) filter (where label = 1), 9) as c1, round(avg(r) filter (where label = 2), 9) as c2,
      round(avg(r) filter (where label = 3), 9) as c3 from (select concept, cast(floor(rollout_idx / 2) as int) as label, case when ok then 1e0 else 0e0 end as r from @graded) x group by concept) y""",
    "arm_delta": "select concept, round(avg(pass_rate) filter (where arm = 'trained') - avg(pass_rate) filter (where arm = 'base'), 9) as delta from @calib group by concept",
    "accuracy": f"select arm, count(*) as n, {_RATE('is_correct')} as accuracy from @runs group by arm",
    # pools
    "dedupe_first": f"select row_id, problem, answer, concept, knob_k from ({_DEDUPED('')}) d",
    "dedupe_last": f"select row_id, problem, answer, concept, knob_k from ({_DEDUPED('desc')}) d",
    "gate_dedupe": "select concept, count(distinct problem) as kept, count(*) as raw, count(distinct problem) >= 0.9 * count(*) as ok from @pool group by concept",
    "gate_top3": f"""select concept, cast(sum(n) filter (where r <= 3) as double) / sum(n) as share, 10 * sum(n) filter (where r <= 3) <= 3 * sum(n) as ok from
      (select concept, answer, count(*) as n, row_number() over (partition by concept order by count(*) desc, answer) as r from ({_DEDUPED('desc')}) d group by concept, answer) x group by concept""",
    "gen_stats": """select concept, count(*) as raw, count(distinct problem) as kept, round(cast(count(distinct problem) as double) / count(*), 4) as survival, count(distinct answer) as n_answers, 2 * count(distinct problem) < count(*) as low_yield from @pool group by concept""",
    "chain_space": "select concept, count(*) as n, count(distinct answer) as n_answers from @pool group by concept",
    "concept_summary": """select concept, count(*) as n, count(*) filter (where answer = 'n/a') as n_non_int, min(try_cast(answer as bigint)) as lowest, max(try_cast(answer as bigint)) as highest, median(cast(try_cast(answer as bigint) as double)) as mid,
      count(distinct try_cast(answer as bigint)) as n_distinct from @pool group by concept""",
    "key_intersect": "select problem from @pool where row_id % 2 = 0 intersect select problem from @pool where row_id % 2 = 1",
    # samples and splits
    "seeded_sample": f"select row_id, problem from @pool order by {_DRAW('row_id')} limit 100",
    "goldilocks_train": "select problem_id, concept, correct from @calib where arm = 'base' and correct between 2 and 6",
    "goldilocks_holdout": f"""with t as (select problem_id, concept, correct from @calib where arm = 'base' and correct between 2 and 6),
      top as (select concept from (select concept, row_number() over (order by count(*) desc, concept) as r from t group by concept) x where r <= 12)
      select problem_id, concept, case when r = 1 then 'holdout' else 'train' end as part from (select t.problem_id, t.concept, row_number() over (partition by t.concept order by {_DRAW('problem_id')}) as r from t join top on top.concept = t.concept) y""",
    "zone_sample": f"select problem_id, zone from (select problem_id, zone, row_number() over (partition by zone order by {_DRAW('problem_id')}) as r from @calib where arm = 'base') x where r <= 4",
    "sft_stats": """select count(*) as n, count(*) filter (where correct = n) as always_right, count(*) filter (where correct = 0) as always_wrong, count(*) filter (where correct between 1 and n - 1) as gap from @calib""",
    "gap_summary": """select concept, count(*) as total, count(*) filter (where correct = n) as always_right, count(*) filter (where correct = 0) as always_wrong, count(*) filter (where correct between 1 and n - 1) as gap from @calib group by concept""",
    "resume_todo": "select distinct p.problem from @pool p where not exists (select 1 from @pool d where d.row_id % 3 = 0 and d.problem = p.problem)",
    # runs against each other
    "compare_runs": "select idx, concept, base_ok, trained_ok, base_pred, trained_pred from @paired",
    "transitions": "select case when base_ok and trained_ok then 'still_right' when trained_ok then 'fixed' when base_ok then 'broken' else 'still_wrong' end as category, count(*) as n from @paired group by case when base_ok and trained_ok then 'still_right' when trained_ok then 'fixed' when base_ok then 'broken' else 'still_wrong' end",
    "method_accuracy": f"select arm, method, count(*) as n, {_RATE('is_correct')} as accuracy from @runs group by arm, method",
    "wrong_boxed": f"select arm, count(*) as n_wrong, {_RATE("method = 'boxed'")} as boxed_rate from @runs where not is_correct group by arm",
    "token_stats": "select arm, avg(cast(n_tokens as double)) as mean_tokens, median(cast(n_tokens as double)) as median_tokens from @runs group by arm",
    "still_wrong": "select count(*) filter (where base_pred = trained_pred) as same_answer, count(*) filter (where base_pred <> trained_pred or base_pred is null or trained_pred is null) as other_answer from @paired where not base_ok and not trained_ok",
    "top_movers": """select problem_id, delta, side from (select problem_id, delta, 'up' as side, row_number() over (order by delta desc, problem_id) as r from (select problem_id, round(max(pass_rate) filter (where arm = 'trained') - max(pass_rate) filter (where arm = 'base'), 9) as delta from @calib group by problem_id) a where delta is not null
      union all select problem_id, delta, 'down' as side, row_number() over (order by delta, problem_id) as r from (select problem_id, round(max(pass_rate) filter (where arm = 'trained') - max(pass_rate) filter (where arm = 'base'), 9) as delta from @calib group by problem_id) b where delta is not null) x where r <= 10""",
    "sign_test": """select improved, regressed, unchanged, case when improved + regressed = 0 then 'mixed' when improved > 0.6 * (improved + regressed) then 'better' when improved < 0.4 * (improved + regressed) then 'worse' else 'mixed' end as verdict from
      (select count(*) filter (where t > b) as improved, count(*) filter (where t < b) as regressed, count(*) filter (where t = b) as unchanged from (select problem_id, max(pass_rate) filter (where arm = 'trained') as t, max(pass_rate) filter (where arm = 'base') as b from @calib group by problem_id) x) y""",
    "holdout_delta": "select cast(sign(t - b) as int) as direction, count(*) as n from (select problem_id, cast(max(correct) filter (where arm = 'trained') as double) as t, cast(max(correct) filter (where arm = 'base') as double) as b from @calib group by problem_id) x where t is not null and b is not null group by cast(sign(t - b) as int)",
    "sweet_spot_join": "select p.p_partkey as problem_id, coalesce(c.correct, -1) as correct, coalesce(c.n, -1) as n from @part p left join (select * from @calib where arm = 'base' and correct between 2 and 6) c on c.problem_id = p.p_partkey",
    # training log
    "reward_by_step": "select step, count(*) as n, cast(sum(reward) as bigint) as n_correct from @steps group by step",
    "reward_log_tail": "select seq, step, reward from (select seq, step, reward, row_number() over (order by seq desc) as r from @steps) x where r <= 500",
    "tripwire_daily": "select cast(date_trunc('day', ts) as timestamp) as day, count(*) as n, round(avg(value), 6) as mean_value from @events group by date_trunc('day', ts)",
    # texts
    "length_metadata": "select doc_id, length(text) as question_length, length(lang) as answer_length, 'unknown' as estimated_difficulty from @documents",
    "completion_unwrap": "select conv_id, coalesce(max_by(text, turn) filter (where text <> ''), '') as text from @conversations group by conv_id",
}
