"""Knob specs and edit proposals made from ``part``, pairs of concepts, strict composition hits, framings and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlens.operators import specs as S
from rolloutlens.sources import files, views

_TAGGED = "case {} when 0 then 'constrained_divisor_count' when 1 then 'modular_exponent' when 2 then 'divisor_sum_filter' when 3 then 'prime_power_divisors' else {} end".format
#: Specs as scalars: two numbers v0 and v1 or two words, and an envelope lo to hi. Some break each rule.
_SPECS = f"""select id, concept, param, type, knob_class, case when id % 5 <> 4 then lo end as lo, case when id % 5 <> 4 then lo + 20 + id % 9 end as hi, case when id % 7 = 0 then 'odd' else 'even' end as w1,
  lo + id % 6 as v0, lo + id % 6 + (id % 11) * 2 - 2 as v1, length(concept) % 4 = 0 as locked from (select p_partkey as id, {_TAGGED("p_partkey % 6", "p_type")} as concept, concat('k', cast(p_partkey as string)) as param, cast(p_size % 7 as double) as lo,
  case when p_partkey % 17 = 0 then null when p_partkey % 19 = 0 then 'float' when p_partkey % 5 in (0, 1) then 'randint' when p_partkey % 5 = 2 then 'const' else 'choice' end as type,
  case when p_partkey % 23 = 0 then 'X' when p_partkey % 3 = 0 then 'num' when p_partkey % 3 = 1 then 'C' else 'S' end as knob_class from @part) s"""
_PROPOSALS = f"""select id as proposal_id, case when id % 31 = 0 then 'nowhere' else concept end as concept, case when id % 29 = 0 then 'k?' else param end as param, v0 + id % 4 - 1 as v0, v1 - id % 3 + 1 as v1, w1 from ({_SPECS}) s"""


def _values(rows: DataFrame, key: str) -> DataFrame:
    words = F.col(key) % 5 == 4
    numbers = ~words & ~((F.col(key) % 5 == 3) & (F.col(key) % 13 == 0))
    none = lambda t: F.array().cast(f"array<{t}>")
    return rows.withColumn("atoms", F.when(numbers, F.array("v0", "v1")).otherwise(none("double"))).withColumn("words", F.when(words, F.array(F.lit("plain"), "w1")).otherwise(none("string"))).withColumn("nested", (F.col(key) % 20 == 3))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(views.query(spark, sf_dir, _SPECS), "id")
    return rows.withColumn("allowed", F.when(F.col("id") % 5 == 4, F.array(F.lit("plain"), F.lit("even")))).drop("v0", "v1", "w1")


def knob_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validate(specs(spark, sf_dir))


#: The reason for numbers a, b of spec row s, by the oracle.
_REASON = """case when s.type is null then 'missing_key' when s.type = 'float' then 'bad_type' when s.knob_class = 'X' then 'bad_class'
  when s.type in ('randint', 'const') then case when {nested} or {a} > {b} then 'bad_range' when {a} < s.lo or {b} > s.hi then 'outside_envelope' end
  when {cat} then case when {w} = 'odd' or not {is_words} then 'not_allowed' end when {is_words} then 'no_numbers' when {none} then 'no_options' when least({a}, {b}) < s.lo or greatest({a}, {b}) > s.hi then 'outside_envelope' end""".format
_VALIDATE_SQL = f"select concept, param, {_REASON(a='v0', b='v1', w='w1', nested='false', cat='id % 5 = 4', is_words='id % 5 = 4', none='id % 65 = 13')} as reason from ({_SPECS}) s"


def knob_edit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = _values(views.query(spark, sf_dir, _PROPOSALS), "proposal_id")
    return S.edit_gate(proposals, specs(spark, sf_dir))


_EDIT_SQL = f"""select proposal_id, concept, param, case when locked is null then 'unknown_concept' when locked then 'locked' when id is null then 'unknown_param' when reason is not null then concat('invalid: ', reason)
  when knob_class = 'num' and id % 5 <> 4 and id % 65 <> 13 and (least(a, b) < least(v0, v1) or greatest(a, b) > greatest(v0, v1)) then 'widened' else 'accepted' end as verdict
from (select p.proposal_id, p.concept, p.param, l.locked, s.id, s.knob_class, s.v0, s.v1, p.v0 as a, p.v1 as b, {_REASON(a='p.v0', b='p.v1', w='p.w1', nested='false', cat='s.id % 5 = 4', is_words='s.id % 5 = 4', none='s.id % 65 = 13')} as reason
  from ({_PROPOSALS}) p left join (select distinct concept, locked from ({_SPECS}) x) l on l.concept = p.concept left join ({_SPECS}) s on s.concept = p.concept and s.param = p.param) g"""


def knob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs written as one JSON folder a concept and read back, the concept from the file's path."""
    path = files.scratch(spark, "specs")
    kept = specs(spark, sf_dir).select("concept", F.struct("param", "type", "knob_class", "atoms", "words").alias("spec"))
    kept.withColumn("file", F.regexp_replace("concept", "[^A-Za-z0-9_]", "_")).drop("concept").write.partitionBy("file").option("ignoreNullFields", "false").json(path)
    read = spark.read.schema(kept.select("spec").schema).json(path, pathGlobFilter="*.json").select(F.regexp_extract("_metadata.file_path", r"file=([^/]+)/", 1).alias("concept"), "spec.*")
    return read.select("concept", "param", "type", "knob_class", F.size("atoms").cast("long").alias("n_numbers"), F.size("words").cast("long").alias("n_words"))


_SCAN_SQL = f"""select regexp_replace(concept, '[^A-Za-z0-9_]', '_', 'g') as concept, param, type, knob_class, cast(case when id % 5 = 4 or id % 65 = 13 then 0 else 2 end as bigint) as n_numbers, cast(case when id % 5 = 4 then 2 else 0 end as bigint) as n_words from ({_SPECS}) s"""

_ANSWERS = f"select {_TAGGED('length(concept) % 5', 'concept')} as concept, try_cast(answer as bigint) as value from @pool"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs(views.query(spark, sf_dir, _ANSWERS), specs(spark, sf_dir))


def chain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = {c: F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in ("n_in", "n_distinct")}  # -1 where nothing can be fed
    return _edges(spark, sf_dir).withColumns(none | {"tags": F.array_join(F.col("tags").cast("array<string>"), ",")})


_TAG_SQL = "case when {0} = 'constrained_divisor_count' then [55, 75] when {0} in ('modular_exponent', 'divisor_sum_filter') then [55] when {0} = 'prime_power_divisors' then [75] else []::int[] end".format
_PAIRS_SQL = f"""select source, target, param, reason, n, case when reason is null then n_in else -1 end as n_in, case when reason is null then n_distinct else -1 end as n_distinct, case when reason is null then round(cast(n_in as double) / n, 4) end as share,
  reason is null and round(cast(n_in as double) / n, 4) >= 0.5 and n_distinct >= 5 as valid, array_to_string(list_sort(list_distinct(list_concat({_TAG_SQL('source')}, {_TAG_SQL('target')}))), ',') as tags
from (select a.concept as source, s.concept as target, s.param, any_value(case when s.type = 'const' then 'constant' when s.type = 'randint' then null when s.type is null then null when s.id % 5 = 4 then 'words' when s.id % 20 = 3 then 'structured' end) as reason, count(*) as n, count(*) filter (where a.value between s.lo and s.hi) as n_in,
  count(distinct case when a.value between s.lo and s.hi then a.value end) as n_distinct from (select * from ({_ANSWERS}) b where value is not null) a join ({_SPECS}) s on s.concept <> a.concept group by a.concept, s.concept, s.param) p"""
_RATES = f"""select concept, avg(x) as mean_pass from (select {_TAGGED('length(concept) % 5', 'concept')} as concept, case when row_id % 10 < 4 then 1e0 else 0e0 end as x from @pool
  union all select {_TAGGED('p_partkey % 6', 'p_type')} as concept, case when p_partkey % 10 < 4 then 1e0 else 0e0 end as x from @part) r group by concept"""


def pair_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With limits that fit the rates of these tables."""
    return S.recommended(_edges(spark, sf_dir), views.query(spark, sf_dir, _RATES), 0.38, (0.3, 0.5)).select("source", "target", "param", "share", F.round("source_pass", 9).alias("source_pass"), F.round("target_pass", 9).alias("target_pass"))


_RECOMMEND_SQL = f"""select e.source, e.target, e.param, e.share, round(a.mean_pass, 9) as source_pass, round(b.mean_pass, 9) as target_pass from ({_PAIRS_SQL}) e join ({_RATES}) a on a.concept = e.source join ({_RATES}) b on b.concept = e.target
where e.valid and a.mean_pass >= 0.38 and b.mean_pass between 0.3 and 0.5"""


def tag_coverage(spark: SparkSession, sf_dir: str, reserved: tuple[str, ...] = ("prime_power_divisors",)) -> DataFrame:
    """How many target problems the concepts cover that aren't reserved as partners of chains, of 83, and which."""
    concepts = specs(spark, sf_dir).select("concept").distinct().where(~F.col("concept").isin(*reserved))
    tags = concepts.select("concept", F.explode(S.tags_of(F.col("concept"))).alias("tag"))
    return tags.agg(F.count_distinct("concept").alias("n_concepts"), F.count_distinct("tag").alias("n_tags"), F.array_join(F.array_sort(F.collect_set("tag")).cast("array<string>"), ",").alias("tags")).withColumn("share", F.col("n_tags") / 83)


_COVERAGE_SQL = f"""select count(distinct concept) as n_concepts, count(distinct tag) as n_tags, coalesce(array_to_string(list_sort(list_distinct(list(tag))), ','), '') as tags, cast(count(distinct tag) as double) / 83 as share
from (select concept, unnest({_TAG_SQL('concept')}) as tag from (select distinct concept from ({_SPECS}) s where concept <> 'prime_power_divisors') c) t"""

# --- strict composition hits ------------------------------------------------------------------------------------------

#: Half of the chains (depth 1) hold their intermediate result, as an exponent, an equation or a count of divisors; the rest by itself or not at all.
_CHAINS = """select problem_id, arm, rollout_idx, ok, concept, case when problem_id % 2 = 0 then 'chain_constrained_divisor_count__modular_exponent' else 'chain_log_laws__ordered_triple_constraint' end as chain, ig, a,
  case (problem_id + rollout_idx) % 6 when 0 then concat(response, ' so ', a, '^{', ig, '}') when 1 then concat(response, ' where e = ', ig, ' holds') when 2 then concat(response, ' the number of divisors is ', ig, '!') when 3 then concat(response, ' and ', ig, ' is seen')
    when 4 then concat(response, ' but ', ig, '7') else response end as txt
from (select problem_id, arm, rollout_idx, ok, concept, response, cast(problem_id % 89 + 211 as string) as ig, cast(problem_id % 7 + 2 as string) as a, problem_id % 5 as depth from @graded) g where depth <> 0"""


def strict_hit(text: Column, result: Column, base: Column) -> Column:
    """The result as an exponent of the base, as the value of a letter, or as a count of divisors in the same sentence (80 characters at most between)."""
    r = F.concat(F.lit(r"\Q"), result, F.lit(r"\E"))
    forms = [F.concat(F.lit(r"\Q"), base, F.lit(r"\E\^\{?"), r, F.lit(r"\}?(?!\d)")), F.concat(F.lit(r"[a-zA-Z]\s*=\s*"), r, F.lit(r"(?!\d)")), F.concat(F.lit(r"divisors[^.]{0,80}?(?:is|are|:)\s*\\?\[?\s*"), r, F.lit(r"(?!\d)"))]
    return F.regexp_like(text, F.concat_ws("|", *forms))


def loose_hit(text: Column, result: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])\Q"), result, F.lit(r"\E(?![\d.])")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.query(spark, sf_dir, _CHAINS)
    strict = F.when(F.col("chain") == "chain_constrained_divisor_count__modular_exponent", strict_hit(F.col("txt"), F.col("ig"), F.col("a"))).otherwise(loose_hit(F.col("txt"), F.col("ig")))
    return rows.select("problem_id", "arm", "rollout_idx", "chain", "ok", loose_hit(F.col("txt"), F.col("ig")).alias("loose"), strict.alias("strict"))


def composition_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By chain, arm and detector: problems, mean pass, zones, hit rate, pass rate, pass given hit and miss, and the share that hits and fails."""
    hits = _hits(spark, sf_dir)
    problems = hits.groupBy("chain", "arm", "problem_id").agg(F.avg(F.col("ok").cast("double")).alias("rate"))
    band = problems.groupBy("chain", "arm").agg(F.count("*").alias("n"), F.round(F.avg("rate"), 9).alias("mean_pass"), F.count_if(F.col("rate") == 0).alias("too_hard"), F.count_if(F.col("rate") == 1).alias("too_easy"), F.count_if(F.col("rate").between(0.25, 0.75)).alias("goldilocks"))
    both = hits.select("chain", "arm", "ok", F.explode(F.array(F.struct(F.lit("loose").alias("detector"), F.col("loose").alias("hit")), F.struct(F.lit("strict").alias("detector"), F.col("strict").alias("hit")))).alias("d")).select("chain", "arm", "ok", "d.*")
    n, hit, ok, both_ok = F.count("*"), F.count_if("hit"), F.count_if("ok"), F.count_if(F.col("hit") & F.col("ok"))
    rates = both.groupBy("chain", "arm", "detector").agg((hit / n).alias("hit_rate"), (ok / n).alias("rollout_pass"), F.try_divide(both_ok, hit).alias("pass_given_hit"), F.try_divide(ok - both_ok, n - hit).alias("pass_given_miss"), ((hit - both_ok) / n).alias("hit_but_fail"))
    return rates.join(F.broadcast(band), ["chain", "arm"])  # a row for each chain and arm


_HITS_SQL = f"""select problem_id, arm, rollout_idx, chain, ok, loose, case when chain like '%modular_exponent' then regexp_matches(concat(txt, ' '), concat(a, '\\^\\{{?', ig, '\\}}?[^0-9]|[a-zA-Z]\\s*=\\s*', ig, '[^0-9]|divisors[^.]{{0,80}}?(?:is|are|:)\\s*', ig, '[^0-9]')) else loose end as strict
from (select *, regexp_matches(concat(' ', txt, ' '), concat('[^0-9.]', ig, '[^0-9.]')) as loose from ({_CHAINS}) c) d"""
_COMPOSITION_SQL = f"""with h as ({_HITS_SQL}), b as (select chain, arm, detector, case when detector = 'loose' then loose else strict end as hit, ok from h, (values ('loose'), ('strict')) d(detector)),
p as (select chain, arm, problem_id, avg(ok::int) as rate from h group by all),
z as (select chain, arm, count(*) as n, round(avg(rate), 9) as mean_pass, count(*) filter (where rate = 0) as too_hard, count(*) filter (where rate = 1) as too_easy, count(*) filter (where rate >= 0.25 and rate <= 0.75) as goldilocks from p group by all),
r as (select chain, arm, detector, cast(count(*) filter (where hit) as double) / count(*) as hit_rate, cast(count(*) filter (where ok) as double) / count(*) as rollout_pass, case when count(*) filter (where hit) > 0 then cast(count(*) filter (where hit and ok) as double) / count(*) filter (where hit) end as pass_given_hit,
  case when count(*) filter (where not hit) > 0 then cast(count(*) filter (where ok and not hit) as double) / count(*) filter (where not hit) end as pass_given_miss, cast(count(*) filter (where hit and not ok) as double) / count(*) as hit_but_fail from b group by all)
select * from r join z using (chain, arm)"""


def composition_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.query(spark, sf_dir, _CHAINS).groupBy("arm", "problem_id").agg(F.avg(F.col("ok").cast("double")).alias("rate"))
    return rates.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("rate"), 9).alias("mean_pass"), F.count_if(F.col("rate").between(0.25, 0.75)).alias("goldilocks"))


_OVERALL_SQL = f"select arm, count(*) as n, round(avg(rate), 9) as mean_pass, count(*) filter (where 4 * rate >= 1 and 4 * rate <= 3) as goldilocks from (select arm, problem_id, avg(ok::int) as rate from ({_CHAINS}) c group by arm, problem_id) p group by arm"

# --- framings ---------------------------------------------------------------------------------------------------------

#: One problem in five wordings, {m} and {x} being its numbers.
FRAMINGS = {
    "plain": "How many positive divisors has {m} above {x}?",
    "word_problem": "{m} chairs stand in equal rows of more than {x} chairs. How many row lengths are possible?",
    "set": "How big is the set of all d with d > {x} that divide {m}?",
    "scene": "A teacher splits {m} cards evenly, more than {x} to a child. How many ways are there?",
    "paraphrase": "Of the divisors of {m}, how many exceed {x}?",
}


def framing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instance in every framing, with the same gold."""
    rows = views.query(spark, sf_dir, "select p_partkey as id, p_partkey % 900 + 60 as m, p_size % 40 as x from @part")
    gold = F.expr("cast(size(filter(sequence(1L, m), d -> m % d = 0 and d > x)) as bigint)")
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("framing"), F.lit(t).alias("text")) for k, t in FRAMINGS.items()]))
    filled = F.replace(F.replace(F.col("f.text"), F.lit("{m}"), F.col("m").cast("string")), F.lit("{x}"), F.col("x").cast("string"))
    return rows.select("id", "m", "x", gold.alias("answer")).select("id", grid.alias("f"), "m", "x", "answer").select("id", "f.framing", filled.alias("problem"), "answer")


_GRID_SQL = f"""select id, framing, replace(replace(text, '{{m}}', cast(m as varchar)), '{{x}}', cast(x as varchar)) as problem, len(list_filter(range(x + 1, m + 1), lambda d: m % d = 0)) as answer
from (select p_partkey as id, p_partkey % 900 + 60 as m, p_size % 40 as x from @part) p, (values {', '.join(f"('{k}', '{t}')" for k, t in FRAMINGS.items())}) f(framing, text)"""


def framing_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept and framing, here the rollout's number modulo 5: the gain from base to trained, the gain in the plain framing, and what is left of it."""
    graded = views.frame(spark, sf_dir, "graded").withColumn("framing", F.col("rollout_idx") % 5)
    right = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("ok").cast("double")))
    gains = graded.groupBy("concept", "framing").agg((right("trained") - right("base")).alias("gain"))
    plain = gains.where("framing = 0").select("concept", F.col("gain").alias("plain_gain"))  # a row for each concept
    return gains.join(F.broadcast(plain), "concept").select("concept", "framing", F.round("gain", 9).alias("gain"), F.round("plain_gain", 9).alias("plain_gain"), F.round(F.col("gain") - F.col("plain_gain"), 9).alias("lost"))


_TRANSFER_SQL = """select concept, framing, round(gain, 9) as gain, round(p, 9) as plain_gain, round(gain - p, 9) as lost from (select *, max(gain) filter (where framing = 0) over (partition by concept) as p
from (select concept, rollout_idx % 5 as framing, avg(ok::int) filter (where arm = 'trained') - avg(ok::int) filter (where arm = 'base') as gain from @graded group by 1, 2) g) h"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "knob_validate": (knob_validate, _VALIDATE_SQL),
    "knob_edit_gate": (knob_edit_gate, _EDIT_SQL),
    "knob_scan": (knob_scan, _SCAN_SQL),
    "chain_pairs": (chain_pairs, _PAIRS_SQL),
    "pair_recommend": (pair_recommend, _RECOMMEND_SQL),
    "tag_coverage": (tag_coverage, _COVERAGE_SQL),
    "composition_strict": (composition_strict, _COMPOSITION_SQL),
    "composition_overall": (composition_overall, _OVERALL_SQL),
    "framing_grid": (framing_grid, _GRID_SQL),
    "framing_transfer": (framing_transfer, _TRANSFER_SQL),
}
