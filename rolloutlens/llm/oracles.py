"""The SQL of the operators that SQL can express, for DuckDB. It compares words, lines and shingles themselves, not their hashes."""

from __future__ import annotations

from rolloutlens.llm.lm_scores import BACKOFF
from rolloutlens.llm.quality import ERROR, RISK, RULES

_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')".format
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(key: str, table: str) -> str:
    """(key, n, s): each distinct five-word shingle of each text with words; fewer words make one."""
    lists = "list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)"
    return f"select {key}, len(l) as n, unnest(l) as s from (select {key}, {lists} as l from (select {key}, {_WORDS(_LOWER)} as w from {table}) a where len(w) > 0) b"


JACCARD = f"""with recursive s as materialized ({_shingles('doc_id', 'documents')}),
links as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2) p where 100 * c >= 80 * (n + m - c)),
reach as (select distinct doc_id, doc_id as r from s union select l.b as doc_id, reach.r from reach join links l on l.a = reach.doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(c.r, d.doc_id) as component_id from documents d left join (select distinct doc_id, n from s) k on k.doc_id = d.doc_id left join (select doc_id, min(r) as r from reach group by doc_id) c on c.doc_id = d.doc_id"""

DECONTAMINATION = f"""with d as materialized ({_shingles('doc_id', 'documents')}), i as materialized ({_shingles('item_id', 'benchmark')})
select doc_id, item_id, cast(any_value(i.n) as bigint) as n_item_shingles, count(*) as n_common from d join i on d.s = i.s group by doc_id, item_id having 100 * count(*) >= 80 * any_value(i.n)"""

#: For each word: o1 to o3, how often the n-gram that ends there occurs in other documents, and h2, o2 of the word before.
LM_SCORES = f"""with w as (select doc_id, unnest(x) as w, generate_subscripts(x, 1) as i, len(x) as n from (select doc_id, {_WORDS("coalesce(text, '')")} as x from documents) a),
g as (select *, lag(w) over d as p, lag(w, 2) over d as q from w window d as (partition by doc_id order by i)),
o as materialized (select doc_id, i, n, count(*) over (partition by w) - count(*) over (partition by doc_id, w) as o1, case when i > 1 then count(*) over (partition by p, w) - count(*) over (partition by doc_id, p, w) else 0 end as o2,
  case when i > 2 then count(*) over (partition by q, p, w) - count(*) over (partition by doc_id, q, p, w) else 0 end as o3 from g),
h as (select *, lag(o1) over d as h1, lag(o2) over d as h2, least(i - 1, 2) as hist from o window d as (partition by doc_id order by i)),
t as (select count(*) as words from w),
c as (select doc_id, any_value(n) as n, count(*) filter (where o2 = 0 and o3 = 0) as u1, count(*) filter (where o2 > 0 and o3 = 0) as u2, count(*) filter (where o3 > 0) as u3,
  sum(case when o3 > 0 then ln(o3::double / h2) when o2 > 0 then ln(o2::double / h1) + (hist - 1) * ln({BACKOFF}) else ln(greatest(o1, 1)) + hist * ln({BACKOFF}) end) as s from h group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(u1, 0)::bigint as n_unigram, coalesce(u2, 0)::bigint as n_bigram, coalesce(u3, 0)::bigint as n_trigram, round(coalesce(s - u1 * ln(greatest(words - n, 1)), 0), 4) as score,
  round((s - u1 * ln(greatest(words - n, 1))) / n, 6) as mean_score from documents d left join c on c.doc_id = d.doc_id, t"""

#: Windows are from a line with a word to the next one; of equal windows those go that don't overlap the first.
LINE_DEDUP = r"""with l as materialized (select doc_id, string_split(text, chr(10)) as l from documents where coalesce(text, '') <> ''),
f as (select doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^ \t\n\x0b\f\r]')) as f from l),
w as (select doc_id, a, b, array_to_string(l[a:b], chr(10)) as body from (select doc_id, l, f[k] as a, f[k + 1] as b from (select doc_id, l, f, unnest(range(1, len(f))) as k from f) x) y),
k as (select *, first_value(doc_id) over o as kd, first_value(b) over o as kb from w window o as (partition by body order by doc_id, a)),
g as (select distinct doc_id, unnest(range(a, b + 1)) as i from k where doc_id <> kd or a > kb),
r as (select doc_id, list(i order by i) as gone from g group by doc_id),
e as (select l.doc_id, len(l) as n, coalesce(gone, []) as gone, array_to_string(list_filter(l, lambda x, i: not list_contains(coalesce(gone, []), i)), chr(10)) as text from l left join r on r.doc_id = l.doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed_lines, coalesce(len(list_filter(gone, lambda i: not list_contains(gone, i - 1))), 0)::bigint as n_removed_chunks, sha256(coalesce(e.text, '')) as kept_sha256
from documents d left join e on e.doc_id = d.doc_id"""

#: Bytes as pairs of hexadecimal digits; of equal 100-byte windows all but the first are repeats, and repeats that touch make one span.
SUFFIX_DEDUP = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) as s from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) as p from h) x),
r as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from w) x where k > 1),
n as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as new from r),
i as (select doc_id, min(p) as a, max(p) + 100 as b from (select doc_id, p, sum(new) over (partition by doc_id order by p) as g from n) x group by doc_id, g),
j as (select doc_id, [0, *list(b order by a)] as b, list(a order by a) as a, sum(b - a) as gone, count(*) as k from i group by doc_id),
m as (select h.doc_id, length(h) // 2 as n, coalesce(gone, 0) as gone, coalesce(k, 0) as k, case when k is null then h else array_to_string(list_transform(range(1, k + 2), lambda q: substr(h, 2 * b[q] + 1, 2 * (case when q > k then length(h) // 2 else a[q] end - b[q]))), '') end as kept from h left join j on j.doc_id = h.doc_id)
select doc_id, n as n_bytes, gone::bigint as n_removed, k as n_spans, sha256(unhex(kept)) as kept_sha256 from m""".replace("[0, *list(b order by a)]", "list_prepend(0, list(b order by a))")


def _quality() -> str:
    """Features, exact binomial tests by the gamma function, the strictest safe cutoff of each rule, and the rules joined one after the other."""
    names = list(RULES)
    count = lambda r: "-word_chars" if RULES[r][0] == "minus_chars" else RULES[r][0]
    fires = lambda r, c: f"1000 * {count(r)} > {c} * {RULES[r][1]}"
    passes = lambda k: f"({k} < n * {RISK} and list_sum(list_transform(range(0, {k} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln({1 - RISK})))) <= {ERROR} / (strata * {len(RULES) + 1}))"
    tests = " union all ".join(f"select stratum, n, strata, '{r}' as rule, {c} as cutoff, t_{r}_{abs(c)} as k from counts" for r in names for c in RULES[r][2])
    steps = []
    for i, r in enumerate(names):
        on = " or ".join([f"(on_{x} and f_{x})" for x in names[:i]] + [f"f_{r}"])
        kept = ", ".join(f"any_value(on_{x}) as on_{x}" for x in names[:i])
        steps.append(f"u{i + 1} as (select stratum, n, strata{''.join(f', on_{x}' for x in names[:i])}, coalesce({passes('k')} and has, false) as on_{r} from (select m.stratum, any_value(m.n) as n, any_value(m.strata) as strata{', ' + kept if kept else ''}, any_value(m.{r}) is not null as has, count(*) filter (where coalesce({on}, false)) as k from marked m join u{i} u on u.stratum = m.stratum group by m.stratum) x)")
    return f"""with x as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, {_WORDS("coalesce(text, '')")} as w from documents),
s as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(s := array_to_string(w[i:i+2], ' '), i := i))) as v from x where len(w) > 2),
r as (select doc_id, count(distinct p) as k from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, v.i as i, count(*) over (partition by doc_id, v.s) as c from s) y where c > 1) z group by doc_id),
f as materialized (select x.doc_id, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(r.k, 0) as n_repeat_words,
  len(w) < 50 or 100 * coalesce(r.k, 0) > 50 * len(w) as base_failed from (select *, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ \\t\\n\\x0b\\f\\r]')) as l from x) x left join r on r.doc_id = x.doc_id),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
labelled as (select * from f where not base_failed and doc_id in (select doc_id from good)),
counts as (select *, count(*) over () as strata from (select stratum, count(*) as n, {", ".join(f"count(*) filter (where {fires(r, c)}) as t_{r}_{abs(c)}" for r in names for c in RULES[r][2])} from labelled group by stratum) c),
alone as (select stratum, any_value(n) as n, any_value(strata) as strata, {", ".join(f"min(cutoff) filter (where rule = '{r}') as {r}" for r in names)} from ({tests}) t where {passes('k')} group by stratum),
marked as (select a.*, {", ".join(f"{fires(r, 'a.' + r)} as f_{r}" for r in names)} from labelled l join alone a on a.stratum = l.stratum),
u0 as (select stratum from alone), {", ".join(steps)},
limits as (select a.stratum, {", ".join(f"case when on_{r} then {r} end as {r}" for r in names)} from alone a join u{len(names)} u on u.stratum = a.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({" or ".join(f"coalesce({fires(r, 'q.' + r)}, false)" for r in names)}) as kept from f left join limits q on q.stratum = f.stratum"""


QUALITY = _quality()

#: Lines by the pattern; the draws are the first four groups of eight hexadecimal digits.
FILL_MIDDLE = r"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as l, sha256(concat('7:', doc_id)) as h from documents),
d as (select *, len(l) as n, list_transform(range(0, 4), lambda k: list_reduce(list_prepend(0::bigint, list_transform(string_split(substr(h, 8 * k + 1, 8), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::bigint)), lambda s, x: 16 * s + x)) as r from t),
c as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(l[1:a], '') as prefix, array_to_string(l[a + 1:b], '') as middle, array_to_string(l[b + 1:n], '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256, sha256(text) as restored_sha256 from p"""


def _clusters(rounds: int = 3) -> str:
    """Assignment and means, one pair of tables a round. Whole-number division is done on remainders, so that it rounds down."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} as materialized (select vec_id, min(struct_pack(distance := s, cluster := c)) as m from (select vec_id, c, sum((v.x - p.x) * (v.x - p.x))::bigint as s from v join p{i} p on p.d = v.d group by vec_id, c) y group by vec_id)""")
        if i < rounds:
            steps.append(f"""p{i + 1} as materialized (select p.c, p.d, coalesce(m.x, p.x) as x from p{i} p left join (select m.cluster as c, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x from a{i} a join v on v.vec_id = a.vec_id group by 1, 2) m on m.c = p.c and m.d = p.d)""")
    return f"""with k as (select vec_id, embedding as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (select vec_id, unnest(range(1, 65)) as d, unnest(list_transform(e, lambda x: floor(64 * x::double)::bigint)) as x from k),
f as (select vec_id, row_number() over (order by sha256(concat('1:', vec_id))) - 1 as c from k qualify c < 16),
p0 as materialized (select c, d, x from f join v using (vec_id)), {", ".join(steps)},
h as (select c, sha256(string_agg(x::varchar, ',' order by d)) as centroid_sha256 from p{rounds} group by c)
select vec_id, m.cluster::int as cluster, m.distance as distance, sum(m.distance) over (partition by m.cluster)::bigint as cluster_inertia, sum(m.distance) over ()::bigint as inertia, centroid_sha256 from a{rounds} join h on h.c = m.cluster"""


CLUSTERS = _clusters()

ORACLES = {
    "op3_line_dedup": LINE_DEDUP,
    "op4_lm_scores": LM_SCORES,
    "op5_quality_rules": QUALITY,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op8_ngram_jaccard_join": JACCARD,
    "op10_suffix_array_dedup": SUFFIX_DEDUP,
    "op11_centroid_clustering": CLUSTERS,
    "op12_fill_middle": FILL_MIDDLE,
}
