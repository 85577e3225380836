"""DuckDB SQL of the queries that SQL can express, written on its own."""

from __future__ import annotations

from . import quality_rules

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

OP3 = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select cast(item_id as string) as item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select item, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0),
bk as (select distinct item, n, w[p:p + n - 1] as k from bw),
dw as (select r, n, w, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from bk) where len(w) >= n),
hit as (select r, item, p, bk.n from (select r, n, p, w[p:p + n - 1] as k from dw) x join bk on x.k = bk.k and x.n = bk.n),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hit) group by 1),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated from d left join words using (r) left join items using (r)"""

OP6 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, {WORD}) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w] else list_transform(range(1, len(w) - 1), lambda i : w[i:i + 2]) end) as k from d),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id as a, doc_id as b from d union select r.a, e.b from reach r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m as component_id from d left join n using (doc_id) join (select a, min(b) as m from reach group by 1) on a = d.doc_id"""

OP12 = f"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
f as (select part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
 regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as x,
 coalesce(doc_id in (select doc_id from labels where quality = 1), false) as good, coalesce(doc_id in (select doc_id from labels where toxic = 1), false) as toxic from d),
g as (select part, x, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from f group by 1, 2),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as c, unnest([1, 2, 3, 4, 5]) as i),
o as (select l1.c || l2.c || l3.c || l4.c || l5.c as filter_order, [l1.i, l2.i, l3.i, l4.i, l5.i] as s from l l1, l l2, l l3, l l4, l l5 where len(list_distinct([l1.i, l2.i, l3.i, l4.i, l5.i])) = 5),
st as (select filter_order, s, unnest([1, 2, 3, 4, 5]) as step from o),
r as (select part, filter_order, step, s[step] as i, n, n_good, n_toxic, x[s[step]] as own, len(list_filter(s[1:step - 1], lambda j : x[j])) > 0 as before, len(list_filter(x, lambda y : y)) as fails from g, st),
a as (select part, filter_order, cast(step as integer) as step, i, coalesce(sum(n) filter (not own and not before), 0) as kept, coalesce(sum(n) filter (own and not before), 0) as removed,
 coalesce(sum(n) filter (own and before), 0) as redundant, coalesce(sum(n) filter (own and fails = 1), 0) as unique_fails,
 coalesce(sum(n_good) filter (own and not before), 0) as good_lost, coalesce(sum(n_toxic) filter (own and not before), 0) as toxic_lost from r group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
 cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, i) as bigint) as shapley from a"""

OP11 = f"""
with recursive tab as (select list_transform(range(256), lambda i : list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, x : xor(c >> 1, (c & 1) * 3988292384), i)) as tab),
r as (select cast(doc_id as string) as d, unnest(regexp_extract_all({LOWER}, '[A-Za-zÀ-ÿ]+')) as w from documents),
o as (select d, w, count(*) as n, hex(encode(concat(d, ':', w))) as x from r where length(w) >= 7 group by d, w),
h as (select w, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i : cast('0x' || substr(x, 2 * i + 1, 2) as bigint)),
 lambda c, b : xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) as h from o, tab),
e as (select case when h % 31 = 0 then concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) else w end as w, n from h),
v as (select w, cast(sum(n) as bigint) as n from e where length(w) >= 7 group by 1 having sum(n) >= 2),
p as (select w, n, unnest(range(1, length(w) + 1)) as i from v),
cut as (select w, n, i, concat(substr(w, 1, i - 1), substr(w, i + 1)) as k from p),
m as (select a.w, b.w as near, b.n from cut a join cut b on a.i = b.i and a.k = b.k and a.w <> b.w
 union select c.w, v.w, v.n from cut c join v on c.k = v.w union select v.w, c.w, c.n from cut c join v on c.k = v.w),
b as (select w, count(*) as n_near, arg_min(near, {{'a': -n, 'b': near}}) as near, max(n) as near_n from (select distinct w, near, n from m) group by 1),
f as (select v.w as word, case when near_n >= 10 * v.n then near end as form, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * v.n then near_n end as form_n from v left join b using (w)),
path as (select word, word as root, 0 as k from f union all select path.word, f.form, k + 1 from path join f on f.word = path.root where f.form is not null)
select word, form, root, n, n_near, form_n from f join (select word, arg_max(root, k) as root from path group by 1) using (word)"""


def op2() -> str:
    rates = {
        "symbols_per_word": "cast(n_symbols as double) / greatest(n_words, 1)", "repeated_lines": "cast(n_dup_lines as double) / greatest(n_lines, 1)",
        "repeated_words": "cast(n_repeat_words as double) / greatest(n_words, 1)", "chars_per_word": "cast(word_chars as double) / greatest(n_words, 1)",
    }
    tried = " union all ".join(
        f"select stratum, '{rule}' as rule, {i} as step, cast({c} as double) as cutoff, count(*) as n, count(*) filter (where {rates[rule]} > {c}) as k from good group by 1"
        for rule, cs in quality_rules.CUTOFFS.items()
        for i, c in enumerate(cs)
    )
    share = quality_rules.RISK / len(quality_rules.CUTOFFS)
    symbols = " + ".join(f"(length(t) - length(replace(t, '{x}', '')))" for x in quality_rules.SYMBOLS)
    above = " or ".join(f"coalesce({rate} > (select cutoff from chosen c where c.stratum = st.stratum and rule = '{rule}'), false)" for rule, rate in rates.items())
    return f"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {WORD}) as w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
x as (select doc_id, w[p:p + 2] as k, p from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from d where len(w) > 2)),
z as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) as m from x) where m > 1),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from z) group by 1),
base as (select doc_id, stratum, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x : length(x))), 0) as bigint) as word_chars,
 cast({symbols} as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words, len(ls) as n_lines from d left join r using (doc_id)),
st as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
good as (select * from st where not base_failed and doc_id in (select doc_id from labels group by 1 having min(quality) = 1)),
tried as ({tried}),
j as (select *, (select count(distinct stratum) from good) as strata from tried),
tail as (select stratum, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))) as p from (select *, unnest(range(0, k + 1)) as i from j) group by 1, 2, 3),
ok as (select j.*, k <= n * {share} and p <= {quality_rules.ERROR / len(quality_rules.CUTOFFS)} / strata as ok from j join tail using (stratum, rule, step)),
chosen as (select stratum, rule, min(cutoff) as cutoff from ok where step < coalesce((select min(step) from ok o where o.stratum = ok.stratum and o.rule = ok.rule and not o.ok), 1000) group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({above}) as kept from st"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": op2(), "op3_decontamination": OP3, "op6_jaccard_join": OP6, "op11_spelling_variants": OP11, "op12_filter_audit": OP12}
