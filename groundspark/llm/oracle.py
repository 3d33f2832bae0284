"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, verdict

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

MIXING = f"""
with d as (select doc_id, source, {_WORDS} as w from documents),
z as (
  select doc_id, source, len(w) as size, greatest(0.05::double, case when len(w) > 0 then len(list_distinct(w)) / pow(len(w), 0.75) else 0 end) as weight,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/17'), 1, 13))::bigint + 0.5::double) / 4503599627370496 as u from d),
s as (select source, sum(size)::bigint as source_size from z group by 1),
k as (select *, row_number() over (order by source asc nulls last) as k, 3::double * source_size as most from s),
h as (select *, ([1, 2, 3][(k - 1) % 3 + 1])::double as share from k),
o as (
  select *, coalesce(sum(most) over (order by most / share, k rows between unbounded preceding and 1 preceding), 0) as spent,
    sum(share) over (order by most / share, k rows between current row and unbounded following) as free, sum(source_size) over () as everything from h),
l as (select *, (everything - spent) / free as level from o),
t as (select k, source, source_size, least(most, share * max(level) over ()) as target from l),
r as (
  select z.doc_id, z.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
    sum(z.size) over (partition by t.k order by -ln(z.u) / z.weight, z.doc_id, z.size rows unbounded preceding) - z.size / 2 as middle
  from z join t on z.source is not distinct from t.source),
c as (select *, case when size > 0 then epochs::bigint + (middle <= target - epochs * source_size)::int else 0 end as copies from r)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies::bigint as copies from c
"""

QUALITY = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
g as (select r, i, list_slice(w, i, i + 7) as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
p as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
c as (select r, count(distinct j) as n_repeat_words from (select r, unnest(range(i, i + 8)) as j from p) group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
m as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(l) as n_lines, len(list_filter(w, lambda x: lower(x) in ({_STOP}))) as n_stop_words
  from d join l using (r) left join c using (r)),
v as (
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    coalesce(word_chars / nullif(n_words, 0)::double, 0) as mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0)::double, 0) as symbol_ratio, coalesce(n_stop_words / nullif(n_words, 0)::double, 0) as stop_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0) as dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0)::double, 0) as repeat_word_ratio from m)
select *, not base_failed and {verdict(RULES).replace("D)", "::double)")} as kept from v
"""

ORACLE_SQL = {"op3_mixing": MIXING, "op10_quality_rules": QUALITY}
