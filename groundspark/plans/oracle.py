"""DuckDB SQL that states what each registered query returns."""

from __future__ import annotations

from groundspark.functions.text import STOPWORDS

_TOKEN = r"([\p{L}\p{N}_](?:[\p{L}\p{N}_$%.\-]*[\p{L}\p{N}_])?)"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{_TOKEN}', 1)"


def _lemma(t: str) -> str:
    t = f"trim(lower({t}), '.,;:!?()[]{{}}''\"')"
    return (
        f"case when {t} like '$%' then '$' || regexp_replace(substr({t}, 2), '[^\\p{{Nd}}]', '', 'g') "
        f"when {t} like '%\\%' escape '\\' then regexp_replace({t}, '[^\\p{{Nd}}.]', '', 'g') || '%' "
        f"when regexp_full_match({t}, '[-+]?\\p{{Nd}}[\\p{{Nd}},]*\\.?\\p{{Nd}}*') then replace({t}, ',', '') "
        f"when {t} like '%s' and length({t}) > 3 then left({t}, length({t}) - 1) "
        f"when {t} like '%ed' and length({t}) > 4 then left({t}, length({t}) - 2) "
        f"when {t} like '%ing' and length({t}) > 5 then left({t}, length({t}) - 3) else {t} end"
    )


def _terms(source: str, keys: str) -> str:
    inner = f"select {keys}, {_lemma('tok')} as term from (select {keys}, unnest({_tokens('text')}) as tok from {source})"
    return f"select {keys}, term, count(*) as cnt from ({inner}) where term not in ('', '$', '%', {_STOP}) and not regexp_full_match(term, '\\p{{Nd}}+') group by all"


_SENTENCES = r"""select trace_id, generate_subscripts(l, 1) - 1 as sentence, unnest(l) as text from (select trace_id, list_filter(string_split(regexp_replace(regexp_replace(a, '^\s+|\s+$', '', 'g'), '([.!?])\s+([A-Z0-9$])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') as l from tr)"""

TRACES = """tr as (
  select u.conv_id * 1000 + u.turn as trace_id, u.conv_id, u.turn, u.text as q, a.text as a
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'),
ctx as (
  select t.trace_id, row_number() over (partition by t.trace_id order by c.turn) - 1 as no, c.text
  from tr t join conversations c on c.conv_id = t.conv_id and c.role = 'assistant' and c.turn < t.turn),
size as (select t.trace_id, (select count(*) from ctx c where c.trace_id = t.trace_id) as n_ctx from tr t),
parts as (
  select trace_id, 'q' as part, 0 as no, q as text from tr union all
  select trace_id, 'a', 0, a from tr union all
  select trace_id, 'c', no, text from ctx)"""
PROFILE = f"""{TRACES}, terms as ({_terms("parts", "trace_id, part, no")}),
prof as (
  select t.trace_id, term, coalesce(sum(cnt) filter (part = 'a'), 0)::bigint as a, coalesce(sum(cnt) filter (part = 'q'), 0)::bigint as q,
    coalesce(sum(cnt) filter (part = 'c'), 0)::bigint as c, count(*) as df, ln((any_value(s.n_ctx) + 3.0) / (count(*) + 1.0)) + 1 as idf
  from terms t join size s using (trace_id) group by t.trace_id, term),
lex as (
  select trace_id, case when sum(idf * a) > 0 then sum(idf * least(a, c)) / sum(idf * a) else 0 end as precision_token,
    case when sum(idf * idf * a * a) > 0 and sum(idf * idf * q * q) > 0 then sum(idf * idf * a * q) / sqrt(sum(idf * idf * a * a) * sum(idf * idf * q * q)) else 0 end as cosine_tfidf,
    case when sum(idf * q) > 0 then sum(idf * least(a, q)) / sum(idf * q) else 0 end as answer_covers_question,
    sum(a) as a_len, sum(q) as q_len, count(*) filter (a > 0) as a_terms, count(*) filter (a > 0 and c = 0) as uns
  from prof group by trace_id)"""
BM25 = f"""{PROFILE},
len as (select x.trace_id, x.no, coalesce((select sum(cnt) from terms t where t.part = 'c' and t.trace_id = x.trace_id and t.no = x.no), 0)::bigint as dl from ctx x),
len2 as (select *, avg(dl) over (partition by trace_id) as avgdl from len),
hit as (
  select t.trace_id, t.no, sum(p.idf * t.cnt * 2.2 / (t.cnt + 1.2 * (0.25 + 0.75 * case when l.avgdl > 0 then l.dl / l.avgdl else 1 end))) as score
  from terms t join prof p on p.trace_id = t.trace_id and p.term = t.term and p.a > 0
  join len2 l on l.trace_id = t.trace_id and l.no = t.no where t.part = 'c' group by all),
bm as (select l.trace_id, l.no, coalesce(h.score, 0) as score, l.dl from len2 l left join hit h using (trace_id, no)),
best as (select trace_id, no as best_no, dl as best_context_len from (select *, row_number() over (partition by trace_id order by round(score, 12) desc, no) as r from bm) where r = 1),
rec as (
  select b.trace_id, b.best_no, b.best_context_len, case when coalesce(sum(p.idf * t.cnt), 0) > 0 then sum(p.idf * least(p.a, t.cnt)) / sum(p.idf * t.cnt) else 0 end as recall_context
  from best b left join terms t on t.part = 'c' and t.trace_id = b.trace_id and t.no = b.best_no
  left join prof p on p.trace_id = t.trace_id and p.term = t.term group by all)"""
SENT = f"""{PROFILE}, sen as ({_SENTENCES}), st as ({_terms("sen", "trace_id, sentence")}),
sp as (
  select s.trace_id, s.sentence, coalesce(any_value(x.p), 0) as precision from sen s left join (
    select st.trace_id, st.sentence, round(sum(p.idf * least(st.cnt, p.c)) / sum(p.idf * st.cnt), 4) as p
    from st join prof p using (trace_id, term) group by all) x using (trace_id, sentence) group by all)"""
UNS = f"""{PROFILE}, uns as (
  select trace_id, term, a as cnt, round(idf, 4) as idf, round(round(a * idf, 10), 4) as impact,
    row_number() over (partition by trace_id order by round(a * idf, 10) desc, term) as rank from prof where a > 0 and c = 0),
sup as (
  select trace_id, term, a as cnt, round(idf, 4) as idf,
    row_number() over (partition by trace_id order by round(a * idf, 10) desc, term) as rank from prof where a > 0 and c > 0)"""
SCORED = "sc as (select doc_id, lang as answer_type, quality as y, (n_chars % 97) / 97.0::double as p from documents join labels using (doc_id))"
FEATURES = """ft as (select doc_id, n_chars::double as chars, (doc_id % 7)::double as phase, length(lang)::double as lang_len, (n_chars * 2 + 1)::double as chars2,
  quality::double as quality, quality as y from documents join labels using (doc_id))"""
CURVE = f"""{SCORED}, byp as (select p, sum(y) as pos, count(*) as n from sc group by p),
cv as (
  select p, pos, n, sum(pos) over w as tp, sum(n) over w - sum(pos) over w as fp, sum(pos) over w / (sum(n) over w)::double as precision,
    coalesce(sum(pos) over w / nullif(sum(pos) over (), 0)::double, 0) as recall
  from byp window w as (order by p desc rows between unbounded preceding and current row))"""
PRED = f"""{SCORED}, pr as (select *, case when y = 1 and p >= 0.5 then 'TP' when y = 0 and p >= 0.5 then 'FP' when y = 1 then 'FN' else 'TN' end as outcome from sc),
co as (
  select outcome, 'lex.a' as feature, ((doc_id * 7) % 201 - 100) / 100.0::double as contribution from pr union all
  select outcome, 'lex.b', ((doc_id * 13) % 201 - 100) / 100.0::double from pr union all
  select outcome, 'num.c', ((doc_id * 29) % 201 - 100) / 100.0::double from pr)"""

_KINDS = "'list', 'fact', 'abstain', 'numeric', 'inference', 'comparison'"
_NAMES = ["chars", "phase", "lang_len", "chars2", "quality"]
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]
_COEF = {"chars": 0.001, "phase": -0.5, "lang_len": 0.25, "chars2": -0.0004, "quality": 1.5}

ORACLE_SQL = {
    "tokens": f"with {TRACES} select trace_id, part, no, len({_tokens('text')}) as n_tokens, len(list_distinct({_tokens('text')})) as n_distinct from parts",
    "lemma_counts": f"with {TRACES}, t as ({_terms('parts', 'trace_id')}) select term, sum(cnt)::bigint as cnt, count(*) as n_traces from t group by term",
    "idf": f"with {PROFILE} select trace_id, term, df, round(idf, 6) as idf from prof",
    "precision_token": f"with {PROFILE} select trace_id, round(precision_token, 4) as precision_token from lex",
    "qa_cosine": f"with {PROFILE} select trace_id, round(cosine_tfidf, 4) as cosine_tfidf, round(answer_covers_question, 4) as answer_covers_question from lex",
    "bm25_scores": f"with {BM25} select trace_id, no, round(score, 6) as score from bm",
    "bm25_best_context": f"with {BM25} select trace_id, best_no, best_context_len from best",
    "recall_best_context": f"with {BM25} select trace_id, round(recall_context, 4) as recall_context from rec",
    "sentences": f"with {TRACES}, sen as ({_SENTENCES}) select trace_id, sentence, text from sen",
    "sentence_precision": f"with {SENT} select trace_id, sentence, precision from sp",
    "sentence_buckets": f"""with {SENT}, v as (select trace_id, list_sort(list(precision)) as v, sum(round(precision * 10000)::bigint) as m from sp group by trace_id)
        select trace_id, len(v) as n_sentences, v[1] as min_sentence_precision, ((2 * m + len(v)) // (2 * len(v))) / 10000 as mean_sentence_precision, v[floor(0.9 * (len(v) - 1))::int + 1] as p90_sentence_precision,
        round(len(list_filter(v, lambda x: x < 0.3)) / len(v), 4) as low_frac, round(len(list_filter(v, lambda x: x >= 0.3 and x < 0.6)) / len(v), 4) as medium_frac, round(len(list_filter(v, lambda x: x >= 0.6)) / len(v), 4) as high_frac from v""",
    "unsupported_terms": f"with {UNS} select trace_id, term, cnt, idf, impact, rank from uns",
    "supported_terms": f"with {UNS} select trace_id, term, cnt, idf, rank from sup",
    "unsupported_extras": f"""with {UNS}, tp as (select trace_id, sum(impact) as top, count(*) as k from uns where rank <= 5 group by 1),
        sk as (select s.trace_id, sum(s.cnt * s.idf) as sup from sup s join tp using (trace_id) where s.rank <= k group by 1)
        select trace_id, round(greatest(0, least(1, 1 - precision_token)), 4) as unsupported_mass, round(coalesce(top, 0), 4) as unsupported_topk_impact, coalesce(k, 0) as unsupported_topk_count,
        round(case when a_terms > 0 then uns / a_terms else 0 end, 4) as unsupported_term_rate, round(coalesce(sup, 0), 4) as supported_topk_impact from lex left join tp using (trace_id) left join sk using (trace_id)""",
    "quickwins": f"""with {BM25}, raw as (select trace_id, sum(len({_tokens("text")})) as raw from ctx group by 1)
        select s.trace_id, s.n_ctx as num_contexts, round(case when s.n_ctx > 0 then raw / s.n_ctx else 0 end, 4) as avg_ctx_len_tokens, coalesce(q_len, 0)::bigint as q_len, coalesce(a_len, 0)::bigint as a_len,
        round(coalesce(a_len, 0) / greatest(1, coalesce(q_len, 0)), 4) as qa_len_ratio, coalesce(best_context_len, 0)::bigint as best_context_len, round(coalesce(precision_token * recall_context, 0), 4) as best_context_share
        from size s left join lex using (trace_id) left join rec using (trace_id) left join raw using (trace_id)""",
    "simple_scores": rf"""with {TRACES}, j as (select t.trace_id, any_value(t.q) as q, any_value(t.a) as a, coalesce(string_agg(c.text, ' ' order by c.no), '') as c from tr t left join ctx c using (trace_id) group by 1),
        n as (select trace_id, list_distinct(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}_]+')) as aw, list_distinct(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]+')) as cw,
          len(regexp_extract_all(a, '[^\s]+')) as na, len(regexp_extract_all(c, '[^\s]+')) as nc, len(regexp_extract_all(q, '[^\s]+')) as nq from j)
        select trace_id, round(case when len(aw) > 0 then len(list_intersect(aw, cw)) / len(aw) else 0 end, 4) as faithfulness,
        case when na > 10 and nc > 50 then 'High' when na > 5 and nc > 20 then 'Medium' else 'Low' end as confidence,
        round(case when na = 0 or nq = 0 then 0 else least(1, na / case when nq < 5 then 20 else 30 end) end, 4) as completeness from n""",
    "inference_signal": f"""with {PROFILE}, v as (select trace_id, precision_token as p, greatest(case trace_id % 3 when 0 then 1.0 when 1 then 0.95 else 0 end::double, 0.5::double) as t, cosine_tfidf + 0.35::double as c from lex),
        s as (select trace_id, case when p < 0.45 and t >= 0.9 and c >= 0.35::double then least(1.0::double, 0.5 * (1 - p) + 5.0 * (t - 0.9::double)) else 0 end as s from v)
        select trace_id, round(s, 4) as inference_score, s >= 0.5 as inference_likely from s""",
    "pr_curve": f"with {CURVE} select round(p, 6) as p, round(precision, 6) as precision, round(recall, 6) as recall from cv",
    "pr_threshold": f"""with {CURVE}, pt as (select p, precision, recall from cv union all select 1.0, 1.0, 0.0), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as score from pt)
        select round(p, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(score, 6) as score from f order by round(f.score, 12) desc, f.p limit 1""",
    "average_precision": f"with {CURVE} select round(sum(precision * pos) / sum(pos), 6) as average_precision from cv",
    "roc_auc": f"with {SCORED} select round(avg(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end), 6) as roc_auc from sc a, sc b where a.y = 1 and b.y = 0",
    "brier": f"with {SCORED} select round(avg((p - y) * (p - y)), 6) as brier from sc",
    "metrics_by_type": f"""with {SCORED}, c as (select answer_type, count(*) as support, count(*) filter (p >= 0.5 and y = 1) as tp, count(*) filter (p >= 0.5 and y = 0) as fp, count(*) filter (p < 0.5 and y = 1) as fn from sc group by 1)
        select answer_type, support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c""",
    "dataset_stats": f"""with {SCORED}, k as (select case answer_type when 'en' then 'fact' when 'de' then '' else answer_type end as t, y from sc)
        select case when t = '' then 'unknown' when t in ({_KINDS}) then t else 'other' end as answer_type, count(*) as total, sum(y)::bigint as positives from k group by 1""",
    "zero_variance": "with " + FEATURES + " " + " union all ".join(f"select '{f}' as feature, round(var_pop({f}), 4) as var_pop, max({f}) - min({f}) <= 1e-12 as constant from ft" for f in _NAMES),
    "feature_corr": "with " + FEATURES + " " + " union all ".join(f"select '{f}' as feature, round(case when max({f}) = min({f}) then 0 else corr({f}, y) end, 6) + 0.0::double as r from ft" for f in _NAMES),
    "corr_pairs": "with " + FEATURES + ", r as (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, case when max({a}) = min({a}) or max({b}) = min({b}) then 0 else corr({a}, {b}) end as r from ft" for a, b in _PAIRS) + ") select feature_a, feature_b, round(r, 6) as r from r where abs(r) >= 0.9",
    "outcome_counts": f"with {PRED} select outcome, case when answer_type in ({_KINDS}) then answer_type else 'other' end as answer_type, count(*) as n from pr group by all",
    "contribution_stats": f"""with {PRED} select feature, count(*) filter (contribution >= 0) as positive, round(sum(contribution) filter (contribution >= 0), 4) as positive_sum, count(*) filter (contribution < 0) as negative,
        round(sum(contribution) filter (contribution < 0), 4) as negative_sum, round(avg(contribution), 6) as average from co where outcome <> 'TN' group by feature""",
    "prefix_rollup": f"with {PRED} select string_split(feature, '.')[1] as prefix, count(*) filter (contribution >= 0) as positive, count(*) filter (contribution < 0) as negative, round(avg(contribution), 5) as average from co where outcome <> 'TN' group by 1",
    "impact_matrix": f"""with {PRED}, m as (select feature, coalesce(avg(contribution) filter (outcome = 'TP'), 0) as t, coalesce(avg(contribution) filter (outcome = 'FN'), 0) as f from co group by feature),
        x as (select *, max(greatest(abs(t), abs(f))) over () as s from m)
        select feature, round(t, 6) as avg_tp, round(f, 6) as avg_fn, round(t / s, 6) as norm_tp, round(f / s, 6) as norm_fn, round(round(t / s - f / s, 10), 6) as score, row_number() over (order by round(t / s - f / s, 10) desc, feature) as rank from x""",
    "top_contributions": "with " + FEATURES + ", u as (" + " union all ".join(f"select doc_id, '{f}' as feature, {f} * {c}::double as contribution from ft" for f, c in _COEF.items()) + """)
        select doc_id, place, feature, round(contribution, 6) as contribution from (select *, row_number() over (partition by doc_id order by abs(contribution) desc, feature) - 1 as place from u) where place < 2""",
    "reproject": f"with {FEATURES} select doc_id, quality, 0.0::double as absent, chars from ft",
    "merge_features": f"with {FEATURES} select doc_id, chars, lang_len, quality, y from ft where y = 1 union all select doc_id, chars, lang_len, quality, y from ft where y = 0",
    "cosine_topk": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (
        select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
        select query_id, vec_id, cosine, rank from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from s) where rank <= 5""",
}

RENDERED = """o as (select o_orderkey as k, round(o_totalprice * 100)::bigint as cents, o_orderdate::date as day from orders),
v as (select *, case when k % 3 = 0 then 1 else 0 end as m, case when k % 4 = 0 then 1 else 0 end as d, case when k % 5 = 0 then 1 else 0 end as w from o)"""
ORACLE_SQL |= {
    "money_entities": f"with {RENDERED} select k as trace_id, cents, 'USD' as currency from v",
    "date_entities": f"with {RENDERED} select k as trace_id, strftime(day, '%Y-%m-%d') as iso from v",
    "percent_entities": f"with {RENDERED} select k as trace_id, k % 30 + 1 as percent from v",
    "quantity_entities": f"with {RENDERED} select k as trace_id, k % 40 + 2 as weight, 'kg' as unit from v",
    "entity_spans": f"""with {RENDERED}, s as (select k, '$' || format('{{:,}}', cents // 100) || '.' || lpad((cents % 100)::varchar, 2, '0') as surface from v)
        select k as trace_id, surface, length('Order  cost ') + length(k::varchar) as start, length('Order  cost ') + length(k::varchar) + length(surface) as end from s""",
    "numeric_match": f"with {RENDERED} select k as trace_id, round((3 - m) / 3.0::double, 4) as numeric_match from v",
    "entity_coverage": f"with {RENDERED} select k as trace_id, round((5 - m - d - w) / 5.0::double, 4) as overall, (m + d + w)::bigint as n_unsupported from v",
    "relative_weekday": """select o_orderkey, strftime(o_orderdate::date + ((5 - isodow(o_orderdate::date) - 1 + 7) % 7 + 1)::int, '%Y-%m-%d') as next_friday,
        strftime(o_orderdate::date - ((isodow(o_orderdate::date) - 5 - 1 + 7) % 7 + 1)::int, '%Y-%m-%d') as last_friday from orders""",
    "entity_report": f"""with {RENDERED} select k as trace_id, round((3 - m) / 3.0::double, 4) as numeric_match, round((5 - m - d - w) / 5.0::double, 4) as entity_overall, m::bigint as unsupported_numeric_count,
        (m + d + w)::bigint as unsupported_entity_count, (5 - m - d - w)::bigint as n_supported, (1 - m)::int as all_money, 1::int as all_percent, (1 - d)::int as all_date, (1 - w)::int as all_quantity from v""",
    "stratified_folds": f"with {SCORED} select doc_id, y, ((row_number() over (partition by y order by md5(doc_id || '/42'), doc_id) - 1) % 5)::int as fold from sc",
    "sentence_unsupported": f"with {SENT} select st.trace_id, st.sentence, st.term, st.cnt, round(round(st.cnt * p.idf, 10), 4) as impact from st join prof p using (trace_id, term) where p.c = 0",
    "best_context_plain": f"""with {BM25}, w as (
        select t.trace_id, t.no, sum(p.idf * least(t.cnt, p.a)) / sum(p.idf * t.cnt) as p from terms t join prof p using (trace_id, term) where t.part = 'c' group by all)
        select trace_id, no as best_no, dl as best_context_len from (
          select l.trace_id, l.no, l.dl, row_number() over (partition by l.trace_id order by round(coalesce(w.p, 0), 12) desc, l.no) as r from len2 l left join w using (trace_id, no)) where r = 1""",
    "semantic_metrics": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
        j as (select q.vec_id as k, list_cosine_similarity(q.v, a.v) as qa, list_cosine_similarity(a.v, c.v) as s0, list_cosine_similarity(a.v, d.v) as s1
          from e q join e a on a.vec_id = q.vec_id + 1 join e c on c.vec_id = q.vec_id + 2 join e d on d.vec_id = q.vec_id + 3),
        f as (select k, round(qa, 4) as cos, round(greatest(s0, s1), 4) as best, round((s0 + s1) / 2, 4) as mean, (k % 11) / 11 as p, (k % 7) / 7 as cov, k % 2 * 3 as n, k % 9 as len, case when k % 3 > 0 then (k % 5) / 5 end as ov from j)
        select k as trace_id, cos as cosine_embed, best as best_context_similarity, mean as answer_context_similarity, round(best / nullif(n, 0), 4) as per_sentence_semantic_alignment,
          round(case when cos > 0 then p / cos end, 4) as answer_novelty_ratio, round(mean * p / greatest(1, len), 4) as semantic_gap, round(greatest(0, cov - best), 4) as qa_context_coverage_gap,
          round(case when cos > 1e-6 then least(1, p / cos) end, 4) as inference_sem_score from f""",
    "pr_auc_by_type": f"""with {SCORED}, c as (select answer_type, count(*) as support, count(*) filter (p >= 0.5 and y = 1) as tp, count(*) filter (p >= 0.5 and y = 0) as fp, count(*) filter (p < 0.5 and y = 1) as fn, sum(y) as pos, count(*) as n from sc group by 1),
        b as (select answer_type, p, sum(y) as pos, count(*) as n from sc group by all), s as (select answer_type, pos, sum(pos) over w / (sum(n) over w)::double as precision from b window w as (partition by answer_type order by p desc rows between unbounded preceding and current row)),
        ap as (select answer_type, sum(precision * pos) as x from s group by 1)
        select c.answer_type, support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
          round(case when pos > 0 and pos < n then x / pos end, 6) as pr_auc from c join ap using (answer_type)""",
    "top_coefficients": "select direction, rank::bigint as rank, feature, coefficient::double as coefficient from (values ('positive', 1, 'quality', 1.5), ('positive', 2, 'lang_len', 0.25), ('negative', 1, 'phase', -0.5), ('negative', 2, 'chars2', -0.0004)) t(direction, rank, feature, coefficient)",
    "canonical_dates": "select o_orderkey, strftime(o_orderdate::date, '%Y-%m-%d') as day from orders",
}

#: All that follows from texts alone, one row a trace; null where there are no contexts.
REPORT = rf"""{BM25},
sen as ({_SENTENCES}), st as ({_terms("sen", "trace_id, sentence")}),
sp as (
  select s.trace_id, s.sentence, coalesce(any_value(x.p), 0) as precision from sen s left join (
    select st.trace_id, st.sentence, round(sum(p.idf * least(st.cnt, p.c)) / sum(p.idf * st.cnt), 4) as p
    from st join prof p using (trace_id, term) group by all) x using (trace_id, sentence) group by all),
sv as (select trace_id, list_sort(list(precision)) as v, sum(round(precision * 10000)::bigint) as m from sp group by trace_id),
uns as (
  select trace_id, term, round(round(a * idf, 10), 4) as impact, row_number() over (partition by trace_id order by round(a * idf, 10) desc, term) as rank from prof where a > 0 and c = 0),
sup as (
  select trace_id, term, a as cnt, round(idf, 4) as idf, row_number() over (partition by trace_id order by round(a * idf, 10) desc, term) as rank from prof where a > 0 and c > 0),
tp as (select trace_id, sum(impact) as top, count(*) as k from uns where rank <= 5 group by 1),
sk as (select s.trace_id, sum(s.cnt * s.idf) as sup from sup s join tp using (trace_id) where s.rank <= k group by 1),
raw as (select trace_id, sum(len({_tokens("text")})) as raw from ctx group by 1),
j as (select t.trace_id, any_value(t.q) as q, any_value(t.a) as a, coalesce(string_agg(c.text, ' ' order by c.no), '') as c from tr t left join ctx c using (trace_id) group by 1),
nw as (select trace_id, list_distinct(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}_]+')) as aw, list_distinct(regexp_extract_all(lower(c), '[\p{{L}}\p{{N}}_]+')) as cw,
  len(regexp_extract_all(a, '[^\s]+')) as na, len(regexp_extract_all(c, '[^\s]+')) as nc, len(regexp_extract_all(q, '[^\s]+')) as nq from j),
rp as (
  select s.trace_id, n_ctx = 0 as alone, round(coalesce(precision_token, 0), 4) as precision_token, round(coalesce(recall_context, 0), 4) as recall_context, round(coalesce(cosine_tfidf, 0), 4) as cosine_tfidf,
    round(coalesce(answer_covers_question, 0), 4) as answer_covers_question, coalesce(len(v), 0) as n_sentences, v[1] as min_sentence_precision, ((2 * m + len(v)) // (2 * len(v))) / 10000 as mean_sentence_precision,
    v[floor(0.9 * (len(v) - 1))::int + 1] as p90_sentence_precision, round(len(list_filter(v, lambda x: x < 0.3)) / len(v), 4) as low_frac, round(len(list_filter(v, lambda x: x >= 0.3 and x < 0.6)) / len(v), 4) as medium_frac,
    round(len(list_filter(v, lambda x: x >= 0.6)) / len(v), 4) as high_frac, round(greatest(0, least(1, 1 - coalesce(precision_token, 0))), 4) as unsupported_mass, round(coalesce(top, 0), 4) as unsupported_topk_impact,
    coalesce(k, 0)::bigint as unsupported_topk_count, round(case when a_terms > 0 then uns / a_terms else 0 end, 4) as unsupported_term_rate, coalesce(uns, 0)::bigint as unsupported_term_count, round(coalesce(sup, 0), 4) as supported_topk_impact,
    n_ctx as num_contexts, round(case when n_ctx > 0 then raw / n_ctx else 0 end, 4) as avg_ctx_len_tokens, coalesce(q_len, 0)::bigint as q_len, coalesce(a_len, 0)::bigint as a_len, round(coalesce(a_len, 0) / greatest(1, coalesce(q_len, 0)), 4) as qa_len_ratio,
    coalesce(best_context_len, 0)::bigint as best_context_len, round(coalesce(precision_token * recall_context, 0), 4) as best_context_share,
    round(case when len(aw) > 0 then len(list_intersect(aw, cw)) / len(aw) else 0 end, 4) as faithfulness, case when na > 10 and nc > 50 then 'High' when na > 5 and nc > 20 then 'Medium' else 'Low' end as confidence,
    round(case when na = 0 or nq = 0 then 0 else least(1, na / case when nq < 5 then 20 else 30 end) end, 4) as completeness
  from size s left join lex using (trace_id) left join rec using (trace_id) left join sv using (trace_id) left join tp using (trace_id) left join sk using (trace_id) left join raw using (trace_id) join nw using (trace_id))"""
_ALWAYS = ("cosine_tfidf", "answer_covers_question", "n_sentences", "faithfulness", "confidence", "completeness")
_FEATURES = ("precision_token", "recall_context", "unsupported_topk_impact", "unsupported_topk_count", "unsupported_term_rate", "supported_topk_impact", "q_len", "a_len", "best_context_len", "best_context_share", "min_sentence_precision", "mean_sentence_precision", "p90_sentence_precision", "low_frac", "medium_frac", "high_frac", "unsupported_term_count")


def _report_columns(names) -> str:
    return ", ".join(n if n in _ALWAYS else f"case when not alone then {n} end as {n}" for n in names)


def report_sql(names) -> str:
    """The columns of a report that follow from texts alone."""
    return f"with {REPORT} select trace_id, {_report_columns(names)} from rp"


ORACLE_SQL |= {
    "lexical_features": f"with {REPORT} select trace_id, "
    + ", ".join(f"coalesce(case when not alone then {n} end, 0)::double as {n}" for n in _FEATURES)
    + """, cosine_tfidf::double as "qr_alignment.cosine_tfidf", answer_covers_question::double as "qr_alignment.answer_covers_question", 0.0::double as "qr_alignment.cosine_embed", 0.0::double as "qr_alignment.answer_covers_question_sem",
        len(list_distinct(coalesce((select list(term) from uns u where u.trace_id = rp.trace_id), [])))::double as unsupported_terms__len from rp""",
}


def grounding_report() -> str:
    from groundspark.plans.queries import LEXICAL

    return report_sql(LEXICAL)


ORACLE_SQL["grounding_report"] = grounding_report()
