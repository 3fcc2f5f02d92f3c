"""DuckDB SQL for the queries of the catalogue."""

from __future__ import annotations

from .operators.cleaning import HEADLINE_BLOCK, NEXT_BLOCK, ROUTES, RULES, Rule
from .operators.lexicons import CERTAINTY, DEHUMANISATION, HEDGING, INGROUP, NOT_EPISTEMIC, OUTGROUP, OUTRAGE, TITLES, Term
from .operators.sentences import ASK, ASK_MOST, BOOST, BOOSTERS, CAPS, DAMPENERS, DEMO_VALENCE, EXCLAIM, EXCLAIM_MOST, NEGATED, NEGATIONS, NEVER_SO, NORMAL
from .queries import BOILERPLATE, PUT_FEELINGS, PUT_MARKERS

_WORDS = "len(regexp_extract_all(coalesce({0}, ''), '[^\\s\\x0B\\x{{85}}\\p{{Z}}]+'))"
_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_SINGLE = "['the','of','and','to','in','is','that','it','for','with']"
_PHRASE = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) // {1}"
_PHRASES = " + ".join(_PHRASE.format(p, len(p)) for p in ("licensed under", "of the"))
_HITS = f"""hits as (select doc_id, source, lang, {_WORDS.format('text')} n_words, len(list_filter({_TOKENS}, lambda t: list_contains({_SINGLE}, t))) a, len(list_filter({_TOKENS}, lambda t: t = 'idiot')) b, ({_PHRASES})::bigint c from documents)"""
_DATED = """dated as (select o_orderpriority outlet, o_orderdate::date d, o_totalprice price, (o_orderkey % 97)::double rest, case when o_orderkey % 5 > 0 then o_totalprice / 7 end sparse from orders)"""
_SERIES = """series as (select year(l_shipdate) y, quarter(l_shipdate) * 3 m, sum(l_quantity)::bigint net from lineitem group by all)"""
_ALIGNED = f"""{_DATED}, {_SERIES}, aligned as (select outlet, y, m, net, count(*) n_articles, round(avg(price), 10) price, round(avg(rest), 10) rest, round(avg(sparse), 10) sparse
 from dated join series on d between (make_date(y, m, 28) - interval 12 month + interval 1 day)::date and make_date(y, m, 28) group by all having count(*) >= 10)"""
_LONG = "long as (select outlet, y, m, net, feature, v from aligned unpivot (v for feature in (price, rest, sparse)))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(words: list[str]) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _with_words_put(put: dict[str, str]) -> str:
    """The text of ``documents`` with whole words replaced by others."""
    cases = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in put.items())
    return f"array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '\\p{{L}}+|\\P{{L}}+'), lambda x: case x {cases} else x end), '')"


def _markers() -> str:
    """Tokens with the token before each; counts, then rates and ratios."""
    split = f"regexp_replace({_with_words_put(PUT_MARKERS)}, '(?i)(\\p{{L}})(n''t|''ll|''re|''ve|''s|''d|''m)(\\P{{L}}|$)', '\\1 \\2\\3', 'g')"
    tokens = f"regexp_extract_all({split}, 'n''t|''\\p{{L}}+|\\p{{L}}+|[.!?\\n]|[^\\s\\p{{L}}.!?]+')"
    count = lambda words: f"len(list_filter(t, lambda x: lower(x) in {_listed(words)}))"
    modal = lambda word: f"len(list_filter(t, lambda x, i: lower(x) = '{word}' and (i = 1 or t[i - 1] in ('.', '!', '?', chr(10)) or not regexp_matches(x, '^\\p{{Lu}}') or lower(t[i - 1]) not in {_listed(TITLES)})))"
    counts = {
        "w": "len(list_filter(t, lambda x: regexp_full_match(x, '\\p{L}+')))", "c": count(CERTAINTY), "s": count([x for x in CERTAINTY if x not in NOT_EPISTEMIC]),
        "h": count(HEDGING), "may": modal("may"), "would": modal("would"), "i": count(INGROUP), "o": count(OUTGROUP),
    }
    said = ", ".join(f"{v} {k}" for k, v in counts.items())
    rate = lambda x: f"round(coalesce(({x}) * 1000.0::double / nullif(w, 0), 0), 4)"
    part = lambda x, y: f"round(({x})::double / nullif({y}, 0), 4)"
    return f"""with k as (select doc_id, {tokens} t from documents), n as (select doc_id, {said} from k)
        select doc_id, c modal_certainty_count, h + may + would modal_hedging_count, w modal_word_count, {rate('c')} modal_certainty_per1k, {rate('h + may + would')} modal_hedging_per1k,
        {part('c', 'c + h + may + would')} modal_certainty_ratio, {part('s', 's + h + may')} modal_epistemic_ratio, {rate('c - h - may - would')} modal_balance, {rate('s - h - may')} modal_epi_balance,
        i pron_ingroup_count, o pron_outgroup_count, {rate('i')} pron_ingroup_per1k, {rate('o')} pron_outgroup_per1k, {rate('i - o')} pron_inclusion_index, {part('i', 'i + o')} pron_ingroup_ratio from n"""


def _sentiment() -> str:
    """Words of sentences as rows that look up to three rows back; one step of the rules in each of the tables v0 to v4."""
    pieces = f"""list_filter(str_split_regex(regexp_replace({_with_words_put(PUT_FEELINGS)}, '([.!?])[\\s\\x0B\\x{{85}}\\p{{Z}}]+', concat('\\1', chr(10)), 'g'), '\\n+'), lambda s: {_WORDS.format('s')} >= 10)"""
    known = ", ".join(f"({_quoted(k)}, {v}::double)" for k, v in DEMO_VALENCE.items())
    boost = ", ".join([f"({_quoted(k)}, {BOOST}::double)" for k in BOOSTERS] + [f"({_quoted(k)}, -{BOOST}::double)" for k in DAMPENERS])
    marks = "[!-/:-@\\[-`{-~]+"
    step = lambda k, fade: f"""v{k - 1} + coalesce(case when k{k} is null and l{k} is not null then {fade} * (case when v{k - 1} < 0 then -b{k} else b{k} end
            + case when mixed and u{k} then case when v{k - 1} > 0 then {CAPS} else -{CAPS} end else 0 end) end, 0)"""  # noqa: E731
    no = lambda k: f"(l{k} in {_listed(NEGATIONS)} or contains(l{k}, 'n''t'))"
    turn = lambda k, between: f"case when l{k} is null or k{k} is not null then 1 {between} when {no(k)} then {NEGATED} else 1 end"
    two = f"when l2 = 'never' and l1 in ('so', 'this') then {NEVER_SO} when l2 = 'without' and l1 = 'doubt' then 1"
    three = f"when l3 = 'never' and (l1 in ('so', 'this') or l2 in ('so', 'this')) then {NEVER_SO} when l3 = 'without' and (l1 = 'doubt' or l2 = 'doubt') then 1"
    back = ", ".join(f"lag({c}, {k}) over o {c}{k}" for k in (1, 2, 3) for c in "lku")
    return f"""with s as (select doc_id, generate_subscripts(x, 1) s, unnest(x) said from (select doc_id, {pieces} x from documents)),
        w as (select doc_id, s, said, generate_subscripts(x, 1) i, unnest(x) raw from (select doc_id, s, said, regexp_extract_all(said, '[^\\s\\x0B\\x{{85}}\\p{{Z}}]+') x from s)),
        b as (select *, regexp_replace(regexp_replace(raw, '^{marks}', ''), '{marks}$', '') bare from w),
        t as (select * exclude (raw, bare), case when length(bare) <= 2 then raw else bare end word from b),
        known as (select * from (values {known}) x(term, v)), boost as (select * from (values {boost}) x(term, b)),
        r as (select t.*, lower(word) l, known.v k, word = upper(word) and word <> lower(word) u from t left join known on known.term = lower(word)),
        q as (select *, {back}, lead(l) over o n1, lead(k) over o nk, count_if(u) over p shouted, count(*) over p total, min(case when l = 'but' then i end) over p turn
            from r window o as (partition by doc_id, s order by i), p as (partition by doc_id, s)),
        h as (select q.*, 0 < shouted and shouted < total mixed, x1.b b1, x2.b b2, x3.b b3, coalesce(y2.b, 0) + coalesce(y3.b, 0) pairs from q left join boost x1 on x1.term = l1
            left join boost x2 on x2.term = l2 left join boost y2 on y2.term = concat(l2, ' ', l1) left join boost x3 on x3.term = l3 left join boost y3 on y3.term = concat(l3, ' ', l2) where k is not null),
        v0 as (select *, case when l1 = 'no' or l2 = 'no' or l3 = 'no' and l1 in ('or', 'nor') then k * {NEGATED} else k end base from h),
        v1 as (select *, base + case when mixed and u then case when base > 0 then {CAPS} else -{CAPS} end else 0 end v0 from v0),
        v2 as (select *, ({step(1, 1.0)}) * {turn(1, '')} v1 from v1), v3 as (select *, ({step(2, 0.95)}) * {turn(2, two)} v2 from v2), v4 as (select *, ({step(3, 0.9)}) * {turn(3, three)} + case when l3 is not null and k3 is null then pairs else 0 end v3 from v3),
        z as (select doc_id, s, said, sum(v3 * case when l1 = 'least' and coalesce(l2, '') not in ('at', 'very') then {NEGATED} else 1 end * case when turn is null or i = turn then 1 when i < turn then 0.5 else 1.5 end) v from v4 group by all),
        e as (select *, least(length(said) - length(replace(said, '!', '')), {EXCLAIM_MOST}) * {EXCLAIM} + case when n < 2 then 0 when n <= 3 then n * {ASK} else {ASK_MOST} end more from (select *, length(said) - length(replace(said, '?', '')) n from z)),
        c as (select s.doc_id, s.s, coalesce(round((v + sign(v) * more) / sqrt(pow(v + sign(v) * more, 2) + {NORMAL}), 4), 0) compound from s left join e using (doc_id, s)),
        g as (select doc_id, count(*) n, round(sum(compound) * 10000)::bigint total, count_if(compound >= 0.05) pos, count_if(compound <= -0.05) neg from c group by doc_id)
        select documents.doc_id, (sign(total) * ((2 * abs(total) + n) // (2 * n)))::double / 10000 sentiment_compound, round(pos / n, 4) sentiment_pos_ratio, round(neg / n, 4) sentiment_neg_ratio, round((n - pos - neg) / n, 4) sentiment_neu_ratio, coalesce(n, 0) sentiment_n_sentences
        from documents left join g using (doc_id)"""


def _t_p(t: str, df: str) -> str:
    angle, cos = f"atan(abs({t}) / sqrt({df}))", f"cos(atan(abs({t}) / sqrt({df})))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, greatest({df} // 2, 1)), lambda i: exp(lgamma(2 * i + 1) - 2 * lgamma(i + 1) - i * ln(4)) * pow({cos}, 2 * i)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * list_sum(list_transform(range(0, greatest(({df} - 1) // 2, 1)), lambda i: exp(i * ln(4) + 2 * lgamma(i + 1) - lgamma(2 * i + 2)) * pow({cos}, 2 * i + 1))))"
    return f"greatest(0, 1 - case when {df} = 1 then 2 * {angle} / pi() when {df} % 2 = 0 then {even} else {odd} end)"


def _rho(source: str, x: str, y: str, keys: str) -> str:
    """CTEs that end in ``cor``: keys, n, rho, p."""
    rank = lambda v: f"rank() over (partition by {keys} order by {v}) + (count(*) over (partition by {keys}, {v}) - 1) / 2.0"
    return f"""ranked as (select {keys}, {rank(x)} rx, {rank(y)} ry from {source} where {x} is not null and {y} is not null),
 cor0 as (select {keys}, count(*) n, case when min(rx) < max(rx) and min(ry) < max(ry) then round(corr(rx, ry), 12) end rho from ranked group by all having count(*) >= 5),
 cor1 as (select *, rho * sqrt((n - 2) / nullif((1 - rho) * (1 + rho), 0)) t from cor0),
 cor as (select {keys}, n, rho, case when abs(rho) >= 1 then 0 else {_t_p('t', '(n - 2)')} end p from cor1)"""


def _stars(p: str) -> str:
    return f"case when {p} <= 0.001 then '***' when {p} <= 0.01 then '**' when {p} <= 0.05 then '*' else '' end"


_SPEARMAN = f"{_ALIGNED}, {_LONG}, {_rho('long', 'v', 'net', 'outlet, feature')}"
_CLEAN = r"""cleaned as (select source, text, regexp_replace(case when source like '%src1%' then regexp_replace(regexp_replace(text, '(?i)\nlicensed under[^\n]*', '', 'g'), '[*#$%&]{3}', '', 'g')
 when source like '%src2%' then regexp_replace(regexp_replace(text, '!!', '', 'g'), '(?i)^the ', '', 'g') else text end, case when source like '%src1%' or source like '%src2%' then '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$' else '\A\z' end, '', 'g') body from documents)"""
_COMP = """comp0 as (select l_returnflag, subcategory, m from (select l_returnflag, avg(l_quantity) l_quantity, avg(l_discount) l_discount, avg(l_tax) l_tax from lineitem group by 1) unpivot (m for subcategory in (l_quantity, l_discount, l_tax))),
 comp as (select l_returnflag, subcategory, round(m, 4) mean_density, round(m / sum(m) over (partition by l_returnflag), 4) share from comp0)"""
_JUDGED = "judged as (select toxic, quality, contains(lower(text), 'idiot')::int rule from labels join documents using (doc_id))"
_STANCE = """stance as (select doc_id, pro, con, case when abs(pro - con) < 0.1 then 'neutral' when pro > con then 'pro' else 'anti' end stance_label
 from (select doc_id, (doc_id * 37) % 101 / 100.0::double pro, (doc_id * 53) % 89 / 88.0::double con from documents))"""
_F = lambda *names: ", ".join(f"round({n}, 5) {n}" for n in names)
_OLS = f"""{_ALIGNED}, rows as (select outlet, feature, v, net / 100000.0 x1, (y >= 1998)::int::double x2 from aligned unpivot (v for feature in (price, rest, sparse))),
 s as (select outlet, feature, count(*) n, covar_pop(x1, x1) * count(*) s11, covar_pop(x2, x2) * count(*) s22, covar_pop(x1, x2) * count(*) s12, covar_pop(x1, v) * count(*) s1y, covar_pop(x2, v) * count(*) s2y, covar_pop(v, v) * count(*) syy from rows group by all having count(*) >= 6),
 b as (select *, s11 * s22 - s12 * s12 det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2 from s),
 e as (select *, syy - b1 * s1y - b2 * s2y sse, n - 3 df from b), f as (select *, sse / df s2, 1 - sse / syy r2, b1 / sqrt(sse / df * s22 / det) t1 from e), g as (select *, {_t_p('t1', 'df')} p1 from f)"""

ORACLE_SQL: dict[str, str] = {
    "lexicon_density_by_source": f"with {_HITS} select source, count(*) n_docs, sum(a + b + c)::bigint hits, sum(n_words)::bigint n_words, round(avg(coalesce(round((a + b + c) / nullif(n_words / 1000.0, 0), 4), 0)), 4) density from hits group by source",
    "lexicon_wide_features": f"with {_HITS} select doc_id, n_words, a n_1, b + c n_2 from hits",
    "phrase_hits": f"with {_HITS} select lang, sum(c)::bigint hits from hits group by lang",
    "term_totals_by_language": f"select lang, term, case when term = 'idiot' then 2 else 1 end::int tier, count(*) hits from (select lang, unnest({_TOKENS}) term from documents) where list_contains({_SINGLE}, term) or term = 'idiot' group by all",
    "paged_articles": f"""select (2010 + doc_id % 10)::int "year", (doc_id % 12 + 1)::int "month", printf('%d-%02d-01T00:00:00Z', 2010 + doc_id % 10, doc_id % 12 + 1) date, concat('https://example.org/', doc_id) url, concat('Document ', doc_id) title,
        source section, {_WORDS.format('text')}::int wordcount, length(text) n_chars, md5(text) body_md5 from documents where {_WORDS.format('text')} >= 200""",
    "stream_first_rows": "select doc_id, lang, source, md5(coalesce(text, '')) text_md5 from documents qualify row_number() over (partition by coalesce(text, '') order by doc_id) = 1",
    "modal_pronoun_markers": _markers(),
    "sentence_sentiment": _sentiment(),
    "sentence_stats": f"""select doc_id, len(list_filter(str_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[\\s\\x0B\\x{{85}}\\p{{Z}}]+', concat('\\1', chr(10)), 'g'), '\\n+'), lambda s: {_WORDS.format('s')} >= 10)) n_sentences, {_WORDS.format('text')} n_words from documents""",
    "keyword_filter": "select source, count(*) n from documents where contains(lower(text), 'idiot') or contains(lower(text), 'licensed') or contains(lower(text), 'threat') group by source",
    "keyword_query_difference": "select n_first, n_second, round(d, 4) diff_pct, case when d < 5 then 'minor' when d < 15 then 'moderate' else 'large' end verdict from (select *, abs(100.0 * (n_second - n_first) / nullif(n_first, 0))::double d from (select count_if(contains(lower(text), 'idiot') or contains(lower(text), 'licensed'))::bigint n_first, count_if(contains(lower(text), 'idiot') or contains(lower(text), 'licensed') or contains(lower(text), 'threat'))::bigint n_second from documents))",
    "clean_rules_apply": f"with {_CLEAN} select source, sum({_WORDS.format('text')})::bigint words_before, sum({_WORDS.format('body')})::bigint words_after, sum(length(body))::bigint chars from cleaned group by source",
    "clean_by_file_name": f"""with d as (select doc_id, concat(coalesce(text, ''), chr(10), '- Bookmark', chr(10), 'READ MORE: more to read', chr(10), 'The reader', chr(8217), 's end') body,
        case when doc_id % 3 = 0 then 'guardian' else ['express', 'independent', 'guardian', 'star', null][doc_id % 5 + 1] end outlet from documents),
        c as (select doc_id, body, outlet, case outlet when 'express' then regexp_replace(body, '\\nREAD MORE:[^\\n]*', '', 'g') when 'independent' then replace(body, concat(chr(10), '- Bookmark'), '')
            when 'guardian' then replace(body, chr(8217), chr(39)) when 'star' then regexp_replace(body, '(?i)READ MORE: ?', '', 'g') else body end cleaned from d),
        e as (select *, regexp_replace(cleaned, case when outlet is null then '\\A\\z' else '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$' end, '', 'g') said from c)
        select doc_id, {_WORDS.format('body')} words_before, {_WORDS.format('said')} wordcount, md5(said) body_md5 from e""",
    "scores_by_batch": "select doc_id, round(len(list_filter(['idiot', 'licensed', 'threat', 'than', 'mment'], lambda k: contains(lower(substring(coalesce(text, 'nan'), 1, 512)), k))) / 5.0::double, 4) topic_score, 'keywords' model, coalesce(lang, '') batch from documents",
    "clean_word_delta": f"with {_CLEAN} select a words_before, b words_after, a - b words_removed, round(100.0 * (a - b) / nullif(a, 0), 4) removed_pct from (select sum({_WORDS.format('text')})::bigint a, sum({_WORDS.format('body')})::bigint b from cleaned)",
    "url_host_counts": "select regexp_extract(url, '^https?://([^/?#]+)', 1) host, count(*) n from pages group by 1",
    "dedup_first_text": "select doc_id, source from (select *, row_number() over (partition by text order by doc_id) r from documents) where r = 1",
    "resume_anti_join": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and (l.toxic = 1 or l.quality = 0))",
    "left_join_match_rate": "select count(*) n_rows, count(toxic) n_matched, round(count(toxic) / count(*), 6) match_rate from documents left join labels using (doc_id)",
    "union_by_name": "select lang, role, count(*) n, sum(length(text))::bigint chars from (select doc_id, text, lang from documents union all by name select conv_id, role, text from conversations) group by all",
    "outlet_names": "select ['guardian', 'mirror', 'express', 'independent'][o_orderkey % 4 + 1] outlet, count(*) n from orders group by 1",
    "rolling_12m_mean": f"with {_ALIGNED} select outlet, y::int quarter_end_year, m::int quarter_end_month, net net_migration, n_articles, {_F('price', 'rest', 'sparse')} from aligned",
    "fiscal_year_mean": f"with {_DATED}, {_SERIES}, years as (select y, sum(net)::bigint total from series group by y) select outlet, y::int fy_start_year, total race_hate_crimes, count(*) n_articles, {', '.join(f'round(avg({f}), 5) {f}' for f in ('price', 'rest', 'sparse'))} from dated join years on d between make_date(y, 4, 1) and make_date(y + 1, 3, 31) group by all having count(*) >= 10",
    "describe_by_group": f"with {_DATED} select outlet, feature, count(v) n, round(avg(v), 4) mean, round(stddev_samp(v), 4) std, round(quantile_cont(v, 0.5), 4) median, round(min(v), 4) min, round(max(v), 4) max, round(quantile_cont(v, 0.25), 4) q25, round(quantile_cont(v, 0.75), 4) q75 from dated unpivot (v for feature in (price, rest, sparse)) group by all",
    "annual_means": f"with {_DATED} select outlet, year(d)::int as year, count(*) n_articles, {', '.join(f'round(avg({f}), 4) {f}' for f in ('price', 'rest', 'sparse'))} from dated group by all",
    "composition_share": f"with {_COMP} select * from comp",
    "largest_share": f"with {_COMP} select l_returnflag, arg_max(subcategory, share) subcategory, max(share) share from comp group by 1",
    "pivot_shares": f"with {_COMP} select l_returnflag, max(share) filter (subcategory = 'l_quantity') l_quantity, max(share) filter (subcategory = 'l_discount') l_discount, max(share) filter (subcategory = 'l_tax') l_tax from comp group by 1",
    "stacked_shares": f"with {_COMP} select l_returnflag, subcategory, round(coalesce(sum(share) over (partition by l_returnflag order by list_position(['l_quantity', 'l_discount', 'l_tax'], subcategory) rows between unbounded preceding and 1 preceding), 0), 4) begins, share > 0.06 labelled from comp",
    "spearman_by_group": f"with {_SPEARMAN} select outlet, feature, 'net_migration' outcome, n, round(rho, 4) rho, round(p, 6) p_value, {_stars('p')} sig from cor",
    "top_abs": f"with {_SPEARMAN}, r as (select outlet, feature, round(rho, 4) rho from cor) select * from r order by abs(rho) desc, outlet, feature limit 10",
    "anova_tertiles": f"""with {_ALIGNED}, cuts as (select outlet, quantile_cont(net::double, 1/3) c1, quantile_cont(net::double, 2/3) c2 from aligned group by 1),
 cells as (select outlet, feature, case when net <= c1 then 'low' when net <= c2 then 'mid' else 'high' end g, count(*) n, avg(v) m, var_samp(v) s from (select outlet, net, feature, v from aligned unpivot (v for feature in (price, rest, sparse))) join cuts using (outlet) group by all),
 t as (select outlet, feature, sum(n)::bigint n, sum((n - 1) * s) ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) ssb0, {', '.join(f"max(m) filter (g = '{g}') m_{g}, max(s) filter (g = '{g}') s_{g}, max(n) filter (g = '{g}') n_{g}" for g in ('low', 'mid', 'high'))}, sum(n * m) / sum(n) mean, min(n) least, count(*) k from cells group by all),
 u as (select *, n_low * (m_low - mean) ** 2 + n_mid * (m_mid - mean) ** 2 + n_high * (m_high - mean) ** 2 ssb from t where n >= 9 and least >= 2 and k = 3), w as (select *, ssb / 2 / (ssw / (n - 3)) f, pow(1 + 2 * (ssb / 2 / (ssw / (n - 3))) / (n - 3), -(n - 3) / 2.0) p from u)
 select outlet, feature, 'net_migration' outcome, n, 2::int df_between, n - 3 df_within, round(f, 4) F, round(ssw / (n - 3), 2) MSE, round(ssb / (ssb + ssw), 4) partial_eta_sq, round(p, 6) p_value, {_stars('p')} sig, {', '.join(f'round(m_{g}, 4) mean_{g}' for g in ('low', 'mid', 'high'))}, {', '.join(f'round(sqrt(s_{g}), 4) sd_{g}' for g in ('low', 'mid', 'high'))} from w""",
    "ols_covariate": f"with {_OLS} select outlet, feature, n, round(r2, 4) r_squared, round(1 - (1 - r2) * (n - 1) / df, 4) adj_r_squared, round(round((syy - sse) / 2 / s2, 4), 3) F, df df_resid, round(round(b1, 6), 4) x1_beta, round(p1, 6) x1_p, {_stars('p1')} x1_sig, p1 < 0.05 x1_survives from g",
    "detrended_spearman": f"with {_ALIGNED}, o as (select *, row_number() over (partition by outlet order by y, m) - 1 t from aligned), r as (select outlet, round(price - regr_intercept(price, t) over w - regr_slope(price, t) over w * t, 9) a, round(net - regr_intercept(net, t) over w - regr_slope(net, t) over w * t, 9) b from o window w as (partition by outlet)), {_rho('r', 'a', 'b', 'outlet')} select outlet, n, round(rho, 4) rho, round(p, 6) p from cor",
    "first_diff_spearman": f"with {_ALIGNED}, r as (select outlet, price - lag(price) over w a, net - lag(net) over w b from aligned window w as (partition by outlet order by y, m)), {_rho('r', 'a', 'b', 'outlet')} select outlet, n, round(rho, 4) rho, round(p, 6) p from cor",
    "bh_fdr": f"with {_SPEARMAN}, r as (select outlet, feature, round(p, 6) p_value from cor), k as (select *, row_number() over (order by p_value, outlet, feature) i, count(*) over () n from r) select outlet, feature, p_value, round(least(1, min(p_value * n / i) over (order by i rows between current row and unbounded following)), 6) q from k",
    "significance_counts": f"with {_SPEARMAN} select feature, count(*) n_tests, count_if(round(p, 6) <= 0.05)::bigint n_significant from cor group by 1",
    "confusion_binary": f"with {_JUDGED}, c as (select count_if(toxic = 1 and rule = 1)::bigint tp, count_if(toxic = 0 and rule = 1)::bigint fp, count_if(toxic = 1 and rule = 0)::bigint fn, count_if(toxic = 0 and rule = 0)::bigint tn from judged) select *, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) \"precision\", coalesce(round(tp / nullif(tp + fn, 0), 4), 0) recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) f1, round((tp + tn) / (tp + fp + fn + tn), 4) accuracy from c",
    "confusion_multiclass": f"with {_JUDGED}, r as (select concat(toxic, quality) h, concat(rule, quality) m from judged), k as (select distinct unnest([h, m]) class from r), c as (select class, count_if(h = class and m = class) tp, count_if(h <> class and m = class) fp, count_if(h = class and m <> class) fn from k, r group by class) select class, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) \"precision\", coalesce(round(tp / nullif(tp + fn, 0), 4), 0) recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) f1, (tp + fn)::bigint support from c",
    "stance_label": f"with {_STANCE} select doc_id, stance_label from stance",
    "stratified_sample_sizes": f"with {_STANCE}, q as (select stance_label, count(*) n, sum(count(*)) over () total from stance group by 1) select least(200, sum(least(n, greatest(10, floor(200 * n / total)))))::bigint n from q",
    "balanced_sample_sizes": f"with {_STANCE} select pro >= 0.5 above, least(150, count(*))::bigint n from stance group by 1",
    "score_distribution": f"with {_STANCE} select count(*) n, round(avg(pro), 6) mean, round(median(pro), 6) median, round(stddev_samp(pro), 6) std, count_if(pro > 0.5)::bigint above_0_5, count_if(pro > 0.7)::bigint above_0_7, count_if(pro > 0.9)::bigint above_0_9 from stance",
    "sitemap_expand": "with mon as (select distinct date_trunc('month', o_orderdate)::date f from orders) select 'a' outlet, 'https://a/' || strftime(f, '%Y%m') || '.xml' url from mon union all select 'b', 'https://b/' || strftime(x, '%Y-%m-%d') || '.xml' from (select unnest(generate_series(f, last_day(f), interval 1 day)) x from mon)",
    "window_share": "select lang, source, n, round(n / sum(n) over (partition by lang), 6) share from (select lang, source, count(*) n from documents group by all)",
    "page_paragraphs": "with p as (select page_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) l from pages) select page_id, length(array_to_string(l, chr(10))) chars, md5(array_to_string(l, chr(10))) digest from p",
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _put(items: list[str], key: str) -> str:
    return f"([{', '.join(map(_quoted, items))}])[({key}) % {len(items)} + 1]"


def _found(terms: list[Term]) -> str:
    """Hits of terms: words among the tokens, phrases as literals."""
    words = ", ".join(_quoted(t.term) for t in terms if " " not in t.term)
    phrases = [f"(length(said) - length(replace(said, {_quoted(t.term)}, ''))) // {len(t.term)}" for t in terms if " " in t.term]
    return " + ".join(["0", *([f"len(list_filter(k, lambda t: list_contains([{words}], t)))"] if words else []), *phrases])


def _lexicon_sql(terms: list[Term], groups: dict[str, list[Term]], counts: tuple[str, ...], rates: dict[str, str]) -> str:
    names = [t.term for t in terms]
    texts = f"said0 as (select doc_id, lower(concat_ws(' ', coalesce(text, ''), {_put(names, 'doc_id')}, {_put(names, 'doc_id * 7 + 3')}, {_put(names, 'doc_id * 11 + 5')})) said from documents)"
    tokens = "said1 as (select *, regexp_extract_all(said, '[\\p{L}\\p{N}_]+') k, " + _WORDS.format("said") + " w from said0)"
    hits = f"found as (select doc_id, w, {', '.join(f'({_found(t)})::bigint {g}' for g, t in groups.items())} from said1)"
    rate = ", ".join(f"coalesce(round({g} / nullif(w / 1000.0, 0), 4), 0) {name}" for name, g in rates.items())
    return f"with {texts}, {tokens}, {hits} select doc_id, {', '.join(counts)}, {rate} from found"


def _of(terms: list[Term], category: str) -> list[Term]:
    return [t for t in terms if t.category == category]


def _rules_sql() -> str:
    """The rules in the other dialect: white space and words spelt out; a NEXT block as the plain pattern it is."""
    space = r"\s\x0B\x{85}\p{Z}"

    def pattern(rule: Rule) -> str:
        if rule.pattern == NEXT_BLOCK:
            return rf"(?i)\nREAD NEXT(?::|\.{{3}}|…)?(?:[\t\x0B\f\r\x{{85}}\p{{Z}}])*\n+(?:[^\n]+\n?)+"
        flags = f"(?{rule.flags})" if rule.flags else ""
        return flags + rule.pattern.replace(r"\s", f"[{space}]").replace(r"\w", r"[\p{L}\p{N}_]")

    columns = []
    for outlet in ROUTES:
        text = "said"
        for r in RULES:
            if r.outlet == outlet and r.pattern != HEADLINE_BLOCK:
                to = "chr(10)" if NEXT_BLOCK == r.pattern or r.replacement == "\n" else _quoted(r.replacement)
                text = f"regexp_replace({text}, {_quoted(pattern(r))}, {to}, 'g')"
        columns.append(f"md5(regexp_replace({text}, '^[{space}]+|[{space}]+$', '', 'g')) {outlet}")
    said = f"concat({_put(BOILERPLATE, 'doc_id * 5 + 2')}, coalesce(text, ''), {_put(BOILERPLATE, 'doc_id')}, chr(10), 'The body goes on.', {_put(BOILERPLATE, 'doc_id * 7 + 3')})"
    return f"with t as (select doc_id, {said} said from documents) select doc_id, {', '.join(columns)} from t"


ORACLE_SQL["dehumanisation_features"] = _lexicon_sql(
    DEHUMANISATION,
    {"dehum_total": DEHUMANISATION, "dehum_tier1": [t for t in DEHUMANISATION if t.tier == 1], "dehum_tier2": [t for t in DEHUMANISATION if t.tier == 2]}
    | {c: _of(DEHUMANISATION, c) for c in ("mass_metaphor", "criminalisation", "burden_framing", "threat_framing")},
    ("dehum_total", "dehum_tier1", "dehum_tier2"),
    {"dehum_density": "dehum_total", "dehum_tier1_density": "dehum_tier1", "dehum_tier2_density": "dehum_tier2", "dehum_mass_metaphor_density": "mass_metaphor"}
    | {"dehum_criminalisation_density": "criminalisation", "dehum_burden_density": "burden_framing", "dehum_threat_density": "threat_framing"},
)
ORACLE_SQL["outrage_features"] = _lexicon_sql(
    OUTRAGE,
    {"outrage_total": OUTRAGE} | {c: _of(OUTRAGE, c) for c in ("moral_condemnation", "institutional_shame", "outrage_intensifier", "tabloid_outrage")},
    ("outrage_total",),
    {"outrage_density": "outrage_total", "outrage_condemnation_density": "moral_condemnation", "outrage_shame_density": "institutional_shame"}
    | {"outrage_intensifier_density": "outrage_intensifier", "outrage_tabloid_density": "tabloid_outrage"},
)
ORACLE_SQL["published_rules"] = _rules_sql()
ORACLE_SQL["subcategory_spearman"] = f"""with {_ALIGNED}, o as (select *, row_number() over (partition by outlet order by y, m) - 1 t from aligned),
 l as (select outlet, t, net, feature, v from o unpivot (v for feature in (price, rest, sparse))),
 nets as (select outlet, t, round(net - regr_intercept(net, t) over w - regr_slope(net, t) over w * t, 9) b from o window w as (partition by outlet)),
 flats as (select l.outlet, feature, b, round(v - regr_intercept(v, t) over w - regr_slope(v, t) over w * t, 9) a from l join nets using (outlet, t) window w as (partition by outlet, feature)),
 raw as (with {_rho('l', 'v', 'net', 'outlet, feature')} select * from cor), flat as (with {_rho('flats', 'a', 'b', 'outlet, feature')} select * from cor),
 r as (select raw.outlet, raw.feature, round(raw.rho, 4) rho_raw, round(raw.p, 6) p_raw, {_stars('raw.p')} sig_raw, round(flat.rho, 4) rho_detrended, round(flat.p, 6) p_detrended, {_stars('flat.p')} sig_detrended from raw left join flat using (outlet, feature)),
 k as (select *, row_number() over (order by p_raw, outlet, feature) i, count(*) over () c from r), q as (select *, round(least(1, min(p_raw * c / i) over (order by i rows between current row and unbounded following)), 6) q_raw_fdr from k)
 select outlet, feature subcategory, (select count(*) from aligned x where x.outlet = q.outlet) n, rho_raw, p_raw, sig_raw, rho_detrended, p_detrended, sig_detrended, q_raw_fdr, q_raw_fdr <= 0.05 survives_fdr from q"""
_TESTS = {"raw": ("v", "net", "o"), "detrended": ("a", "b", "flats"), "first_diff": ("a", "b", "diffs")}
_FIGURES = ", ".join(f"round({k}.rho, 4) rho_{k}, round({k}.p, 6) p_{k}, coalesce({_stars(f'{k}.p')}, '') sig_{k}" for k in _TESTS)
_FOUND = ", ".join(f"{k} as (with {_rho(source, x, y, 'outlet')} select * from cor)" for k, (x, y, source) in _TESTS.items())


def _main_text() -> str:
    """Blocks of the article as rows, each with the nearest above and below that isn't short."""
    gone = "html"
    for pattern in ("(?is)<!--.*?-->", *(f"(?is)<{t}\\b.*?</{t}>" for t in ("script", "style", "nav", "aside", "footer", "header", "table", "form", "noscript", "figure", "title"))):
        gone = f"regexp_replace({gone}, '{pattern}', '', 'g')"
    bare = lambda x: "replace(" * 6 + f"regexp_replace({x}, '<[^>]*>', '', 'g')" + "".join(f", '{k}', {v})" for k, v in {"&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#39;": "chr(39)", "&nbsp;": "' '", "&amp;": "'&'"}.items())
    tidy = lambda x: f"trim(regexp_replace({x}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
    links = f"list_sum(list_transform(regexp_extract_all(raw, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: length(trim({bare('x')}))))"
    return f"""with a as (select page_id, url, regexp_replace(regexp_extract({gone}, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '(?i)<h[1-6]\\b[^>]*>', '<p>' || chr(1), 'g') inner_html from pages),
 b as (select page_id, generate_subscripts(x, 1) i, unnest(x) raw from (select page_id, string_split_regex(inner_html, '(?i)</?(p|h[1-6]|li|blockquote|div|br|section|main|ul|ol|hr|pre|td)\\b[^>]*>') x from a)),
 c as (select page_id, i, {tidy(bare("replace(raw, chr(1), '')"))} said, contains(raw, chr(1)) heading, coalesce({links}, 0) linked from b),
 d as (select *, case when linked > length(said) / 3.0 then 'bad' when length(said) >= 80 then 'good' end kind from c where said <> ''),
 e as (select *, last_value(kind ignore nulls) over (w rows between unbounded preceding and 1 preceding) above, first_value(kind ignore nulls) over (w rows between 1 following and unbounded following) below,
  bool_or(kind = 'good') over (partition by page_id) any_good from d window w as (partition by page_id order by i)),
 f as (select page_id, string_agg(said, chr(10) order by i) body from e where case when not coalesce(any_good, false) then kind is null when kind is null then case when heading then below = 'good' else coalesce(above, below) = 'good' and coalesce(below, above) = 'good' end else kind = 'good' end group by page_id),
 g as (select page_id, regexp_extract(url, '(?:^|\\D)((?:19|20)\\d\\d[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\\d|3[01]))(?:\\D|$)', 1) on_day from pages)
 select page_id, body, replace(nullif(on_day, ''), '/', '-') date from g left join f using (page_id)"""


ORACLE_SQL["page_text_extract"] = _main_text()


def _q(p: str) -> str:
    ranked = f"(select outlet, case when {p} is not null then {p} * count({p}) over () / row_number() over (order by {p} nulls last, outlet) end v, {p} from r)"
    return f"(select outlet, case when {p} is not null then round(least(1, min(v) over (order by {p} nulls last, outlet rows between current row and unbounded following)), 6) end q from {ranked})"


ORACLE_SQL["trend_robustness"] = f"""with {_ALIGNED}, o as (select outlet, net, price v, row_number() over (partition by outlet order by y, m) - 1 t from aligned where price is not null),
 flats as (select outlet, round(v - regr_intercept(v, t) over w - regr_slope(v, t) over w * t, 9) a, round(net - regr_intercept(net, t) over w - regr_slope(net, t) over w * t, 9) b from o window w as (partition by outlet)),
 diffs as (select outlet, v - lag(v) over w a, net - lag(net) over w b from o window w as (partition by outlet order by t)),
 {_FOUND}, r as (select raw.outlet, raw.n, {_FIGURES} from raw left join detrended using (outlet) left join first_diff using (outlet))
 select r.*, a.q q_raw_fdr, coalesce(a.q <= 0.05, false) raw_survives_fdr, b.q q_detrended_fdr, coalesce(b.q <= 0.05, false) detrended_survives_fdr from r join {_q('p_raw')} a using (outlet) join {_q('p_detrended')} b using (outlet)"""
ORACLE_SQL["stance_validation_sample"] = (
    f"with {_STANCE}, q as (select stance_label, count(*) n, sum(count(*)) over () total from stance group by 1), d as (select stance_label, least(n, greatest(10, floor(200 * n / total)))::bigint n from q) select stance_label, n, n n_urls, n n_same from d"
)
ORACLE_SQL["dual_axis_series"] = (
    f"with {_ALIGNED}, s as (select list_position(['2-HIGH', '1-URGENT', '5-LOW'], outlet)::bigint panel, make_date(y, m, 1) date, * from aligned) select panel, ['High', 'Urgent', 'Low'][panel] title, date, round(rest, 5) rest, net / 1000.0 net_migration_thousands, date < date '1996-06-01' before_break from s where panel > 0"
)
