"""DuckDB SQL of the training-data operators that SQL can say: the contracts, over whole tables."""

from .rules import STOP_WORDS, THRESHOLDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*)(/?s>|/?INST\]|/?<?SYS>>|</SYS>>)', '\1\\\2\3', 'g')"


_CHAT = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed as (
  select *, row_number() over w as place, count(*) over (partition by conv_id) as n,
    sum(length('<s>[INST]' || {_escaped("role")} || '[/INST]' || {_escaped("text")} || '</s>')) over w as upto
  from turns window w as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or place = n then upto else 0 end)::bigint as formatted_chars,
  count(*) filter (where role = 'assistant' or place = n)::bigint as n_examples
from placed group by conv_id
"""

_JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 5
    then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id
  join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))
),
reached(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reached r join links l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.b) as component_id
from documents d left join n on n.doc_id = d.doc_id join reached r on r.a = d.doc_id group by d.doc_id, n.n
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_BOUNDS = " and ".join(
    f"coalesce({name} {sign} {bound}::double, true)" for name, least, most in THRESHOLDS for sign, bound in ((">=", least), ("<=", most)) if bound is not None
)
_RULES = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_SPACED}) as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACED})) as lines from documents
),
places as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as key from d, unnest(range(1, len(words) - 6)) as r(i)),
spots as (select doc_id, i, count(*) over (partition by doc_id, key) as k from places),
covered as (select doc_id, count(distinct i + j)::bigint as n from spots, range(0, 8) as r(j) where k > 1 group by doc_id),
c as (
  select d.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(list_filter(words, lambda w: rtrim(lower(w), '.,') in ({_STOP}))) as n_stop,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, len(list_filter(lines, lambda x: length(x) < 20)) as n_short
  from d left join covered on covered.doc_id = d.doc_id
),
f as (
  select *, word_chars / nullif(n_words, 0)::double as mean_word_chars, n_symbols / nullif(n_words, 0)::double as symbol_ratio,
    n_upper / nullif(word_chars, 0)::double as upper_ratio, n_stop / nullif(n_words, 0)::double as stop_ratio,
    n_dup_lines / nullif(n_lines, 0)::double as dup_line_ratio, n_short / nullif(n_lines, 0)::double as short_line_ratio,
    n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_BOUNDS} as kept,
  mean_word_chars, symbol_ratio, upper_ratio, stop_ratio, dup_line_ratio, short_line_ratio from f
"""

_SUBSTRING = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as key from d, unnest(range(1, len(words) - 11)) as r(i)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by key) as first from win) where first < doc_id),
gone as (select doc_id, list(distinct i + j) as spots from late, range(0, 13) as r(j) group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(len(spots), 0)::bigint as n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(coalesce(spots, []), i)), lambda i: words[i]), ' ')) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id
"""

_DECONTAM = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as words from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as words from benchmark),
windows as (
  select distinct item_id, least(len(words), 10) as n, unnest(list_transform(range(1, greatest(len(words) - 8, 2)), lambda i: array_to_string(words[i:i + 9], ' '))) as key
  from b where len(words) > 0
),
sizes as (select distinct n from windows),
spots as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as key from d, sizes, unnest(range(1, len(words) - n + 2)) as r(i)),
hits as (select s.doc_id, s.i, s.n, w.item_id from spots s join windows w on w.n = s.n and w.key = s.key),
cut as (select doc_id, count(distinct i + j)::bigint as n_hit from (select distinct doc_id, i, n from hits), range(0, 10) as r(j) where j < n group by doc_id),
items as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select d.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  n_hit is not null as contaminated
from d left join cut on cut.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {shift}) & 31)::int + 1, 1)" for shift in (15, 10, 5, 0))
_WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr(sha, i * 5 + 1, 5))::bigint), lambda v: {_BASE32}), '') as payload_digest,
  case when page_id = min(page_id) over same then 'response' else 'revisit' end as record_type,
  case when page_id = min(page_id) over same then null else min(page_id) over same end as refers_to
from p window same as (partition by html)
"""

ORACLE_SQL: dict[str, str] = {"op1_chat": _CHAT, "op2_jaccard": _JACCARD, "op3_rules": _RULES, "op6_substring": _SUBSTRING, "op8_decontam": _DECONTAM, "op9_warc": _WARC}


def _crc32(text: str) -> str:
    """Of ASCII text, a bit at a time."""
    step = "list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, xor(crc, byte))"
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce({bytes_}, lambda crc, byte: {step}, 4294967295::bigint), 4294967295)"


def _repair() -> str:
    """Rows are taken one by one; s0 to s3 hold the least cost (nine digits) and labels that lead to each state of the grammar."""

    def plus(s: str, cost: object, label: str) -> str:
        return f"case when {s} is not null then concat(lpad((left({s}, 9)::bigint + {cost})::varchar, 9, '0'), substr({s}, 10), '{label}') end"

    to_u = "least(s0, s1, s3)"
    raw = {
      "t0": plus("s0", 2, "D"),
      "t1": f"least({plus('s1', 2, 'D')}, case when not must and initial = 's' then {plus('s0', 'more', 'K')} end)",
      "t2": f"least({plus('s2', 2, 'D')}, case when not must and initial = 'u' then {plus(to_u, 'more', 'K')} end, case when not must then {plus(to_u, '1 + more', 'R')} end)",
      "t3": f"least({plus('s3', 2, 'D')}, case when not must and initial = 'a' then {plus('s2', 'more', 'K')} end, case when not must then {plus('s2', '1 + more', 'R')} end)",
    }
    u = f"least(t2, {plus('least(t0, t1, t3)', 5, 'I')})"
    said = "coalesce({0}::varchar, ' ')".format
    start = ("'000000000'", "null::varchar", "'000000005I'", "'000000010II'")
    crc = _crc32(f"concat({said('conv_id')}, ':', {said('turn')})")
    return f"""with recursive d as (select conv_id, turn, {said('role')} role, {said('text')} text, {crc} % 20 kind from conversations),
 e as (select conv_id, turn, case when kind = 4 then 'user' else role end role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) copy from d),
 f as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(concat(strlen(role), ':', role, text)), copy) i, coalesce(nullif(left(role, 1), ''), ' ') initial,
   not regexp_matches(text, '[^\\x20\\x09-\\x0D]') blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') cut from e),
 g as (select *, not blank and row_number() over (partition by conv_id, role, text order by i) > 1 again, lag(initial) over (partition by conv_id order by i) before from f),
 h as (select *, blank or again must, case when cut and not blank and not again then 5 else 0 end more from g),
 counts as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank, count_if(again) "duplicate", count_if(more > 0) truncated,
   count_if(before is not null and concat(before, initial) not in ('su', 'ua', 'au')) illegal from h group by conv_id),
 step as (select conv_id, 0::bigint i, {', '.join(f'{v} s{k}' for k, v in enumerate(start))} from (select distinct conv_id from conversations)
   union all select conv_id, i, t0, t1, u, least(t3, {plus('u', 5, 'I')}) from (select *, {u} u from (select step.conv_id, h.i, {', '.join(f'{v} {k}' for k, v in raw.items())} from step join h on h.conv_id is not distinct from step.conv_id and h.i = step.i + 1))),
 best as (select step.conv_id, left(least(s0, s3), 9)::bigint cost, substr(least(s0, s3), 10) audit from step left join counts c on c.conv_id is not distinct from step.conv_id where step.i = coalesce(c.n, 0)),
 edits as (select conv_id, audit, generate_subscripts(x, 1) p, unnest(x) edit from (select conv_id, audit, string_split(audit, '') x from best where audit <> '')),
 placed as (select *, count_if(edit <> 'I') over w i, count_if(edit <> 'D') over w - 1 j, count_if(edit <> 'D') over (partition by conv_id) % 2 odd from edits window w as (partition by conv_id order by p)),
 made as (select placed.conv_id, sha256(string_agg(concat(case when edit = 'K' then role when (j - odd) % 2 = 0 then 'user' else 'assistant' end, ':', case when edit = 'I' then '' else text end), chr(10) order by p)) digest
   from placed left join h on h.conv_id is not distinct from placed.conv_id and h.i = placed.i where edit <> 'D' group by placed.conv_id)
 select best.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cost, audit, coalesce(digest, sha256('')) repaired_sha256
 from best left join counts c on c.conv_id is not distinct from best.conv_id left join made m on m.conv_id is not distinct from best.conv_id"""


def _manifest() -> str:
    """Trees from the leaves up; a step of a leaf's path holds the digests on its left and right."""
    enc = lambda x: f"case when {x} is null then '-' else concat(strlen({x}::varchar), ':', {x}) end"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name, source, group, node):
        return f"""{name} as (select {group} g, 0 h, pos, {node} node, count(*) over (partition by {group}) n from {source}
          union all select g, h + 1, pos // 8, sha256(string_agg(node, '' order by pos)), (n + 7) // 8 from {name} where n > 1 group by g, h, pos // 8, n)"""

    return f"""with recursive leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, row_number() over () id
   from (select doc_id, lang, {leaf('text')} leaf, case when {_crc32('doc_id::varchar')} % 3 = 0 then {leaf(lower)} else {leaf('text')} end offered from documents)),
 {tree('below', 'leaves', 'lang', 'leaf')},
 tops as (select g lang, node subroot, row_number() over (order by g nulls first) - 1 pos from below where n = 1),
 {tree('above', 'tops', "''", 'subroot')},
 paths as (select id, 0 part, h, leaves.pos // pow(8, h)::bigint own, lang g from leaves join (select distinct g, h from below where n > 1) l on l.g is not distinct from lang
   union all select id, 1, h, tops.pos // pow(8, h)::bigint, '' from leaves join tops on tops.lang is not distinct from leaves.lang cross join (select distinct h from above where n > 1)),
 nodes as (select 0 part, * from below union all select 1, * from above),
 steps as (select id, p.part, p.h, row_number() over (partition by id order by p.part, p.h) - 1 k, coalesce(string_agg(node, '' order by pos) filter (pos < own), '') l, coalesce(string_agg(node, '' order by pos) filter (pos > own), '') r
   from paths p join nodes s on s.part = p.part and s.g is not distinct from p.g and s.h = p.h and s.pos // 8 = own // 8 group by id, p.part, p.h),
 folded as (select id, 0 k, offered d from leaves union all select f.id, f.k + 1, sha256(concat(l, d, r)) from folded f join steps s on s.id = f.id and s.k = f.k),
 ends as (select id, max_by(d, k) d from folded group by id),
 proofs as (select id, sha256(string_agg(concat(l, r), '' order by k)) proof from steps group by id)
 select doc_id, leaf, subroot, (select node from above where n = 1) root, coalesce(proof, sha256('')) proof_sha256, d folded_root, d = (select node from above where n = 1) verified
 from leaves join tops on tops.lang is not distinct from leaves.lang join ends using (id) left join proofs using (id)"""


ORACLE_SQL["op11_repair"] = _repair()
ORACLE_SQL["op12_manifest"] = _manifest()
