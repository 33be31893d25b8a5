"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.licenses import NAMES, PHRASES, TEMPLATES

#: A-Z lower-cased and nothing else, as DuckDB's translate().
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

op5_exact_dedup = f"""
with t as (select doc_id, {LOWER} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""

#: The blanks that words and lines are stripped of.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

op3_line_dedup = f"""
with l as (
  select doc_id, line, pos, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
c as (select k, max(doc_id) as top from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.*, c.top is null or l.doc_id = c.top as kept from l left join c on l.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (where not kept) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where kept), '')) as kept_sha256
from m group by doc_id
"""


def word_list(text: str) -> str:
    """The words of letters, digits and non-ASCII characters of an expression, A-Z lower-cased."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


op4_decontaminate = f"""
with d as (select doc_id, {word_list('text')} as w from documents),
b as (select cast(item_id as varchar) as item, {word_list('text')} as w from benchmark where item_id is not null),
win as (select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as k
        from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as u(i) where len(w) > 0),
sizes as (select distinct n from win),
hits as (select d.doc_id, i, win.n, win.item
         from d, sizes s, unnest(range(1, len(d.w) - s.n + 2)) as u(i), win
         where win.n = s.n and win.k = array_to_string(d.w[i:i + s.n - 1], ' ')),
marks as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + n)) as v(p) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
        from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join marks using (doc_id) left join its using (doc_id)
"""


def license_templates() -> str:
    """(t, kind, label, pairs): what the license scan looks for; and (t, off, a, b): its pairs of words."""
    rows, pairs = [], []
    kinds = ["base"] * len(PHRASES) + ["name"] * len(NAMES) + ["sentence"] * len(TEMPLATES)
    for t, (kind, (text, label)) in enumerate(zip(kinds, [*PHRASES, *NAMES, *TEMPLATES])):
        words = text.split()
        rows.append(f"({t}, '{kind}', '{label}', {len(words) - 1})")
        pairs += [f"({t}, {i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(words, words[1:]))]
    return f"tm(t, kind, label, pairs) as (values {', '.join(rows)}), tp(t, off, a, b) as (values {', '.join(pairs)})"


op10_licenses = f"""
with {license_templates()},
d as (select doc_id, {word_list('text')} as w from documents),
g as (select doc_id, p - 1 as pos, w[p] as a, w[p + 1] as b from d, unnest(range(1, len(w))) as u(p)),
diag as (select doc_id, t, pos - off as diagonal, list(distinct off) as hit, min(pos) as low, max(pos) as high
         from g join tp using (a, b) group by doc_id, t, pos - off),
good as (select diag.*, kind, label, pairs from diag join tm using (t)
         where case when kind = 'sentence' then len(hit) >= least(2, pairs) else len(hit) = pairs end),
cut as (select *, coalesce(diagonal - lag(diagonal) over (partition by doc_id, t order by diagonal) > case when kind = 'sentence' then 3 else 0 end, false) as apart from good),
num as (select *, sum(apart::int) over (partition by doc_id, t order by diagonal) as span from cut),
spans as (select doc_id, t, span, any_value(kind) as kind, any_value(label) as label, any_value(pairs) as pairs,
          len(list_distinct(flatten(list(hit)))) as hits, min(low) as low, max(high) as high from num group by doc_id, t, span),
told as (select *, kind <> 'sentence' or (hits >= 0.6 * pairs and high + 2 - low <= 2 * (pairs + 1)) as counts from spans),
per as (select doc_id, count(*) filter (where kind = 'base') as n_base, min(low) filter (where kind = 'base') as first_word,
        max(low) filter (where kind = 'base') as last_word,
        string_agg(distinct label, ',' order by label) filter (where kind = 'base') as base_labels,
        string_agg(distinct label, ',' order by label) filter (where counts) as labels,
        max(case when counts then hits / pairs else 0.0 end) as score
        from told group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from d left join per using (doc_id)
"""
