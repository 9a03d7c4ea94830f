"""DuckDB SQL of the queries that SQL can express."""

from .licenses import CERTAINTY, RULES

DECONTAMINATE = r"""
with dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents
), iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null
), starts as (
  select item_id, ws, least(10, len(ws)) as m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i
  from iw where len(ws) > 0
), win as (
  select distinct item_id, m, array_to_string(ws[i : i + m - 1], ' ') as g from starts
), places as (
  select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) as i
  from dw, (select distinct m from win) where len(ws) >= m
), occ as (
  select p.doc_id, p.i, p.m, w.item_id
  from (select doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') as g from places) p join win w using (m, g)
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from occ) group by 1
), items as (
  select doc_id, list_sort(list_distinct(list(item_id::varchar))) as ids from occ group by 1
)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""

URLS = r"""
with rules(rule_host, rule_path, said) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rest as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(regexp_extract(r, '^[^?#]*'), length(regexp_extract(r, '^[^/?#]*')) + 1) as path from rest
)
select page_id, host, path, rule_host || rule_path as rule, coalesce(said, 'allow') as verdict
from parts left join rules
  on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) = 1
"""

LINES = r"""
with l as (
  select doc_id, source, text, case when text is null then [] else string_split(text, chr(10)) end as ls from documents
), k as (
  select distinct doc_id, source, trim(x) as line from (select doc_id, source, unnest(ls) as x from l) where trim(x) <> ''
), totals as (select source, count(*) as n from documents group by 1), bad as (
  select source, list(line) as lines from (
    select k.source, line from k join totals t on k.source is not distinct from t.source
    group by k.source, line, n having count(*) >= 5 and count(*) > 0.1 * n
  ) group by 1
), kept as (
  select doc_id, text, ls, list_filter(ls, lambda x: trim(x) = '' or not list_contains(coalesce(lines, []), trim(x))) as stays
  from l left join bad b on l.source is not distinct from b.source
)
select doc_id, len(ls)::bigint as n_lines, (len(ls) - len(stays))::bigint as n_dropped,
  case when len(ls) = len(stays) then text else array_to_string(stays, chr(10)) end as text
from kept
"""

SUBSTRINGS = r"""
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i : i + 19], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)
), later as (
  select doc_id, i from win qualify row_number() over (partition by g order by doc_id, i) > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 20)) as p from later
), word as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w
), kept as (
  select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n
  from word anti join gone using (doc_id, p) group by 1
)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)
"""

_RULE_ROWS = ",\n  ".join(
    f"('{r.keyword}', '{r.also or r.keyword}', '({r.pattern})', {r.tier}, {i}, '{r.label}')" for i, r in enumerate(RULES)
)

LICENSES = rf"""
with rules(keyword, also, pattern, tier, rule, label) as (values
  {_RULE_ROWS}
), sure(tier, value) as (values {", ".join(f"({i}, {x}::double)" for i, x in enumerate(CERTAINTY))}), w as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), phrases(words, said) as (values
  (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')
), base as (
  select r, i - 1 as start, said from (select r, ws, unnest(range(1, len(ws) + 1)) as i from w), phrases
  where ws[i : i + len(words) - 1] = words
), line as (
  select r, ' ' || array_to_string(ws, '  ') || ' ' as line from w where len(ws) > 0
), tried as (
  select r, tier, rule, label,
    regexp_replace(line, pattern, ' ' || chr(1) || ' \1 ' || chr(2) || ' ', 'g') as m
  from line join rules on contains(line, keyword) and contains(line, also) where regexp_matches(line, pattern)
), marked as (
  select r, tier, rule, label, string_split(substr(m, 2, len(m) - 2), '  ') as t from tried
), place as (
  select r, tier, rule, label,
    unnest(list_transform(list_filter(list_transform(t, lambda x, i: case when x = chr(1) then i end),
      lambda p: p is not null), lambda p, k: p + 1 - 2 * k)) as s,
    unnest(list_transform(list_filter(list_transform(t, lambda x, i: case when x = chr(2) then i end),
      lambda p: p is not null), lambda p, k: p - 2 * k)) as e
  from marked
), kept as (
  select r, tier, label from place p where not exists (
    select 1 from place q where q.r = p.r and q.s <= p.s and q.e >= p.e and (
      q.tier < p.tier or (q.tier = p.tier and (q.e - q.s > p.e - p.s or q.rule < p.rule))))
), stated as (
  select r, count(*) as n, min(start) as a, max(start) as b, array_to_string(list_sort(list_distinct(list(said))), ',') as said
  from base group by r
), every as (
  select r, array_to_string(list_sort(list_distinct(list(label))), ',') as labels
  from (select r, label from kept union all select r, said from base) group by r
), best as (select r, max(value) as value from kept join sure using (tier) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, a::bigint as first_word, b::bigint as last_word,
  coalesce(said, '') as base_labels, coalesce(labels, '') as labels,
  greatest(coalesce(value, 0), case when n > 0 then {CERTAINTY[-1]} else 0 end)::double as score
from w left join stated using (r) left join every using (r) left join best using (r)
"""

RANKED = r"""
with d as (
  select doc_id, row_number() over () as r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) as ws from documents
), size as (
  select count(*)::bigint as nn, sum(len(ws))::bigint as ll from d where len(ws) > 0
), q as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), tf as (
  select r, doc_id, term, count(*)::bigint as tf, any_value(n)::bigint as n
  from (select r, doc_id, len(ws) as n, unnest(ws) as term from d) where term in (select term from q) group by 1, 2, 3
), df as (
  select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, size group by term, nn
), score as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from q join df using (term) join tf using (term), size group by 1, 2, 3
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from score where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50
"""
