"""The operators' results in DuckDB SQL, written apart from them: all pairs and whole texts, no hashing."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = """
with recursive raw as (
  select doc_id, string_split(text, chr(10)) ls from documents
), lines as (
  select doc_id, unnest(range(len(ls))) place, lower(trim(unnest(ls))) line from raw where ls is not null
), used as (select * from lines where line <> ''),
nodes as (select line, row_number() over (order by line) id from (select distinct line from used)),
grams as (
  select distinct id, substring(line, i, 8) g
  from (select id, line, unnest(range(1, length(line) - 6)) i from nodes where length(line) >= 16)
),
sizes as (select id, count(*) n from grams group by id),
shared as (select a.id x, b.id y, count(*) k from grams a join grams b on a.g = b.g and a.id < b.id group by 1, 2),
links as (
  select x, y from shared join sizes p on p.id = x join sizes q on q.id = y where 100 * k >= 80 * (p.n + q.n - k)
), both_ways as (select x, y from links union all select y, x from links),
reach as (select distinct x, x r from both_ways union select b.y, r.r from reach r join both_ways b on b.x = r.x),
component as (select x id, min(r) c from reach group by x),
seen as (
  select doc_id, place, coalesce(c, n.id) c from used join nodes n using (line) left join component m on m.id = n.id
), gone as (
  select doc_id, place from (select *, row_number() over (partition by c order by doc_id, place) k from seen) where k > 1
), lists as (select doc_id, count(*) n, string_agg(cast(place as varchar), ',' order by place) ps from gone group by doc_id)
select d.doc_id, coalesce(len(d.ls), 0) n_lines, coalesce(l.n, 0) n_removed, coalesce(l.ps, '') removed_lines
from raw d left join lists l using (doc_id)
"""

OP5 = f"""
with d as (select doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) w from documents),
windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) i from d)
), first as (select s, min(doc_id) owner from windows group by s),
hit as (select doc_id, i from windows join first using (s) where doc_id > owner),
gone as (select distinct doc_id, unnest(range(i, i + 50)) p from hit),
words as (select doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) word from d),
kept as (
  select doc_id, string_agg(word, ' ' order by p) t, count(*) n
  from words anti join gone using (doc_id, p) group by doc_id
)
select doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (doc_id)
"""

OP6 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
), sound as (
  select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id x, b.vec_id y from sound a join sound b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (select vec_id x, vec_id r from v union select l.y, r.r from reach r join links l on l.x = r.x),
component as (select x, min(r) c from reach group by x),
degree as (select x, count(*) n from links group by x)
select vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept
from v join component on component.x = vec_id left join degree on degree.x = vec_id
"""

OP8 = f"""
with recursive d as (
  select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_SPACED}), []) w from documents
), grams as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i from d where len(w) > 0)
), sizes as (select doc_id, count(*) n from grams group by doc_id),
shared as (
  select a.doc_id x, b.doc_id y, count(*) k from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)
), both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id x, doc_id r from d union select b.y, r.r from reach r join both_ways b on b.x = r.x),
component as (select x, min(r) c from reach group by x)
select d.doc_id, coalesce(n, 0) n_shingles, c component_id, d.doc_id = c kept
from d join component on x = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""

OP10 = f"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_ALNUM}), []) w from documents),
b as (select item_id, coalesce(regexp_extract_all({_LOWER.format('text')}, {_ALNUM}), []) w from benchmark),
needles as (
  select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') s
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) i from (select *, least(len(w), 13) k from b where len(w) > 0))
), windows as (
  select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d join (select distinct k from needles) on len(w) >= k)
), found as (select w.doc_id, w.i, w.k, n.item_id from windows w join needles n on n.k = w.k and n.s = w.s),
hit as (
  select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + k)) p from found) group by doc_id
), items as (
  select doc_id, count(*) n, string_agg(t, ',' order by t) ts
  from (select distinct doc_id, cast(item_id as varchar) t from found) group by doc_id
)
select d.doc_id, len(w) n_words, coalesce(hit.n, 0) n_hit, coalesce(items.n, 0) n_items,
  sha256(coalesce(ts, '')) items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""

#: The CRC-32 of a string, byte by byte (letters beyond ASCII here have two), over the table of its reflected polynomial.
OP11 = """
with recursive steps(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8
), crc as (select list(c order by i) t from steps where k = 8),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') run from documents where text is not null
), counted as (select doc_id, run, count(*) k, length(run) l from runs group by all),
hashed as (
  select run, l, k, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
    string_split(concat(doc_id, ':', run), ''),
    lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [(192 + ord(c) // 64)::bigint, (128 + ord(c) % 64)::bigint] end
  ))), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) h
  from counted, crc
), words as (
  select case when h % 97 = 0 then run[:h % l] || run[h % l + 2:] else run end word, sum(k)::bigint n
  from hashed group by 1 having length(word) >= 5 and n >= 3
), places as (select word, n, unnest(range(1, length(word) + 1)) i from words),
holes as (select word, n, i, word[:i - 1] a, word[i + 1:] b from places),
near as (
  select x.word, y.word other, y.n m from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from holes x join words y on y.word = x.a || x.b
  union select y.word, x.word, x.n from holes x join words y on y.word = x.a || x.b
), best as (select word, count(*) n_near, arg_min(other, (-m, other)) other, max(m) m from near group by word),
led as (
  select word, n, coalesce(n_near, 0) n_near, case when m >= 2 * n then other end form, case when m >= 2 * n then m end form_n
  from words left join best using (word)
), chain as (
  select word, word as tip from led union all select c.word, l.form from chain c join led l on l.word = c.tip where l.form is not null
), ends as (select c.word, c.tip root from chain c join led l on l.word = c.tip where l.form is null)
select word, form, root, n, n_near, form_n from led join ends using (word)
"""

OP12 = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) s from documents)
select doc_id, min(doc_id) over (partition by s) keep_id, count(*) over (partition by s) group_size,
  doc_id = min(doc_id) over (partition by s) kept, s text_sha256
from d
"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op5_substring_dedup": OP5,
    "op6_cross_polytope": OP6,
    "op8_minhash": OP8,
    "op10_decontaminate": OP10,
    "op11_pivotal_spelling": OP11,
    "op12_heavy_dedup": OP12,
}
