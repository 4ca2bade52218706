"""DuckDB SQL of corpus operators that plain joins can express, for small tables: exact, without the operators' filters."""

from __future__ import annotations

from .merkle_sql import SQL as MANIFEST

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Nearest vectors: products are added in order, as the operator does.
NEIGHBOURS = """with v as (select vec_id, min(embedding::double[]) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id),
 p as (select q.vec_id as query_id, c.vec_id, list_reduce(list_prepend(0::double, list_transform(range(1, len(q.v) + 1), lambda i: c.v[i] * q.v[i])), lambda a, x: a + x) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""

_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER)

#: Benchmark passages: all windows of all lengths that items have.
CONTAMINATION = f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark),
 n as (select distinct least(len(w), 13) as n from i where len(w) > 0), win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') as s from i, lateral (select unnest(range(1, len(w) - least(len(w), 13) + 2)) as k) where len(w) > 0),
 spot as (select r, k, d.n, item_id from (select r, n, unnest(range(1, len(w) - n + 2)) as k, w from d, n where len(w) >= n) d join win on win.n = d.n and win.s = array_to_string(d.w[k:k + d.n - 1], ' ')),
 hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from spot) group by r), items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id::varchar as item_id from spot) group by r)
 select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
 from d left join hit using (r) left join items using (r)"""

#: Near duplicates: equal sets are one class; classes that share a shingle are compared; links are followed to the least id.
NEAR_DUPLICATES = f"""with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select r, doc_id, case when len(w) >= 5 then list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) when len(w) > 0 then [len(w) || ' ' || array_to_string(w, ' ')] else []::varchar[] end as s from d),
 classes as (select min(doc_id) as c, s, md5(array_to_string(s, chr(10))) as h from s where len(s) > 0 group by s),
 grams as (select c, len(s) as n, unnest(s) as g from classes), links as (select x.c as a, y.c as b from grams x join grams y on x.g = y.g and x.c < y.c group by x.c, y.c, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
 ways as (select a, b from links union all select b, a from links), reach(a, b) as (select c, c from classes union select reach.a, ways.b from reach join ways on reach.b = ways.a),
 lowest as (select a as c, min(b) as component_id from reach group by a)
 select doc_id, len(s.s)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept from s left join classes on len(s.s) > 0 and classes.s = s.s left join lowest using (c)"""

#: Repeated strings: every 200-byte string by its bytes; covered bytes are the union of repeated ones.
REPEATS = """with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents), n as (select *, octet_length(b) as n from d),
 s as (select r, k, hash(b[k:k + 199]) as h, md5(b[k:k + 199]) as m from (select r, b, unnest(range(1, n - 198)) as k from n where n >= 200)),
 again as (select h, m from s group by h, m having count(*) > 1), hit as (select r, k from s semi join again using (h, m)),
 mark as (select *, case when k > lag(k) over w + 200 or lag(k) over w is null then 1 else 0 end as fresh from hit window w as (partition by r order by k)),
 span as (select r, min(k) as a, max(k) + 200 as b from (select *, sum(fresh) over (partition by r order by k rows unbounded preceding) as g from mark) group by r, g),
 gap as (select r, coalesce(lag(b) over w, 1) as a, a as b from span window w as (partition by r order by a) union all select r, max(b), null from span group by r),
 kept as (select r, string_agg(hex(n.b[gap.a:coalesce(gap.b, n.n + 1) - 1]), '' order by gap.a) as hex from gap join n using (r) where coalesce(gap.b, n.n + 1) > gap.a group by r),
 gone as (select r, sum(b - a) as n_removed, count(*) as n_spans from span group by r)
 select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, case when n_removed is null then sha256(n.b) else sha256(from_hex(coalesce(hex, ''))) end as kept_sha256 from n left join gone using (r) left join kept using (r)"""

#: Similar lines: words by rarity, lines that share one of their rarest are compared whole; the earlier of two stays.
LINES = f"""with t as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
 l as (select r, doc_id, i as no, ls[i] as line, list_distinct(regexp_extract_all(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) as w from t, lateral (select unnest(range(1, len(ls) + 1)) as i)),
 sets as (select list_sort(w) as w, min((doc_id, no)) as spot, row_number() over () as k from l where len(w) > 0 group by list_sort(w)),
 each as (select k, len(w) as n, unnest(w) as x from sets), often as (select x, count(*) as c from each group by x),
 placed as (select k, n, x, row_number() over (partition by k order by c, x) as p from each join often using (x)),
 rare as (select k, n, x from placed where p <= n - ceil(0.75 * n)::int + 1),
 near as (select distinct a.k as a, b.k as b from rare a join rare b on a.x = b.x and a.k < b.k and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
 alike as (select case when x.spot > y.spot then a else b end as k from near join sets x on x.k = a join sets y on y.k = b where 100 * len(list_intersect(x.w, y.w)) >= 75 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))),
 stay as (select spot from sets where k not in (select k from alike)), told as (select r, doc_id, no, line, len(w) > 0 and (doc_id, no) not in (select spot from stay) as gone from l),
 out as (select r, count(*) filter (gone) as n, coalesce(string_agg(line, chr(10) order by no) filter (not gone), '') as text from told group by r)
 select d.doc_id, coalesce(out.n, 0)::bigint as n_lines_removed, sha256(coalesce(out.text, '')) as text_sha256 from (select row_number() over () as q, * from documents) d left join (select t.doc_id, t.text as whole, out.n, out.text from t join out using (r)) out on d.doc_id = out.doc_id and d.text = out.whole"""
