"""DuckDB SQL of the Merkle manifest: the same trees by recursive levels."""

from __future__ import annotations

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_REST = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: One byte shifts the register eight times; fixed value: the reversed polynomial of this checksum.
_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: {_BYTE}), 4294967295)"
_SIBLINGS = """coalesce(string_agg(h, '') over (partition by tree, lang, level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as lft,
 coalesce(string_agg(h, '') over (partition by tree, lang, level, pos // 8 order by pos rows between 1 following and unbounded following), '') as rgt"""


def _levels(start: str) -> str:
    return f"""{start}
 union all select lang, level + 1, pos // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' order by pos)) from {{0}} where n > 1 group by lang, level, pos // 8"""


SQL = f"""with recursive leaves as (
 select row_number() over () as r, doc_id, lang, sha256({_REST} || {_FIELD.format('text')}) as leaf, case when {_CRC} % 3 = 0 then sha256({_REST} || {_FIELD.format(_LOWER)}) end as other from documents),
 placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaves),
 low(lang, level, pos, n, h) as ({_levels("select lang, 0, pos, n, leaf from placed").format("low")}),
 tops as (select lang, h, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from low where n = 1),
 high(lang, level, pos, n, h) as ({_levels("select null::varchar, 0, pos, n, h from tops").format("high")}),
 nodes as (select *, {_SIBLINGS} from (select 0 as tree, * from low union all select 1, * from high)),
 fold(r, tree, lang, level, pos, top, h, proof) as (
  select r, 0, placed.lang, 0, placed.pos, tops.pos, coalesce(other, leaf), '' from placed join tops on placed.lang is not distinct from tops.lang
  union all
  select r, case when e.n > 1 then f.tree else 1 end, case when e.n > 1 then f.lang end, case when e.n > 1 then f.level + 1 else 0 end, case when e.n > 1 then f.pos // 8 else f.top end, f.top,
   case when e.n > 1 then sha256(e.lft || f.h || e.rgt) else f.h end, case when e.n > 1 then f.proof || e.lft || e.rgt else f.proof end
  from fold f join nodes e on f.tree = e.tree and f.lang is not distinct from e.lang and f.level = e.level and f.pos = e.pos where e.n > 1 or f.tree = 0)
select doc_id, leaf, s.h as subroot, t.h as root, sha256(f.proof) as proof_sha256, f.h as folded_root, f.h = t.h as verified
from fold f join high t on f.tree = 1 and t.n = 1 and f.level = t.level join placed p on p.r = f.r join tops s on s.lang is not distinct from p.lang"""
