"""All queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunking, codegraph, dialogue, extraction, frontend, graph, matching, messaging, vectors
from ..session import materialize, table
from ..streaming import debounce as quiet
from . import sources
from .planner import TRIGGERS, rule_plan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NODES = """nodes as (
 select 'region::'||r_regionkey as id, 'region' as type, null as project, r_name as name from region
 union all select 'nation::'||n_nationkey, 'nation', null, n_name from nation
 union all select 'customer::'||c_custkey, 'customer', c_mktsegment, c_name from customer
 union all select 'supplier::'||s_suppkey, 'supplier', null, s_name from supplier
 union all select 'part::'||p_partkey, 'part', p_brand, p_name from part
 union all select 'order::'||o_orderkey, 'order', c_mktsegment, o_orderpriority from orders left join customer on o_custkey = c_custkey)"""
_EDGES = """edges as (
 select 'nation::'||n_nationkey as src, 'region::'||n_regionkey as dst, 'in_region' as type from nation
 union select 'customer::'||c_custkey, 'nation::'||c_nationkey, 'located_in' from customer
 union select 'order::'||o_orderkey, 'customer::'||o_custkey, 'placed_by' from orders
 union select 'order::'||l_orderkey, 'part::'||l_partkey, 'contains' from lineitem
 union select 'part::'||l_partkey, 'supplier::'||l_suppkey, 'supplied_by' from lineitem)"""


def _walk(name: str, root: str, depth: int, backward: bool = False) -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return f"""{name}_w as (select '{root}' as id, 0 as depth union select e.{b}, w.depth + 1 from {name}_w w join edges e on e.{a} = w.id where w.depth < {depth}),
 {name} as (select id, min(depth) as depth from {name}_w group by id having min(depth) > 0)"""


@query(f"with {_NODES} select type, count(*) as n from nodes group by type")
def graph_nodes_by_type(spark, d):
    return graph.relational_graph(spark, d)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_EDGES} select type, count(*) as n from edges group by type")
def graph_edges_by_type(spark, d):
    return graph.relational_graph(spark, d)[1].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_NODES} select case grouping(type, project) when 3 then 'total' when 1 then 'type' else 'project' end as level,
 coalesce(type, project, 'all') as key, count(*) as n from nodes group by grouping sets ((), (type), (project)) having not (grouping(type, project) = 2 and project is null)""")
def graph_summary(spark, d):
    nodes = graph.relational_graph(spark, d)[0]
    g = nodes.groupingSets([[], ["type"], ["project"]], "type", "project").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    g = g.where("not (g = 2 and project is null)")
    return g.select(F.expr("case g when 3 then 'total' when 1 then 'type' else 'project' end").alias("level"), F.coalesce("type", "project", F.lit("all")).alias("key"), "n")


@query(f"with recursive {_EDGES}, {_walk('w', 'order::1', 4)} select id, depth from w")
def bfs_forward(spark, d):
    nodes, edges = graph.relational_graph(spark, d)
    return graph.bfs(edges, nodes.where("id = 'order::1'"), 4)


@query(f"with recursive {_EDGES}, {_walk('w', 'region::0', 3, True)} select id, depth from w")
def bfs_backward(spark, d):
    nodes, edges = graph.relational_graph(spark, d)
    return graph.bfs(graph.reversed_edges(edges), nodes.where("id = 'region::0'"), 3)


@query(f"with recursive {_EDGES}, {_walk('w', 'region::0', 3, True)} select id, depth from w where id not like 'nation::%'")
def bfs_backward_filtered(spark, d):
    return bfs_backward(spark, d).where("id not like 'nation::%'")


@query(f"""with recursive {_NODES}, {_EDGES}, {_walk('o', 'order::1', 4)}, {_walk('i', 'order::1', 3, True)},
 c as (select direction, type, count(*) as n from (select 'outgoing' as direction, id from o union all select 'incoming', id from i) join nodes using (id) group by all)
 select direction, type, n, case when sum(n) over () > 8 then 'HIGH' when sum(n) over () > 3 then 'MEDIUM' else 'LOW' end as risk from c""")
def impact_report(spark, d):
    nodes, edges = graph.relational_graph(spark, d)
    return graph.impact(nodes, edges, "order::1")


@query(f"with {_EDGES} select dst as target, type, count(*) as n, min(src) as first_caller from edges where dst like 'part::%' or dst like 'customer::%' group by all")
def find_callers(spark, d):
    nodes, edges = graph.relational_graph(spark, d)
    return graph.callers(edges, nodes.where("type in ('part', 'customer')"))


@query("""select o_orderkey, n_name as nation, r_name as region, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join lineitem on l_orderkey = o_orderkey group by all""")
def trace_orders(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "nation", "region", "lineitem")}
    items = t["lineitem"].groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
    out = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return out.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "parts", "suppliers")


@query("""select event_type as topic, count(*) filter (where user_id % 2 = 0) as produced, count(*) filter (where user_id % 2 = 1) as consumed,
 min_by(user_id, (ts, event_id)) as first_user, max_by(user_id, (ts, event_id)) as last_user from events group by event_type""")
def event_flow(spark, d):
    at = F.struct("ts", "event_id")
    role = F.col("user_id") % 2
    return table(spark, d, "events").groupBy(F.col("event_type").alias("topic")).agg(
        F.count(F.when(role == 0, 1)).alias("produced"), F.count(F.when(role == 1, 1)).alias("consumed"), F.min_by("user_id", at).alias("first_user"), F.max_by("user_id", at).alias("last_user"))


_SLUG = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)/([^/?#]*)', {})"


@query(f"""select {_SLUG.format(2)} as slug, count(*) as pages, string_agg(distinct {_SLUG.format(1)}, ',' order by {_SLUG.format(1)}) as hosts from pages group by 1""")
def feature_groups(spark, d):
    p = table(spark, d, "pages").select(F.expr(_SLUG.format(2)).alias("slug"), F.expr(_SLUG.format(1)).alias("host"))
    return p.groupBy("slug").agg(F.count(F.lit(1)).alias("pages"), F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))


@query(f"select distinct {_SLUG.format(2)} as slug, upper(substr({_SLUG.format(2)}, 1, 1)) || lower(substr({_SLUG.format(2)}, 2)) as title from pages")
def list_features(spark, d):
    return table(spark, d, "pages").select(F.expr(_SLUG.format(2)).alias("slug")).distinct().select("slug", T.slug_title(F.col("slug")).alias("title"))


@query("""with a as (select c_custkey, c_name, p_partkey, p_name, case when lower(c_mktsegment) = lower(split_part(p_type, ' ', 1)) then 0 else 1 end as tier from customer join part on c_custkey = p_partkey)
 select c_custkey as key, p_partkey as hit, tier from a""")
def tiered_lookup(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "part"), F.col("c_custkey") == F.col("p_partkey"))
    exact = F.lower("c_mktsegment") == F.lower(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1)))
    tiers = [both.where(exact), both]
    return matching.first_match([t.select(F.col("c_custkey").alias("key"), F.col("p_partkey").alias("hit")) for t in tiers], "key", ["hit"])


_PATH = r"regexp_extract({}, '^(?:[a-zA-Z]+://[^/?#]*)?(/[^?#]*)', 1)"


@query(rf"""with e as (select page_id as endpoint_id, {_PATH.format('url')} as epath from pages), c as (select page_id as call_id, regexp_extract(url, '(/[^/?#]*)(?:[?#].*)?$', 1) as cpath from pages),
 m as (select call_id, cpath, endpoint_id, epath, row_number() over (partition by call_id order by cpath <> epath, endpoint_id) as rn from c join e on cpath = epath or (cpath <> '' and epath <> '' and (ends_with(cpath, epath) or ends_with(epath, cpath))))
 select call_id, cpath, endpoint_id, epath from m where rn = 1 and cpath <> '' and epath <> ''""")
def suffix_join(spark, d):
    p = table(spark, d, "pages")
    calls = p.select(F.col("page_id").alias("call_id"), F.regexp_extract("url", "(/[^/?#]*)(?:[?#].*)?$", 1).alias("path")).where("path <> ''")
    ends = p.select(F.col("page_id").alias("endpoint_id"), T.url_path(F.col("url")).alias("path")).where("path <> ''")
    return matching.suffix_join(calls, ends)


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''")
def contract_substring_join(spark, d):
    return matching.substring_join(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")))


@query("""with s as (select distinct p_brand, s_nationkey from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)
 select a.p_brand as service, string_agg(distinct b.p_brand, ',' order by b.p_brand) as targets from s a join s b on a.s_nationkey = b.s_nationkey and a.p_brand <> b.p_brand group by 1""")
def service_dependencies(spark, d):
    s = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("p_brand", "s_nationkey").distinct()
    b = s.select(F.col("p_brand").alias("target"), F.col("s_nationkey").alias("k"))
    return s.join(b, (F.col("s_nationkey") == F.col("k")) & (F.col("p_brand") != F.col("target"))).groupBy(F.col("p_brand").alias("service")).agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderpriority like '1%')")
def unconnected_customers(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority like '1%'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def customers_with_urgent_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority like '1%'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""with l as (select distinct source, line from (select source, unnest(string_split(text, chr(10))) as line from documents) where trim(line, ' ') <> '')
 select line, count(*) as n_sources, string_agg(source, ',' order by source) as sources from l group by line having count(*) > 1""")
def shared_lines(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")).where("n_sources > 1")


@query(r"""select page_id, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), ',') as tags from pages""")
def html_extract(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(tags, ",").alias("tags"))


@query(r"""select page_id, split_part(kv, '=', 1) as key, max(split_part(kv, '=', 2)) as value from (select page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) as kv from pages) where kv like '%=%' group by all""")
def url_properties(spark, d):
    kv = table(spark, d, "pages").select("page_id", F.explode(F.split(F.regexp_extract("url", "[?]([^#]*)", 1), "&")).alias("kv")).where("kv like '%=%'")
    return kv.groupBy("page_id", F.split_part(F.col("kv"), F.lit("="), F.lit(1)).alias("key")).agg(F.max(F.split_part(F.col("kv"), F.lit("="), F.lit(2))).alias("value"))


@query("select event_type, count(*) as n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by 1")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


_CHUNKS = """c as (select doc_id, text, length(text) as n, unnest(range(0, case when length(text) <= 2200 then 1 else cast(ceil((length(text) - 2000) / 1800.0) as bigint) + 1 end)) as i from documents where text <> ''),
 chunks as (select doc_id, i::int as idx, case when n <= 2200 then text else substr(text, i * 1800 + 1, 2000) end as content from c)"""


@query(f"with {_CHUNKS} select doc_id, idx, content from chunks")
def chunk_chars(spark, d):
    return chunking.char_chunks(table(spark, d, "documents"))


@query(f"""with {_CHUNKS} select case grouping(lang, source) when 3 then 'total' when 1 then 'lang' else 'source' end as level, coalesce(lang, source, 'all') as key, count(*) as n
 from chunks join documents using (doc_id) group by grouping sets ((), (lang), (source))""")
def chunk_stats(spark, d):
    docs = table(spark, d, "documents")
    return chunking.chunk_stats(chunking.char_chunks(docs), docs)


@query("""with w as (select doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') as w from documents),
 c as (select doc_id, w, len(w) as n, unnest(range(0, case when len(w) <= 600 then 1 else cast(ceil((len(w) - 500) / 450.0) as bigint) + 1 end)) as i from w where len(w) > 0),
 p as (select doc_id, i, case when n <= 600 then w else w[i * 450 + 1 : i * 450 + 500] end as p from c)
 select doc_id, i::int as idx, len(p)::int as n_tokens, array_to_string(p, ' ') as content from p""")
def chunk_tokens(spark, d):
    return chunking.token_chunks(table(spark, d, "documents"))


@query(f"""with {_NODES}, {_EDGES},
 o as (select src as id, string_agg(type || ' ' || dst, '; ' order by rn) as outs from (select *, row_number() over (partition by src order by type, dst) as rn from edges) where rn <= 12 group by 1),
 i as (select dst as id, string_agg(type || ' ' || src, '; ' order by rn) as ins from (select *, row_number() over (partition by dst order by type, src) as rn from edges) where rn <= 8 group by 1)
 select id, type || ' ' || coalesce(name, '') || ' | out: ' || coalesce(outs, '') || ' | in: ' || coalesce(ins, '') as content from nodes join (o full join i using (id)) using (id)""")
def node_chunks(spark, d):
    return graph.node_chunks(*graph.relational_graph(spark, d))


_KNN = """probes as (select vec_id as probe_id, embedding as probe from embeddings where vec_id % 20 = 0),
 hits as (select probe_id, row_number() over (partition by probe_id order by distance, vec_id) as rank, vec_id, distance from
 (select probe_id, vec_id, round(1 - list_cosine_similarity(embedding::double[], probe::double[]), 6) as distance from embeddings, probes where vec_id <> probe_id))"""


def _hits(spark, d, k):
    v = table(spark, d, "embeddings")
    probes = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))
    return vectors.knn_cosine(v.select("vec_id", "embedding"), probes, k)


@query(f"with {_KNN} select probe_id, rank::int as rank, vec_id, distance from hits where rank <= 8")
def knn_cosine(spark, d):
    return _hits(spark, d, 8)


@query(f"with {_KNN} select vec_id, min(distance) as distance from hits where rank <= 12 group by 1 order by 2, 1 limit 30")
def knn_merge(spark, d):
    return vectors.merge_hits(_hits(spark, d, 12), 30)


@query(f"""with {_KNN}, first as (select * from hits where rank <= 4), found as (select distinct label from first join embeddings using (vec_id)),
 again as (select e.vec_id, min(h.distance) as distance from hits h join embeddings e on e.vec_id = h.vec_id where e.label in (select label from found) and h.rank <= 16 group by 1)
 select vec_id, distance from again where vec_id not in (select vec_id from first)""")
def multihop_expand(spark, d):
    hits = _hits(spark, d, 16)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    first = hits.where("rank <= 4")
    found = first.join(labels, "vec_id").select("label").distinct()
    again = hits.join(labels.join(found, "label", "left_semi"), "vec_id").groupBy("vec_id").agg(F.min("distance").alias("distance"))
    return again.join(first.select("vec_id"), "vec_id", "left_anti")


_QUESTION = "what does the erthin work with license that stble thought"


@query("""with q as (select list_distinct(list_filter(regexp_extract_all(lower('what does the erthin work with license that stble thought'), '\\b(\\w{4,})\\b', 1), lambda x: x not in ('what','how','does','the','and','for','with','that','this','which','when','where','from','into','about','have','been'))) as words)
 select doc_id, round(len(list_filter(words, lambda w: contains(lower(text), w))) + case when source in ('src0', 'src1') then 1.5 when source = 'src2' then 1.2 else 0.0 end + case lang when 'en' then 0.8 when 'de' then 0.6 else 0.0 end
 + greatest(0.0, 1 - n_chars / 10000.0), 6)::double as score from documents, q""")
def hybrid_rerank(spark, d):
    source = F.when(F.col("source").isin("src0", "src1"), "digest").when(F.col("source") == "src2", "graph").otherwise("code")
    kind = F.when(F.col("lang") == "en", "endpoint").when(F.col("lang") == "de", "bean").otherwise("")
    return table(spark, d, "documents").select("doc_id", vectors.hybrid_score(F.col("text"), source, kind, F.col("n_chars") / 10000.0, _QUESTION).alias("score"))


@query("""with n as (select vec_id, label + 1 as label from embeddings where vec_id % 3 = 0) select e.vec_id, coalesce(n.label, e.label)::int as label from embeddings e left join n using (vec_id)""")
def vector_upsert(spark, d):
    old = table(spark, d, "embeddings").select("vec_id", "label")
    return vectors.upsert(old, old.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 1).cast("int").alias("label")), "vec_id").select("vec_id", F.col("label").cast("int").alias("label"))


@query("""with s as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seg, unnest(string_split(text, chr(10))) as s from documents),
 k as (select substr(trim(s, ' '), 1, 200) as fp, doc_id, seg from s where trim(s, ' ') <> ''),
 f as (select fp, min((doc_id, seg)) as x from k group by fp) select x[1] as doc_id, x[2]::int as seg from f""")
def segment_dedup(spark, d):
    return dialogue.segment_dedup(table(spark, d, "documents"))


@query("""select conv_id, string_agg('[' || role || '] ' || case when length(text) > 12000 then substr(text, 1, 12000) || chr(10) || '… (truncated)' else text end, chr(10) || chr(10) order by case when role in ('system', 'assistant') then 0 else 1 end, turn) as context from conversations group by 1""")
def context_assembly(spark, d):
    return dialogue.assemble(table(spark, d, "conversations"), ["system", "assistant"])


_EMPTY = " or ".join(f"starts_with(trim(lower(text), ' '), '{m}')" for m in T.EMPTY_MARKERS)


@query(f"""select conv_id, sum(case when trim(lower(text), ' ') = '' or length(trim(lower(text), ' ')) < 80 or {_EMPTY} then 0 else length(text) end) < 200 as thin,
 bool_or(role in ('system', 'assistant') and length(trim(text, ' ')) > 120) as structural_hit from conversations group by 1""")
def context_flags(spark, d):
    return dialogue.context_flags(table(spark, d, "conversations"), ["system", "assistant"])


def _recent(n: int) -> str:
    return f"""select conv_id, turn, role, case when role = 'assistant' and length(text) > 400 then substr(text, 1, 400) || '…' else text end as text from
 (select *, row_number() over (partition by conv_id order by turn desc, role desc) as rn from conversations where role in ('user', 'assistant')) where rn <= {2 * n}"""


@query(_recent(4))
def recent_turns(spark, d):
    return dialogue.recent_turns(table(spark, d, "conversations"), 4)


@query(_recent(1))
def recent_exchange(spark, d):
    return dialogue.recent_turns(table(spark, d, "conversations"), 1)


@query("""with l as (select user_id, max(ts) as last_active from events group by 1) select user_id, last_active from l where last_active >= (select max(ts) from events) - interval 120 minutes order by last_active desc, user_id limit 200""")
def session_evict(spark, d):
    return dialogue.evict_sessions(table(spark, d, "events"))


def _has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_MODE = "case " + " ".join(f"when {_has(w)} then '{m}'" for m, w in T.MODE_WORDS.items()) + " else 'chat' end"


@query(f"select conv_id, turn, {_MODE} as mode from conversations")
def detect_mode(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.detect_mode(F.col("text")).alias("mode"))


def _says(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


_TOOLS = {name: _says(words) for name, words in TRIGGERS.items()}
_MODE = "case " + " ".join(f"when {_says(words)} then '{mode}'" for mode, words in T.MODE_WORDS.items()) + " else 'chat' end"
_CALL = "{{'tool': '{}', 'input': {}}}".format
_SEARCH, _DEEP = _CALL("search_codebase", "q"), _CALL("search_deep", "q")
_HAS = lambda when, made: f"case when {when} then {made} end"
_TRACE, _SUBJECT_CALLS = _HAS("path <> ''", _CALL("trace_request", "path")), _HAS("subject <> ''", _CALL("get_method_calls", "subject"))
_BRANCHES = [
    (f"mode = 'impact' or {_TOOLS['impact']}", [_CALL("impact_graph", "topic"), _SEARCH]),
    (_TOOLS["features"], [_CALL("list_features", "''"), _DEEP]),
    (_TOOLS["flow"], [_HAS("subject <> ''", _CALL("describe_feature", "subject")), _TRACE, _CALL("search_deep", "'controller endpoint handler ' || topic"), _DEEP, _HAS("subject <> '' and path = ''", _CALL("get_method_calls", "subject"))]),
    ("mode = 'deep'", [_TRACE, _DEEP, _SUBJECT_CALLS, _HAS("path = ''", _CALL("get_api_contracts", "''"))]),
    (f"mode = 'generate' or {_TOOLS['generate']}", [_SEARCH, _HAS("subject <> ''", _CALL("get_entity_schema", "subject"))]),
    (f"{_TOOLS['source']} and regexp_matches(q, '\\b[a-z][A-Za-z]+[A-Z][a-z]')", [_CALL("get_method_implementation", "target"), _CALL("get_method_calls", "topic"), _DEEP]),
    (_TOOLS["api"], [_CALL("get_all_endpoints", "topic"), _CALL("get_external_calls", "topic"), _DEEP]),
    (_TOOLS["schema"], [_CALL("get_entity_schema", "topic"), _CALL("search_deep", "'MongoDB collection document schema ' || topic"), _SEARCH]),
    (f"{_TOOLS['downstream']} and {_TOOLS['calls']}", [_CALL("get_external_calls", "topic"), _DEEP]),
    (_TOOLS["logic"], [_CALL("get_method_implementation", "target"), _CALL("get_method_calls", "topic"), _DEEP]),
    (_TOOLS["callers"], [_CALL("find_callers", "topic"), _SEARCH]),
]
_STOPPED = ", ".join(f"'{w}'" for w in T.SUBJECT_STOP)


_PLANNED = f"""with a as (select conv_id, turn, text as q, lower(text) as low, regexp_extract(text, '(/(?:api|v\\d+)/[\\w/{{}}-]+)', 1) as path, regexp_extract(text, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1) as compound,
 list_filter(regexp_extract_all(text, '\\b([A-Z][a-z]{{2,}})\\b', 1), lambda w: w not in ({_STOPPED})) as single, regexp_extract(text, '\\b([a-z][A-Za-z]+[A-Z][a-z][A-Za-z]*)\\b', 1) as method from @asked),
 b as (select *, case when compound <> '' then compound else coalesce(single[1], '') end as subject, {_MODE} as mode from a),
 c as (select *, case when subject <> '' then subject else substring(q, 1, 40) end as topic from b), e as (select *, case when method <> '' then topic || '::' || method else topic end as target from c),
 plans as (select conv_id, turn, list_filter(case {' '.join(f"when {w} then [{', '.join(calls)}]" for w, calls in _BRANCHES)} else [{_SEARCH}, {_TRACE}] end, lambda x: x is not null) as calls from e),
 each as (select conv_id, turn, unnest(calls) as call, generate_subscripts(calls, 1) as n from plans), once as (select conv_id, turn, call, min(n) as n from each group by all)
 select conv_id, turn, (row_number() over (partition by conv_id, turn order by n) - 1)::int as ord, call.tool as tool, call.input as input from once"""
#: Questions for each branch, about a name.
_ASKED_OF = [
    "What would break if I change @Service", "what features has @", "How does @Service work end to end for /api/v1/@/{id}", "trace the flow of @", "tell me deep detailed facts of @Repo", "create a @Entity",
    "show the source code of loadItems in @Service", "all endpoints of @", "show the db schema of @Order", "downstream feign clients that @Client calls", "how is @Policy applied", "who calls @Repo", "Hello to @ and /api/x",
]


def _plans(c: DataFrame) -> DataFrame:
    plan = c.select("conv_id", "turn", F.posexplode(rule_plan(F.col("text"), T.detect_mode(F.col("text")))).alias("ord", "call"))
    return plan.select("conv_id", "turn", "ord", "call.tool", "call.input")


@query(_PLANNED.replace("@asked", "conversations where role = 'user'"))
def rule_plans(spark, d):
    """Plans of all questions."""
    return _plans(table(spark, d, "conversations").where("role = 'user'"))


_WHO = sources.NATION_NAME


@query(_PLANNED.replace("@asked", f"(select c_custkey as conv_id, i as turn, replace({_ASKED_OF}[i], '@', {_WHO} || case when c_custkey % 2 = 0 then 'Main' else '' end) as text from customer join nation on c_nationkey = n_nationkey, (select unnest(range(1, {len(_ASKED_OF) + 1})) as i))"))
def plan_branches(spark, d):
    """Questions of every branch of the planner, about each customer's nation."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(sources.nation_name(), F.when(F.col("c_custkey") % 2 == 0, "Main").otherwise(""))
    asked = c.select(F.col("c_custkey").alias("conv_id"), name.alias("name"), F.posexplode(F.array(*map(F.lit, _ASKED_OF))).alias("i", "t"))
    return _plans(asked.select("conv_id", (F.col("i") + 1).cast("long").alias("turn"), F.replace("t", F.lit("@"), F.col("name")).alias("text")))


@query("""with g as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
 s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
 select user_id, min(ts) as start, count(*) as n, max_by(event_id, (ts, event_id)) as last_event from s group by user_id, sid""")
def debounce_sessions(spark, d):
    return quiet.debounce(table(spark, d, "events"))


@query("""select c_custkey, count(*) as refs, sum(case when k = 'status' then 1 else 0 end)::bigint as by_status from customer join
 (select o_custkey, unnest(['status', 'priority']) as k, unnest([o_orderstatus, substr(o_orderpriority, 1, 1)]) as v from orders) on o_custkey = c_custkey where v in ('F', '1') group by 1""")
def dto_references(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.explode(F.array(F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("priority").alias("k"), F.substring("o_orderpriority", 1, 1).alias("v")))).alias("x")).select("o_custkey", "x.*").where("v in ('F', '1')")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("refs"), F.sum((F.col("k") == "status").cast("long")).alias("by_status"))


@query(rf"select page_id, case when rtrim({_PATH.format('url')}, '/') = '' then '/' else rtrim({_PATH.format('url')}, '/') end as path from pages")
def normalized_paths(spark, d):
    return table(spark, d, "pages").select("page_id", T.norm_path(T.url_path(F.col("url"))).alias("path"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem group by all""")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""select n_name, c_custkey, spent, rank from (select n_name, c_custkey, round(sum(o_totalprice), 2) as spent, row_number() over (partition by n_name order by round(sum(o_totalprice), 2) desc, c_custkey)::int as rank
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2) where rank <= 3""")
def top_customers(spark, d):
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    named = table(spark, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    order = Window.partitionBy("n_name").orderBy(F.desc("spent"), "c_custkey")
    return named.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("n_name", "c_custkey", "spent", "rank")


def _java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements and members, parsed once: several rows of a query come from the same parse."""
    statements = materialize(extraction.java_statements(files))
    return statements, materialize(extraction.java_members(statements))


def _members(files: DataFrame) -> DataFrame:
    """Members alone; statements are not kept."""
    return materialize(extraction.java_members(extraction.java_statements(files)))


_SLUG_SQL = "lower(regexp_replace({}, '[^A-Za-z0-9]+', '-', 'g'))"
_ENDPOINTS = f"""endpoints as (select {_SLUG_SQL.format('c_mktsegment')} as project, '/api/' || {_SLUG_SQL.format('c_mktsegment')} || '/' || c_custkey || '/orders/' || o_orderkey || '/{{id}}' as path,
 case when o_orderpriority like '1%' then 'POST' else 'GET' end as method, 'Customer' || c_custkey || 'Controller' as controller, 'take' || o_orderkey as handler, 'Order' || o_orderstatus || 'Dto' as response_dto,
 'Order ' || o_orderkey || '.' as javadoc, o_orderkey from orders join customer on o_custkey = c_custkey)"""
_TOPICS = """topics as (select 'user-' || user_id as project, event_type || '-' || (event_id % 50) as topic, case when count(distinct value > 50) > 1 then 'both' when bool_or(value > 50) then 'consumer' else 'producer' end as role from
 (select user_id, event_type, event_id, coalesce(value, 0) as value from events) group by 1, 2)"""


@query(f"""with {_ENDPOINTS} select * exclude (o_orderkey), case when method = 'POST' then replace(response_dto, 'Dto', 'Request') end as request_dto, case when method = 'POST' then 'CLERK,DESK' else '' end as roles, method = 'POST' as auth_required
 from endpoints""")
def extract_endpoints(spark, d):
    out = extraction.endpoints(_members(sources.controllers(spark, d))).drop("file", "no")
    return out.withColumn("roles", F.array_join("roles", ","))


@query(f"""select {_SLUG_SQL.format('c_mktsegment')} as project, 'Customer' || c_custkey || 'Controller' as name, 'controller' as bean_type, 'CheckService,Nation' || c_nationkey || 'Service' as dependencies, count(*) as n_methods
 from orders join customer on o_custkey = c_custkey group by c_mktsegment, c_custkey, c_nationkey""")
def extract_beans(spark, d):
    b = extraction.beans(_members(sources.controllers(spark, d)))
    return b.select("project", "name", "bean_type", F.array_join("dependencies", ",").alias("dependencies"), F.size("methods").cast("long").alias("n_methods"))


@query("select 'Customer' || o_custkey || 'Controller' as cls, 'take' || o_orderkey as method, 'check.pass,orders.find' as calls from orders join customer on o_custkey = c_custkey")
def extract_method_calls(spark, d):
    return extraction.method_calls(*_java(sources.controllers(spark, d))).select("cls", "method", F.array_join("calls", ",").alias("calls"))


@query(f"select {_SLUG_SQL.format('p_brand')} as project, 'Part' || p_partkey || 'Request' as name, 't_' || p_size as \"table\", 'key,brand' || p_size as fields, 'ManyToOne -> maker' as relationships from part")
def extract_entities(spark, d):
    e = extraction.entities(_members(sources.entities(spark, d)))
    return e.select("project", "name", "table", F.array_join("fields", ",").alias("fields"), F.array_join("relationships", ",").alias("relationships"))


@query(f"""select {_SLUG_SQL.format('p_brand')} as project, 'Part' || p_partkey || 'Request' as dto, unnest(['key', 'brand' || p_size, 'maker']) as name, unnest(['Long', 'String', 'Maker']) as type, unnest([true, false, false]) as required from part""")
def extract_dto_fields(spark, d):
    return extraction.dto_fields(_members(sources.entities(spark, d))).select("project", "dto", "name", "type", "required")


@query(f"""select {_SLUG_SQL.format('n_name')} as project, 's' || s_suppkey as client, 'region-' || n_regionkey as target, 'GET' as method, '/orders/' || l_orderkey || '/{{line}}' as path, 'LineDto' as response_dto
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""")
def extract_client_calls(spark, d):
    m = _members(sources.clients(spark, d))
    return extraction.client_calls(m, sources.settings(spark, d)).select("project", "client", "target", "method", "path", "response_dto")


def _topics(spark, d):
    return messaging.topics(*_java(sources.listeners(spark, d)), sources.topic_settings(spark, d))


@query(f"with {_TOPICS} select project, topic, role from topics")
def extract_topics(spark, d):
    return _topics(spark, d).select("project", "topic", "role")


@query(f"""with {_TOPICS} select topic, coalesce(string_agg(project, ',' order by project) filter (role <> 'consumer'), '') as producers, coalesce(string_agg(project, ',' order by project) filter (role <> 'producer'), '') as consumers from topics group by topic""")
def code_event_flow(spark, d):
    return codegraph.event_flow(_topics(spark, d)).select("topic", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


@query("""with e as (select 'user-' || user_id as project, event_type || '-' || event_id % 50 as topic, value > 50 as heard, event_id % 3 as way, 'topic.' || event_type || '.' || event_id % 50 as key, event_id % 50 as k from events)
 select project, topic, coalesce(min(case when heard and way = 1 then key when heard and way = 2 then 'gone.' || k end), min(key)) as property_key, max(case when heard then 'g' end) as group_id from e group by project, topic""")
def topic_keys(spark, d):
    """The setting behind each topic, by its reference or by its value, and the listening group."""
    return _topics(spark, d).select("project", "topic", "property_key", "group_id")


@query(f"""select {_SLUG_SQL.format('p_brand')} as project, 'Part' || p_partkey || 'Item' as name,
 case when p_partkey % 4 = 0 then 'parts_' || p_size when p_partkey % 4 = 3 then 'Part' || p_partkey || 'Item' when p_size % 2 = 0 then 'p_' || p_size || 'x' else 'p_any' end as collection from part""")
def stored_collections(spark, d):
    return messaging.collections(_members(sources.stored_documents(spark, d)), sources.size_settings(spark, d))


@query("""select 'Supplier' || s_suppkey || 'Service' as service, case s_suppkey % 6 when 0 then 'own' when 1 then 'parent' when 2 then 'override' when 3 then 'slug' else 'literal' end as via,
 case when s_suppkey % 6 = 2 then 'PUT' when s_suppkey % 6 = 1 and s_nationkey % 2 = 0 then 'POST' else 'GET' end as method,
 case s_suppkey % 6 when 0 then '/api/supplier/' || s_suppkey when 1 then case when s_nationkey % 2 = 0 then '/api/nation/' || s_nationkey else '/api/base' end when 2 then 'v2/s/' || s_suppkey
 when 3 then case when s_nationkey % 3 = 0 then 'v1/all-' || s_nationkey else 'v1/n' || s_nationkey end else 'v1/supplier-' || s_suppkey end as url from supplier where s_suppkey % 6 < 5""")
def service_calls(spark, d):
    """HTTP calls of front-end services, through up to two ancestors."""
    return frontend.service_calls(materialize(sources.front_services(spark, d))).select("service", "via", "method", "url")


@query("""select 'V' || o_custkey || '__orders.sql' as file, count(distinct o_orderstatus) as n_tables, least(count(*), 6) as n_columns, 'c' || min(o_orderkey) || ':text' as first_column from orders group by o_custkey""")
def extract_migrations(spark, d):
    m = extraction.migrations(sources.migrations(spark, d))
    return m.select("file", F.size("tables").cast("long").alias("n_tables"), F.size("columns").cast("long").alias("n_columns"), F.element_at("columns", 1).alias("first_column"))


@query(f"""with {_ENDPOINTS} select distinct 'bean::' || {_SLUG_SQL.format('n_name')} || '::s' || s_suppkey as src, 'endpoint::' || project || '::GET::' || path as dst, 'GET /orders/' || l_orderkey || '/*' as label
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join endpoints on o_orderkey = l_orderkey where method = 'GET'""")
def code_client_edges(spark, d):
    calls = materialize(extraction.client_calls(_members(sources.clients(spark, d)), sources.settings(spark, d)))
    c = _members(sources.controllers(spark, d))
    return codegraph.client_edges(calls, materialize(extraction.endpoints(c)), materialize(extraction.beans(c))).select("src", "dst", "label")


@query(f"with {_ENDPOINTS} select 'endpoint::' || project || '::' || method || '::' || path as src, 'bean::' || project || '::' || controller as dst from endpoints")
def code_handled_by(spark, d):
    c = _members(sources.controllers(spark, d))
    return codegraph.handled_by(extraction.endpoints(c), extraction.beans(c)).select("src", "dst")


@query(f"""with {_TOPICS}, heard as (select project, topic from topics where role <> 'producer'), said as (select project as target, topic from topics where role <> 'consumer')
 select {_SLUG_SQL.format('n_name')} as project, 'region-' || n_regionkey as targets from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all
 union all select project, string_agg(distinct target, ',' order by target) from heard join said using (topic) where project <> target group by project""")
def code_service_dependencies(spark, d):
    """Targets of clients, and who sends the topics that a project listens to."""
    calls = extraction.client_calls(_members(sources.clients(spark, d)), sources.settings(spark, d))
    return codegraph.service_dependencies(calls, _topics(spark, d)).select("project", F.array_join("targets", ",").alias("targets"))



def queries() -> dict[str, Query]:
    from . import change_queries, chunk_queries, front_queries, graph_queries, search_queries, tool_queries, trace_queries  # noqa: F401  these register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
