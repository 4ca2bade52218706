"""Queries over a front end that the given tables describe: pages are its components, order segments the back ends.

A page lies in a folder named after its host and uses a service for its language and one for a segment; orders give end
points, calls, contracts and publishers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, codegraph, features, lookup, search, vectors
from ..session import materialize, table
from . import sources
from .catalogue import _ENDPOINTS, _NODES, _SLUG, _SLUG_SQL, query
from ..operators import graph
from ..operators.pieces import code_pieces

_BOXES, _SEGMENTS = ["components", "pages", "shared"], ["Machinery", "Building", "Automobile", "Household", "Furniture"]
_WEB = f"""web as (select *, 'src/app/' || box || '/' || slug || '/page-' || page_id || '.component.ts' as path, array_to_string(list_transform(string_split(slug, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title
 from (select page_id, 'Page' || page_id || 'Component' as name, replace({_SLUG.format(1)}, '.', '-') as slug, {_BOXES}[page_id % 3 + 1] as box,
 [upper({_SLUG.format(2)}) || 'Service', {_SEGMENTS}[page_id % 5 + 1] || 'Service'] as services, lower({_SEGMENTS}[page_id % 5 + 1]) as backend from pages))"""


def components(spark, d) -> DataFrame:
    p = table(spark, d, "pages")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    host = F.replace(F.expr(_SLUG.format(1)), F.lit("."), F.lit("-"))
    path = F.format_string("src/app/%s/%s/page-%d.component.ts", pick(_BOXES, 3), host, "page_id")
    uses = F.array(F.concat(F.upper(F.expr(_SLUG.format(2))), F.lit("Service")), F.concat(pick(_SEGMENTS, 5), F.lit("Service")))
    return p.select(F.lit("web").alias("project"), F.format_string("Page%dComponent", "page_id").alias("name"), path.alias("path"), uses.alias("services"))


def services(spark, d) -> DataFrame:
    return components(spark, d).select("project", F.explode("services").alias("name")).distinct()


def endpoints(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    slug, method = sources._slug("c_mktsegment"), F.when(F.startswith("o_orderpriority", F.lit("1")), "POST").otherwise("GET")
    path = F.format_string("/api/%s/%d/orders/%d/{id}", slug, "c_custkey", "o_orderkey")
    return o.select(codegraph.endpoint_id(slug, method, path).alias("id"), slug.alias("project"), method.alias("method"), path.alias("path"), "o_orderkey", "o_orderstatus")


def beans(spark, d) -> DataFrame:
    """A service for each segment, and a controller for each customer."""
    c = table(spark, d, "customer")
    slug = sources._slug("c_mktsegment")
    facade = c.select(slug.alias("project"), F.concat(F.initcap(slug), F.lit("Facade")).alias("name"), F.lit("service").alias("bean_type")).distinct()
    return facade.unionByName(c.select(slug.alias("project"), F.format_string("Customer%dController", "c_custkey").alias("name"), F.lit("controller").alias("bean_type")))


def backends(spark, d) -> DataFrame:
    projects = beans(spark, d).where("bean_type = 'service'").select("project").distinct()
    return features.backend_of(services(spark, d), projects.withColumn("ord", F.xxhash64("project")))


def http_calls(spark, d) -> DataFrame:
    e = endpoints(spark, d).where("project <> 'furniture'")  # whose service makes none of its own
    return e.select(F.lit("web").alias("project"), F.concat(F.initcap("project"), F.lit("Service")).alias("service"), "method", F.concat(F.lit("https://gw.example.com"), "path", F.lit("?x=1")).alias("url"))


def edges(spark, d) -> DataFrame:
    c, s, b = components(spark, d), services(spark, d), beans(spark, d)
    back = materialize(backends(spark, d))
    http = materialize(codegraph.http_edges(http_calls(spark, d), endpoints(spark, d)))
    f = features.feature_nodes(c, back)
    parts = [codegraph.uses_service(c, s), http, codegraph.inferred_edges(s, http, back, b), features.feature_edges(f, c, s, b)]
    return codegraph.union_edges(parts)


_HTTP = f"""calls as (select upper(project[1]) || project[2:] || 'Service' as service, project, method, path from endpoints where project <> 'furniture'),
 used as (select distinct unnest(services) as service from web),
 http as (select distinct 'angular_service::web::' || service as src, 'endpoint::' || project || '::' || method || '::' || path as dst, 'http_call' as type, service || '.' || lower(method) || '() → ' || regexp_replace(path, '\\{{[^}}]*\\}}', '*', 'g') as label from calls)"""
_FEATURES = """features as (select 'user_function::web::' || slug as id, slug as feature_key, any_value(title) as name, min_by(name, path) as entry_components,
 list_sort(list_distinct(flatten(list(services)))) as services, list_sort(list_distinct(list(backend))) as backends from web where box <> 'shared' group by slug)"""
_ALL_EDGES = f"""edges as (
 select 'angular_component::web::' || name as src, 'angular_service::web::' || s as dst, 'uses_service' as type, name || ' uses ' || s as label from (select name, unnest(services) as s from web)
 union select * from http
 union select 'angular_service::web::FurnitureService', 'bean::furniture::FurnitureFacade', 'inferred_http_call', 'FurnitureService → furniture (inferred by name)' from used where service = 'FurnitureService'
 union select 'angular_service::web::' || service, 'bean::' || lower(replace(service, 'Service', '')) || '::' || replace(service, 'Service', '') || 'Facade', 'inferred_http_call', service || ' → ' || lower(replace(service, 'Service', '')) || ' (inferred by name)' from used
  where lower(replace(service, 'Service', '')) in (select lower(c_mktsegment) from customer) and 'angular_service::web::' || service not in (select src from http)
 union select 'angular_component::web::' || name, 'user_function::web::' || slug, 'part_of_feature', name || ' is part of ' || title from web where box <> 'shared'
 union select id, 'angular_service::web::' || s, 'feature_uses', name || ' uses ' || s from (select id, name, unnest(services) as s from features)
 union select id, 'bean::' || b || '::' || upper(b[1]) || b[2:] || 'Facade', 'feature_calls', name || ' calls ' || upper(b[1]) || b[2:] || 'Facade [' || b || ']' from (select id, name, unnest(backends) as b from features))"""
_CODE = f"with {_WEB}, {_ENDPOINTS}, {_HTTP}, {_FEATURES}, {_ALL_EDGES}"


@query(f"with {_WEB} select name, slug as feature_key, title from web where box <> 'shared'")
def feature_slugs(spark, d):
    c = components(spark, d).withColumn("feature_key", T.feature_slug(F.col("path"))).where("feature_key is not null")
    return c.select("name", "feature_key", T.slug_title(F.col("feature_key")).alias("title"))


@query(f"with {_WEB}, {_FEATURES} select id, feature_key, name, entry_components, array_to_string(services, ',') as services, array_to_string(backends, ',') as backends from features")
def feature_nodes(spark, d):
    f = features.feature_nodes(components(spark, d), backends(spark, d))
    return f.select("id", "feature_key", "name", *[F.array_join(c, ",").alias(c) for c in ("entry_components", "services", "backends")])


@query(f"{_CODE} select distinct src, dst, type, min(label) as label from edges group by src, dst, type")
def frontend_edges(spark, d):
    return edges(spark, d)


@query(f"""with {_ENDPOINTS} select distinct 'angular_service::web::' || upper(project[1]) || project[2:] || 'Service' as src, 'endpoint::' || project || '::' || method || '::' || path as dst, 'http_call' as type,
 upper(project[1]) || project[2:] || 'Service.load → ' || project || ' ' || method || ' /orders/' || o_orderkey || '/{{id}}' as label from endpoints""")
def contract_edges(spark, d):
    e = endpoints(spark, d)
    made = e.select(F.lit("web").alias("caller"), F.col("project").alias("service"), F.format_string("%s /orders/%d/{id}", "method", "o_orderkey").alias("endpoint"), F.concat(F.initcap("project"), F.lit("Service.load")).alias("angular_service"))
    known = e.select(F.lit("web").alias("project"), F.concat(F.initcap("project"), F.lit("Service")).alias("name")).distinct()
    return codegraph.contract_edges(made, known, e)


@query(f"""with {_ENDPOINTS} select distinct 'endpoint::' || project || '::POST::' || path as src, 'kafka_topic::order-' || lower(o_orderstatus) as dst, 'publishes_to' as type,
 'POST /orders/' || o_orderkey || '/{{id}} publishes to order-' || lower(o_orderstatus) as label from endpoints join orders using (o_orderkey) where method = 'POST'""")
def publish_edges(spark, d):
    e = endpoints(spark, d)
    sent = e.where("method = 'POST'").select("project", F.concat(F.lit("order-"), F.lower("o_orderstatus")).alias("topic"), F.lit("producer").alias("role"), F.format_string("POST /orders/%d/{id}", "o_orderkey").alias("publisher_endpoint"))
    return codegraph.publish_edges(sent, e)


@query(f"with {_ENDPOINTS} select 'endpoint::' || project || '::' || method || '::' || path as id, method, path from endpoints where contains(lower(path), '/orders/1')")
def endpoint_lookup(spark, d):
    return lookup.find_endpoints(endpoints(spark, d), " /Orders/1").select("id", "method", "path")


@query(f"""with {_NODES}, t as (select id, name, case when lower(name) = 'red widget' then 0 when contains(lower(name), 'red widget') then 1 end as tier from nodes)
 select id, name from t where tier = (select min(tier) from t)""")
def node_lookup(spark, d):
    nodes = graph.relational_graph(spark, d)[0].select("id", "name", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("path"))
    return lookup.find_nodes(nodes, "Red Widget").select("id", "name")


_SIMPLE = "simple as (select 'endpoint::n::' || m || '::/api/nation/' || n_nationkey || '/{id}' as id, m as method, '/api/nation/' || n_nationkey || '/{id}' as path from nation, (select unnest(['GET', 'POST']) as m))"


@query(f"with {_SIMPLE} select id, method, path from simple where method = 'GET' and path = '/api/nation/7/{{id}}'")
def endpoint_exact(spark, d):
    """The first tier: a method and a path, whose variables may have other names."""
    n = table(spark, d, "nation").select(F.explode(F.array(F.lit("GET"), F.lit("POST"))).alias("method"), F.format_string("/api/nation/%d/{id}", "n_nationkey").alias("path"))
    return lookup.find_endpoints(n.select(F.concat_ws("::", F.lit("endpoint"), F.lit("n"), "method", "path").alias("id"), "method", "path"), "get /api/nation/7/{key}/")


@query(f"with {_NODES} select id, name from nodes where lower(name) = 'middle east'")
def node_exact(spark, d):
    """The first tier: equal names in any case."""
    nodes = graph.relational_graph(spark, d)[0].select("id", "name", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("path"))
    return lookup.find_nodes(nodes, " Middle EAST ").select("id", "name")


@query("select distinct 'kafka_topic::' || event_type || '-' || (event_id % 50) as id, event_type || '-' || (event_id % 50) as name from events where contains('user-' || user_id, 'user-7')")
def topics_of_project(spark, d):
    """The second tier: no topic has the name, so those of projects that do."""
    return lookup.find_topics(*_topic_graph(spark, d), "User-7")


@query("select distinct 'kafka_topic::' || event_type || '-' || (event_id % 50) as id, event_type || '-' || (event_id % 50) as name from events where contains(event_type || '-' || (event_id % 50), 'click-1') or contains('click-1', event_type || '-' || (event_id % 50))")
def topic_lookup(spark, d):
    return lookup.find_topics(*_topic_graph(spark, d), "CLICK-1")


def _topic_graph(spark, d):
    name = F.format_string("%s-%d", "event_type", F.col("event_id") % 50)
    e = table(spark, d, "events").select(name.alias("name"), F.format_string("user-%d", "user_id").alias("project"))
    topics = e.select(F.concat(F.lit("kafka_topic::"), "name").alias("id"), F.lit("kafka_topic").alias("type"), F.lit(None).cast("string").alias("project"), "name").distinct()
    users = e.select(F.concat(F.lit("bean::"), "project").alias("id"), F.lit("spring_service").alias("type"), "project", F.col("project").alias("name")).distinct()
    sent = e.select(F.concat(F.lit("bean::"), "project").alias("src"), F.concat(F.lit("kafka_topic::"), "name").alias("dst"), F.lit("produces_event").alias("type")).distinct()
    return topics.unionByName(users), sent


_ASKED = "the example net feature"
_FOUND = """found as (select *, case when lower(name) in (raw, plain) then 0 when contains(lower(name), raw) or contains(lower(name), plain) or contains(raw, lower(name)) or contains(plain, replace(feature_key, '-', ' ')) or contains(replace(feature_key, '-', ' '), plain) then 1
 when len(list_intersect(string_split(plain, ' '), string_split(lower(name), ' '))) >= 2 then 2 end as tier from features, (select 'the example net feature' as raw, 'the example net' as plain)),
 best as (select * from found where tier is not null order by tier, case when tier = 2 then len(list_intersect(string_split(plain, ' '), string_split(lower(name), ' '))) else 0 end desc, id limit 1)"""


@query(f"with {_WEB}, {_FEATURES}, {_FOUND} select id, feature_key, name from best")
def feature_lookup(spark, d):
    return features.find_feature(features.feature_nodes(components(spark, d), backends(spark, d)), _ASKED).select("id", "feature_key", "name")


@query(f"""{_CODE}, {_FOUND},
 s as (select 'component' as section, src as item from edges where type = 'part_of_feature' and dst in (select id from best) union select 'service', dst from edges where type = 'feature_uses' and src in (select id from best)
 union select 'backend', dst from edges where type = 'feature_calls' and src in (select id from best)
 union select 'endpoint', e.dst from edges e join edges u on u.dst = e.src and u.type = 'feature_uses' and u.src in (select id from best) where e.type = 'http_call'),
 n as (select *, row_number() over (partition by section order by item) as nth from s) select section, item from n where nth <= case section when 'component' then 10 when 'endpoint' then 8 else 1000000 end""")
def describe_feature(spark, d):
    found = features.find_feature(features.feature_nodes(components(spark, d), backends(spark, d)), _ASKED)
    return features.describe_feature(found, materialize(edges(spark, d)), endpoints(spark, d)).select("section", "item")


@query(f"""with {_ENDPOINTS}, c as (select project, 'endpoint' as type, handler as name, 'Endpoint ' || method || ' ' || path || chr(10) || 'controller=' || controller || ' handler=' || handler || chr(10) || 'request=None response=' || response_dto || chr(10) || 'auth=False roles=[]' || chr(10) || 'doc=' || javadoc as content from endpoints
 union all select {_SLUG_SQL.format('p_brand')}, 'entity', 'Part' || p_partkey || 'Request', 'Entity Part' || p_partkey || 'Request table=t_' || p_size || chr(10) || 'fields=[''key'', ''brand' || p_size || ''']' || chr(10) || 'relationships=[''ManyToOne -> maker'']' from part)
 select sha256(project || '::' || type || '::' || name || '::0') as id, project, type, name, content from c""")
def digest_chunks(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.format_string("Customer%dController", "c_custkey").alias("controller"))
    e = endpoints(spark, d).join(o, "o_orderkey").select("project", "method", "path", "controller", F.format_string("take%d", "o_orderkey").alias("handler"), F.lit(None).cast("string").alias("request_dto"), F.format_string("Order%sDto", "o_orderstatus").alias("response_dto"), F.lit(False).alias("auth_required"), F.array().cast("array<string>").alias("roles"), F.format_string("Order %d.", "o_orderkey").alias("javadoc"))
    p = table(spark, d, "part").select(sources._slug("p_brand").alias("project"), F.format_string("Part%dRequest", "p_partkey").alias("name"), F.format_string("t_%d", "p_size").alias("table"), F.array(F.lit("key"), F.format_string("brand%d", "p_size")).alias("fields"), F.array(F.lit("ManyToOne -> maker")).alias("relationships"))
    return chunking.digest_chunks(endpoints=e, entities=p)


@query("""with t as (select o_custkey, count(*) as n from orders join customer on o_custkey = c_custkey group by 1) select 'src/Customer' || o_custkey || 'Controller.java' as path, case when n < 2 then 1 else n + 1 end as pieces from t""")
def semantic_chunks(spark, d):
    pieces = code_pieces(sources.controllers(spark, d).select("path", "text"))
    return pieces.groupBy("path").agg(F.count(F.lit(1)).alias("pieces"))


_NEAR = """probe as (select embedding::double[] as p from embeddings where vec_id = 0), near as (select vec_id, round(1 - list_cosine_similarity(embedding::double[], p), 6) as distance from embeddings, probe where vec_id <> 0 {})"""


def _probe(spark, d):
    v = table(spark, d, "embeddings")
    return v, v.where("vec_id = 0").select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))


@query(f"with {_NEAR.format('and label = 3')} select vec_id, distance from near order by distance, vec_id limit 16")
def knn_filtered(spark, d):
    v, probe = _probe(spark, d)
    return vectors.knn_cosine(v.where("label = 3"), probe, 16).select("vec_id", "distance")


@query(f"""with {_NEAR.format('')}, hits as (select * from near order by distance, vec_id limit 16), q as (select ['license','word','stble','thought'] as words),
 s as (select vec_id, distance, text, lang, round(len(list_filter(words, lambda w: contains(lower(text), w))) + 1.5 + greatest(0.0, 1 - distance), 6) as score from hits join documents on doc_id = vec_id, q),
 r as (select *, row_number() over (order by score desc, distance, vec_id) as i from s)
 select i::int as i, '[SOURCE ' || i || '] project=' || lang || ' type=digest file=digest class= method=' || chr(10) || text as block from r where i <= 8""")
def search_context(spark, d):
    v, probe = _probe(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.lit("digest").alias("source"), F.lit("digest").alias("type"), F.col("lang").alias("project"))
    return search.context(search.search(v, texts, probe, "license word stble thought"))


@query(f"""with n as (select {_SLUG_SQL.format('n_name')} as project, n_nationkey as k from nation) select 'JWT' as type, (select project from n where k % 4 = 1 order by k limit 1) as token_issuer,
 (select string_agg(project, ',' order by project) from n where k % 3 = 0) as validated_by, 'HttpAuthInterceptor' as fe_interceptor""")
def auth_flow(spark, d):
    n = table(spark, d, "nation").select(sources._slug("n_name").alias("project"), F.col("n_nationkey").alias("ord"))
    facts = n.select("project", "ord", (F.col("ord") % 3 == 0).alias("jwt_filter"))
    paths = n.select("project", F.when(F.col("ord") % 4 == 1, "/api/auth/token").otherwise("/api/items").alias("path"))
    guards = spark.createDataFrame([(0, "LoggingInterceptor"), (1, "HttpAuthInterceptor"), (2, "JwtInterceptor")], "ord int, name string")
    return codegraph.auth_flow(facts, paths, guards).withColumn("validated_by", F.array_join("validated_by", ","))
