"""Texts for retrieval, made of facts that the extraction finds in source texts, and windows of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunking, codegraph, extraction, fact_chunks, features, frontend
from ..session import materialize, table
from . import front_queries as front
from . import sources
from .catalogue import _ENDPOINTS, _SLUG_SQL, _java, _members, query

_NL = "chr(10)"


def _listed(values: str) -> str:
    """An array as the texts show it."""
    return f"('[' || array_to_string(list_transform({values}, lambda v: '''' || v || ''''), ', ') || ']')"


_SEGMENT = _SLUG_SQL.format("c_mktsegment")
_HANDLERS = f"h as (select {_SEGMENT} as project, c_custkey, c_nationkey, 'Customer' || c_custkey || 'Controller' as cls, 'take' || o_orderkey as m, row_number() over (partition by c_custkey order by 'take' || o_orderkey) as nth from orders join customer on o_custkey = c_custkey)"


@query(f"""with {_ENDPOINTS} select project, 'endpoint' as type, handler as name, 'Endpoint ' || method || ' ' || path || {_NL} || 'controller=' || controller || ' handler=' || handler || {_NL}
 || 'request=' || case when method = 'POST' then replace(response_dto, 'Dto', 'Request') else 'None' end || ' response=' || response_dto || {_NL}
 || case when method = 'POST' then 'auth=True roles=[''CLERK'', ''DESK'']' else 'auth=False roles=[]' end || {_NL} || 'doc=' || javadoc as content from endpoints""")
def endpoint_chunks(spark, d):
    return fact_chunks.endpoint(extraction.endpoints(_members(sources.controllers(spark, d))))


@query(f"""with {_HANDLERS}, b as (select project, cls, c_custkey, c_nationkey, list(m order by m) as ms, string_agg('  ' || m || '() → check.pass, orders.find', {_NL} order by m) filter (nth <= 10) as ten, string_agg('  ' || m || '() calls: check.pass, orders.find', {_NL} order by m) as graph from h group by all)
 select project, 'bean' as type, cls as name, 'Bean ' || cls || ' type=controller file=src/' || cls || '.java' || {_NL} || 'dependencies=[''CheckService'', ''Nation' || c_nationkey || 'Service'']' || {_NL} || 'methods=' || {_listed('ms')} || {_NL} || 'transactional_methods=[]' || {_NL} || 'method_call_graph:' || {_NL} || ten as content from b
 union all select project, 'method_call_graph', cls, 'Method call graph for ' || cls || ' [' || project || ']:' || {_NL} || graph from b
 union all select project, 'method_body', cls || '.' || m, 'Implementation of ' || cls || '.' || m || '() [' || project || ']:' || {_NL} || 'return orders.find(check.pass(id));' from h where nth <= 8""")
def bean_chunks(spark, d):
    """Beans, their call graphs and method bodies."""
    statements, members = _java(sources.controllers(spark, d))
    beans, calls = materialize(extraction.beans(members)), materialize(extraction.method_calls(statements, members))
    parts = [fact_chunks.bean(beans, calls, extraction.repository_queries(members)), fact_chunks.method_call_graph(beans, calls), fact_chunks.method_body(beans, extraction.method_bodies(statements, members))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_REQUEST = "'Part' || p_partkey || 'Request'"


@query(f"""select {_SLUG_SQL.format('p_brand')} as project, 'entity' as type, {_REQUEST} as name, 'Entity ' || {_REQUEST} || ' table=t_' || p_size || {_NL} || 'fields=[''key'', ''brand' || p_size || ''']' || {_NL} || 'relationships=[''ManyToOne -> maker'']' as content from part
 union all select {_SLUG_SQL.format('p_brand')}, 'dto_schema', {_REQUEST}, 'DTO ' || {_REQUEST} || ' [' || {_SLUG_SQL.format('p_brand')} || ']' || {_NL} || 'fields:' || {_NL} || '  brand' || p_size || ': String' || {_NL} || '  key: Long [required] validations=[''NotNull'']' || {_NL} || '  maker: Maker' || {_NL} || 'Used in Feign calls: parts PUT /' || p_partkey from part""")
def model_chunks(spark, d):
    """Entities, and transfer objects with the calls that use them."""
    members = _members(sources.entities(spark, d))
    calls = table(spark, d, "part").select(sources._slug("p_brand").alias("project"), F.lit("parts").alias("client"), F.lit("PUT").alias("method"), F.format_string("/%d", "p_partkey").alias("path"), F.format_string("Part%dRequest", "p_partkey").alias("request_dto"), F.lit(None).cast("string").alias("response_dto"))
    return fact_chunks.entity(extraction.entities(members)).unionByName(fact_chunks.dto_schema(extraction.dto_fields(members), calls))


@query(f"""select {_SLUG_SQL.format('n_name')} as project, 'feign' as type, 's' || s_suppkey as name, 'Feign s' || s_suppkey || ' target=region-' || n_regionkey || {_NL} || 'url_property_key=region.url (check application.properties)' || {_NL} || 'endpoints:' || {_NL}
 || string_agg('  GET /orders/' || l_orderkey || '/{{line}}  response=LineDto', {_NL} order by '/orders/' || l_orderkey || '/{{line}}') as content
 from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by n_name, n_regionkey, s_suppkey""")
def client_chunks(spark, d):
    calls = extraction.client_calls(_members(sources.clients(spark, d)), sources.settings(spark, d))
    return fact_chunks.feign(calls)


_NATION = _SLUG_SQL.format("n_name")


@query(f"""select {_NATION} as project, 'exception_handler' as type, 'Nation' || n_nationkey || 'Advice' as name, 'ExceptionHandler Nation' || n_nationkey || 'Advice' || {_NL} || 'handles=[''Bad' || n_regionkey || ''', ''Worse' || n_nationkey || ''']' as content from nation
 union all select {_NATION}, 'scheduled_task', 'Nation' || n_nationkey || 'Advice.tick' || n_nationkey, 'ScheduledTask class=Nation' || n_nationkey || 'Advice method=tick' || n_nationkey || {_NL} || 'schedule=cron = "0 ' || n_nationkey || ' * * * *"' from nation
 union all select {_NATION}, 'ngrx', 'cart-' || n_nationkey, 'NgRxFeature cart-' || n_nationkey || {_NL} || 'actions=[''add' || n_nationkey || ''', ''drop'']' || {_NL} || 'effects=[]' || {_NL} || 'selectors=[''all' || n_regionkey || ''']' from nation
 union all select {_NATION}, 'build_deps', 'dependencies', 'Build dependencies:' || {_NL} || string_agg('s:supplier-' || s_suppkey || ':' || s_nationkey, {_NL} order by 's:supplier-' || s_suppkey || ':' || s_nationkey) from supplier join nation on s_nationkey = n_nationkey group by n_name
 union all select 'orders', 'migration', 'V' || o_custkey || '__orders.sql', 'Migration: V' || o_custkey || '__orders.sql: tables=' || {_listed("list_distinct_ordered")} || ' columns=' || {_listed("cols")} from
 (select o_custkey, list_transform(list_sort(list_transform(map_entries(map_from_entries(list((st, k)))), lambda e: (e.value, e.key))), lambda e: e[2]) as list_distinct_ordered, any_value(cols) as cols from
  (select o_custkey, 't_' || lower(o_orderstatus) as st, min(o_orderkey) as k from orders group by all) join (select o_custkey, (list('c' || o_orderkey || ':text' order by o_orderkey))[:6] as cols from orders group by 1) using (o_custkey) group by o_custkey)
 union all select 'web', 'component', 'Page' || page_id || 'Component', 'Component Page' || page_id || 'Component selector=page-' || page_id || ' file=src/page-' || page_id || '.component.ts' || {_NL} || 'inputs=[''a'', ''b''] outputs=[''done'']' || {_NL} || 'services=[''Site' || page_id % 7 || 'Service'', ''Router'']'
  || case when page_id % 2 = 0 then {_NL} || 'template_events=[''blur'', ''click'']' else '' end from pages
 union all select 'web', 'angular_service', 'Supplier' || s_suppkey || 'Service', 'AngularService Supplier' || s_suppkey || 'Service file=src/s' || s_suppkey || '.service.ts' || {_NL} || 'http_calls=' || case when s_suppkey % 6 = 2 then 'PUT ' when s_suppkey % 6 = 1 and s_nationkey % 2 = 0 then 'POST ' else 'GET ' end
  || case s_suppkey % 6 when 0 then '/api/supplier/' || s_suppkey when 1 then case when s_nationkey % 2 = 0 then '/api/nation/' || s_nationkey else '/api/base' end when 2 then 'v2/s/' || s_suppkey when 3 then case when s_nationkey % 3 = 0 then 'v1/all-' || s_nationkey else 'v1/n' || s_nationkey end else 'v1/supplier-' || s_suppkey end from supplier where s_suppkey % 6 < 5
 union all select 'master', 'api_contracts', 'web-' || c_nationkey || '->' || {_SEGMENT}, 'API contracts:' || {_NL} || string_agg('web-' || c_nationkey || ' -> ' || {_SEGMENT} || ' : GET /orders/' || o_orderkey || ' via Orders.load', {_NL} order by 'GET /orders/' || o_orderkey) from orders join customer on o_custkey = c_custkey group by c_nationkey, c_mktsegment""")
def other_chunks(spark, d):
    """Handlers, tasks, stores, dependencies, migrations, components, services and contracts."""
    files = materialize(sources.nation_files(spark, d))
    marks = materialize(extraction.marked_methods(_members(files)))
    contracts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.format_string("web-%d", "c_nationkey").alias("caller"), sources._slug("c_mktsegment").alias("service"), F.format_string("GET /orders/%d", "o_orderkey").alias("endpoint"), F.lit("Orders.load").alias("angular_service"))
    parts = [
        fact_chunks.exception_handler(marks), fact_chunks.scheduled_task(marks), fact_chunks.ngrx(extraction.store_features(files)), fact_chunks.build_deps(extraction.build_dependencies(files)),
        fact_chunks.migration(extraction.migrations(sources.migrations(spark, d))), fact_chunks.component(extraction.components(sources.page_components(spark, d))),
        fact_chunks.angular_service(frontend.service_calls(materialize(sources.front_services(spark, d)))), fact_chunks.api_contracts(contracts),
    ]
    return fact_chunks.chunks(parts).drop("id")


_FEATURE = f"""{front._CODE}, comps as (select slug, list(distinct name order by name) as cs from web where box <> 'shared' group by slug),
 stored as (select project as b, string_agg(distinct 'Order' || o_orderstatus, ', ' order by 'Order' || o_orderstatus) as es from endpoints join orders using (o_orderkey) group by project),
 facade as (select lower(c_mktsegment) as b, any_value(upper(c_mktsegment[1]) || lower(c_mktsegment)[2:]) || 'Facade(find, load)' as said from customer group by 1)"""


@query(f"""{_FEATURE} select 'web' as project, 'user_function' as type, name, 'User Function: ' || name || ' [web]' || {_NL} || {_NL} || 'Entry components: ' || entry_components
 || case when len(cs) > 1 then {_NL} || 'All components (' || len(cs) || '): ' || array_to_string(cs[:12], ', ') else '' end || {_NL} || 'Angular services used: ' || array_to_string(services, ', ')
 || {_NL} || 'Backend microservices: ' || array_to_string(backends, ', ') || {_NL} || 'Backend services: ' || (select string_agg(said, '; ' order by said) from facade where list_contains(backends, b))
 || {_NL} || 'Repositories/Entities: ' || (select string_agg(distinct e, ', ' order by e) from (select unnest(string_split(es, ', ')) as e from stored where list_contains(backends, b))) as content from features join comps on slug = feature_key""")
def feature_chunks(spark, d):
    """A text for each feature of the front end, with the order kinds that its back ends keep."""
    c, b, e = front.components(spark, d), front.beans(spark, d), front.endpoints(spark, d)
    f = features.feature_nodes(c, front.backends(spark, d))
    kept = e.select(F.format_string("bean::%s::%sFacade", "project", F.initcap("project")).alias("src"), F.format_string("entity::%s::Order%s", "project", "o_orderstatus").alias("dst"), F.lit("manages").alias("type"), F.format_string("Order%s", "o_orderstatus").alias("name")).distinct()
    edges = front.edges(spark, d).select("src", "dst", "type").unionByName(kept.drop("name"))
    named = b.select(codegraph.bean_id(F.col("project"), F.col("name")).alias("id"), "name", "bean_type", F.when(F.col("bean_type") == "service", F.array(F.lit("find"), F.lit("load"))).otherwise(F.array().cast("array<string>")).alias("methods"))
    return fact_chunks.feature(materialize(f), c, materialize(edges), named, kept.select(F.col("dst").alias("id"), "name"))


@query("select doc_id, sha256(text) as sha256, length(text) as n_chars from documents where text <> ''")
def token_windows(spark, d):
    """Texts put together again from their windows of tokens, each without what the one before holds."""
    import public_tokenizers

    w = chunking.token_windows(table(spark, d, "documents").select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")))
    before = F.coalesce(F.lag(F.col("start") + F.length("content")).over(Window.partitionBy("doc_id").orderBy("idx")), F.lit(0))
    new = w.withColumn("skip", before - F.col("start")).withColumn("new", F.expr("substring(content, cast(skip as int) + 1)"))
    whole = new.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "new"))), lambda x: x["new"]), "").alias("text"))
    return whole.select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))
