"""Nodes and edges of the code graph from extracted rows. Every rule is an equality join; a first match wins by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import dedup_edges
from .matching import first_match, path_suffixes


def endpoint_id(project: Column, method: Column, path: Column) -> Column:
    return F.concat_ws("::", F.lit("endpoint"), project, method, path)


def bean_id(project: Column, name: Column) -> Column:
    return F.concat_ws("::", F.lit("bean"), project, name)


def nodes(endpoints: DataFrame, beans: DataFrame, entities: DataFrame, topics: DataFrame) -> DataFrame:
    """id, type, project, name; one row for each id, topics without a project."""
    every = (
        endpoints.select(endpoint_id(F.col("project"), F.col("method"), F.col("path")).alias("id"), F.lit("endpoint").alias("type"), "project", F.concat_ws(" ", "method", "path").alias("name"))
        .unionByName(beans.select(bean_id(F.col("project"), F.col("name")).alias("id"), F.concat(F.lit("spring_"), "bean_type").alias("type"), "project", "name"))
        .unionByName(entities.select(F.concat_ws("::", F.lit("entity"), "project", "name").alias("id"), F.lit("entity").alias("type"), "project", "name"))
        .unionByName(topics.select(F.concat_ws("::", F.lit("kafka_topic"), "topic").alias("id"), F.lit("kafka_topic").alias("type"), F.lit(None).cast("string").alias("project"), F.col("topic").alias("name")))
    )
    return every.groupBy("id").agg(F.min("type").alias("type"), F.min("project").alias("project"), F.min("name").alias("name"))


def depends_on(beans: DataFrame) -> DataFrame:
    """Each dependency's bean: of that name in the project, of that name anywhere, or, for a name with a suffix, equal
    when one suffix is dropped on both sides."""
    wants = beans.select("project", F.col("name").alias("bean"), F.explode("dependencies").alias("want")).withColumn("key", F.concat_ws("|", "project", "bean", "want"))
    has = beans.select(F.col("project").alias("tp"), F.col("name").alias("tn"))
    stem = T.strip_bean_suffix
    here = wants.join(has, (F.col("want") == F.col("tn")) & (F.col("project") == F.col("tp")))
    # a name that many projects have would meet all of them: only its first bean can win
    by_name = has.groupBy("tn").agg(F.min("tp").alias("tp"))
    by_stem = has.groupBy(stem(F.col("tn")).alias("ts")).agg(F.min(F.struct("tn", "tp")).alias("x")).select("ts", "x.tn", "x.tp")
    far = wants.join(by_name, F.col("want") == F.col("tn")).select(*here.columns)
    like = wants.where(stem(F.col("want")) != F.col("want")).join(by_stem, (stem(F.col("want")) == F.col("ts")) & (F.col("ts") != "")).select(*here.columns)
    best = first_match([here, far, like], "key", ["tn", "tp"])
    out = best.select(bean_id(F.col("project"), F.col("bean")).alias("src"), bean_id(F.col("tp"), F.col("tn")).alias("dst"), F.lit("depends_on").alias("type"), F.col("want").alias("label"))
    return out.where("src <> dst")


def manages(beans: DataFrame, entities: DataFrame) -> DataFrame:
    """Repository to the entity of its name without suffix, in any project, the first by project."""
    repos = beans.where("bean_type = 'repository'").withColumn("k", F.lower(T.strip_bean_suffix(F.col("name"))))
    first = entities.groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("project", "name")).alias("e"))
    return repos.join(first, "k").select(bean_id(F.col("project"), F.col("name")).alias("src"), F.concat_ws("::", F.lit("entity"), "e.project", "e.name").alias("dst"), F.lit("manages").alias("type"), F.lit("").alias("label"))


def handled_by(endpoints: DataFrame, beans: DataFrame) -> DataFrame:
    """Endpoint to the service named like its controller: of its project, of any, or of an equal name but for one suffix; else to
    the controller itself. Of several the first by name and project."""
    e = endpoints.select("project", "controller", endpoint_id(F.col("project"), F.col("method"), F.col("path")).alias("src"))
    e = e.withColumn("want", F.concat(F.regexp_replace("controller", "Controller$", ""), F.lit("Service")))
    asks = e.select("project", "controller", "want").distinct().withColumn("key", F.concat_ws("|", "project", "controller"))
    stem = T.strip_bean_suffix
    has = beans.select(F.col("project").alias("tp"), F.col("name").alias("tn"))
    by_name = has.groupBy("tn").agg(F.min("tp").alias("tp"))
    by_stem = has.groupBy(stem(F.col("tn")).alias("ts")).agg(F.min(F.struct("tn", "tp")).alias("x")).select("ts", "x.tn", "x.tp")
    service = F.col("want") != F.lit("Service")
    tiers = [
        asks.join(has, (F.col("want") == F.col("tn")) & (F.col("project") == F.col("tp"))),
        asks.join(by_name, F.col("want") == F.col("tn")),
        asks.where(service & (F.col("controller") != F.col("want"))).join(by_stem, (stem(F.col("want")) == F.col("ts")) & (F.col("ts") != "")),
        asks.join(has, (F.col("controller") == F.col("tn")) & (F.col("project") == F.col("tp"))),
    ]
    best = first_match([t.select("key", "project", "controller", "tn", "tp") for t in tiers], "key", ["tn", "tp"])
    out = e.join(best.select("project", "controller", "tn", "tp"), ["project", "controller"])
    return out.select("src", bean_id(F.col("tp"), F.col("tn")).alias("dst"), F.lit("handled_by").alias("type"), F.lit("").alias("label"))


def calls_to_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(src, target, method, path) to endpoints: equal methods, and normalised paths equal or one a suffix of the
    other; the target project first, then by id. (src, dst, label)"""
    c = calls.select("src", "target", "method", T.norm_path(F.col("path")).alias("cp")).distinct().withColumn("key", F.concat_ws("|", "src", "target", "method", "cp"))
    e = endpoints.select(F.col("project").alias("ep"), F.col("method").alias("em"), T.norm_path(F.col("path")).alias("epath"), endpoint_id(F.col("project"), F.col("method"), F.col("path")).alias("dst")).distinct()
    sides = [(c.withColumn("k", F.explode(F.expr(path_suffixes("cp")))), e.withColumn("k", F.col("epath"))), (c.withColumn("k", F.col("cp")), e.withColumn("k", F.explode(F.expr(path_suffixes("epath")))))]
    far = [x.join(y.groupBy("k", "em").agg(F.min("dst").alias("dst")), (x["method"] == F.col("em")) & (x["k"] == y["k"])).select("key", "src", "method", "cp", "dst") for x, y in sides]
    near = [x.join(y.groupBy("k", "em", "ep").agg(F.min("dst").alias("dst")), (x["method"] == F.col("em")) & (x["k"] == y["k"]) & (x["target"] == F.col("ep"))).select("key", "src", "method", "cp", "dst") for x, y in sides]
    best = first_match([near[0].unionByName(near[1]), far[0].unionByName(far[1])], "key", ["dst"])
    return best.select("src", "dst", F.concat_ws(" ", "method", "cp").alias("label")).distinct()


def client_edges(calls: DataFrame, endpoints: DataFrame, beans: DataFrame) -> DataFrame:
    """Client calls leave from the first service bean of their project, else its first bean, else the client."""
    first = first_services(beans)
    named = calls.join(first, "project", "left").withColumn("src", bean_id(F.col("project"), F.coalesce("bean", "client")))
    return calls_to_endpoints(named, endpoints).select("src", "dst", F.lit("feign_calls").alias("type"), "label")


def topic_edges(topics: DataFrame, beans: DataFrame) -> DataFrame:
    """First service bean of a project to the topics it sends, and topics to it where it listens."""
    first = first_services(beans)
    t = topics.join(first, "project").select(bean_id(F.col("project"), F.col("bean")).alias("b"), F.concat_ws("::", F.lit("kafka_topic"), "topic").alias("t"), "role")
    sent = t.where("role <> 'consumer'").select(F.col("b").alias("src"), F.col("t").alias("dst"), F.lit("produces_event").alias("type"), F.lit("").alias("label"))
    return sent.unionByName(t.where("role <> 'producer'").select(F.col("t").alias("src"), F.col("b").alias("dst"), F.lit("consumes_event").alias("type"), F.lit("").alias("label")))


def entity_edges(entities: DataFrame) -> DataFrame:
    """Entity to the entity its relationship's field is named after, in the same project."""
    r = entities.select("project", "name", F.explode("relationships").alias("r")).withColumn("kind", F.substring_index("r", " -> ", 1)).withColumn("to", T.relationship_entity(F.substring_index("r", " -> ", -1)))
    target = entities.select("project", F.col("name").alias("to")).distinct()
    kind = F.lower(F.regexp_replace("kind", "(?<=[a-z])(?=[A-Z])", "_"))
    return r.join(target, ["project", "to"]).select(F.concat_ws("::", F.lit("entity"), "project", "name").alias("src"), F.concat_ws("::", F.lit("entity"), "project", "to").alias("dst"), F.concat(F.lit("jpa_"), kind).alias("type"), F.col("r").alias("label"))


def service_dependencies(calls: DataFrame, topics: DataFrame) -> DataFrame:
    """project, targets: client targets, and projects that send a topic which the project listens to."""
    a = calls.select("project", "target")
    sent = topics.where("role <> 'consumer'").select("topic", F.col("project").alias("target")).distinct()
    b = topics.where("role <> 'producer'").select("topic", "project").distinct().join(sent, "topic").select("project", "target")
    return a.unionByName(b).where("project <> target").groupBy("project").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def event_flow(topics: DataFrame) -> DataFrame:
    """topic, producers, consumers: sorted projects."""
    has = lambda role: F.array_sort(F.collect_set(F.when(F.col("role").isin(role, "both"), F.col("project"))))
    return topics.groupBy("topic").agg(has("producer").alias("producers"), has("consumer").alias("consumers"))


def shared_models(fields: DataFrame) -> DataFrame:
    """Transfer objects that more than one project has: dto, projects."""
    return fields.groupBy("dto").agg(F.array_sort(F.collect_set("project")).alias("projects")).where("size(projects) > 1")


def union_edges(parts: list[DataFrame]) -> DataFrame:
    """One row for each (src, dst, type), with the least label."""
    return dedup_edges(reduce(DataFrame.unionByName, parts))


def first_services(beans: DataFrame) -> DataFrame:
    """project, bean: the first service of each project, else its first bean."""
    return beans.groupBy("project").agg(F.coalesce(F.min(F.when(F.col("bean_type") == "service", F.col("name"))), F.min("name")).alias("bean"))


def publish_edges(topics: DataFrame, endpoints: DataFrame) -> DataFrame:
    """topics(project, topic, role, publisher_endpoint `METHOD path`): the end point, of the own project first, to the topic."""
    t = topics.where(F.col("role").isin("producer", "both") & F.contains("publisher_endpoint", F.lit(" ")))
    said = t.select(F.concat_ws("::", F.lit("kafka_topic"), "topic").alias("src"), F.col("project").alias("target"), F.substring_index("publisher_endpoint", " ", 1).alias("method"), F.expr("substring(publisher_endpoint, instr(publisher_endpoint, ' ') + 1)").alias("path"), "publisher_endpoint", "topic")
    found = calls_to_endpoints(said, endpoints).select(F.col("src").alias("t"), F.col("dst").alias("e"), F.col("label").alias("key"))
    key = F.concat_ws(" ", "method", T.norm_path(F.col("path")))
    out = found.join(said.select(F.col("src").alias("t"), key.alias("key"), "publisher_endpoint", "topic").distinct(), ["t", "key"])
    return out.select(F.col("e").alias("src"), F.col("t").alias("dst"), F.lit("publishes_to").alias("type"), F.concat_ws(" publishes to ", "publisher_endpoint", "topic").alias("label"))


def uses_service(components: DataFrame, services: DataFrame) -> DataFrame:
    """Components to the injected services of their own project."""
    c = components.select("project", F.col("name").alias("component"), F.explode("services").alias("name")).join(services.select("project", "name").distinct(), ["project", "name"])
    return c.select(F.concat_ws("::", F.lit("angular_component"), "project", "component").alias("src"), F.concat_ws("::", F.lit("angular_service"), "project", "name").alias("dst"), F.lit("uses_service").alias("type"), F.concat_ws(" uses ", "component", "name").alias("label"))


def http_edges(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(project, service, method, url) to the end points of their paths, of whatever project."""
    c = calls.select(F.concat_ws("::", F.lit("angular_service"), "project", "service").alias("src"), F.lit("").alias("target"), "method", T.url_path(F.col("url")).alias("path")).where("path <> ''")
    e = calls_to_endpoints(c, endpoints)
    service, method, path = F.substring_index("src", "::", -1), F.lower(F.substring_index("label", " ", 1)), F.substring_index("label", " ", -1)
    return e.select("src", "dst", F.lit("http_call").alias("type"), F.format_string("%s.%s() → %s", service, method, path).alias("label"))


def inferred_edges(services: DataFrame, http: DataFrame, backends: DataFrame, beans: DataFrame) -> DataFrame:
    """Services without any http_call to the first service bean of the back end that their name gives."""
    own = services.select("project", "name", F.concat_ws("::", F.lit("angular_service"), "project", "name").alias("src")).distinct().join(http.select("src").distinct(), "src", "left_anti")
    b = own.join(backends, "name").join(first_services(beans).withColumnRenamed("project", "backend"), "backend")
    return b.select("src", bean_id(F.col("backend"), F.col("bean")).alias("dst"), F.lit("inferred_http_call").alias("type"), F.format_string("%s → %s (inferred by name)", "name", "backend").alias("label"))


def contract_edges(contracts: DataFrame, services: DataFrame, endpoints: DataFrame) -> DataFrame:
    """contracts(caller, service, endpoint `METHOD path`, angular_service `Name.method`): known services to end points."""
    c = contracts.where(F.contains("endpoint", F.lit(" "))).withColumn("name", F.substring_index("angular_service", ".", 1))
    c = c.join(services.select(F.col("project").alias("caller"), "name").distinct(), ["caller", "name"], "left_semi")
    c = c.select(F.concat_ws("::", F.lit("angular_service"), "caller", "name").alias("src"), F.col("service").alias("target"), F.substring_index("endpoint", " ", 1).alias("method"), F.expr("substring(endpoint, instr(endpoint, ' ') + 1)").alias("path"), F.format_string("%s → %s %s", "angular_service", "service", "endpoint").alias("said"))
    found = calls_to_endpoints(c, endpoints).withColumnRenamed("label", "key")
    said = c.groupBy("src", F.concat_ws(" ", "method", T.norm_path(F.col("path"))).alias("key")).agg(F.min("said").alias("label"))
    return found.join(said, ["src", "key"]).select("src", "dst", F.lit("http_call").alias("type"), "label")


def build(nodes_: DataFrame, edge_parts: list[DataFrame], root: str) -> tuple[DataFrame, DataFrame]:
    """Write nodes and one row for each edge below root, partitioned by type, and read them again; edges without both ends
    are kept, as a later build may bring these."""
    return store(nodes_, f"{root}/nodes"), store(union_edges(edge_parts), f"{root}/edges")


def store(rows: DataFrame, path: str) -> DataFrame:
    """Write nodes or edges, partitioned by type, and read them again."""
    rows.write.mode("overwrite").partitionBy("type").parquet(path)
    return rows.sparkSession.read.parquet(path)


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")


def auth_flow(facts: DataFrame, endpoints: DataFrame, interceptors: DataFrame) -> DataFrame:
    """One row. facts(project, ord, jwt_filter), endpoints(project, path), interceptors(ord, name): the first project with a path
    of authentication, all projects that validate tokens, and the first interceptor of that kind."""
    signs = endpoints.where(F.contains("path", F.lit("/auth")) | F.contains("path", F.lit("login"))).select("project").distinct().withColumn("issues", F.lit(True))
    back = facts.join(signs, "project", "left").agg(F.min_by(F.when(F.col("issues"), F.col("project")), F.when(F.col("issues"), F.col("ord"))).alias("token_issuer"), F.array_sort(F.collect_set(F.when(F.col("jwt_filter"), F.col("project")))).alias("validated_by"))
    guard = interceptors.where(F.rlike(F.lower("name"), F.lit("auth|jwt"))).agg(F.min_by("name", "ord").alias("fe_interceptor"))
    return back.crossJoin(F.broadcast(guard)).select(F.lit("JWT").alias("type"), "token_issuer", "validated_by", "fe_interceptor")  # one row each
