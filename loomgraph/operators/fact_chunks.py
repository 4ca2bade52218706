"""Facts of a project as texts for retrieval: one function for each kind of fact, and one for features of the front end.

Each function takes rows as the extraction gives them and returns project, type, name, content; `chunks` joins any of them
into one table with stable ids. Lists within a text are sorted, so a text depends on the facts alone. Facts that would gather
a whole code base into one text (contracts between services) are divided by pairs of services.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import listed
from .chunking import chunk_id


def _text(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def _some(label: str, value: Column, more: Column | None = None) -> Column:
    """A labelled line, or null (which joins leave out) where there is no value."""
    present = more if more is not None else value.isNotNull()
    return F.when(present, F.concat(F.lit(label), value))


def _or_none(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("None"))


def _said(c: str) -> Column:
    return F.when(F.col(c), "True").otherwise("False")


def _lines(keys: list[str], rows: DataFrame, order: Column, line: Column, as_: str, most: int | None = None) -> DataFrame:
    """For each key its lines in order, the first `most` of them, as one text."""
    nth = rows.withColumns({"_o": order, "_l": line})
    if most:
        nth = nth.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "_l"))).where(F.col("_n") <= most)
    each = nth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "_l"))).alias("_x"))
    return each.select(*keys, F.array_join(F.transform("_x", lambda s: s["_l"]), "\n").alias(as_))


def _rows(df: DataFrame, kind: str, name: Column | str, content: Column) -> DataFrame:
    return df.select("project", F.lit(kind).alias("type"), (F.col(name) if isinstance(name, str) else name).alias("name"), content.alias("content"))


def endpoint(endpoints: DataFrame) -> DataFrame:
    doc = _some("doc=", F.col("javadoc"), F.col("javadoc") != "")
    text = _text(F.format_string("Endpoint %s %s", "method", "path"), F.format_string("controller=%s handler=%s", "controller", "handler"), F.concat(F.lit("request="), _or_none("request_dto"), F.lit(" response="), _or_none("response_dto")), F.concat(F.lit("auth="), _said("auth_required"), F.lit(" roles="), listed(F.col("roles"))), doc)
    return _rows(endpoints, "endpoint", "handler", text)


def entity(entities: DataFrame) -> DataFrame:
    return _rows(entities, "entity", "name", _text(F.format_string("Entity %s table=%s", "name", "table"), F.concat(F.lit("fields="), listed(F.col("fields"))), F.concat(F.lit("relationships="), listed(F.col("relationships")))))


def feign(calls: DataFrame) -> DataFrame:
    """client calls -> one text for each client of a project, with its calls."""
    line = F.concat(F.format_string("  %s %s", "method", "path"), F.coalesce(F.concat(F.lit("  request="), "request_dto"), F.lit("")), F.coalesce(F.concat(F.lit("  response="), "response_dto"), F.lit("")))
    keys = ["project", "client", "target"]
    calls = calls.withColumn("property_key", F.coalesce("property_key", F.lit("")))
    each = _lines([*keys, "property_key"], calls, F.col("path"), line, "calls")
    key = F.when(F.col("property_key") != "", F.format_string("url_property_key=%s (check application.properties)", "property_key"))
    return _rows(each, "feign", "client", _text(F.format_string("Feign %s target=%s", "client", "target"), key, "endpoints:", F.col("calls")))


def _call_lines(calls: DataFrame, form: str, most: int | None) -> DataFrame:
    return _lines(["project", "cls"], calls, F.col("method"), F.format_string(form, "method", F.array_join("calls", ", ")), "graph", most)


def bean(beans: DataFrame, calls: DataFrame, queries: DataFrame) -> DataFrame:
    """beans, method_calls(project, cls, method, calls), repository_queries(project, repository, method, query)."""
    graph = _call_lines(calls, "  %s() → %s", 10).withColumnRenamed("cls", "name")
    asked = _lines(["project", "repository"], queries, F.col("method"), F.concat(F.lit("  "), F.substring("query", 1, 200)), "asked", 5).withColumnRenamed("repository", "name")
    b = beans.join(graph, ["project", "name"], "left").join(asked, ["project", "name"], "left")
    text = _text(
        F.format_string("Bean %s type=%s file=%s", "name", "bean_type", "path"), F.concat(F.lit("dependencies="), listed(F.col("dependencies"))), F.concat(F.lit("methods="), listed(F.col("methods"))),
        F.concat(F.lit("transactional_methods="), listed(F.col("transactional_methods"))), _some("method_call_graph:\n", F.col("graph")), _some("queries:\n", F.col("asked")),
    )
    return _rows(b, "bean", "name", text)


def method_call_graph(beans: DataFrame, calls: DataFrame) -> DataFrame:
    graph = _call_lines(calls, "  %s() calls: %s", None).withColumnRenamed("cls", "name")
    b = beans.select("project", "name").join(graph, ["project", "name"])
    return _rows(b, "method_call_graph", "name", _text(F.format_string("Method call graph for %s [%s]:", "name", "project"), F.col("graph")))


def method_body(beans: DataFrame, bodies: DataFrame, most: int = 8) -> DataFrame:
    """method_bodies(project, cls, method, body): the first `most` methods of each bean by name."""
    b = bodies.join(beans.select("project", F.col("name").alias("cls")).distinct(), ["project", "cls"])
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("project", "cls").orderBy("method", "body"))).where(F.col("n") <= most)
    return _rows(b, "method_body", F.concat_ws(".", "cls", "method"), _text(F.format_string("Implementation of %s.%s() [%s]:", "cls", "method", "project"), F.col("body")))


def exception_handler(marks: DataFrame) -> DataFrame:
    """marked_methods(project, cls, method, mark, value) -> one text for each class that handles exceptions."""
    each = marks.where("mark = 'exception'").groupBy("project", "cls").agg(F.array_sort(F.collect_set("value")).alias("kinds"))
    return _rows(each, "exception_handler", "cls", _text(F.format_string("ExceptionHandler %s", "cls"), F.concat(F.lit("handles="), listed(F.col("kinds")))))


def scheduled_task(marks: DataFrame) -> DataFrame:
    tasks = marks.where("mark = 'scheduled'")
    return _rows(tasks, "scheduled_task", F.concat_ws(".", "cls", "method"), _text(F.format_string("ScheduledTask class=%s method=%s", "cls", "method"), F.concat(F.lit("schedule="), "value")))


def migration(migrations: DataFrame) -> DataFrame:
    """migrations(project, file, tables, columns)."""
    return _rows(migrations, "migration", "file", F.concat(F.lit("Migration: "), "file", F.lit(": tables="), listed(F.col("tables")), F.lit(" columns="), listed(F.col("columns"))))


def build_deps(dependencies: DataFrame) -> DataFrame:
    each = _lines(["project"], dependencies, F.col("dependency"), F.col("dependency"), "all")
    return _rows(each, "build_deps", F.lit("dependencies"), _text("Build dependencies:", F.col("all")))


def dto_schema(fields: DataFrame, calls: DataFrame) -> DataFrame:
    """dto_fields, and the client calls that send or return the type, by project."""
    line = F.concat(
        F.format_string("  %s: %s", "name", "type"), F.when(F.col("required"), " [required]").otherwise(""), F.coalesce(F.concat(F.lit(" @JsonProperty('"), "json_property", F.lit("')")), F.lit("")),
        F.when(F.size("validations") > 0, F.concat(F.lit(" validations="), listed(F.col("validations")))).otherwise(""),
    )
    each = _lines(["project", "dto"], fields, F.col("name"), line, "fields")
    used = calls.select("project", F.explode(F.array("request_dto", "response_dto")).alias("dto"), F.format_string("%s %s %s", "client", "method", "path").alias("call")).where("dto is not null").distinct()
    used = used.groupBy("project", "dto").agg(F.array_join(F.array_sort(F.collect_set("call")), ", ").alias("calls"))
    each = each.join(used, ["project", "dto"], "left")
    return _rows(each, "dto_schema", "dto", _text(F.format_string("DTO %s [%s]", "dto", "project"), "fields:", F.col("fields"), _some("Used in Feign calls: ", F.col("calls"))))


def component(components: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """components, and component_methods if their methods and calls are to be told."""
    if methods is not None:
        m = methods.groupBy("project", "path").agg(F.array_sort(F.collect_set("method")).alias("methods"))
        graph = _lines(["project", "path"], methods.where("size(calls) > 0"), F.col("method"), F.format_string("  %s() → %s", "method", F.array_join("calls", ", ")), "graph", 10)
        components = components.join(m, ["project", "path"], "left").join(graph, ["project", "path"], "left")
    told = [] if methods is None else [F.concat(F.lit("methods="), listed(F.col("methods"))), _some("method_call_graph:\n", F.col("graph"))]
    text = _text(
        F.concat(F.lit("Component "), "name", F.lit(" selector="), F.coalesce("selector", F.lit("")), F.lit(" file="), "path"), F.concat(F.lit("inputs="), listed(F.col("inputs")), F.lit(" outputs="), listed(F.col("outputs"))),
        F.concat(F.lit("services="), listed(F.col("injected"))), _some("template_events=", listed(F.col("template_events")), F.size("template_events") > 0), _some("view_children=", listed(F.col("view_children")), F.size("view_children") > 0), *told,
    )
    return _rows(components, "component", "name", text)


def angular_service(calls: DataFrame) -> DataFrame:
    """service_calls(project, path, service, method, url)."""
    each = calls.groupBy("project", "service", "path").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "method", "url"))), "; ").alias("calls"))
    return _rows(each, "angular_service", "service", _text(F.format_string("AngularService %s file=%s", "service", "path"), F.concat(F.lit("http_calls="), "calls")))


def ngrx(stores: DataFrame) -> DataFrame:
    return _rows(stores, "ngrx", "name", _text(F.format_string("NgRxFeature %s", "name"), *[F.concat(F.lit(f"{c}="), listed(F.col(c))) for c in ("actions", "effects", "selectors")]))


def auth_flow(flow: DataFrame) -> DataFrame:
    """codegraph.auth_flow's row."""
    text = F.concat(F.lit("Auth flow: type="), "type", *[x for c in ("token_issuer", "fe_interceptor") for x in (F.lit(f" {c}="), _or_none(c))], F.lit(" validated_by="), listed(F.col("validated_by")))
    return _rows(flow.withColumn("project", F.lit("master")), "auth_flow", F.lit("auth_flow"), text)


def api_contracts(contracts: DataFrame) -> DataFrame:
    """contracts(caller, service, endpoint, angular_service): one text for each caller and service."""
    line = F.format_string("%s -> %s : %s via %s", "caller", "service", "endpoint", "angular_service")
    each = _lines(["caller", "service"], contracts, F.col("endpoint"), line, "all").withColumn("project", F.lit("master"))
    return _rows(each, "api_contracts", F.concat_ws("->", "caller", "service"), _text("API contracts:", F.col("all")))


def feature(features: DataFrame, components: DataFrame, edges: DataFrame, beans: DataFrame, entities: DataFrame) -> DataFrame:
    """A text for each feature: features(id, project, feature_key, name, entry_components, services, backends), edges(src, dst,
    type), beans(id, name, bean_type, methods), entities(id, name); what it enters by, has, uses and calls.
    """
    of = lambda *kinds: edges.where(F.col("type").isin(*kinds)).select("src", "dst").distinct()
    named = components.select(F.concat_ws("::", F.lit("angular_component"), "project", "name").alias("src"), F.col("name").alias("component"))
    all_ = of("part_of_feature").join(named, "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("component")).alias("components"))
    shown = lambda most: F.concat("name", F.when(F.size("methods") > 0, F.concat(F.lit("("), F.array_join(F.slice("methods", 1, most), ", "), F.lit(")"))).otherwise(""))
    called = of("feature_calls").select(F.col("src").alias("id"), F.col("dst").alias("bean")).join(beans.select(F.col("id").alias("bean"), shown(5).alias("said")), "bean")
    backend = called.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("said")), "; ").alias("called"))
    ends = beans.where("bean_type = 'repository'").select(F.col("id").alias("dst"), shown(4).alias("said")).unionByName(entities.select(F.col("id").alias("dst"), F.col("name").alias("said")))
    beyond = called.select("id", F.col("bean").alias("src")).join(of("depends_on", "manages"), "src").join(ends, "dst").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("said")), ", ").alias("stored"))
    f = features.join(all_, "id", "left").join(backend, "id", "left").join(beyond, "id", "left")
    many = F.size("components") > F.size("entry_components")
    lines = [
        F.format_string("User Function: %s [%s]", "name", "project"), F.lit(""), _some("Entry components: ", F.array_join("entry_components", ", "), F.size("entry_components") > 0),
        F.when(many, F.format_string("All components (%d): %s", F.size("components"), F.array_join(F.slice("components", 1, 12), ", "))), _some("Angular services used: ", F.array_join("services", ", "), F.size("services") > 0),
        _some("Backend microservices: ", F.array_join("backends", ", "), F.size("backends") > 0), _some("Backend services: ", F.col("called")), _some("Repositories/Entities: ", F.col("stored")),
    ]
    return _rows(f, "user_function", "name", _text(*lines))


def chunks(parts: list[DataFrame]) -> DataFrame:
    """id, project, type, name, content of all parts; rows that are the same are one chunk, others of one name are told apart
    by their text."""
    every = reduce(DataFrame.unionByName, parts).distinct()
    return every.select(chunk_id(F.col("project"), F.col("type"), F.col("name"), F.xxhash64("content")).alias("id"), "project", "type", "name", "content")
