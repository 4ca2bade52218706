"""The code graph from source files in one run: facts are extracted once, joined into nodes and edges, and stored.

files(project, path, text) of any kinds, settings(project, key, value). Each kind of fact is written before it is joined, so a
text is parsed once however many edges rest on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import codegraph, extraction, features, frontend, messaging

Facts = dict[str, DataFrame]
#: The facts that nodes rest on; edges rest on clients too.
OF_NODES = ("endpoints", "beans", "entities", "topics", "components", "http")
OF_GRAPH = (*OF_NODES, "clients")


def facts_of(files: DataFrame, settings: DataFrame, kinds: tuple[str, ...] = OF_GRAPH) -> Facts:
    """Facts of these kinds, each a stored table."""
    files = materialize(files)
    statements = materialize(extraction.java_statements(files))
    members = materialize(extraction.java_members(statements))
    made = {
        "endpoints": lambda: extraction.endpoints(members), "beans": lambda: extraction.beans(members), "entities": lambda: extraction.entities(members), "clients": lambda: extraction.client_calls(members, settings),
        "topics": lambda: messaging.topics(statements, members, settings), "components": lambda: extraction.components(files), "http": lambda: frontend.service_calls(files),
    }
    return {name: materialize(made[name]()) for name in kinds}


def nodes_of(f: Facts, shown: DataFrame) -> DataFrame:
    """Nodes of all kinds: id, type, project, name; `shown` are features."""
    back = codegraph.nodes(f["endpoints"], f["beans"], f["entities"], f["topics"])
    node = lambda df, kind, name: df.select(features.node(kind, F.col("project"), F.col(name)).alias("id"), F.lit(kind).alias("type"), "project", F.col(name).alias("name")).distinct()
    front = node(f["components"], "angular_component", "name").unionByName(node(_services(f), "angular_service", "name"))
    return back.unionByName(front).unionByName(shown.select("id", F.lit("user_function").alias("type"), "project", "name"))


def _services(f: Facts) -> DataFrame:
    """Front-end services that call something or are injected by that name."""
    used = f["components"].select("project", F.explode("injected").alias("name")).where(F.endswith("name", F.lit("Service")))
    return f["http"].select("project", F.col("service").alias("name")).unionByName(used).distinct()


def _shown(f: Facts, services: DataFrame, aliases: dict[str, str] | None, prefixes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The back end of each service's name, and the features that components show."""
    projects = f["beans"].where("bean_type = 'service'").select("project").distinct().withColumn("ord", F.xxhash64("project"))
    backends = materialize(features.backend_of(services, projects, aliases, prefixes))
    return backends, materialize(features.feature_nodes(f["components"].withColumnRenamed("injected", "services"), backends))


def edges_of(f: Facts, aliases: dict[str, str] | None = None, prefixes: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Edges of each rule, and the features that they lead to."""
    services = materialize(_services(f))
    components = f["components"].withColumnRenamed("injected", "services")
    backends, shown = _shown(f, services, aliases, prefixes)
    http = materialize(codegraph.http_edges(f["http"], f["endpoints"]))
    parts = [
        codegraph.handled_by(f["endpoints"], f["beans"]), codegraph.depends_on(f["beans"]), codegraph.manages(f["beans"], f["entities"]), codegraph.entity_edges(f["entities"]),
        codegraph.client_edges(f["clients"], f["endpoints"], f["beans"]), codegraph.topic_edges(f["topics"], f["beans"]), codegraph.publish_edges(f["topics"], f["endpoints"]),
        codegraph.uses_service(components, services), http, codegraph.inferred_edges(services, http, backends, f["beans"]), features.feature_edges(shown, components, services, f["beans"]),
    ]
    return parts, shown


def build_graph(files: DataFrame, settings: DataFrame, root: str, aliases: dict[str, str] | None = None, prefixes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the files, stored below root and read again (`codegraph.load`)."""
    f = facts_of(files, settings)
    parts, shown = edges_of(f, aliases, prefixes)
    return codegraph.build(nodes_of(f, shown), parts, root)


def build_nodes(files: DataFrame, settings: DataFrame, root: str, aliases: dict[str, str] | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The nodes that `build_graph` stores, without the facts and joins that only its edges need."""
    f = facts_of(files, settings, OF_NODES)
    _, shown = _shown(f, materialize(_services(f)), aliases, prefixes)
    return codegraph.store(nodes_of(f, shown), f"{root}/nodes")
