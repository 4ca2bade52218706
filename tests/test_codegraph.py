"""Edges of the code graph between a few rows."""

from loomgraph.operators import codegraph as G


def edges(df):
    return {(r.src, r.dst, r.type) for r in df.collect()}


def test_edges(spark):
    beans = spark.createDataFrame(
        [("a", "OrderService", "service", ["StockRepo", "OrderRepository", "Mailer", "Stock"]), ("a", "OrderRepository", "repository", []), ("a", "Zed", "component", []), ("b", "StockService", "service", []), ("b", "Mailer", "component", []), ("c", "Mailer", "component", []), ("a", "OrderController", "controller", ["OrderService"])],
        "project string, name string, bean_type string, dependencies array<string>",
    )
    entities = spark.createDataFrame([("b", "Order", "t", [], ["OneToMany -> items", "ManyToOne -> nowhere"]), ("b", "Item", "i", [], [])], "project string, name string, table string, fields array<string>, relationships array<string>")
    assert edges(G.depends_on(beans)) == {
        ("bean::a::OrderService", "bean::b::StockService", "depends_on"), ("bean::a::OrderService", "bean::a::OrderRepository", "depends_on"), ("bean::a::OrderService", "bean::b::Mailer", "depends_on"), ("bean::a::OrderController", "bean::a::OrderService", "depends_on")}
    assert edges(G.manages(beans, entities)) == {("bean::a::OrderRepository", "entity::b::Order", "manages")}
    assert edges(G.entity_edges(entities)) == {("entity::b::Order", "entity::b::Item", "jpa_one_to_many")}
    ends = spark.createDataFrame([("a", "OrderController", "GET", "/api/orders/{id}"), ("b", "X", "GET", "/api/orders/{k}"), ("b", "X", "POST", "/api/orders/{k}")], "project string, controller string, method string, path string")
    assert edges(G.handled_by(ends, beans)) == {("endpoint::a::GET::/api/orders/{id}", "bean::a::OrderService", "handled_by")}
    calls = spark.createDataFrame([("a", "c1", "b", "GET", "/orders/{x}/"), ("b", "c2", "zz", "GET", "/v1/api/orders/{x}"), ("c", "c3", "b", "PUT", "/api/orders/{x}")], "project string, client string, target string, method string, path string")
    assert edges(G.client_edges(calls, ends, beans)) == {("bean::a::OrderService", "endpoint::b::GET::/api/orders/{k}", "feign_calls"), ("bean::b::StockService", "endpoint::a::GET::/api/orders/{id}", "feign_calls")}
    topics = spark.createDataFrame([("a", "t", "producer"), ("b", "t", "consumer"), ("b", "u", "both")], "project string, topic string, role string")
    assert edges(G.topic_edges(topics, beans)) == {("bean::a::OrderService", "kafka_topic::t", "produces_event"), ("kafka_topic::t", "bean::b::StockService", "consumes_event"), ("bean::b::StockService", "kafka_topic::u", "produces_event"), ("kafka_topic::u", "bean::b::StockService", "consumes_event")}
    assert {(r.topic, tuple(r.producers), tuple(r.consumers)) for r in G.event_flow(topics).collect()} == {("t", ("a",), ("b",)), ("u", ("b",), ("b",))}
    assert {r.project: r.targets for r in G.service_dependencies(calls, topics).collect()} == {"a": ["b"], "b": ["a", "zz"], "c": ["b"]}
    fields = spark.createDataFrame([("a", "XDto"), ("b", "XDto"), ("b", "YDto")], "project string, dto string")
    assert [tuple(r) for r in G.shared_models(fields).collect()] == [("XDto", ["a", "b"])]
    found = G.nodes(ends, beans, entities, topics)
    assert found.count() == 3 + 7 + 2 + 2 and {r.project for r in found.where("type = 'kafka_topic'").collect()} == {None}
