"""Lookups in tiers, feature names, back ends by name, code pieces and searches, on small inputs."""

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunking, codegraph, features, lookup, search, pieces


def ids(df):
    return sorted(r.id for r in df.collect())


def test_endpoints_by_method_and_path_else_by_part_of_the_path(spark):
    e = spark.createDataFrame([("a", "GET", "/api/orders/{id}"), ("b", "POST", "/api/orders/{id}"), ("c", "GET", "/api/orders/{id}/lines")], "id string, method string, path string")
    assert ids(lookup.find_endpoints(e, "get /api/orders/{key}/")) == ["a"]
    assert ids(lookup.find_endpoints(e, "/ORDERS/")) == ["a", "b", "c"]
    assert ids(lookup.find_endpoints(e, "PUT /api/orders")) == []


def test_nodes_and_topics(spark):
    n = spark.createDataFrame([(f"n{i:02}", "spring_service", "svc-order", f"OrderService{i or ''}", None, None) for i in range(14)], "id string, type string, project string, name string, label string, path string")
    assert ids(lookup.find_nodes(n, "orderservice")) == ["n00"] and len(ids(lookup.find_nodes(n, "service"))) == 10
    t = n.unionByName(spark.createDataFrame([("t1", "kafka_topic", None, "stock.sold", None, None), ("t2", "kafka_topic", None, "x", None, None)], n.schema))
    edges = spark.createDataFrame([("n00", "t1", "produces_event"), ("t2", "n01", "consumes_event")], "src string, dst string, type string")
    assert ids(lookup.find_topics(t, edges, "stock.sold.v2")) == ["t1"] and ids(lookup.find_topics(t, edges, "svc-order")) == ["t1", "t2"]
    assert lookup.named(n, "name", "ORDERSERVICE").count() == 1 and lookup.named(n, "name", "ORDERSERVICE", whole=False).count() == 14


def test_feature_names(spark):
    f = spark.createDataFrame([("f1", "cancel-order", "Cancel Order"), ("f2", "book-a-slot", "Book A Slot"), ("f3", "order-history-list", "Order History List")], "id string, feature_key string, name string")
    for question, found in [("CancelOrderModule", ["f1"]), ("history", ["f3"]), ("the list of order things", ["f3"]), ("nothing", []), ("I want to book a slot now", ["f2"])]:
        assert ids(features.find_feature(f, question)) == found, question
    one = spark.range(1)
    paths = ["src/app/components/cancel-order/x.component.ts", "src/app/components/shared/pages/menu/y.ts", "src/app/pages/home.ts", "src/app/z.ts"]
    assert list(one.select(*[T.feature_slug(F.lit(p)) for p in paths]).first()) == ["cancel-order", "menu", None, None]


def test_backends_by_alias_then_by_name_in_order(spark):
    s = spark.createDataFrame([("AuthOrderService",), ("OrderService",), ("UiService",)], "name string")
    p = spark.createDataFrame([("svc-stocks", 0), ("svc-orders", 1), ("identity", 2), ("order", 3)], "project string, ord long")
    got = {r.name: r.backend for r in features.backend_of(s, p, {"auth": "identity"}, ("svc-",)).collect()}
    assert got == {"AuthOrderService": "identity", "OrderService": "svc-orders"}


def test_types_labels_and_reach(spark):
    one = spark.range(1)
    got = one.select(T.openapi_type(F.lit("List<Set<UUID>>")), T.openapi_type(F.lit("Order")), T.openapi_type(F.lit("LocalDate")), T.auth_label(F.lit(True), F.array(F.lit("A"), F.lit("B"))), T.auth_label(F.lit(False), F.array(F.lit("A"))), T.reach(F.lit("orders-api"), F.array(F.lit("orders")))).first()
    assert list(got) == ['{"type":"array","items":{"type":"array","items":{"type":"string","format":"uuid"}}}', '{"$ref":"#/components/schemas/Order"}', '{"type":"string","format":"date-time"}', "[AUTH: required, roles=['A', 'B']]", "[AUTH: public]", "internal"]


def test_code_pieces_rebuild_the_text(spark):
    java = "package a;\nclass A {\n  /** One. */\n  @Get\n  public int one(int x) { return x + 1; }\n  private void two() {\n    go();\n  }\n" + "".join(f"  public void m{i}() {{ call{i}(); }}\n" for i in range(9)) + "}\n"
    script = "import x;\nexport function one() { return 11111; }\n// two\nexport async function two() { return 2222222; }\n"
    files = spark.createDataFrame([("a.java", java), ("b.ts", script), ("c.html", "<p>"), ("d.java", ""), ("e.java", None)], "path string, text string")
    got = pieces.code_pieces(files).orderBy("path", "idx").collect()
    for path, text in (("a.java", java), ("b.ts", script), ("c.html", "<p>")):
        assert "".join(r.content for r in got if r.path == path) == text
    assert sum(r.path == "a.java" for r in got) == 12 and [r.method_name for r in got if r.path == "a.java"][1] == "one"


def test_search_steps(spark):
    merged = spark.createDataFrame([(1, 0.5)], "vec_id long, distance double")
    again = spark.createDataFrame([(1, 0.1), (2, 0.4), (2, 0.3)], "vec_id long, distance double")
    assert {tuple(r) for r in search.multi_hop(merged, again).collect()} == {(1, 0.5), (2, 0.3)}
    hits = spark.createDataFrame([("uses OrderService and ResponseEntity",), ("OrderService StockClient",)], "content string")
    assert [r.name for r in search.hop_names(hits).collect()] == ["OrderService", "StockClient"]
    texts = spark.createDataFrame([(7, "abc"), (8, "z")], "id long, content string")

    def model():
        left = [1]  # fails once

        def run(batch):
            if left and left.pop():
                raise OSError("busy")
            return [[float(len(x))] for x in batch]

        return run

    assert {r.id: list(r.embedding) for r in search.embed(texts, model, wait=0.01).collect()} == {7: [3.0], 8: [1.0]}
    assert len(search.variants("x")) == 10


def test_graph_is_written_and_loaded(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "bean", "p", "A"), ("b", "entity", "p", "B")], "id string, type string, project string, name string")
    e = spark.createDataFrame([("a", "b", "manages", "x"), ("a", "b", "manages", "y")], "src string, dst string, type string, label string")
    n, edges = codegraph.build(nodes, [e, e], str(tmp_path))
    assert n.count() == 2 and [tuple(r) for r in edges.select("src", "dst", "type", "label").collect()] == [("a", "b", "manages", "x")]
