"""Queries against DuckDB on the given tables, and properties of the operators behind them."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunking, graph, matching, vectors
from loomgraph.plans import catalogue
from loomgraph.plans.planner import rule_plan
from loomgraph.streaming import debounce as quiet

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6)
    return int(x) if hasattr(x, "__index__") else str(x)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, D).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_bfs_takes_least_depths_and_stops_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "t", ""), ("b", "c", "t", ""), ("c", "a", "t", ""), ("a", "c", "u", ""), ("c", "x", "t", "")], "src string, dst string, type string, label string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    roots = nodes.where("id = 'a'")
    assert {(r.id, r.depth) for r in graph.bfs(edges, roots, 4).collect()} == {("b", 1), ("c", 1), ("x", 2)}
    assert {r.id for r in graph.bfs(edges, roots, 4, nodes).collect()} == {"b", "c"}


def test_chunks_rebuild_the_text(spark):
    texts = ["a", "ab" * 1100, "abcde" * 441, "xyz" * 3000, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.char_chunks(docs).orderBy("doc_id", "idx").collect():
        got[r.doc_id] = got[r.doc_id] + r.content[200:] if r.doc_id in got else r.content
    assert got == {i: x for i, x in enumerate(texts) if x}


def test_suffix_join_prefers_equal_paths(spark):
    calls = spark.createDataFrame([(1, "/v1/orders"), (2, "/orders"), (3, "/none")], "call_id int, path string")
    ends = spark.createDataFrame([(7, "/orders"), (8, "/v1/orders"), (9, "/x/v1/orders")], "endpoint_id int, path string")
    assert {(r.call_id, r.endpoint_id) for r in matching.suffix_join(calls, ends).collect()} == {(1, 8), (2, 7)}


def test_upsert_twice_is_once(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = vectors.upsert(old, new, "id")
    assert sorted(map(tuple, vectors.upsert(once, new, "id").collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


@pytest.mark.parametrize(
    "question, tools",
    [
        ("Explain the OrderService deep", ["search_deep", "get_method_calls", "get_api_contracts"]),
        ("what breaks if I change OrderRepository", ["impact_graph", "search_codebase"]),
        ("How does CancelOrder work end to end", ["describe_feature", "search_deep", "search_deep", "get_method_calls"]),
        ("list features", ["list_features", "search_deep"]),
        ("who calls StockClient", ["find_callers", "search_codebase"]),
        ("GET /api/orders/1", ["search_codebase", "trace_request"]),
        ("the address of it", ["search_codebase"]),  # `add` is found inside a word
    ],
)
def test_rule_plans(spark, question, tools):
    plan = spark.createDataFrame([(question,)], "q string").select(rule_plan(F.col("q"), T.detect_mode(F.col("q"))).alias("p")).first().p
    assert [c.tool for c in plan] == tools


def test_scalar_functions(spark):
    one = spark.range(1)
    values = one.select(
        T.norm_path(F.lit("/a/{id}/b/")).alias("a"), T.norm_path(F.lit("")).alias("b"), T.url_path(F.lit("http://h/x/y?q#f")).alias("c"), T.join_paths(F.lit("/a/"), F.lit("/b")).alias("d"),
        T.strip_bean_suffix(F.lit("OrderServiceImpl")).alias("e"), T.relationship_entity(F.lit("orderItems")).alias("f"), T.unwrap_generic(F.lit("List<Order>")).alias("g"), T.slug_title(F.lit("cancel-order")).alias("h"),
        T.roles(F.lit("hasRole('B') ROLE_A hasAuthority('A')")).alias("i"), T.pascal_names(F.lit("use OrderService and fooBar")).alias("j"), T.risk(F.lit(4)).alias("k"), T.query_words(F.lit("What about the Cached cached orders")).alias("l"),
    ).first()
    assert list(values) == ["/a/*/b", "/", "/x/y", "/a/b", "OrderService", "OrderItem", "Order", "Cancel Order", ["A", "B"], ["OrderService"], "MEDIUM", ["cached", "orders"]]


def test_stream_closes_the_sessions_that_batch_finds(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = quiet.debounce_stream(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed, batch = {tuple(r) for r in spark.table("closed").collect()}, {tuple(r) for r in quiet.debounce(events).collect()}
    assert closed <= batch and len(batch) - len(closed) < math.sqrt(len(batch)) + 5
