"""What grows with the tables: plans that try a rule once, sizes that the driver sees, and rows that joins make."""

import re

from pyspark.sql import functions as F

from loomgraph.operators import extraction, graphbuild, matching, trace
from loomgraph.session import materialize

JAVA = "src/A.java", "@Service\npublic class A {\n  private final B b;\n  A(B b) { this.b = b; }\n  /** Some. */\n  @GetMapping(\"/x\")\n  public List<C> all(int n) { return b.all(n); }\n}\n"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joined_rows(spark, df):
    """The most rows that a join of the plan makes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        nodes = [df._jdf.queryExecution().executedPlan()]
        made = []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
        return max(made)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_rules_are_not_tried_again_by_a_filter(spark):
    files = spark.createDataFrame([("p", *JAVA)], "project string, path string, text string")
    members = extraction.java_members(materialize(extraction.java_statements(files)))
    assert len(re.findall(r"regexp_\w+\(|RLIKE", plan(members))) < 12
    got = sorted(tuple(r) for r in members.select("no", "what", "type", "name", "params", "doc").collect())
    assert [g[1:] for g in got] == [("field", "B", "b", None, ""), ("constructor", "A", "A", "B b", ""), ("method", "List<C>", "all", "int n", "Some.")]


def test_marks_in_texts_divide_nothing(spark):
    body = "  int a = f(\"\");\n  void b() { }\n  fieldxy\n}\n"
    files = spark.createDataFrame([("p", "src/A.java", "class A {\n" + body)], "project string, path string, text string")
    got = extraction.java_members(extraction.java_statements(files)).select("what", "type", "name", "params").collect()
    assert sorted(map(tuple, got), key=str) == [("field", "int", "a", None), ("method", "void", "b", "")]


def test_written_texts_are_not_taken_for_small(spark):
    """Files of some KB hold 40 MB of texts: a join with them is planned as a shuffle."""
    texts = materialize(spark.range(200_000).select("id", F.repeat(F.lit("same words "), 20).alias("text")))
    assert "BroadcastHashJoin" not in texts.join(texts.select("id", F.col("text").alias("t")), "id")._jdf.queryExecution().sparkPlan().toString()


def test_suffix_join_meets_the_first_of_each_ending(spark):
    """600 endpoints that end alike and 600 calls of that ending: no product of them is made, whatever wins."""
    ends = spark.range(600).select(F.col("id").alias("endpoint_id"), F.format_string("/v%d/x", 600 - F.col("id")).alias("path"))
    calls = spark.range(600).select(F.col("id").alias("call_id"), F.when(F.col("id") == 7, "/v1/x").when(F.col("id") == 8, "/far/v2/x").otherwise("/x").alias("path"))
    out = matching.suffix_join(calls, ends)
    assert {r.call_id: (r.endpoint_id, r.epath) for r in out.where("call_id < 10").collect()} == {n: (0, "/v600/x") for n in range(10)} | {7: (599, "/v1/x"), 8: (598, "/v2/x")}
    assert joined_rows(spark, out) <= 3 * 600


def test_nodes_are_built_without_edges(spark, tmp_path):
    files = spark.createDataFrame([("p", *JAVA), ("web", "src/c.component.ts", "@Component({ selector: 'c' })\nexport class CComponent { constructor(private s: AService) {} }")], "project string, path string, text string")
    settings = spark.createDataFrame([], "project string, key string, value string")
    nodes, _ = graphbuild.build_graph(files, settings, f"{tmp_path}/whole")
    alone = graphbuild.build_nodes(files, settings, f"{tmp_path}/alone")
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, alone.collect())) and nodes.count() == 4
    assert not (tmp_path / "alone" / "edges").exists()


def test_rounds_of_chains_leave_one_table(spark, tmp_path, monkeypatch):
    """A chain of six nodes takes several rounds; only links and the last round stay."""
    made = iter(range(99))
    monkeypatch.setattr("loomgraph.session.scratch", lambda _, kind: f"file://{tmp_path}/{kind}-{next(made)}")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "a") for i in range(6)], "src string, dst string, type string")
    got = trace.chains(edges, spark.createDataFrame([("n0",)], "root string"))
    assert sorted(r["depth"] for r in got.collect()) == [1, 2, 3, 4, 5] and len(list(tmp_path.iterdir())) == 2 < next(made)


def test_impact_walks_over_numbers(spark):
    """Names come once for each finding: rows that walks deal out and sort hold numbers."""
    edges = [("e1", "b1", "handled_by"), ("b1", "t", "produces_event"), ("b2", "t", "produces_event"), ("t", "f", "consumes_event"), ("s", "e1", "http_call"), ("c", "s", "uses_service"), ("f", "f", "loop"), (None, "f", "x")]
    roots = spark.createDataFrame([("b1",), ("f",), ("alone",), (None,)], "root string")
    walked = []
    was, trace.walk = trace.walk, lambda e, r, n: walked.append(e.schema["src"].dataType.simpleString()) or was(e, r, n)
    try:
        got = trace.impact_graph(roots, spark.createDataFrame(edges, "src string, dst string, type string"))
    finally:
        trace.walk = was
    assert walked == ["bigint", "bigint"]
    assert {tuple(r) for r in got.collect()} == {
        ("b1", "forward", "t", 1, "MEDIUM"), ("b1", "forward", "f", 2, "MEDIUM"), ("b1", "backward", "e1", 1, "MEDIUM"), ("b1", "backward", "s", 2, "MEDIUM"), ("b1", "backward", "c", 3, "MEDIUM"),
        ("f", "backward", "t", 1, "MEDIUM"), ("f", "backward", "b1", 2, "MEDIUM"), ("f", "backward", "b2", 2, "MEDIUM"), ("f", "backward", "e1", 3, "MEDIUM"), ("b1", "peer", "b2", 0, "MEDIUM"), ("b1", "peer", "f", 0, "MEDIUM"), ("f", "peer", "b1", 0, "MEDIUM"), ("f", "peer", "b2", 0, "MEDIUM"),
    }
