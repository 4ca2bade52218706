"""A directed property graph as two tables, nodes(id, type, project, name) and edges(src, dst, type, label), and its
traversals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import risk
from ..session import materialize, table


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), key.cast("string"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, type), with the smallest label."""
    return edges.groupBy("src", "dst", "type").agg(F.min("label").alias("label"))


def relational_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the relational tables: keys become nodes, references edges; an order's project is its segment."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    segment = t["customer"].select("c_custkey", "c_mktsegment")
    nodes = [
        t["region"].select(node_id("region", F.col("r_regionkey")).alias("id"), F.lit("region").alias("type"), F.lit(None).cast("string").alias("project"), F.col("r_name").alias("name")),
        t["nation"].select(node_id("nation", F.col("n_nationkey")), F.lit("nation"), F.lit(None).cast("string"), F.col("n_name")),
        t["customer"].select(node_id("customer", F.col("c_custkey")), F.lit("customer"), F.col("c_mktsegment"), F.col("c_name")),
        t["supplier"].select(node_id("supplier", F.col("s_suppkey")), F.lit("supplier"), F.lit(None).cast("string"), F.col("s_name")),
        t["part"].select(node_id("part", F.col("p_partkey")), F.lit("part"), F.col("p_brand"), F.col("p_name")),
        t["orders"].join(segment, F.col("o_custkey") == F.col("c_custkey"), "left").select(node_id("order", F.col("o_orderkey")), F.lit("order"), F.col("c_mktsegment"), F.col("o_orderpriority")),
    ]
    edges = [
        t["nation"].select(node_id("nation", F.col("n_nationkey")).alias("src"), node_id("region", F.col("n_regionkey")).alias("dst"), F.lit("in_region").alias("type"), F.lit("").alias("label")),
        t["customer"].select(node_id("customer", F.col("c_custkey")), node_id("nation", F.col("c_nationkey")), F.lit("located_in"), F.lit("")),
        t["orders"].select(node_id("order", F.col("o_orderkey")), node_id("customer", F.col("o_custkey")), F.lit("placed_by"), F.lit("")),
        t["lineitem"].select(node_id("order", F.col("l_orderkey")), node_id("part", F.col("l_partkey")), F.lit("contains"), F.lit("")),
        t["lineitem"].select(node_id("part", F.col("l_partkey")), node_id("supplier", F.col("l_suppkey")), F.lit("supplied_by"), F.lit("")),
    ]
    return reduce(DataFrame.union, nodes), dedup_edges(reduce(DataFrame.union, edges))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "label")


def bfs(edges: DataFrame, roots: DataFrame, depth: int, nodes: DataFrame | None = None) -> DataFrame:
    """roots(id) -> (id, depth) of all nodes within `depth` steps, each once at its least depth; roots are left out.

    Each level is one join of the frontier with the edges and an anti-join with what has been seen, cut from its
    lineage; targets that are no nodes are skipped if nodes are given. Stops when a level is empty.
    """
    links = materialize(edges.select("src", "dst"))  # read again by each level
    seen = materialize(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for level in range(1, depth + 1):
        step = links.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        step = step.join(seen, "id", "left_anti")
        if nodes is not None:
            step = step.join(nodes.select("id"), "id", "left_semi")
        front = materialize(step.withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def impact(nodes: DataFrame, edges: DataFrame, root: str, out_depth: int = 4, in_depth: int = 3) -> DataFrame:
    """direction, type, n: what a node reaches and what reaches it by node type, with the risk of the whole."""
    roots, edges = nodes.where(F.col("id") == root).select("id"), materialize(edges)
    sides = [("outgoing", bfs(edges, roots, out_depth)), ("incoming", bfs(reversed_edges(edges), roots, in_depth))]
    both = reduce(DataFrame.unionByName, [found.withColumn("direction", F.lit(side)) for side, found in sides])
    counts = both.join(nodes.select("id", "type"), "id").groupBy("direction", "type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a handful of rows: one for each direction and node type
    return counts.select("direction", "type", "n", risk(total).alias("risk"))


def callers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """target, type, n, first_caller: incoming edges of each target by edge type."""
    hit = edges.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return hit.groupBy(F.col("dst").alias("target"), "type").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_caller"))


def node_chunks(nodes: DataFrame, edges: DataFrame, out_most: int = 12, in_most: int = 8) -> DataFrame:
    """id, content: a node with its first outgoing and incoming edges as text; nodes without edges are left out."""

    def side(key: str, other: str, most: int, name: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy("type", other)
        top = edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
        listed = F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(" ", "type", other).alias("s"))))
        return top.groupBy(F.col(key).alias("id")).agg(F.concat_ws("; ", F.transform(listed, lambda x: x["s"])).alias(name))

    both = side("src", "dst", out_most, "outs").join(side("dst", "src", in_most, "ins"), "id", "full")
    text = F.concat(F.col("type"), F.lit(" "), F.coalesce("name", F.lit("")), F.lit(" | out: "), F.coalesce("outs", F.lit("")), F.lit(" | in: "), F.coalesce("ins", F.lit("")))
    return nodes.join(both, "id").select("id", text.alias("content"))
