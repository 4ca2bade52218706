"""Lookups of one question in several tiers: the rows of the best tier that has any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH"]


def best_tier(rows: DataFrame, tier: Column) -> DataFrame:
    """The rows whose tier is the least that any row has; null is none."""
    rated = rows.withColumn("tier", tier).where("tier is not null")
    return rated.join(F.broadcast(rated.agg(F.min("tier").alias("tier"))), "tier").drop("tier")  # one row


def first_of(sections: dict[str, DataFrame], most: dict[str, int]) -> DataFrame:
    """key, section, item: of each key's items the first by name, where a section is bounded."""
    every = reduce(DataFrame.unionByName, [rows.withColumn("section", F.lit(name)) for name, rows in sections.items()])
    nth = F.row_number().over(Window.partitionBy("key", "section").orderBy("item"))
    bound = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])
    kept = every.withColumn("nth", nth).where(F.col("nth") <= F.coalesce(F.try_element_at(bound, F.col("section")), F.lit(1 << 30)))
    return kept.select("key", "section", "item")


def find_endpoints(endpoints: DataFrame, question: str) -> DataFrame:
    """endpoints(id, method, path, ...): `METHOD path` with equal normalised paths, else paths that hold the question."""
    low = question.lower().strip()
    method, _, path = low.partition(" ")
    exact = (F.col("method") == method.upper()) & (T.norm_path(F.col("path")) == T.norm_path(F.lit(path))) if method.upper() in METHODS and path else F.lit(False)
    return best_tier(endpoints, F.when(exact, 0).when(F.contains(F.lower("path"), F.lit(low)), 1))


def find_nodes(nodes: DataFrame, question: str, most: int = 10) -> DataFrame:
    """nodes(id, name, label, path): equal names in any case, else the first `most` by id that hold the question."""
    low = F.lit(question.lower().strip())
    inside = reduce(Column.__or__, [F.contains(F.coalesce(F.lower(c), F.lit("")), low) for c in ("name", "label", "path")])
    exact = F.lower("name") == low
    found = best_tier(nodes, F.when(exact, 0).when(inside, 1))
    ordered = found.withColumn("nth", F.when(F.lower("name") == low, 0).otherwise(F.lit(1)))
    return ordered.where("nth = 0").unionByName(ordered.where("nth = 1").orderBy("id").limit(most)).drop("nth")


def find_topics(nodes: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """Topics whose name holds the question or stands in it, else those of service beans of projects that hold it."""
    low = F.lit(question.lower().strip())
    topics = nodes.where("type = 'kafka_topic'").select("id", "name")
    near = topics.where(F.contains(F.lower("name"), low) | F.contains(low, F.lower("name"))).withColumn("t", F.lit(0))
    beans = nodes.where(F.col("type").isin("spring_service", "spring_component") & F.contains(F.lower("project"), low)).select(F.col("id").alias("bean"))
    ends = edges.where(F.col("type").isin("produces_event", "publishes_to")).select(F.col("src").alias("bean"), F.col("dst").alias("id"))
    ends = ends.unionByName(edges.where("type = 'consumes_event'").select(F.col("dst").alias("bean"), F.col("src").alias("id")))
    far = topics.join(ends.join(beans, "bean", "left_semi").select("id").distinct(), "id").select("id", "name").withColumn("t", F.lit(1))
    return best_tier(near.unionByName(far), F.col("t")).drop("t")


def named(rows: DataFrame, column: str, question: str, whole: bool = True) -> DataFrame:
    """Rows whose column equals the question in any case, or holds it."""
    low = F.lit(question.lower().strip())
    return rows.where(F.lower(column) == low if whole else F.contains(F.lower(column), low))
