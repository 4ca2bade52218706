"""Facts as JSON by project, digests of other makers, and the registry of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Groups of the registry in their order, and how a digest file is named.
GROUPS, MASTER, SUFFIX = ["frontend", "services"], "master.digest.json", ".digest.json"


def write_digests(facts: dict[str, DataFrame], root: str) -> None:
    """Each kind of fact below root as JSON lines, a folder for each project; what was there goes."""
    for kind, rows in facts.items():
        rows.write.mode("overwrite").partitionBy("project").json(f"{root}/{kind}")


def read_digest(spark: SparkSession, root: str, kind: str, schema: StructType) -> DataFrame:
    """Facts of one kind with a given schema (project is text); lines that cannot be read are skipped."""
    kept = StructType([f for f in schema.fields if f.name != "project"]).add("_bad", "string")
    read = spark.read.schema(StructType(kept.fields).add("project", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/{kind}")
    return read.where("_bad is null").select(*[f.name for f in schema.fields])


def scan_digests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Whole digest files below root, one row each, as schema reads them, with `file` and `kind` (master, angular, spring-boot by
    their own word); files that cannot be read are skipped."""
    texts = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SUFFIX}").load(root)
    read = texts.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("d"))
    good = read.where("d is not null and d._bad is null").select("file", "d.*").drop("_bad")
    return good.withColumn("kind", F.when(F.col("file") == MASTER, "master").otherwise(F.col("type")))


def registry(files: DataFrame) -> DataFrame:
    """files(path, text) of registries -> project, type, root, port, ord: the front ends, then the services, in their order.

    Read as lines: a group's key, then items of `key: value`, the first after a dash. An item without a name is none.
    """
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\s+#.*$|^\s*#.*$", "")).where("trim(line) <> ''")
    so_far = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    group = F.regexp_extract("line", r"^\s*(\w+):\s*$", 1)
    lines = lines.withColumns({"group": F.last(F.nullif(group, F.lit("")), True).over(so_far), "item": F.sum(F.rlike("line", F.lit(r"^\s*-\s")).cast("int")).over(so_far)})
    pair = r"^\s*(?:-\s+)?(\w+)\s*:\s*['\"]?(.*?)['\"]?\s*$"
    pairs = lines.where(F.col("group").isin(GROUPS) & (F.col("item") > 0) & (group == "")).select("path", "group", "item", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    items = pairs.groupBy("path", "group", "item").agg(value("name").alias("project"), value("type").alias("type"), value("path").alias("root"), value("port").cast("int").alias("port")).where("project is not null")
    order = Window.partitionBy("path").orderBy(F.array_position(F.array(*map(F.lit, GROUPS)), F.col("group")), "item")
    return items.select("project", "type", "root", "port", (F.row_number().over(order) - 1).alias("ord"))
