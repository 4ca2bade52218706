"""What the corpus operators share: tables, cut lineage and distributed ranks."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[str] = []
_made: list[str] | None = None
_old: list[str] = []
#: Spark then deletes the shuffle files of a query when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. A temporary one where it is unset, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _OWN[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor lose it with an executor.

    The shuffle files behind it are deleted at once, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that `cut` wrote and nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._cut_at)


def row_key(doc_id: Column) -> Column:
    """A number for the id that is never null; rows are told apart by it and a hash of their text."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def by_text_id(df: DataFrame, run, schema: str, *ids: str) -> DataFrame:
    """df.mapInPandas(run, schema) with the ids as decimal text inside: beside a null, pandas would make them doubles."""
    out = df.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(run, schema)
    return out.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in ids})


def rank_in_class(df: DataFrame, cls: str, order: list[str], buckets: int = 64) -> DataFrame:
    """Add `rank`, gapless from 0 within each value of `cls`, without bringing a whole class into one task.

    Rows of a class are dealt over hash buckets of the order columns; bucket counts (at most classes x buckets
    rows) give each bucket its first rank, and a window numbers the rows of one bucket only.
    """
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(cls, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col(cls), "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(cls, "_b").orderBy(*order)
    return (
        keyed.join(first, [cls, "_b"])
        .withColumn("rank", (F.col("_first") + F.row_number().over(within) - 1).cast("long"))
        .drop("_b", "_first")
    )


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


def stage(f):
    """A pipeline stage: its working tables are removed when the next stage starts, which reads the written result."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _made
        used = docs.inputFiles()
        for path in [p for p in _old if not any(p.split("://")[-1] in u for u in used)]:
            _delete(spark, path)
            _old.remove(path)
        _made = []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _old.extend(_made)
            _made = None

    return run
