"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: A byte of a written table's files stands for so many in memory: texts of one make shrink to a fiftieth and less. Joins then
#: start as shuffles, and those whose sides are really small are made broadcasts by what the shuffles measured.
TEXT_SHRINKS = 64
#: Spark then deletes the shuffle files of a query when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "loomgraph", master: str | None = None) -> SparkSession:
    """A session with the settings that the operators assume; a cluster's own settings win where given at submit."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A path for a new folder in spark.checkpoint.dir; where that is unset, in a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
        root = _OWN[0]
    return f"{root}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files behind it go at once, as nothing reads them again. From then on the session takes tables to be as large as their texts, not as
    their files: one of a few MB may hold hundreds, and the driver would gather these to broadcast them."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "step")
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < TEXT_SHRINKS:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", TEXT_SHRINKS)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `materialize` wrote and nothing reads any more."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._step_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
