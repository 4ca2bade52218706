"""File events as a stream: a folder of change logs, debounced for each project, then the project's index follows.

A change log is a file of JSON lines (path, kind, ts), which whatever watches a source tree adds to a folder; kinds are
created, modified and deleted. Events of other suffixes and of paths outside every project are dropped. A project is handled
once it has been quiet for the gap, however many of its files changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reindex import Index, owners

# Suffixes that are watched.
WATCHED = ["java", "ts", "html", "yml", "yaml", "properties", "json"]
EVENT = "path string, kind string, ts timestamp"


def file_events(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of (path, kind, ts) from the change logs below folder."""
    reader = spark.readStream.schema(EVENT)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return watched(reader.json(folder))


def watched(events: DataFrame) -> DataFrame:
    return events.where(F.rlike(F.lower("path"), F.lit(rf"\.(?:{'|'.join(WATCHED)})$")) & F.col("ts").isNotNull())


def quiet_projects(events: DataFrame, registry: DataFrame, gap: str = "2 seconds", late: str | None = "10 seconds") -> DataFrame:
    """events(path, ts), registry(project, root, ord) -> project, start, end, n, last_path: bursts that a quiet gap has ended.

    In batch every burst is given; as a stream those that the watermark has passed. Roots are joined on the path's prefixes,
    so the registry may be of any size.
    """
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    if events.isStreaming:  # one first root for each prefix, and of a path's prefixes the first registered
        clean = registry.groupBy(F.regexp_replace("root", "/+$", "").alias("prefix")).agg(F.min(F.struct("ord", "project")).alias("x"))
        own = clean.select("prefix", "x")
        each = events.select("path", "ts", F.explode(prefixes).alias("prefix")).join(own, "prefix")
        # a path below two roots counts for both here; the re-index of the outer one finds nothing changed
        named = each.select("path", "ts", F.col("x.project").alias("project"))
    else:
        named = owners(events, registry)
    bursts = named.groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("ts", "path")).alias("x"))
    return bursts.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", F.col("x.path").alias("last_path"))


def follow(bursts: DataFrame, index: Index, read: Callable[[list[str]], DataFrame], checkpoint: str, said: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Start re-indexing: for the projects of each batch of bursts, `read(projects)` gives their files as they are now.

    A repeated batch changes nothing, as an update depends on the files and the manifest alone.
    """

    def handle(batch: DataFrame, _: int) -> None:
        projects = sorted(r["project"] for r in batch.select("project").distinct().collect())  # the projects of one batch of events
        if projects:
            only = index.spark.createDataFrame([(p,) for p in projects], "project string")
            found = index.update(read(projects), only)
            if said:
                said(found)

    return bursts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
