"""An index of source files that follows its files: what changed between two snapshots, and only that computed anew.

An index is a folder of tables, each partitioned by project: `manifest` (project, path, hash), and those that an `Index`
names. A table of the kind `local` has rows that depend on one file each (project, path, ...): rows of changed and deleted files
go, those of changed and added files are made. One of the kind `project` depends on a project's files together and is made
anew for projects that changed. One of the kind `derived` depends on the other tables, is a small part of the texts, and is
made anew when anything changed.

Null texts count as empty; rows without project or path are not indexed; of repeated paths the greatest text counts. A
project whose files are all gone leaves every table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

Maker = Callable[[DataFrame], DataFrame]


def snapshot(files: DataFrame) -> DataFrame:
    """project, path, text: one row for each file."""
    known = files.where("project is not null and path is not null")
    return known.groupBy("project", "path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("project", "path", F.sha2("text", 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two manifests -> project, path, change (added, changed, deleted); files that are the same give no row."""
    both = old.select("project", "path", F.col("hash").alias("was")).join(new.select("project", "path", F.col("hash").alias("now")), ["project", "path"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("project", "path", kind.alias("change")).where("change is not null")


@dataclass
class Index:
    """Tables of an index below `root`, and how each is made."""

    spark: SparkSession
    root: str
    local: dict[str, Maker] = field(default_factory=dict)
    project: dict[str, Maker] = field(default_factory=dict)
    derived: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A stored table; the project is text whatever it looks like."""
        return self.spark.read.option("basePath", f"{self.root}/{name}").schema(self._schema(name)).parquet(f"{self.root}/{name}")

    def _schema(self, name: str):
        # a footer has no partition column, and inference would make numbers of projects that look like them
        found = self.spark.read.parquet(f"{self.root}/{name}/_empty").schema
        return found.add("project", "string")

    def _write(self, name: str, rows: DataFrame, mode: str) -> None:
        columns = [c for c in rows.columns if c != "project"]
        out = rows.select(*columns, F.col("project").cast("string").alias("project"))
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{self.root}/{name}")
        if mode == "errorifexists":
            out.drop("project").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/_empty")

    def _drop(self, name: str, gone: set[str]) -> None:
        """Remove the partitions of projects that have no rows left."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for entry in fs.listStatus(place):
            kind, _, value = entry.getPath().getName().partition("=")
            if kind == "project" and unquote(value) in gone:
                fs.delete(entry.getPath(), True)

    def _derive(self, mode: str) -> None:
        tables = {n: self.table(n) for n in [*self.local, *self.project]}
        for name, make in self.derived.items():
            rows = materialize(make(tables))
            if mode == "overwrite":
                self._drop(name, {r["project"] for r in self.table(name).select("project").distinct().join(rows.select("project").distinct(), "project", "left_anti").toLocalIterator()})
            self._write(name, rows, mode)
            tables[name] = self.table(name)

    def build(self, files: DataFrame) -> None:
        """All tables from all files, in an empty folder."""
        files = materialize(snapshot(files))
        self._write("manifest", manifest(files), "errorifexists")
        for name, make in [*self.local.items(), *self.project.items()]:
            self._write(name, make(files), "errorifexists")
        self._derive("errorifexists")

    def update(self, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """Follow the files, of the projects in only(project) if given; returns what changed.

        Each table's new partitions are complete before they replace the old ones, and the manifest comes last: an update that
        fails is repeated by the next one.
        """
        files = snapshot(files)
        old = self.table("manifest")
        if only is not None:
            files, old = (x.join(only.select("project").distinct(), "project", "left_semi") for x in (files, old))
        files = materialize(files)
        found = materialize(changes(old, manifest(files)))
        if found.isEmpty():
            return found
        touched = materialize(found.select("project").distinct())
        of = lambda x: x.join(touched, "project", "left_semi")
        here = materialize(of(files))
        fresh = materialize(here.join(found.where("change <> 'deleted'").select("project", "path"), ["project", "path"], "left_semi"))
        made = {n: of(self.table(n)).join(found.select("project", "path"), ["project", "path"], "left_anti").unionByName(make(fresh)) for n, make in self.local.items()}
        made |= {n: make(here) for n, make in self.project.items()}
        for name, rows in [*made.items(), ("manifest", manifest(here))]:
            rows = materialize(rows)
            if name == "manifest":
                self._derive("overwrite")
            self._write(name, rows, "overwrite")
            self._drop(name, {r["project"] for r in touched.join(rows.select("project").distinct(), "project", "left_anti").toLocalIterator()})
        return found


def owners(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """paths(path, ...), registry(project, root, ord): the first registered project whose root holds the path, by equality on
    the path's prefixes; paths of no project give no rows."""
    clean = F.regexp_replace("root", "/+$", "")
    roots = registry.groupBy(clean.alias("prefix")).agg(F.min(F.struct("ord", "project")).alias("x"))
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.where("path is not null").select("path", F.explode(prefixes).alias("prefix")).distinct().join(roots, "prefix")
    best = each.groupBy("path").agg(F.min("x").alias("x"))
    return paths.join(best.select("path", F.col("x.project").alias("project")), "path")
