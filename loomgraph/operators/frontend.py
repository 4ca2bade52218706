"""What a front end's texts tell beyond one file: HTTP calls through inherited classes, slugs and names by kind.

Classes are looked up by name in their own project. The chain of parents is followed one join a round; a class that a chain
has met ends it, so circles end too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .extraction import _all, _get, _of, environments, script_calls
from .pieces import method_texts

# What stands before a slug, marks of interceptors, and keys of environments that are kept.
SLUG_ROOT = "v1/"
MARKS = {"JWTHeaderInjectionDetected": "Authorization|Bearer", "TokenRefreshDetected": r"(?is)refresh.*token|token.*refresh"}
LIFE_CYCLE = ["ngOnInit", "ngOnDestroy", "ngOnChanges", "ngAfterViewInit", "ngAfterContentInit", "ngAfterViewChecked", "ngAfterContentChecked", "ngDoCheck", "constructor"]
ENVIRONMENT_KEYS = ["apiUrl", "baseUrl", "apiBaseUrl", "backendUrl", "serverUrl"]


def script_classes(files: DataFrame) -> DataFrame:
    """project, path, name, parent of each class; null without a parent."""
    declared = r"\bclass\s+(\w+(?:\s*<[^{]*?>)?(?:\s+extends\s+\w+)?)"
    each = _of(files, r"\.ts$").select("project", "path", F.explode(_all(F.col("text"), declared)).alias("x"))
    return each.select("project", "path", F.regexp_extract("x", r"^\w+", 0).alias("name"), _get(F.col("x"), r"\bextends\s+(\w+)$").alias("parent"))


def ancestors_with(starts: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """starts(project, path, name, parent) -> project, path, found: the file of the nearest ancestor among wanted(project, path).

    A class is found by its name, else by a file of that name; of several the first by path counts.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.ts$", 1)
    names = classes.select("project", "name", F.lit(0).alias("tier"), "path", "parent").unionByName(classes.select("project", stem.alias("name"), F.lit(1).alias("tier"), "path", "parent"))
    place = names.groupBy("project", "name").agg(F.min(F.struct("tier", "path", "parent")).alias("x"))
    place = materialize(place.select("project", F.col("name").alias("at"), F.col("x.path").alias("file"), F.col("x.parent").alias("above")))
    full = wanted.select("project", F.col("path").alias("file"), F.lit(True).alias("full")).distinct()
    front = materialize(starts.where("parent is not null").select("project", "path", F.col("parent").alias("at"), F.array("name").alias("met")))
    found = []
    while not front.isEmpty():
        step = front.join(place, ["project", "at"]).join(full, ["project", "file"], "left")
        step = materialize(step.select("project", "path", "at", "file", "above", "met", F.coalesce("full", F.lit(False)).alias("full")))
        found.append(step.where("full").select("project", "path", F.col("file").alias("found")))
        on = step.where("not full and above is not null").select("project", "path", F.col("above").alias("at"), F.concat("met", F.array("at")).alias("met"))
        front = materialize(on.where(~F.array_contains("met", F.col("at"))))
    return reduce(DataFrame.unionByName, found) if found else front.select("project", "path", F.lit("").alias("found"))


def component_methods(files: DataFrame) -> DataFrame:
    """project, path, component, method, calls: methods of components but those of their life cycle, in order of name, with the
    distinct `field.call()` of their bodies."""
    c = _of(files, r"\.component\.ts$").where("project is not null").select(F.to_json(F.struct("project", "path")).alias("k"), F.concat(F.to_json(F.struct("project", "path")), F.lit(".ts")).alias("path"), "text")
    found = method_texts(c.select("path", "text")).where(~F.col("method_name").isin(LIFE_CYCLE) & F.rlike("method_name", F.lit("^[^A-Z]")))
    calls = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"this\.(\w+\.\w+)\s*\("), F.lit(1)), lambda x: F.concat(x, F.lit("()")))))
    place = F.from_json(F.regexp_replace("path", r"\.ts$", ""), "project string, path string")
    each = found.select(place.alias("p"), F.col("class_name").alias("component"), F.col("method_name").alias("method"), calls.alias("calls"))
    return each.groupBy("p.project", "p.path", "component", "method").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("calls")))).alias("calls"))


def _methods(text: Column) -> Column:
    """Methods that a service passes to its parent's calls; GET if it passes none."""
    said = F.transform(_all(text, r"\b(?:super|this)\.\w+\([^()]*?\bmethod\s*:\s*(?:\w+\.)*(\w+)"), F.upper)
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("GET")))


def slugs(files: DataFrame) -> DataFrame:
    """project, constant, slug of constant files; of equal names the first by path."""
    each = _of(files, r"\.constants\.ts$").select("project", "path", F.posexplode(_all(F.col("text"), r"(\b\w+\s*[=:]\s*(?:'[^'\n]+'|\"[^\"\n]+\"))")).alias("no", "x"))
    value = F.regexp_extract("x", r"[=:]\s*['\"](.*)['\"]$", 1)
    return each.groupBy("project", F.regexp_extract("x", r"^\w+", 0).alias("constant")).agg(F.min_by(value, F.struct("path", "no")).alias("slug"))


def service_calls(files: DataFrame) -> DataFrame:
    """project, path, service, method, url, response_shape, via: the HTTP calls of each service.

    Its own calls (own), else those of its nearest ancestor that has any (parent), else the address that it overrides
    (override), else the constant slug (slug; in lower case if no file defines it) or the literal one (literal) that it gives
    its parent. A service with none of these gives no row.
    """
    scripts = _of(files, r"\.ts$")
    classes = materialize(script_classes(files))
    calls = materialize(script_calls(scripts))
    texts = _of(files, r"\.service\.ts$").select("project", "path", "text", _get(F.col("text"), r"\bexport\s+(?:abstract\s+)?class\s+(\w+)").alias("service")).where("service is not null")
    own = calls.join(texts.select("project", "path", "service"), ["project", "path"])
    bare = texts.join(calls.select("project", "path").distinct(), ["project", "path"], "left_anti")
    starts = bare.select("project", "path", F.col("service").alias("name")).join(classes, ["project", "path", "name"]).select("project", "path", "name", "parent")
    above = materialize(ancestors_with(starts, classes, calls).groupBy("project", "path").agg(F.min("found").alias("found")))
    inherited = above.join(calls.withColumnRenamed("path", "found"), ["project", "found"]).join(texts.select("project", "path", "service"), ["project", "path"])
    rest = bare.join(above, ["project", "path"], "left_anti")
    t = F.col("text")
    rest = rest.select(
        "project", "path", "service", F.explode(_methods(t)).alias("method"), _get(t, r"\boverride\s+apiItemsUrl\s*\([^)]*\)[^{;]*\{\s*return\s*['\"`]([^'\"`]+)['\"`]").alias("address"),
        _get(t, r"\bsuper\s*\([^;]*?\bAPI_SLUGS\.(\w+)").alias("constant"), _get(t, r"\bsuper\s*\([^;)]*?['\"]([a-z][a-z0-9_/-]+)['\"]").alias("literal"),
    ).join(slugs(files), ["project", "constant"], "left")
    named = F.concat(F.lit(SLUG_ROOT), F.coalesce("slug", F.lower("constant")))
    literal = F.when(F.contains("literal", F.lit("/")) | (F.length("literal") > 2), F.concat(F.lit(SLUG_ROOT), "literal"))
    via = F.when(F.col("address").isNotNull(), "override").when(F.col("constant").isNotNull(), "slug").when(literal.isNotNull(), "literal")
    rest = rest.withColumn("via", via).where("via is not null")
    # a literal slug is read, whatever methods are passed
    rest = rest.select("project", "path", "service", F.when(F.col("via") == "literal", "GET").otherwise(F.col("method")).alias("method"), F.coalesce("address", named, literal).alias("url"), F.lit("unknown").alias("response_shape"), "via")
    rest = rest.where("via <> 'literal'").unionByName(rest.where("via = 'literal'").distinct())
    columns = ["project", "path", "service", "method", "url", "response_shape"]
    return own.select(*columns, F.lit("own").alias("via")).unionByName(inherited.select(*columns, F.lit("parent").alias("via"))).unionByName(rest)


def angular_names(files: DataFrame) -> DataFrame:
    """project, kind (module, guard, interceptor, model), name, each once; what an interceptor does and the addresses of
    environments are names of their kind."""

    def of(kind: str, path: str, pattern: str) -> DataFrame:
        return _of(files, path).select("project", F.lit(kind).alias("kind"), F.explode(_all(F.col("text"), pattern)).alias("name"))

    intercepts = _of(files, r"\.interceptor\.ts$")
    parts = [
        of("module", r"\.module\.ts$", r"\bexport\s+class\s+(\w+Module)\b"),
        of("guard", r"\.guard\.ts$", r"\bexport\s+(?:class|function|const)\s+(\w+)"),
        of("interceptor", r"\.interceptor\.ts$", r"\bexport\s+class\s+(\w+)"),
        *[intercepts.where(F.rlike("text", F.lit(p))).select("project", F.lit("interceptor").alias("kind"), F.lit(name).alias("name")) for name, p in MARKS.items()],
        of("model", r"\.(?:model|interface|type|dto)\.ts$", r"\b(?:interface|enum|class|type)\s+(\w+)"),
        environments(files).where(F.col("key").isin(ENVIRONMENT_KEYS)).select("project", F.lit("model").alias("kind"), F.concat_ws(":", "key", "value").alias("name")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()
