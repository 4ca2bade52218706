"""Settings of a project from its configuration files(project, path, text): precedence, imports and what they tell.

Main files come before those of profiles and imported ones last; of equal keys the last one wins. Null texts have no
settings; a project without configuration files gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Configuration files from the weakest to the strongest, and the keys that are kept as facts.
PRECEDENCE = [r"application\.yml", r"application\.yaml", r"application\.properties", r"application-[^/]*\.yml", r"application-[^/]*\.properties"]
IMPORT, RESOURCES = "spring.config.import", "src/main/resources/"
FACTS = {"port": "server.port", "app_name": "spring.application.name", "datasource": "spring.datasource.url"}
FLAGS = {"has_feign": "feign", "has_eureka": "eureka", "has_kafka": "kafka", "has_rabbitmq": "rabbitmq"}
LINE = r"^\s*([^#!\s=:][^=:\s]*)\s*[=:]\s*(.*?)\s*$"


def _rank(path: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(PRECEDENCE))):
        out = F.when(F.rlike(path, F.lit(f"(^|/){pattern}$")), i).otherwise(out)
    return out


def _pairs(files: DataFrame) -> DataFrame:
    lines = files.select("project", "path", "rank", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    key, value = (F.regexp_extract("line", LINE, i) for i in (1, 2))
    return lines.select("project", "path", "rank", "no", key.alias("key"), value.alias("value")).where("key <> ''")


def _last(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("project", "key").agg(F.max_by("value", F.struct("rank", "path", "no")).alias("value"))


def config_settings(files: DataFrame) -> DataFrame:
    """project, key, value: main files, then profiles, then files that the import setting names, in its order."""
    ranked = files.select("project", "path", "text", _rank(F.col("path")).alias("rank"))
    main = _pairs(ranked.where("rank is not null"))
    named = _last(main.where(F.col("key") == IMPORT)).select("project", F.posexplode(F.split("value", ",")).alias("nth", "entry"))
    entry = F.trim(F.regexp_replace(F.trim("entry"), r"^optional:classpath:", ""))
    named = named.select("project", (F.lit(len(PRECEDENCE)) + F.col("nth")).alias("rank"), entry.alias("entry")).where("entry <> ''")
    others = ranked.where(F.col("rank").isNull() & F.contains("path", F.lit(RESOURCES))).drop("rank")
    others = others.withColumn("entry", F.regexp_extract("path", rf"(?:^|/){RESOURCES}(.*)$", 1))
    return _last(main.unionByName(_pairs(others.join(named, ["project", "entry"]))))


def app_facts(files: DataFrame) -> DataFrame:
    """project, port, app_name, datasource, has_datasource, has_feign, has_eureka, has_kafka, has_rabbitmq, active_profiles."""
    ranked = files.select("project", "path", "text", _rank(F.col("path")).alias("rank")).where("rank is not null and text is not null")
    order = F.struct("rank", "path")

    def last(found: Column) -> Column:
        return F.max_by(F.trim(found), F.when(found.isNotNull(), order))

    def first_match(key: str) -> Column:
        pattern = key.replace(".", r"\.") + r"\s*[:=]\s*(.+)"
        return F.when(F.rlike("text", F.lit(pattern)), F.regexp_extract("text", pattern, 1))

    profiles = F.element_at(F.regexp_extract_all("text", F.lit(r"spring\.profiles\.active\s*[:=]\s*(.+)"), F.lit(1)), -1)
    profiles = F.when(F.rlike("text", F.lit(r"spring\.profiles\.active\s*[:=]\s*.")), profiles)
    facts = [last(first_match(key)).alias(name) for name, key in FACTS.items()]
    flags = [F.bool_or(F.contains("text", F.lit("spring.datasource"))).alias("has_datasource")]
    flags += [F.bool_or(F.contains(F.lower("text"), F.lit(word))).alias(name) for name, word in FLAGS.items()]
    listed = F.transform(F.split(last(profiles), ","), lambda x: F.trim(x)).alias("active_profiles")
    return ranked.groupBy("project").agg(*facts, *flags, listed)
