"""Searches composed of nearest vectors, re-ranking by the question, follow-up names and a readable context."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import pascal_names
from ..session import materialize
from .vectors import hybrid_score, knn_cosine

# Common type names that are not followed, and what each variant of a question asks for.
NOT_FOLLOWED = ["Optional", "ResponseEntity", "HttpStatus", "List", "Map", "String", "Long", "Integer", "Boolean", "Object"]
VARIANTS = [
    "{}", "service method implementation business logic: {}", "REST endpoint controller handler DTO: {}", "entity repository database query: {}",
    "configuration properties Feign Kafka event: {}", "Angular component service HTTP call: {}", "method call graph dependencies: {}",
    "security authentication authorization @PreAuthorize JWT role: {}", "exception error handling @ControllerAdvice fault tolerance: {}",
    "Kafka event topic property configuration value: {}",
]


def embed(texts: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], tries: int = 3, wait: float = 0.5) -> DataFrame:
    """texts(id, content) -> id, embedding. `model` makes a function from texts to vectors, once in each task; a batch that
    fails is tried again, each time after a longer wait."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors_of = model()
        for f in frames:
            for nth in range(1, tries + 1):
                try:
                    found = vectors_of(f["content"].tolist())
                    break
                except Exception:
                    if nth == tries:
                        raise
                    time.sleep(wait * nth)
            yield pd.DataFrame({"id": f["id"], "embedding": found})

    return texts.select("id", "content").mapInPandas(run, texts.select("id").schema.simpleString()[7:-1].replace("id:", "id ") + ", embedding array<float>")


def variants(question: str) -> list[str]:
    return [v.format(question) for v in VARIANTS]


def search(vectors: DataFrame, contents: DataFrame, probe: DataFrame, question: str, first: int = 16, keep: int = 8, project: str | None = None) -> DataFrame:
    """contents(vec_id, content, source, type, project) nearest to the probe, of one project if given before the search,
    ranked anew by the question: i, vec_id, score, distance and the contents' columns."""
    if project is not None:
        contents = contents.where(F.col("project") == project)
        vectors = vectors.join(contents.select("vec_id"), "vec_id", "left_semi")
    hits = knn_cosine(vectors, probe, first).select("vec_id", "distance").join(contents, "vec_id")
    scored = hits.withColumn("score", hybrid_score(F.col("content"), F.col("source"), F.col("type"), F.col("distance"), question))
    best = scored.orderBy(F.desc("score"), "distance", "vec_id").limit(keep)
    return best.withColumn("i", F.row_number().over(Window.orderBy(F.desc("score"), "distance", "vec_id")))  # at most `keep` rows


def _ranked(hits: DataFrame, contents: DataFrame, questions: DataFrame, keep: int) -> DataFrame:
    """hits(question_id, vec_id, distance) with their contents, ranked anew for each question: i from 1 to keep."""
    each = hits.join(contents, "vec_id").join(questions.select("question_id", "question"), "question_id")
    score = hybrid_score(F.col("content"), F.col("source"), F.col("type"), F.col("distance"), F.col("question"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "distance", "vec_id")
    return each.withColumn("score", score).withColumn("i", F.row_number().over(best)).where(F.col("i") <= keep).drop("question")


def search_all(vectors: DataFrame, contents: DataFrame, questions: DataFrame, first: int = 16, keep: int = 8) -> DataFrame:
    """`search` for many questions at once: questions(question_id, question, own, probe, project), of one project where that
    is given -> question_id, i, vec_id, score, distance and the contents' columns."""
    asks = questions.select(F.col("question_id").alias("probe_id"), "own", "probe", F.col("project").alias("part"))
    near = knn_cosine(vectors, asks.where("part is null").drop("part"), first)
    # before the search, so that a project's nearest are found however far they are
    of = vectors.join(contents.select("vec_id", F.col("project").alias("part")).distinct(), "vec_id")
    near = near.unionByName(knn_cosine(of, asks.where("part is not null"), first))
    return _ranked(near.select(F.col("probe_id").alias("question_id"), "vec_id", "distance"), contents, questions, keep)


def deep_search(vectors: DataFrame, contents: DataFrame, questions: DataFrame, probes: DataFrame, names: DataFrame, first: int = 12, hops: int = 8, each: int = 4, keep: int = 30) -> DataFrame:
    """questions(question_id, question, own), probes(question_id, variant, probe), names(name, probe) -> as search_all.

    Every variant of a question is searched on its own, and its hits are merged by least distance. The first `hops` names in
    the contents found are searched again (`names` has the vector of each), and add what the question has not found yet; all
    are ranked anew by the question.
    """
    key = F.concat_ws("|", F.col("question_id").cast("string"), F.col("variant").cast("string"))
    asks = probes.join(questions.select("question_id", "own"), "question_id").select("question_id", "own", key.alias("probe_id"), "probe")
    asked = asks.select("probe_id", "question_id")
    near = knn_cosine(vectors, asks.select("probe_id", "own", "probe"), first).join(asked, "probe_id")
    merged = materialize(near.groupBy("question_id", "vec_id").agg(F.min("distance").alias("distance")))
    told = merged.join(contents.select("vec_id", "content"), "vec_id").select("question_id", F.explode(F.array_distinct(pascal_names(F.col("content")))).alias("name"))
    told = told.where(~F.col("name").isin(NOT_FOLLOWED)).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("question_id").orderBy("name"))).where(F.col("nth") <= hops)
    follow = materialize(told.join(names, "name").join(questions.select("question_id", "own"), "question_id").select("question_id", "own", "name", "probe"))
    # a name is searched once, with one more, as a question does not find its own vector
    found = knn_cosine(vectors, follow.select(F.col("name").alias("probe_id"), F.lit(None).cast("long").alias("own"), "probe").dropDuplicates(["probe_id"]), each + 1)
    again = found.join(follow.select(F.col("name").alias("probe_id"), "question_id", "own"), "probe_id").where("own is null or vec_id <> own")
    again = again.withColumn("nth", F.row_number().over(Window.partitionBy("question_id", "probe_id").orderBy("rank"))).where(F.col("nth") <= each)
    new = again.join(merged.select("question_id", "vec_id"), ["question_id", "vec_id"], "left_anti").groupBy("question_id", "vec_id").agg(F.min("distance").alias("distance"))
    return _ranked(merged.unionByName(new), contents, questions, keep)


def hop_names(hits: DataFrame, most: int | None = 8) -> DataFrame:
    """Names of several capitalised words in the hits, once for each hit, but common types; if bounded, the first by name."""
    names = hits.select(F.explode(F.array_distinct(pascal_names(F.col("content")))).alias("name")).where(~F.col("name").isin(NOT_FOLLOWED))
    return names if most is None else names.distinct().orderBy("name").limit(most)


def multi_hop(merged: DataFrame, follow: DataFrame) -> DataFrame:
    """merged(vec_id, distance) and those of follow that it lacks, each once at its least distance."""
    new = follow.join(merged.select("vec_id"), "vec_id", "left_anti").groupBy("vec_id").agg(F.min("distance").alias("distance"))
    return merged.select("vec_id", "distance").unionByName(new)


def context(hits: DataFrame) -> DataFrame:
    """i, block: each hit under a line that names it; file, class and method where the hits have them."""
    part = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in hits.columns else F.lit(other)
    head = F.format_string("[SOURCE %d] project=%s type=%s file=%s class=%s method=%s\n%s", "i", "project", "type", part("file_path", "digest"), part("class_name", ""), part("method_name", ""), "content")
    return hits.select(F.col("i").cast("int").alias("i"), head.alias("block"))
