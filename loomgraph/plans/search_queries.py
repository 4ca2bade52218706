"""Searches of many questions at once: every vector whose id is divisible by 20 asks, and all vectors are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..session import table
from . import sources
from .catalogue import _SLUG_SQL, query

_NAME = f"{sources.NATION_NAME} || 'Service'"
_FAR = "round(1 - list_cosine_similarity(e.embedding::double[], p.probe::double[]), 6)"
_TEXTS = f"""nat as (select n_nationkey as k, {_NAME} as name, {_SLUG_SQL.format('n_name')} as project from nation),
 texts as (select vec_id, a.project, 'calls ' || a.name || ' and ' || b.name || ' for item ' || vec_id as content, ['digest', 'graph', 'code'][vec_id % 3 + 1] as source, ['endpoint', 'bean', 'entity', 'java'][vec_id % 4 + 1] as type
  from embeddings join nat a on a.k = (vec_id * 7) % 25 join nat b on b.k = (vec_id * 3 + 1) % 25),
 questions as (select vec_id as question_id, 'what does ' || lower(name) || ' call for item ' || vec_id as question, embedding as probe, case when vec_id % 40 = 0 then project end as project from embeddings join nat on k = vec_id % 25 where vec_id % 20 = 0)"""
_SCORE = """round(len(list_filter(list_distinct(list_filter(regexp_extract_all(lower(question), '\\b(\\w{4,})\\b', 1), lambda x: x not in ('what','how','does','the','and','for','with','that','this','which','when','where','from','into','about','have','been'))), lambda w: contains(lower(content), w)))
 + case source when 'digest' then 1.5 when 'graph' then 1.2 else 0.0 end + case type when 'endpoint' then 0.8 when 'bean' then 0.6 when 'entity' then 0.5 else 0.0 end + greatest(0.0, 1 - distance), 6)"""
_RANKED = f"""scored as (select question_id, vec_id, distance, {_SCORE} as score from @hits join texts using (vec_id) join questions using (question_id)),
 ranked as (select *, row_number() over (partition by question_id order by score desc, distance, vec_id) as i from scored) select question_id, i::int as i, vec_id, score, distance from ranked where i <= @keep"""


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vectors, what they stand for, questions, and nations as names."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = table(spark, d, "nation")
    pascal = F.concat(sources.nation_name(), F.lit("Service"))
    nat = n.select(F.col("n_nationkey").cast("long").alias("k"), pascal.alias("name"), sources._slug("n_name").alias("project"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("vec_id") % len(values) + 1).cast("int"))
    a, b = nat.select(F.col("k").alias("ka"), F.col("name").alias("na"), "project"), nat.select(F.col("k").alias("kb"), F.col("name").alias("nb"))
    texts = v.select("vec_id").join(a, F.col("vec_id") * 7 % 25 == F.col("ka")).join(b, (F.col("vec_id") * 3 + 1) % 25 == F.col("kb"))
    texts = texts.select("vec_id", "project", F.format_string("calls %s and %s for item %d", "na", "nb", "vec_id").alias("content"), pick(["digest", "graph", "code"]).alias("source"), pick(["endpoint", "bean", "entity", "java"]).alias("type"))
    asks = v.where("vec_id % 20 = 0").join(nat, F.col("vec_id") % 25 == F.col("k"))
    question = F.format_string("what does %s call for item %d", F.lower("name"), "vec_id")
    questions = asks.select(F.col("vec_id").alias("question_id"), question.alias("question"), F.col("vec_id").alias("own"), F.col("embedding").alias("probe"), F.when(F.col("vec_id") % 40 == 0, F.col("project")).alias("project"))
    return v, texts, questions, nat


@query(f"""with {_TEXTS}, near as (select question_id, e.vec_id, {_FAR} as distance, p.project as only, t.project from questions p join embeddings e on e.vec_id <> question_id join texts t on t.vec_id = e.vec_id where p.project is null or p.project = t.project),
 hits as (select question_id, vec_id, distance from near qualify row_number() over (partition by question_id order by distance, vec_id) <= 16), {_RANKED.replace('@hits', 'hits').replace('@keep', '8')}""")
def search_questions(spark, d):
    """Sixteen nearest, eight best by the question; every other question asks one project only."""
    v, texts, questions, _ = _parts(spark, d)
    return search.search_all(v, texts, questions).select("question_id", "i", "vec_id", "score", "distance")


@query(f"""with {_TEXTS}, probes as (select question_id, v.vec_id as variant, v.embedding as probe from questions join embeddings v on v.vec_id between question_id and question_id + 9),
 near as (select question_id, variant, e.vec_id, {_FAR} as distance from probes p join embeddings e on e.vec_id <> question_id),
 merged as (select question_id, vec_id, min(distance) as distance from (select * from near qualify row_number() over (partition by question_id, variant order by distance, vec_id) <= 12) group by all),
 told as (select distinct question_id, unnest(regexp_extract_all(content, '([A-Z][a-z]+(?:[A-Z][a-z]+)+)', 1)) as name from merged join texts using (vec_id)),
 hop as (select question_id, told.name, k from told join nat using (name) qualify row_number() over (partition by question_id order by told.name) <= 8),
 more as (select question_id, hop.name, e.vec_id, {_FAR} as distance from hop join (select vec_id, embedding as probe from embeddings) p on p.vec_id = 100 + k join embeddings e on e.vec_id <> question_id),
 again as (select question_id, vec_id, min(distance) as distance from (select * from more qualify row_number() over (partition by question_id, name order by distance, vec_id) <= 4) where (question_id, vec_id) not in (select (question_id, vec_id) from merged) group by all),
 whole as (select * from merged union all select * from again), {_RANKED.replace('@hits', 'whole').replace('@keep', '30')}""")
def deep_search(spark, d):
    """Ten variants of each question (the vectors from its own on), hops over the names found, thirty best."""
    v, texts, questions, nat = _parts(spark, d)
    probes = questions.select("question_id", F.explode(F.sequence("question_id", F.col("question_id") + 9)).alias("variant")).join(v.select(F.col("vec_id").alias("variant"), F.col("embedding").alias("probe")), "variant")
    names = nat.join(v, F.col("k") + 100 == F.col("vec_id")).select("name", F.col("embedding").alias("probe"))
    return search.deep_search(v, texts, questions, probes, names).select("question_id", "i", "vec_id", "score", "distance")


@query(f"""with {_TEXTS} select name, count(*) as n from (select unnest(list_distinct(regexp_extract_all(content, '([A-Z][a-z]+(?:[A-Z][a-z]+)+)', 1))) as name from texts) group by name""")
def hop_names(spark, d):
    """Names to follow in all contents, and in how many they are."""
    return search.hop_names(_parts(spark, d)[1], None).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
