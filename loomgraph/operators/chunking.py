"""Texts cut into overlapping windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import listed

def char_chunks(docs: DataFrame, window: int = 2000, overlap: int = 200, single: int = 2200) -> DataFrame:
    """docs(doc_id, text) -> doc_id, idx, content: windows of characters; a text of at most `single` stays whole."""
    step = window - overlap
    n = F.length("text")
    last = F.when(n <= single, 0).otherwise(F.ceil((n - window) / F.lit(float(step))).cast("int"))
    each = docs.where("text <> ''").select("doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    size = F.when(F.col("n") <= single, F.col("n")).otherwise(window)
    return each.select("doc_id", "idx", F.substring(F.col("text"), F.col("idx") * step + 1, size).alias("content"))


def token_chunks(docs: DataFrame, window: int = 500, overlap: int = 50, single: int = 600) -> DataFrame:
    """docs(doc_id, text) -> doc_id, idx, n_tokens, content: windows of words between blanks."""
    step = window - overlap
    split = docs.select("doc_id", F.expr(r"filter(split(text, '[ \n]+'), w -> w <> '')").alias("w")).where("size(w) > 0")
    n = F.size("w")
    last = F.when(n <= single, 0).otherwise(F.ceil((n - window) / F.lit(float(step))).cast("int"))
    each = split.select("doc_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    part = F.when(F.col("n") <= single, F.col("w")).otherwise(F.slice("w", F.col("idx") * step + 1, F.lit(window)))
    return each.select("doc_id", "idx", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("content"))


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts of chunks in total, by lang and by source, in one pass over grouping sets."""
    both = chunks.select("doc_id").join(docs.select("doc_id", "lang", "source"), "doc_id")
    sets = both.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.expr("case g when 3 then 'total' when 1 then 'lang' else 'source' end").alias("level"), F.coalesce("lang", "source", F.lit("all")).alias("key"), "n")


def token_windows(docs: DataFrame, tokenizer: str, window: int = 500, overlap: int = 50, single: int = 600) -> DataFrame:
    """docs(doc_id, text) -> doc_id, idx, n_tokens, start, content: windows of tokens of a vocabulary file, as pieces of the
    text itself; `start` counts characters. Null and empty texts give no rows; a task encodes a batch of texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True  # their names in a text are text
        for f in frames:
            rows = []
            for no, text in zip(f["no"].tolist(), f["text"].tolist()):
                at = encoder.encode(text, add_special_tokens=False).offsets
                n = len(at)
                starts = [0] if n <= single else list(range(0, n - overlap, window - overlap))
                for i, a in enumerate(starts):
                    b = n if n <= single else min(a + window, n)
                    # what lies before the first token or behind the last one belongs to them
                    first, last = at[a][0] if a else 0, at[b - 1][1] if b < n else len(text)
                    rows.append((no, i, b - a, first, text[first:last]))
            yield pd.DataFrame(rows, columns=["no", "idx", "n_tokens", "start", "content"])

    kind = docs.schema["doc_id"].dataType
    some = docs.where("text <> ''").select(F.to_json(F.struct("doc_id")).alias("no"), "text")
    cut = some.mapInPandas(run, "no string, idx int, n_tokens int, start long, content string")
    return cut.select(F.from_json("no", f"doc_id {kind.simpleString()}")["doc_id"].alias("doc_id"), "idx", "n_tokens", "start", "content")


def chunk_id(project: Column, kind: Column, name: Column, idx: Column) -> Column:
    """The same for the same chunk in every run."""
    return F.sha2(F.concat_ws("::", project, kind, name, idx.cast("string")), 256)


def digest_chunks(endpoints: DataFrame | None = None, entities: DataFrame | None = None, beans: DataFrame | None = None, clients: DataFrame | None = None) -> DataFrame:
    """id, project, type, name, content: facts of each kind as text, in one union."""
    or_none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    said = lambda c: F.when(F.col(c), "True").otherwise("False")
    parts = []
    if endpoints is not None:
        text = F.concat_ws("\n", F.format_string("Endpoint %s %s", "method", "path"), F.format_string("controller=%s handler=%s", "controller", "handler"), F.concat(F.lit("request="), or_none("request_dto"), F.lit(" response="), or_none("response_dto")), F.concat(F.lit("auth="), said("auth_required"), F.lit(" roles="), listed(F.col("roles"))), F.when(F.col("javadoc") != "", F.concat(F.lit("doc="), F.col("javadoc"))))
        parts.append(endpoints.select("project", F.lit("endpoint").alias("type"), F.col("handler").alias("name"), text.alias("content")))
    if entities is not None:
        text = F.concat_ws("\n", F.format_string("Entity %s table=%s", "name", "table"), F.concat(F.lit("fields="), listed(F.col("fields"))), F.concat(F.lit("relationships="), listed(F.col("relationships"))))
        parts.append(entities.select("project", F.lit("entity").alias("type"), "name", text.alias("content")))
    if beans is not None:
        text = F.concat_ws("\n", F.format_string("Bean %s type=%s", "name", "bean_type"), F.concat(F.lit("dependencies="), listed(F.col("dependencies"))), F.concat(F.lit("methods="), listed(F.col("methods"))))
        parts.append(beans.select("project", F.lit("bean").alias("type"), "name", text.alias("content")))
    if clients is not None:
        text = F.format_string("Feign %s target=%s\nendpoints:\n  %s %s", "client", "target", "method", "path")
        parts.append(clients.select("project", F.lit("feign").alias("type"), F.col("client").alias("name"), text.alias("content")))
    every = reduce(DataFrame.unionByName, parts)
    return every.select(chunk_id(F.col("project"), F.col("type"), F.col("name"), F.lit(0)).alias("id"), "project", "type", "name", "content")
