"""Ids beside null ones: none lost, none changed, in one partition."""

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import stages
from loomgraph.llm.decontamination import contamination
from loomgraph.llm.katz import katz_scores
from loomgraph.llm.language import identify_language
from loomgraph.llm.linededup import dedup_lines
from loomgraph.llm.merkle import manifest
from loomgraph.llm.neardup import near_duplicates
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality import score_quality
from loomgraph.llm.queries import tokenizer_path
from loomgraph.llm.repeats import remove_repeats
from loomgraph.llm.sharding import shard
from loomgraph.llm.toxicity import score_toxicity
from loomgraph.llm.whitening import whiten

IDS = [None, 2**53 + 1, 2**53 + 3, -1, 7]
TEXTS = ["a quiet river bends past the old stone mill", "seven green lamps hang over the empty market square", "no letter came that winter to the northern post", "they counted sheep until the storm had passed by", "copper wires hum along the road to the harbour"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else "de", "src", len(t), k) for k, (i, t) in enumerate(zip(IDS, TEXTS))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2**53 + 1, 1, 0), (2**53 + 3, 0, 1), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, l: near_duplicates(d),
    "op2": lambda d, l: contamination(d, d.select(F.lit("x").alias("item_id"), "text").limit(1)),
    "op3": lambda d, l: shard(d, 3),
    "op4": lambda d, l: katz_scores(d),
    "op5": lambda d, l: dedup_lines(d),
    "op6": lambda d, l: identify_language(d),
    "op7": lambda d, l: pack_documents(d, tokenizer_path()),
    "op8": lambda d, l: remove_repeats(d),
    "op9": score_toxicity,
    "op12": score_quality,
    "op13": lambda d, l: manifest(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_id_comes_back(docs, labels, name):
    got = [r["doc_id"] for r in OPERATORS[name](docs, labels).collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_vector_ids_come_back(spark):
    rows = [(i, [float(k), float(k * k % 7)]) for k, i in enumerate(IDS)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)).collect()
    assert sorted((r["vec_id"] for r in got if r["component"] == 1), key=str) == sorted(IDS, key=str)


def test_stages_keep_every_id(spark, docs, tmp_path):
    spark.createDataFrame([("b", "wholly unrelated words of a benchmark item that nobody wrote into any document here")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (stages.toxicity, stages.line_dedup, stages.minhash_near_dedup, stages.decontamination):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())), stage.__name__
    assert sorted((r["doc_id"] for r in stages.packing(spark, docs, str(tmp_path)).collect()), key=str) == sorted(IDS, key=str)
