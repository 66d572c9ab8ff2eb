"""A corpus pipeline over ``documents``: stages of (spark, docs, sf_dir) -> DataFrame, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fabsight.llm.common import durable, table
from fabsight.llm.lines import drop_boilerplate
from fabsight.llm.minhash import drop_near_copies
from fabsight.llm.packing import harmonic_pack
from fabsight.llm.repeats import drop_repeats
from fabsight.llm.toxicity import drop_toxic

#: Shingle words, differing fingerprint bits of candidates and least Jaccard similarity of near copies.
WORDS, RADIUS, SIMILARITY = 5, 5, 0.8
#: Bytes of a passage that must not stand anywhere else.
PASSAGE = 200


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text has them now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays."""
    return _counted(drop_boilerplate(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies of a document that stays go: candidates by SimHash and by MinHash, exact Jaccard decides."""
    return drop_near_copies(docs, WORDS, SIMILARITY, RADIUS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand more than once go; every document stays."""
    return _counted(drop_repeats(docs, PASSAGE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", packing)]

#: Learned scores, fingerprints and tokenizer ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
