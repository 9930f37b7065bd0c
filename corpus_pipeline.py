"""A corpus from raw documents to packed sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringspark.llm import common, mixing, order_minhash, packing, queries, suffix_dedup, toxicity


# Passages of over 50 words have about 285 bytes and more; 400 bytes would leave half of them.
PASSAGE = 280


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.clean(docs, common.table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return order_minhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes that occur more than once are cut out of the texts."""
    return suffix_dedup.cleaned(docs, length=PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor documents are thinned out until good ones make up 0.95 of the expected tokens."""
    return mixing.mix(docs, mixing.by_quality(common.table(spark, sf_dir, "labels")), {"good": 0.95, "poor": 0.05})


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_copies), ("suffix_dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

# No SQL: the learned scores, sketches and the packing are not expressible; tests/llm compares the
# near-copy, mixing and packing operators with plain versions, and the chain's columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
