"""Corpus pipeline: toxic documents go, then exact and near copies; what stays is packed.

Every stage works on all rows that the one before it left, and its result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweave.llm import exact, minhash, packing, simhash, toxicity
from geoweave.llm.common import prepared, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones among them scores below 0.5."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled_texts(docs, labels))
    return toxicity.without_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    prepared(spark)
    return exact.drop_exact(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their five-word shingles), the document with the smallest id.

    SimHash over the same shingles finds texts within 3 bits of each other, MinHash bands those that it has
    no reach for; what either finds is a near copy if the shingles themselves say so.
    """
    prepared(spark)
    near = simhash.near_groups(docs, width=minhash.SHINGLE_WORDS)
    return minhash.drop_similar(docs, near=near)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences of 1024 tokens that hold them."""
    prepared(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack),
]

# The classifier's scores cannot be stated in SQL; a plain version of all stages is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
