"""A training corpus from raw documents, stage by stage.

Toxic documents go, one document of each near-duplicate group stays, passages
that repeat earlier documents are cut out, sources are mixed to their target
weights (no document is lost, rare sources repeat), and what is left is packed
into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newstide.llm import copies, mixing, packing, substring, toxicity
from newstide.llm.cluster import materialise, parquet


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.without_toxic(docs, parquet(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return copies.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that start in an earlier one."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of rare sources repeated."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place there."""
    return packing.pack(docs, packing.ranks_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, iterate and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder before the next."""
    docs = parquet(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialise(docs), sf_dir)
    return docs
