"""A training corpus from raw documents: quality, exact copies, near copies, mix, packing.

Each stage works on all that the stage before it kept. run() writes every stage
as Parquet to the folder that the cluster shares and reads it again. Other
columns are carried whatever their names, but for the last stage. Empty tables
give no rows. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, near_copies, packing, quality
from corvane.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels beside the documents.

    Null and empty texts score alike, so do repeated rows and all equal texts: they stay or go together. Null ids
    are scored like others. Labels without an id or a value are left out; of several labels of an id the lowest
    counts. Without labels every document stays.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts: the smallest id, a null id last.

    Null counts as empty. Of repeated rows with that id one stays.
    """
    return exact_dedup.without_duplicates(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a similarity of 0.8 or more: the smallest id.

    SimHash with production settings of its own finds the candidates, the shingles decide. Texts without words
    (null, empty) and rows without an id stay; rows that repeat an id stay or go together.
    """
    return near_copies.without_near_copies(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, and the runs of words that it takes once more.

    A null source is a source of its own. Texts without words come once, as they are. Repeated rows are taken
    each for themselves.
    """
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    Null and empty texts are one piece, the end id alone; repeated rows are packed as often as they come; null ids
    are kept.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", unlike_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: A trained classifier, XXH64 and a tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
