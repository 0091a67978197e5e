"""A corpus from documents to a training mix.

Stages, each on all that the one before kept, written as Parquet in between:
toxic documents go; of near-duplicates one stays; repeated strings of 50 bytes are cut out;
documents with benchmark passages go; the sources are mixed to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm import contamination, mixing, simhash, substrings, toxicity
from arbitra.llm.mixing_query import WEIGHTS
from arbitra.llm.tables import read, written


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the nearest labelled examples call toxic."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each component of linked fingerprints."""
    return simhash.deduplicated(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 50 bytes that a document with a smaller id has, too."""
    return substrings.shortened(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out contaminated documents."""
    return contamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken.

    Columns of these names in the input are replaced.
    """
    made = {"doc_id", "size", "source_size", "target", "taken"}
    mixed, _ = mixing.mix(docs, WEIGHTS, keep=[c for c in docs.columns if c not in made])
    return mixed.where("taken > 0")


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_strings),
    ("benchmark_contamination", benchmark_passages),
    ("source_mix", source_mix),
]

#: Nearest neighbours, components and repeated strings are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs
