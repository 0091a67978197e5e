"""Keyed Parquet tables: append versions, read the winning one.

A store is a folder of immutable batches.  Writing appends a batch; reading takes one row per
key.  Nothing is rewritten in place, so a lost executor or a repeated write does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.functions.ranking import newest


@dataclass(frozen=True)
class KeyedStore:
    """A table with a key; the newest (or the first) version of a row counts."""

    path: str
    keys: Sequence[str]
    version: str = "written_at"
    partition_by: Sequence[str] = ()
    first_wins: bool = False

    def append(self, df: DataFrame) -> None:
        writer = df.write.mode("append")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        order = F.col(self.version).asc() if self.first_wins else F.col(self.version).desc()
        return newest(spark.read.parquet(self.path), self.keys, [order])

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted rows whose key is not stored yet."""
        stored = wanted.sparkSession.read.parquet(self.path).select(*self.keys)
        return wanted.join(stored, list(self.keys), "left_anti")


def raw_judgments(path: str) -> KeyedStore:
    return KeyedStore(path, ("topic", "review_id", "model", "run"), "extracted_at", ("topic",))


def aggregated_judgments(path: str) -> KeyedStore:
    return KeyedStore(path, ("topic", "review_id"), "aggregated_at", ("topic",))


def verified_tags(path: str) -> KeyedStore:
    return KeyedStore(path, ("review_id", "text_hash", "prompt_version"), "created_at", first_wins=True)


def gate_scores(path: str) -> KeyedStore:
    return KeyedStore(path, ("gate_id", "review_id"), "scored_at", ("gate_id",))


def embeddings(path: str) -> KeyedStore:
    return KeyedStore(path, ("model", "text_hash"), "created_at", ("model",))


def retrievals(path: str) -> KeyedStore:
    return KeyedStore(path, ("sample_id", "n_reviews", "top_k"), "created_at")
