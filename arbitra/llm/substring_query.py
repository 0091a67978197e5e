"""op4: repeated strings of 50 bytes in all documents.  Its oracle is brute force, in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbitra.llm.registry import query
from arbitra.llm.substrings import without_repeats
from arbitra.llm.tables import read


@query("op4_repeated_substrings")
def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).drop("row", "kept")
