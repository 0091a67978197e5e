"""op1: fingerprint and component of every document.  Its oracle is brute force, in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.registry import query
from arbitra.llm.simhash import hex_print, near_duplicates
from arbitra.llm.tables import read


@query("op1_simhash_anchors")
def op1_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")
