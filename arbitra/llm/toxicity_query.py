"""op5: toxicity of every document.  Tested by held-out accuracy and against plain cosine search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.registry import query
from arbitra.llm.tables import read
from arbitra.llm.toxicity import held_out, learn, toxicity


@query("op5_toxicity_neighbours")
def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity(docs, learn(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
