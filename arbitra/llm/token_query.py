"""op10: tokens of every document.  Its oracle is the vocabulary's own library, in the tests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.registry import query
from arbitra.llm.tables import read
from arbitra.llm.tokens import over_limit, token_counts

LIMIT = 2048


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", over_limit(F.col("n_tokens"), LIMIT))
