"""op12: documents packed by powers of two.  Its oracle is the vocabulary's own library, in the tests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.llm.packing import pieces, sequences
from arbitra.llm.registry import query
from arbitra.llm.tables import read


@query("op12_binary_packing")
def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digest = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return sequences(digest)
