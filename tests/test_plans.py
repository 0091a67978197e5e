"""Shapes of physical plans that the queries rely on at scale."""

import pytest

import __spark_entry__ as entry
from arbitra.functions.ranking import rank_normalize, top_per_key
from pyspark.sql import functions as F

QUERIES = entry.queries()
SAMPLE = [
    "k_recent_reviews", "topic_scores", "weighted_vote", "missing_extractions", "apply_overrides", "all_policies",
    "formula_program", "macro_f1", "evidence_by_entity", "bm25_scores", "bm25_postings", "cosine_topk", "hybrid_retrieval",
    "rank_normalize", "quantile_bins", "over_representation", "usage_by_model", "response_ingest",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_nested_loops(name, spark, sf):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text


def test_top_per_key_cuts_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    text = plan(top_per_key(docs, ["source"], [F.col("doc_id")], 3))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(QUERIES["weighted_vote"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_filter_reaches_the_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").select("doc_id")
    assert "EqualTo(toxic,1)" in plan(docs)


def test_verdicts_of_all_policies_share_one_aggregation(spark, sf):
    one = plan(QUERIES["count_rule_verdict"](spark, sf)).count("Exchange")
    five = plan(QUERIES["all_policies"](spark, sf)).count("Exchange")
    assert one == five


def test_rank_buckets_reuse_their_exchange(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 97).cast("double").alias("v"))
    out = rank_normalize(df, [], "v", "r")
    out.collect()
    assert "ReusedExchange" in plan(out) or "ResultQueryStage" in plan(out)


@pytest.mark.parametrize("name", ["scored_pairs", "macro_f1", "ordinal_auprc", "rich_filter", "formula_program"])
def test_generated_code_compiles(name, spark, sf):
    """Without the fallback a method over 64 KB is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_average_precision_of_all_levels_takes_five_exchanges(spark, sf):
    assert plan(QUERIES["ordinal_auprc"](spark, sf)).count("Exchange") <= 5
