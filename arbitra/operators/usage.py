"""Call usage, costs, run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import top_per_key
from arbitra.functions.scoring import cost_usd
from arbitra.session import dimension


def price_table(spark, prices: Mapping[str, tuple[float, float]]) -> DataFrame:
    return dimension(spark, [(m, float(i), float(o)) for m, (i, o) in prices.items()], "model string, price_in double, price_out double")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call; models without a price take the default."""
    cost = cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"))
    return usage.join(prices, "model", "left").withColumn("cost_usd", cost).drop("price_in", "price_out")


def filter_context(usage: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """calls whose context map has all the given values."""
    out = usage
    for key, value in wanted.items():
        out = out.where(F.try_element_at("context", F.lit(key)) == value)
    return out


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals per model and overall (model null)."""
    return usage.rollup("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_ms"),
    )


def run_totals(items: DataFrame) -> DataFrame:
    """Totals per run over items without error."""
    ok = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    return items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(~ok).alias("errors"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("latency_ms").alias("latency_ms"),
    )


def run_latency(items: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Median and 95th percentile latency of each run, from item rows."""
    from arbitra.functions.ranking import quantiles

    q = quantiles(items.where(F.col("latency_ms").isNotNull()), ["run_id"], "latency_ms", [0.5, 0.95])
    return q.groupBy("run_id").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("p50_ms"),
        F.max(F.when(F.col("p") == 0.95, F.col("quantile"))).alias("p95_ms"),
    )


def runs_summary(runs: DataFrame) -> DataFrame:
    """Mean and deviation over runs per (method, policy); latency of on-demand runs only.

    ``runs`` has method, policy_id, run_id, mode, accuracy, auprc, p50_ms, p95_ms.
    """
    live = F.col("mode") == "ondemand"
    return runs.groupBy("method", "policy_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("auprc").alias("auprc_mean"),
        F.coalesce(F.stddev_pop("auprc"), F.lit(0.0)).alias("auprc_std"),
        F.avg(F.when(live, F.col("p50_ms"))).alias("latency_p50_ms"),
        F.avg(F.when(live, F.col("p95_ms"))).alias("latency_p95_ms"),
    )


def next_run(runs: DataFrame, quota: int = 5) -> DataFrame:
    """Next run number and mode per (method, policy): on demand first, then batch, then none."""
    return runs.groupBy("method", "policy_id").agg(
        (F.max("run_number") + 1).alias("next_run"),
        F.when(F.count(F.lit(1)) >= quota, F.lit(None).cast("string"))
        .when(F.count_if(F.col("mode") == "ondemand") == 0, F.lit("ondemand"))
        .otherwise(F.lit("batch"))
        .alias("next_mode"),
    )


def latest_runs(runs: DataFrame, n: int, **matching) -> DataFrame:
    """Newest n runs with the given column values."""
    out = runs
    for column, value in matching.items():
        out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def comparison(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Newest run per (method, policy) with its metrics."""
    newest = top_per_key(runs, ["method", "policy_id"], [F.desc("started_at"), F.desc("run_id")], 1)
    return newest.select("method", "policy_id", "run_id", *metrics)


def delete_matching(usage: DataFrame, wanted: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """U11, filter form: (calls that stay, one-row count of calls removed)."""
    gone = F.lit(True)
    for key, value in wanted.items():
        gone = gone & F.coalesce(F.try_element_at("context", F.lit(key)) == value, F.lit(False))
    return usage.where(~gone), usage.agg(F.count_if(gone).alias("removed"))


def chunked(requests: DataFrame, size: int = 40_000, order: str = "custom_id") -> DataFrame:
    """Chunk number within the model, in id order.

    A model may hold most requests, so positions come from running totals over ids rather than
    from one window per model.
    """
    from arbitra.functions.ranking import global_row_number

    placed = global_row_number(requests, [F.col("model"), F.col(order)], "_pos")
    start = placed.groupBy("model").agg(F.min("_pos").alias("_start"))
    return (
        placed.join(start, "model")
        .withColumn("chunk", F.floor((F.col("_pos") - F.col("_start")) / size))
        .drop("_pos", "_start")
    )
