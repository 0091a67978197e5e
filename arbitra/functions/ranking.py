"""Ranks, quantiles and running totals that no single task has to hold.

A window without a partition key sends the whole table to one task, and an exact percentile
aggregate keeps all distinct values of a group in memory.  The helpers here split the ordered
domain into buckets (by approximate quantiles per key, or the range partitions of a whole table),
total the buckets, and add the totals of the earlier buckets to the running totals inside each
bucket.  The approximation only decides where buckets end; the results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.session import materialize

DEFAULT_BUCKETS = 64


# Spark cuts rows per key before the shuffle only for limits below this default of
# spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT_THRESHOLD = 1000
SALTS = 64


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn"
) -> DataFrame:
    """First n rows per key.  Spark cuts each map task to n rows before the shuffle, so a key
    that holds a third of all rows still sends only n rows per task.

    Larger n go through salted parts of each key first; a part keeps its own first n rows, so
    nothing that belongs to the result is lost.
    """
    if n >= GROUP_LIMIT_THRESHOLD:
        hashable = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        kept = salted.withColumn("_part_rank", F.row_number().over(part)).where(F.col("_part_rank") <= n)
        df = kept.drop("_salt", "_part_rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_per_key(df, keys, order, 1, "_rn").drop("_rn")


def prefix_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Per distinct (keys, value): each sum, ``before_<sum>`` over smaller values of the same
    keys, and ``total_<sum>`` over all of them.

    Equal values are first added up map-side, so a value held by a third of all rows costs one
    row per task.
    """
    keys = list(keys)
    if not keys:
        return _totals_of_table(df, value, sums)
    per_value = df.groupBy(*keys, value).agg(*[e.alias(n) for n, e in sums.items()])
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = per_value.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(value, steps, 1000)).alias("_bounds")
    )
    placed = per_value.join(bounds, keys).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(value)))
    ).drop("_bounds")

    by_bucket = placed.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    in_key = Window.partitionBy(*keys)
    earlier = in_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most `buckets` rows per key take part in these two windows.
    offsets = by_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(n).over(in_key).alias(f"total_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        F.col(value),
        *sums,
        *[
            (F.col(f"_off_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"before_{n}")
            for n in sums
        ],
        *[f"total_{n}" for n in sums],
    )


def _totals_of_table(df: DataFrame, value: str, sums: Mapping[str, Column]) -> DataFrame:
    """``prefix_totals`` over the whole table.

    The distinct values are range-partitioned and written once; a partition is a bucket, so their
    number follows the size of the shuffle.  The sums of the earlier partitions are one map, with
    an entry per partition, that is read as a scalar subquery.  A null value comes first, like
    any other value.
    """
    per_value = df.groupBy(value).agg(*[e.alias(n) for n, e in sums.items()])
    placed = materialize(
        per_value.repartitionByRange(F.asc_nulls_first(value)).withColumn("_bucket", F.spark_partition_id())
    )
    by_bucket = placed.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in sums])
    listed = by_bucket.agg(F.collect_list(F.struct("_bucket", *sums)).alias("b"))
    earlier = lambda b, x: F.filter("b", lambda e: e["_bucket"] < b["_bucket"])[x]
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    entry = lambda b: F.struct(
        b["_bucket"], F.struct(*[total(earlier(b, n)).alias(f"before_{n}") for n in sums], *[total(F.col("b")[n]).alias(f"total_{n}") for n in sums])
    )
    offsets = listed.select(F.map_from_entries(F.transform("b", entry)).alias("o")).scalar()
    inside = Window.partitionBy("_bucket").orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums]
    ).withColumn("_o", offsets[F.col("_bucket")])
    return running.select(
        value, *sums,
        *[(F.col("_o")[f"before_{n}"] + F.col(f"_in_{n}")).alias(f"before_{n}") for n in sums],
        *[F.col("_o")[f"total_{n}"].alias(f"total_{n}") for n in sums],
    )


def rank_normalize(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Tie-averaged rank scaled to [0, 1]; 0.5 everywhere on an all-equal column.

    Rows with a null value or key stay and have no rank.
    """
    table = prefix_totals(df.where(F.col(value).isNotNull()), keys, value, {"_n": F.count(F.lit(1))})
    ranks = table.select(
        *keys,
        value,
        (
            (F.col("before__n") + (F.col("_n") - 1) / 2)
            / F.greatest(F.col("total__n") - 1, F.lit(1))
        ).alias(out),
    )
    return df.join(ranks, [*keys, value], "left")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per (keys, p).

    With ``weight`` a row stands for so many rows with its value.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    table = prefix_totals(df.where(F.col(value).isNotNull()), keys, value, {"_n": n})
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    last = F.col("total__n") - 1
    # 0-based positions below and above p * (n - 1); keep the values that sit on them.
    spread = table.withColumn("p", wanted).withColumn("_at", F.col("p") * last)
    on = lambda pos: (pos >= F.col("before__n")) & (pos < F.col("before__n") + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    near = spread.where(on(low) | on(high))
    return near.groupBy(*keys, "p").agg(
        (
            F.max(F.when(on(low), F.col(value)))
            + (F.max(F.when(on(high), F.col(value))) - F.max(F.when(on(low), F.col(value))))
            * F.max(F.col("_at") - low)
        ).alias("quantile")
    )


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int, weight: str | None = None) -> DataFrame:
    """Inner bin edges per key as one sorted array (bins - 1 values)."""
    inner = [i / bins for i in range(1, bins)]
    found = quantiles(df, keys, value, inner, weight)
    return found.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "quantile"))), lambda e: e["quantile"]).alias(
            "edges"
        )
    )


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Number of inner edges below the value; null for a null value or key."""
    if bins <= 1:
        return df.withColumn(out, F.lit(0))
    edges = quantile_edges(df, keys, value, bins)
    below = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return df.join(edges, list(keys), "left" if keys else "inner").withColumn(
        out, F.when(F.col(value).isNotNull() & F.col("edges").isNotNull(), below)
    ).drop("edges")


def global_row_number(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """1-based position in a total order, without a single-task window.

    The range-partitioned sort is materialised in the shared folder, so that partition numbers
    stay what they were; then each partition adds the sizes of the ones before it.
    """
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, pos = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, pos + F.col("_offset") + 1)
        .drop("_id", "_part", "_offset")
    )


def number_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based position of each row inside its key, for keys of any size.

    Rows are numbered over the whole table in the order of keys and then of ``order``; a row's
    position in its key is its number less that of the key's first row.  The first numbers fold
    map-side, and a join with a hot key is one that Spark splits; no window holds a key.  A null
    key is a key like any other.
    """
    numbered = global_row_number(df, [*[F.asc_nulls_first(k) for k in keys], *order], "_g")
    first = numbered.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min("_g").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = numbered.join(first, same)
    return joined.withColumn(out, F.col("_g") - F.col("_first") + 1).drop("_g", "_first", *[f"_of_{k}" for k in keys])
