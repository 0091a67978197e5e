"""Coverage and bias analyses over topic hits and businesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_coverage(hits: DataFrame) -> DataFrame:
    """Businesses per number of covered topics, with share."""
    per_business = hits.groupBy("business_id").agg(F.count_distinct("topic").alias("topics"))
    counted = per_business.groupBy("topics").agg(F.count(F.lit(1)).alias("businesses"))
    total = counted.agg(F.sum("businesses")).scalar()
    return counted.withColumn("share", F.col("businesses") / total)


def group_overlap(hits: DataFrame) -> DataFrame:
    """Businesses in all three, at least two, and any topic of each group."""
    per_group = hits.groupBy("group", "business_id").agg(F.count_distinct("topic").alias("n"))
    return per_group.groupBy("group").agg(
        F.count_if(F.col("n") >= 3).alias("all_three"),
        F.count_if(F.col("n") >= 2).alias("two_or_more"),
        F.count(F.lit(1)).alias("any_topic"),
    )


def coverage_correlation(businesses: DataFrame) -> DataFrame:
    """Correlation of review count and covered topics over the businesses that have both.

    Where one of the two does not vary it is undefined, NaN; without such businesses it is null.
    """
    x, y = (F.col(c).cast("double") for c in ("review_count", "coverage"))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sums = businesses.agg(
        F.regr_count(y, x).alias("pairs"), F.regr_sxy(y, x).alias("sxy"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        ((F.min(x) < F.max(x)) & (F.min(y) < F.max(y))).alias("varied"), F.count(F.lit(1)).alias("n"),
    )
    # corr divides before any condition is looked at, and two equal values may differ by rounding.
    r = F.try_divide(F.when(F.col("varied"), F.col("sxy")), F.sqrt("sxx") * F.sqrt("syy"))
    return sums.select(F.when(F.col("pairs") > 0, F.coalesce(r, F.lit(float("nan")))).alias("correlation"), "n")


def coverage_by_volume(businesses: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Mean coverage per review-count bucket; bucket i starts at edges[i]."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + F.when(F.col("review_count") >= e, 1).otherwise(0)
    return businesses.groupBy(bucket.alias("bucket")).agg(
        F.avg("coverage").alias("avg_coverage"), F.count(F.lit(1)).alias("businesses")
    )


def over_representation(selected: DataFrame, everyone: DataFrame, category: str) -> DataFrame:
    """Share of a category among the selected over its share among all."""
    def share(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.count(F.lit(1))).scalar()
        return df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).select(
            category, (F.col("n") / total).alias(name)
        )

    both = share(everyone, "share_all").join(share(selected, "share_selected"), category, "left")
    return both.fillna(0.0, ["share_selected"]).withColumn("ratio", F.col("share_selected") / F.col("share_all"))


def category_tokens(businesses: DataFrame) -> DataFrame:
    """One row per (business, category)."""
    return businesses.withColumn(
        "category", F.explode(F.transform(F.split("categories", ","), lambda c: F.trim(c)))
    )


def hits_per_review(businesses: DataFrame, n: int) -> DataFrame:
    """The n highest and n lowest hit rates."""
    rate = businesses.withColumn("rate", F.try_divide("hits", "review_count"))
    top = rate.orderBy(F.desc("rate"), "business_id").limit(n).withColumn("end", F.lit("top"))
    low = rate.orderBy("rate", "business_id").limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(low).select("end", "business_id", "hits", "review_count", "rate")


def quadrants(businesses: DataFrame, stars_at: float, volume_at: int) -> DataFrame:
    """Businesses per (stars, volume) quadrant with both margins."""
    def side(c: Column, at, high: str, low: str) -> Column:
        return F.when(c >= at, F.lit(high)).otherwise(F.lit(low))

    return businesses.cube(
        side(F.col("stars"), stars_at, "high", "low").alias("stars_side"),
        side(F.col("review_count"), volume_at, "many", "few").alias("volume_side"),
    ).agg(F.count(F.lit(1)).alias("businesses"))
