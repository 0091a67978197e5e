"""The K most recent reviews of selected businesses, flat and nested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import top_per_key

def restrict(df: DataFrame, ids: DataFrame, key: str = "business_id") -> DataFrame:
    """Rows whose key is in the id table.  Spark broadcasts the ids only below its own
    size threshold, else both sides are shuffled."""
    return df.join(ids.select(key), key, "left_semi")


def recent_reviews(reviews: DataFrame, k: int, position: str = "pos") -> DataFrame:
    """Newest k per business; equal dates keep input order, a missing date is oldest."""
    order = [F.coalesce("date", F.lit("")).desc(), F.col(position)]
    return top_per_key(reviews, ["business_id"], order, k)


def k_scales(reviews: DataFrame, scales: Sequence[int], position: str = "pos") -> DataFrame:
    """S7 working form: one ranking for the largest K, each review repeated for the K it is in."""
    ranked = recent_reviews(reviews, max(scales), position)
    inside = F.filter(F.array(*[F.lit(k) for k in scales]), lambda k: F.col("rn") <= k)
    return ranked.withColumn("k", F.explode(inside))


def with_user(reviews: DataFrame, users: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The user's fields (all unless named) as a struct, null for an unknown user."""
    known = [c for c in (fields or users.columns) if c != "user_id"]
    nested = users.select("user_id", F.struct(*known).alias("user"))
    return reviews.join(nested, "user_id", "left")


def nested_datasets(
    businesses: DataFrame, reviews: DataFrame, scales: Sequence[int], position: str = "pos"
) -> DataFrame:
    """One record per (k, business) with its reviews newest first.

    A business without reviews keeps an empty list; a review without business drops out.  Each
    list holds at most K reviews.
    """
    kept = k_scales(reviews, scales, position)
    columns = [c for c in kept.columns if c not in ("k", "rn")]
    lists = kept.groupBy("k", "business_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rn", F.struct(*columns).alias("review")))),
            lambda e: e["review"],
        ).alias("reviews")
    )
    per_k = businesses.select(
        "business_id",
        F.struct(*businesses.columns).alias("business"),
        F.explode(F.array(*[F.lit(k) for k in scales])).alias("k"),
    )
    joined = per_k.join(lists, ["k", "business_id"], "left")
    empty = F.array().cast(lists.schema["reviews"].dataType)
    return joined.withColumn("reviews", F.coalesce("reviews", empty)).withColumn(
        "review_count_actual", F.size("reviews")
    )


def review_pool(nested: DataFrame) -> DataFrame:
    """Nested records back to rows; a review without id is named after its place."""
    flat = nested.select("k", "business_id", F.posexplode("reviews").alias("position", "r"))
    rid = F.coalesce(
        F.nullif(F.col("r.review_id"), F.lit("")),
        F.concat(F.col("business_id"), F.lit("::"), F.col("position").cast("string")),
    )
    return flat.select(
        "k", "business_id", "position", rid.alias("review_id"), "r.text", "r.date", "r.stars",
        F.sha1(F.coalesce(F.col("r.text"), F.lit(""))).alias("text_hash"),
    )


def rendered_context(nested: DataFrame) -> DataFrame:
    """reviews as indexed text blocks, one string per record."""
    def block(r, i):
        head = F.format_string(
            "REVIEW_%d [id=%s, stars=%s, date=%s]:\n",
            i, F.coalesce(r["review_id"], F.concat(F.lit("R"), i.cast("string"))),
            F.coalesce(r["stars"].cast("string"), F.lit("?")),
            F.coalesce(r["date"], F.lit("unknown")),
        )
        return F.concat(head, F.trim(F.coalesce(r["text"], F.lit(""))))

    # Fixed value: the separator starts the text and stands between blocks.
    body = F.array_join(F.transform("reviews", block), "\n\n")
    return nested.select(
        "k", "business_id", F.concat(F.lit("\n\n" + "=" * 40), body).alias("context")
    )


def path_value(record: str, path: str, limit: int | None = None):
    """value at a dotted path such as ``reviews.0.text`` of a JSON column.

    With a limit, longer objects and arrays are cut there and say so.
    """
    parts = [p for p in path.replace("[", ".").replace("]", ".").split(".") if p]
    json_path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in parts)
    value = F.get_json_object(record, json_path)
    missing = F.lit(f"Error: path '{path}' not found")
    if limit is None:
        return F.when(value.isNull(), missing).otherwise(value)
    cut = F.concat(
        F.substring(value, 1, limit), F.lit("\n... (truncated, use more specific path)")
    )
    return (
        F.when(value.isNull(), missing)
        .when(value.rlike(r"^[\[{]") & (F.length(value) > limit), cut)
        .otherwise(value)
    )


def keyword_positions(reviews_column: str, keyword: str, limit: int | None = None):
    """0-based positions of the reviews (with a limit, the first) whose text holds the keyword."""
    hit = F.transform(
        reviews_column,
        lambda r, i: F.when(F.contains(F.lower(r["text"]), F.lit(keyword.lower())), i),
    )
    found = F.array_compact(hit)
    return found if limit is None else F.slice(found, 1, limit)
