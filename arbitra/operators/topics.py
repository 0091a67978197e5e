"""Topic mining: keyword hits, weighted pattern scores, per-business roll-ups.

A topic is a mapping ``{"topic", "keywords": [...], "critical": [(pattern, weight)], "high":
[(pattern, weight)]}``.  All topics are scored in one scan of the reviews.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import top_per_key
from arbitra.functions.text import any_of, first_match

# Category fragments of an eating place, cuisines that count as high risk.
PLACE_CATEGORIES = ["Restaurant", "Food", "Cafe", "Bakery", "Bar"]
HIGH_RISK_CUISINES = ["Thai", "Vietnamese", "Chinese", "Asian", "Asian Fusion"]

# Peak scores from which a business is listed, and the low-star boost.
CRITICAL_AT, HIGH_BY_CRITICAL_AT, HIGH_AT = 4.0, 2.0, 3.0
LOW_STARS, LOW_STAR_BOOST = 2, 1.5


def category_contains(categories: Column, fragments: Sequence[str] = PLACE_CATEGORIES) -> Column:
    """some fragment occurs in the category text (case-sensitive)."""
    return any_of(F.coalesce(categories, F.lit("")), fragments)


def valid_businesses(businesses: DataFrame, min_reviews: int = 20) -> DataFrame:
    """eating places with enough reviews."""
    return businesses.where(
        category_contains(F.col("categories"))
        & (F.coalesce("review_count", F.lit(0)) >= min_reviews)
    )


def category_token(categories: Column, wanted: Sequence[str]) -> Column:
    """some comma-separated category equals a wanted one."""
    parts = F.transform(F.split(F.coalesce(categories, F.lit("")), ","), lambda c: F.trim(c))
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in wanted]))


def high_risk_cuisine(categories: Column, cuisines: Sequence[str] = HIGH_RISK_CUISINES) -> Column:
    """case-insensitive; no categories means no."""
    return any_of(F.lower(F.coalesce(categories, F.lit(""))), [c.lower() for c in cuisines])


def capped_per_business(reviews: DataFrame, cap: int = 500, position: str = "pos") -> DataFrame:
    """The first reviews of each business in input order."""
    return top_per_key(reviews, ["business_id"], [F.col(position)], cap, "_rn").drop("_rn")


def start_of(column: str, length: int | None) -> Column:
    """The whole text, or with a length its beginning."""
    return F.col(column) if length is None else F.substring(column, 1, length)


def keyword_hits(
    reviews: DataFrame, patterns: Mapping[str, Sequence[str]], snippet_length: int | None = None
) -> DataFrame:
    """One row per (topic, review) whose text matches the topic's alternation."""
    found = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("topic"), first_match(F.col("text"), p).alias("match"))
                for t, p in patterns.items()
            ]
        )
    )
    return (
        reviews.withColumn("_hit", found)
        .select("*", "_hit.*")
        .drop("_hit")
        .where(F.col("match").isNotNull())
        .withColumn("snippet", start_of("text", snippet_length))
    )


def hits_per_business(hits: DataFrame, min_hits: int = 1) -> DataFrame:
    """A1: hit counts per (topic, business) above a minimum."""
    return (
        hits.groupBy("topic", "business_id")
        .agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= min_hits)
    )


def top_businesses(hits: DataFrame, min_hits: int, n: int) -> DataFrame:
    """Most hits first per topic."""
    counted = hits_per_business(hits, min_hits)
    return top_per_key(counted, ["topic"], [F.desc("hits"), F.col("business_id")], n, "rank")


def first_matches(hits: DataFrame, n: int = 5, position: str = "pos") -> DataFrame:
    """Matched texts of the first n hits per (topic, business), in input order."""
    few = top_per_key(hits, ["topic", "business_id"], [F.col(position)], n)
    return few.groupBy("topic", "business_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rn", "match"))), lambda m: m["match"]
        ).alias("sample_matches")
    )


def ranked_places(hits: DataFrame, businesses: DataFrame, min_hits: int, n: int) -> DataFrame:
    """Best businesses per topic with their data; unknown or other places drop out."""
    counted = hits_per_business(hits, min_hits)
    places = businesses.where(category_contains(F.col("categories")))
    joined = counted.join(places, "business_id")
    return top_per_key(joined, ["topic"], [F.desc("hits"), F.col("business_id")], n, "rank")


def pattern_flags(text: Column, patterns: Sequence[tuple[str, float]]) -> Column:
    """array<boolean>, does each pattern occur?"""
    return F.array(*[text.rlike("(?i)" + p) for p, _ in patterns])


def flag_score(flags: Column, patterns: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of the patterns that occur; each counts once."""
    total = F.lit(0.0)
    for i, (_, weight) in enumerate(patterns):
        total = total + F.when(flags[i], F.lit(float(weight))).otherwise(F.lit(0.0))
    return total


def flag_matches(flags: Column, patterns: Sequence[tuple[str, float]]) -> Column:
    """The patterns that occur, in list order."""
    return F.array_compact(F.array(*[F.when(flags[i], F.lit(p)) for i, (p, _) in enumerate(patterns)]))


def score_reviews(
    reviews: DataFrame,
    topics: Sequence[Mapping],
    custom_scorer: Callable[[DataFrame, Mapping], Column] | None = None,
) -> DataFrame:
    """F4 + X2: one row per (topic, review) with a positive score.

    The literal prefilter comes first and is part of the meaning: a review without any of a
    topic's keywords scores nothing even where a pattern would match.  Low-star reviews weigh
    their critical patterns more.  ``custom_scorer`` (UD1) may replace the critical score.

    Every pattern is tried once per review that passes the prefilter; scores and matches are
    read from the flags.
    """
    low = F.lower("text")
    flags = []
    for i, t in enumerate(topics):
        gate = any_of(low, t["keywords"]) if t.get("keywords") else F.lit(True)
        both = pattern_flags(F.col("text"), [*t["critical"], *t["high"]])
        flags.append(F.when(gate, both).alias(f"_t{i}"))
    flagged = reviews.select("*", *flags)
    boost = F.when(F.col("stars") <= LOW_STARS, F.lit(LOW_STAR_BOOST)).otherwise(F.lit(1.0))

    def scored(i: int, t: Mapping) -> Column:
        own, n = F.col(f"_t{i}"), len(t["critical"])
        critical, high = F.slice(own, 1, n), F.slice(own, n + 1, len(t["high"]))
        score = custom_scorer(reviews, t) if custom_scorer else flag_score(critical, t["critical"]) * boost
        return F.when(
            own.isNotNull(),
            F.struct(
                F.lit(t["topic"]).alias("topic"),
                score.alias("critical_score"),
                flag_score(high, t["high"]).alias("high_score"),
                flag_matches(critical, t["critical"]).alias("critical_matches"),
                flag_matches(high, t["high"]).alias("high_matches"),
            ),
        )

    per_topic = F.explode(F.array_compact(F.array(*[scored(i, t) for i, t in enumerate(topics)])))
    return (
        flagged.select(*reviews.columns, per_topic.alias("_s"))
        .select(*reviews.columns, "_s.*")
        .where((F.col("critical_score") > 0) | (F.col("high_score") > 0))
    )


def scan_counters(reviews: DataFrame, topics: Sequence[Mapping]) -> DataFrame:
    """A3: reviews scanned and passed by the prefilter, per topic, in one pass."""
    low = F.lower("text")
    gates = [any_of(low, t["keywords"]) if t.get("keywords") else F.lit(True) for t in topics]
    totals = reviews.agg(
        F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(g).alias(f"_p{i}") for i, g in enumerate(gates)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(t["topic"]).alias("topic"), F.col(f"_p{i}").alias("passed"))
                for i, t in enumerate(topics)
            ]
        )
    )
    return totals.select("scanned", rows.alias("_r")).select(
        "_r.topic",
        "scanned",
        "_r.passed",
        F.try_divide(F.col("_r.passed"), F.col("scanned")).alias("pass_rate"),
    )


def severity_of(max_critical: Column, max_high: Column) -> Column:
    """A2: which list a business belongs to, null for neither."""
    return F.when(max_critical >= CRITICAL_AT, F.lit("critical")).when(
        (max_critical >= HIGH_BY_CRITICAL_AT) | (max_high >= HIGH_AT), F.lit("high")
    )


def business_scores(scored: DataFrame) -> DataFrame:
    """A2: peak and total scores per (topic, business); unlisted businesses drop out."""
    c, h = F.col("critical_score"), F.col("high_score")
    rolled = scored.groupBy("topic", "business_id").agg(
        F.max(c).alias("max_critical_score"),
        F.max(h).alias("max_high_score"),
        F.sum(c).alias("total_critical_score"),
        F.sum(h).alias("total_high_score"),
        F.count(F.lit(1)).alias("topic_reviews"),
        F.count_if(c > 0).alias("critical_review_count"),
        F.count_if(h > 0).alias("high_review_count"),
    )
    return rolled.withColumn(
        "severity", severity_of(F.col("max_critical_score"), F.col("max_high_score"))
    ).where(F.col("severity").isNotNull())


def severity_lists(scores: DataFrame) -> DataFrame:
    """Critical list by critical scores, high list by high scores, both falling."""
    crit = F.col("severity") == "critical"
    return scores.orderBy(
        "topic",
        "severity",
        F.desc(F.when(crit, F.col("max_critical_score")).otherwise(F.col("max_high_score"))),
        F.desc(F.when(crit, F.col("total_critical_score")).otherwise(F.col("total_high_score"))),
        "business_id",
    )


def sample_reviews(
    scored: DataFrame, kind: str, n: int = 5, position: str = "pos", snippet_length: int | None = None
) -> DataFrame:
    """Best n reviews per (topic, business) by ``critical`` or ``high`` score."""
    score = F.col(f"{kind}_score")
    best = top_per_key(
        scored.where(score > 0), ["topic", "business_id"], [score.desc(), F.col(position)], n
    )
    return best.select(
        "topic", "business_id", "rn", "review_id", score.alias("score"),
        F.col(f"{kind}_matches").alias("matches"), start_of("text", snippet_length).alias("snippet"),
    )


def with_business(scores: DataFrame, businesses: DataFrame) -> DataFrame:
    """Business data joined on, name ``Unknown`` where there is none."""
    info = businesses.select(
        "business_id", "name", "city", "state", "stars", "review_count", "categories"
    )
    return scores.join(info, "business_id", "left").withColumn(
        "name", F.coalesce("name", F.lit("Unknown"))
    )
