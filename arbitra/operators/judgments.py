"""Judgement tables: upsert, quotas, weighted votes, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import newest

RAW_KEY = ["topic", "review_id", "model", "run"]


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Union of both, one row per key, first in the given order (newest first)."""
    return newest(existing.unionByName(incoming, allowMissingColumns=True), keys, order)


def latest_raw(raw: DataFrame) -> DataFrame:
    """Last write per (topic, review, model, run) wins."""
    return newest(raw, RAW_KEY, [F.desc("extracted_at"), F.desc("ord")])


def first_written(records: DataFrame) -> DataFrame:
    """First writer per (review, text, prompt version) wins."""
    return newest(records, ["review_id", "text_hash", "prompt_version"], [F.col("created_at")])


def model_weight(model: Column, weights: Mapping[str, int]) -> Column:
    out = None
    for name, w in weights.items():
        out = F.when(model == name, F.lit(w)) if out is None else out.when(model == name, F.lit(w))
    return out.otherwise(F.lit(1)) if out is not None else F.lit(1)


def vote(raw: DataFrame, schema: Sequence[str], weights: Mapping[str, int]) -> DataFrame:
    """Weighted majority per (topic, review, field), in long form.

    A missing field votes "none"; of equal weights the value voted first (smallest ``ord``)
    wins.  Relevance votes as the field ``is_relevant``.  Votes for the same value are added
    up before the shuffle.
    """
    ballots = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.coalesce(F.col("fields")[name], F.lit("none")).alias("value"),
            )
            for name in schema
        ],
        F.struct(
            F.lit("is_relevant").alias("field"),
            F.coalesce(F.col("is_relevant"), F.lit(False)).cast("string").alias("value"),
        ),
    )
    tally = (
        raw.select(
            "topic", "review_id", "ord", model_weight(F.col("model"), weights).alias("w"),
            F.explode(ballots).alias("b"),
        )
        .groupBy("topic", "review_id", F.col("b.field").alias("field"), F.col("b.value").alias("value"))
        .agg(F.sum("w").alias("w"), F.min("ord").alias("first"))
    )
    return tally.groupBy("topic", "review_id", "field").agg(
        F.min_by("value", F.struct(-F.col("w"), F.col("first"))).alias("value"),
        F.round(F.max("w") / F.sum("w"), 3).alias("confidence"),
    )


def assemble(votes: DataFrame) -> DataFrame:
    """Long votes as one row per review with field and confidence maps."""
    is_flag = F.col("field") == "is_relevant"
    entry = lambda value: F.struct(F.col("field").alias("key"), value.alias("value"))

    def collected(value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(~is_flag, entry(value)))))

    return votes.groupBy("topic", "review_id").agg(
        F.bool_or(is_flag & (F.col("value") == "true")).alias("is_relevant"),
        collected(F.col("value")).alias("fields"),
        collected(F.col("confidence")).alias("confidence"),
    )


def vote_declared(raw: DataFrame, schema: Mapping[str, Sequence[str]], weights: Mapping[str, int]) -> DataFrame:
    """A6-A8 in map form for fields with declared values: one shuffle, one row per review.

    Each legal value of each field (and "none") has its own weight sum and first position, so
    votes fold map-side into one numeric row per review and winners are read off that row.
    Reviews with a vote outside the declared values are found by a row filter and take the
    general path, ``vote``; with none of them that path reads nothing.
    """
    value = {f: F.coalesce(F.col("fields")[f], F.lit("none")).alias(f"v_{i}") for i, f in enumerate(schema)}
    slots = {f: list(dict.fromkeys([*legal, "none"])) for f, legal in schema.items()}
    flag = F.coalesce(F.col("is_relevant"), F.lit(False)).cast("string").alias("v_flag")
    ballots = raw.select(
        "topic", "review_id", "ord", model_weight(F.col("model"), weights).alias("w"), flag, *value.values()
    )
    columns = {f: (f"v_{i}", slots[f]) for i, f in enumerate(schema)} | {"is_relevant": ("v_flag", ["true", "false"])}
    strange = F.lit(False)
    for column, legal in columns.values():
        strange = strange | ~F.col(column).isin(legal)

    sums = []
    for column, legal in columns.values():
        for j, v in enumerate(legal):
            hit = F.col(column) == v
            sums += [F.sum(F.when(hit, F.col("w"))).alias(f"{column}_w{j}"), F.min(F.when(hit, F.col("ord"))).alias(f"{column}_o{j}")]
    wide = ballots.groupBy("topic", "review_id").agg(F.bool_or(strange).alias("strange"), *sums)

    def winner(name: str) -> Column:
        column, legal = columns[name]
        return F.least(
            *[
                F.when(
                    F.col(f"{column}_w{j}").isNotNull(),
                    F.struct((-F.col(f"{column}_w{j}")).alias("w"), F.col(f"{column}_o{j}").alias("o"), F.lit(v).alias("v")),
                )
                for j, v in enumerate(legal)
            ]
        ).alias(f"win_{column}")

    def total(name: str) -> Column:
        column, legal = columns[name]
        out = F.lit(0)
        for j in range(len(legal)):
            out = out + F.coalesce(F.col(f"{column}_w{j}"), F.lit(0))
        return out.alias(f"all_{column}")

    decided = wide.where(~F.col("strange")).select("topic", "review_id", *[winner(n) for n in columns], *[total(n) for n in schema])
    pick = {f: F.col(f"win_{columns[f][0]}") for f in columns}
    plain = decided.select(
        "topic", "review_id", (pick["is_relevant"]["v"] == "true").alias("is_relevant"),
        F.create_map(*[x for f in schema for x in (F.lit(f), pick[f]["v"])]).alias("fields"),
        F.create_map(
            *[x for f in schema for x in (F.lit(f), F.round(-pick[f]["w"] / F.col(f"all_{columns[f][0]}"), 3))]
        ).alias("confidence"),
    )
    odd = ballots.where(strange).select("topic", "review_id").distinct()
    rest = assemble(vote(raw.join(odd, ["topic", "review_id"], "left_semi"), list(schema), weights))
    return plain.unionByName(rest)


def first_metadata(raw: DataFrame, columns: Sequence[str] = ("date", "stars", "useful")) -> DataFrame:
    """Non-vote columns of the first raw row per review."""
    first = raw.groupBy("topic", "review_id").agg(F.min_by(F.struct(*columns), "ord").alias("m"))
    return first.select("topic", "review_id", "m.*")


def aggregate(
    raw: DataFrame, schema: Sequence[str] | Mapping[str, Sequence[str]], weights: Mapping[str, int]
) -> DataFrame:
    """A6-A8 in map form; a schema with declared values takes the one-shuffle path."""
    if isinstance(schema, Mapping):
        return vote_declared(raw, schema, weights)
    return assemble(vote(raw, schema, weights))


def required_runs(reviews: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """Each review with every (model, run) it should have; the quota is a literal list."""
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.lit(r).alias("run"))
                for m, n in quota.items()
                for r in range(1, n + 1)
            ]
        )
    )
    return reviews.withColumn("_q", wanted).select("*", "_q.model", "_q.run").drop("_q")


def missing_runs(reviews: DataFrame, raw: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """Required minus existing extractions.  ``reviews`` has (topic, review_id)."""
    return required_runs(reviews.select("topic", "review_id"), quota).join(
        raw.select(*RAW_KEY), RAW_KEY, "left_anti"
    )


def quota_complete(raw: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """Reviews with all required runs.

    Runs are deduplicated by a bit per required run, so there is one shuffle and a hot review
    is folded map-side.
    """
    slots = [(m, r) for m, n in quota.items() for r in range(1, n + 1)]
    seen = [
        F.max(F.when((F.col("model") == m) & (F.col("run") == r), 1).otherwise(0)) for m, r in slots
    ]
    done = seen[0]
    for s in seen[1:]:
        done = done + s
    return (
        raw.groupBy("topic", "review_id")
        .agg(done.alias("runs_done"))
        .where(F.col("runs_done") == len(slots))
        .select("topic", "review_id")
    )


def vote_complete(raw: DataFrame, schema, weights, quota) -> DataFrame:
    """A32 + A6: votes of the reviews whose quota is complete."""
    ready = raw.join(quota_complete(raw, quota), ["topic", "review_id"], "left_semi")
    return vote(ready, schema, weights)


def vote_unaggregated(raw: DataFrame, aggregated: DataFrame, schema, weights) -> DataFrame:
    """Votes of reviews that have raw rows but no aggregated row; no quota check."""
    todo = raw.join(aggregated.select("topic", "review_id"), ["topic", "review_id"], "left_anti")
    return vote(todo, schema, weights)


def raw_per_model(raw: DataFrame) -> DataFrame:
    """Raw rows and distinct reviews per (topic, model), and the runs seen.

    The distinct review count goes through (topic, model, review) first; run numbers are few.
    """
    per_review = raw.groupBy("topic", "model", "review_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("run").alias("lo"), F.max("run").alias("hi")
    )
    return per_review.groupBy("topic", "model").agg(
        F.sum("n").alias("raw_rows"),
        F.count(F.lit(1)).alias("reviews"),
        F.min("lo").alias("first_run"),
        F.max("hi").alias("last_run"),
    )


def completeness(reviews: DataFrame, raw: DataFrame, quota: Mapping[str, int]) -> DataFrame:
    """Expected, present and missing extractions per (topic, model)."""
    wanted = required_runs(reviews.select("topic", "review_id"), quota)
    have = raw.groupBy(*RAW_KEY).agg(F.lit(1).alias("have"))
    return (
        wanted.join(have, RAW_KEY, "left")
        .groupBy("topic", "model")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count("have").alias("cached"),
            F.count_if(F.col("have").isNull()).alias("missing"),
        )
    )


def merge_overrides(overrides: DataFrame) -> DataFrame:
    """One override per (topic, review), manual (smaller priority) first."""
    return newest(overrides, ["topic", "review_id"], [F.col("priority")])


def apply_overrides(judgments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrected fields replace the voted ones; the row is marked with flag and reason."""
    merged = judgments.join(merge_overrides(overrides).drop("priority"), ["topic", "review_id"], "left")
    kept = F.map_filter("fields", lambda k, _: ~F.array_contains(F.map_keys("corrected"), k))
    return merged.select(
        *[c for c in judgments.columns if c != "fields"],
        F.when(F.col("corrected").isNull(), F.col("fields"))
        .otherwise(F.map_concat(kept, "corrected"))
        .alias("fields"),
        F.col("corrected").isNotNull().alias("override_applied"),
        F.col("reason").alias("override_reason"),
    )


def delete_topic(table: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row count of rows removed)."""
    gone = F.col("topic") == topic
    return table.where(~gone), table.agg(F.count_if(gone).alias("removed"))


def schema_current(metadata: DataFrame, topic: str, term_hash: str) -> DataFrame:
    """Does the stored hash equal the current one?  No stored row means yes."""
    stored = metadata.where(F.col("topic") == topic)
    return stored.agg(
        F.coalesce(F.bool_and(F.col("term_hash") == term_hash), F.lit(True)).alias("current")
    )
