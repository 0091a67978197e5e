"""Data-quality checks that report violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.text import quote_in_markup


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def illegal_values(judgments: DataFrame, legal: DataFrame) -> DataFrame:
    """(review_id, field, value) whose field or value is not declared.

    ``legal`` has (field, value).  Undeclared fields and undeclared values are told apart.
    """
    used = judgments.select("review_id", F.explode("fields").alias("field", "value"))
    known = legal.select("field").distinct().withColumn("known_field", F.lit(True))
    pairs = legal.select("field", "value").withColumn("known_value", F.lit(True))
    joined = used.join(known, "field", "left").join(pairs, ["field", "value"], "left")
    return joined.where(F.col("known_value").isNull()).select(
        "review_id", "field", "value",
        F.when(F.col("known_field").isNull(), "unknown field").otherwise("unknown value").alias("violation"),
    )


def clause_violations(clauses: DataFrame, legal: DataFrame) -> DataFrame:
    """broken clauses; ``clauses`` has (clause_id, min_count, logic, conditions)."""
    shape = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("min_count") < 1, F.lit(True)), F.lit("min_count must be >= 1")),
            F.when(~F.coalesce(F.col("logic").isin("ANY", "ALL"), F.lit(False)), F.lit("logic must be ANY or ALL")),
            F.when(F.size(F.coalesce("conditions", F.array().cast(clauses.schema["conditions"].dataType))) < 1,
                   F.lit("conditions must not be empty")),
        )
    )
    broken = clauses.select("clause_id", F.explode(shape).alias("violation"))
    used = clauses.select("clause_id", F.explode("conditions").alias("c")).select(
        "clause_id", F.col("c.field_id").alias("field"), F.explode_outer("c.values").alias("value")
    )
    no_field = used.join(legal.select("field").distinct(), "field", "left_anti")
    bad = used.join(no_field.select("clause_id", "field").distinct(), ["clause_id", "field"], "left_anti")
    no_value = bad.where(F.col("value").isNotNull()).join(legal.select("field", "value"), ["field", "value"], "left_anti")
    empty = bad.where(F.col("value").isNull())
    return (
        broken.unionByName(no_field.select("clause_id", F.concat(F.lit("unknown field "), F.coalesce("field", F.lit(""))).alias("violation")).distinct())
        .unionByName(no_value.select("clause_id", F.concat_ws(" ", F.lit("unknown value"), "field", "value").alias("violation")))
        .unionByName(empty.select("clause_id", F.concat_ws(" ", F.lit("no values for"), "field").alias("violation")))
    )


def rule_violations(specs: DataFrame) -> DataFrame:
    """label lists and rules that contradict each other.

    ``specs`` has (spec_id, labels, default_label, order, rules array<struct<label, default,
    connective>>).
    """
    labels, order, rules = F.col("labels"), F.col("order"), F.col("rules")
    rule_labels = F.transform(rules, lambda r: r["label"])
    defaults = F.filter(rules, lambda r: F.coalesce(r["default"], F.lit(False)))
    others = F.filter(rules, lambda r: ~F.coalesce(r["default"], F.lit(False)))
    checks: list[tuple[Column, str]] = [
        (F.size(labels) < 1, "labels is empty"),
        (F.size(labels) != F.size(F.array_distinct(labels)), "labels repeat"),
        (~F.array_contains(labels, F.col("default_label")), "default label is not a label"),
        (~F.sort_array(order).eqNullSafe(F.sort_array(labels)), "order is not a permutation of the labels"),
        (F.element_at(order, -1) != F.col("default_label"), "order does not end with the default label"),
        (F.size(defaults) != 1, "there must be one default rule"),
        (F.exists(others, lambda r: ~F.coalesce(r["connective"].isin("ANY", "ALL"), F.lit(False))), "connective must be ANY or ALL"),
        (~F.sort_array(F.array_distinct(rule_labels)).eqNullSafe(F.sort_array(F.array_distinct(labels))), "rules must cover all labels"),
        (F.size(rule_labels) != F.size(F.array_distinct(rule_labels)), "a label has two rules"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))
    return specs.select("spec_id", F.explode(found).alias("violation"))


def quotes_missing(quotes: DataFrame) -> DataFrame:
    """quotes that the text next to them does not hold; (id, quote, text)."""
    return quotes.where(~F.coalesce(quote_in_markup(F.col("quote"), F.col("text")), F.lit(False))).select("id", "quote")
