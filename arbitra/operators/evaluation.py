"""Predicted verdicts and their evidence measured against truth.

Long tables: ``predictions`` (business_id, verdict, risk_score, error), ``truth`` (business_id,
verdict, score), ``claims`` (business_id, evidence_id, pos, review_id, field, judgement,
snippet, is_direct), ``incidents`` (business_id, review_id, field, value, modifiers).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbitra.functions.ranking import prefix_totals
from arbitra.functions.text import quote_check
from arbitra.functions.values import (
    known_value, normalize_verdict, same_field, same_value, verdict_from_rule, verdict_ordinal,
)

# Points, thresholds and wordings of the evidence-based score.
SEVERITY_POINTS = {"mild": 2, "moderate": 5, "severe": 15}
MODIFIER_POINTS = {"False assurance": 5, "Dismissive staff": 3}
VERDICT_AT = [("Critical Risk", 8), ("High Risk", 4)]
DEFAULT_VERDICTS = ["Low Risk", "High Risk", "Critical Risk"]
ASSURANCE_FIELDS = ["ASSURANCE_CLAIM", "ASSURANCE_OF_SAFETY"]
ASSURANCE_WORDS = ["true", "yes", "detected", "false assurance", "no assurance"]
STAFF_WORDS = ["dismissive", "negative", "bad", "rude", "unhelpful"]

# Weights of the deprecated process score.
PROCESS_WEIGHTS = {
    "incident_precision": 0.35,
    "severity_accuracy": 0.30,
    "modifier_accuracy": 0.15,
    "verdict_support_rate": 0.15,
    "snippet_validity": 0.05,
}


def structured(results: DataFrame) -> DataFrame:
    """results whose parsed answer has an evidence list."""
    return results.where(F.col("parsed.evidences").isNotNull())


def without_errors(results: DataFrame) -> DataFrame:
    """F13."""
    return results.where(F.col("error").isNull())


def flatten_claims(results: DataFrame) -> DataFrame:
    """Evidence of nested results as rows.  Without direct evidence all of it is direct."""
    direct = F.coalesce(F.col("parsed.justification.direct_evidence"), F.array().cast("array<string>"))
    rows = structured(results).select(
        "business_id", direct.alias("direct"), F.posexplode("parsed.evidences").alias("pos", "e")
    )
    return rows.select(
        "business_id", "e.evidence_id", "pos", "e.review_id", "e.field", "e.judgement", "e.snippet",
        ((F.size("direct") == 0) | F.array_contains("direct", F.col("e.evidence_id"))).alias("is_direct"),
    )


def scored_pairs(predictions: DataFrame, truth: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """J8 + M4: ordinals of both sides and a risk score, which falls back to ordinal * 5."""
    p = predictions.where(F.col("error").isNull()) if "error" in predictions.columns else predictions
    pred = verdict_ordinal(normalize_verdict(F.col("verdict"), verdicts), verdicts)
    left = p.select("business_id", pred.alias("y_pred"), "risk_score")
    right = truth.select(
        "business_id", verdict_ordinal(normalize_verdict(F.col("verdict"), verdicts), verdicts).alias("y_true")
    )
    return (
        left.join(right, "business_id")
        .where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
        .withColumn("risk_score", F.coalesce("risk_score", F.col("y_pred") * 5.0))
    )


def accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """M1: share of equal verdicts; 0 without pairs."""
    pairs = predictions.select("business_id", F.col("verdict").alias("p")).join(
        truth.select("business_id", F.col("verdict").alias("t")), "business_id"
    )
    return pairs.agg(
        F.coalesce(F.avg((F.col("p").eqNullSafe(F.col("t"))).cast("int")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def average_precision(scored: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Step-wise average precision per key; equal scores share one threshold.

    Keys with no or only positives drop out.
    """
    ranked = scored.withColumn("_neg", -F.col(score))
    table = prefix_totals(
        ranked, keys, "_neg", {"_n": F.count(F.lit(1)), "_tp": F.sum(positive.cast("long"))}
    )
    hits, seen = F.col("before__tp") + F.col("_tp"), F.col("before__n") + F.col("_n")
    return (
        table.where((F.col("total__tp") > 0) & (F.col("total__tp") < F.col("total__n")))
        .groupBy(*keys)
        .agg(F.sum(F.col("_tp") / F.col("total__tp") * (hits / seen)).alias("average_precision"))
    )


def ordinal_auprc(pairs: DataFrame, levels: Sequence[int] = (1, 2)) -> DataFrame:
    """M2: average precision at "at least level" for each level, and their mean.

    All levels share one ranking of the scores, so a pair is one row however many there are.
    A level with no or only positives has none, and the mean leaves it out.
    """
    hits = {f"_tp{v}": F.sum((F.col("y_true") >= v).cast("long")) for v in levels}
    ranked = pairs.select("y_true", (-F.col("risk_score")).alias("_neg"))
    table = prefix_totals(ranked, [], "_neg", {"_n": F.count(F.lit(1)), **hits})
    seen = F.col("before__n") + F.col("_n")

    def precision(tp: str) -> Column:
        step = F.col(tp) / F.col(f"total_{tp}") * ((F.col(f"before_{tp}") + F.col(tp)) / seen)
        mixed = (F.col(f"total_{tp}") > 0) & (F.col(f"total_{tp}") < F.col("total__n"))
        return F.sum(F.when(mixed, step))

    per_level = table.agg(*[precision(tp).alias(tp) for tp in hits])
    found = F.array_compact(F.array(*hits))
    mean = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(found), F.lit(0))
    first, second = list(hits)[:2]
    return per_level.select(
        F.col(first).alias("auprc_ge_high"), F.col(second).alias("auprc_ge_critical"), mean.alias("ordinal_auprc")
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    """M3: mean F1 over the classes seen on either side; 0 with fewer than two pairs."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("long")
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("c"), hit.alias("tp")),
                              F.struct(F.col("y_pred").alias("c"), F.lit(0).cast("long").alias("tp"))))
    per_class = (
        pairs.select(sides.alias("s"))
        .groupBy("s.c")
        .agg((2 * F.sum("s.tp") / F.count(F.lit(1))).alias("f1"), F.count(F.lit(1)).alias("n"))
    )
    return per_class.agg(
        F.when(F.sum("n") >= 4, F.avg("f1")).otherwise(F.lit(0.0)).alias("macro_f1"),
        F.count(F.lit(1)).alias("classes"),
    )


def evidence_by_entity(entities: DataFrame, claims: DataFrame, incidents: DataFrame) -> DataFrame:
    """Distinct claimed, true and matched reviews of every entity.

    Claims and incidents are folded to one row per (entity, review) together, so neither side
    is joined with the other.
    """
    named = (F.col("review_id").isNotNull()) & (F.col("review_id") != "")
    marks = claims.where(named).select("business_id", "review_id", F.lit(1).alias("c"), F.lit(0).alias("t"))
    marks = marks.unionByName(
        incidents.where(named).select("business_id", "review_id", F.lit(0).alias("c"), F.lit(1).alias("t"))
    )
    folded = marks.groupBy("business_id", "review_id").agg(F.max("c").alias("c"), F.max("t").alias("t"))
    counts = folded.groupBy("business_id").agg(
        F.sum("c").alias("claimed"), F.sum("t").alias("truth"), F.sum(F.col("c") * F.col("t")).alias("matched")
    )
    out = entities.select("business_id").distinct().join(counts, "business_id", "left").fillna(0)
    return out.select(
        "*",
        F.try_divide("matched", "claimed").alias("evidence_precision"),
        F.when(F.col("truth") > 0, F.when(F.col("claimed") > 0, F.col("matched")).otherwise(F.lit(0)) / F.col("truth")).alias("evidence_recall"),
    )


def evidence_validity(by_entity: DataFrame) -> DataFrame:
    """M5: micro precision and recall; entities without claims count for recall only."""
    return by_entity.agg(
        F.try_divide(F.sum("matched"), F.sum("claimed")).alias("evidence_precision"),
        F.try_divide(F.sum("matched"), F.sum("truth")).alias("evidence_recall"),
        F.sum("claimed").alias("total_claimed"),
        F.sum("matched").alias("total_matched"),
        F.sum("truth").alias("total_truth"),
        F.count_if(F.col("claimed") == 0).alias("no_claims"),
        F.count_if(F.col("truth") == 0).alias("no_truth"),
    )


def snippet_checks(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """J11 + X17: claims with a quote, checked against the review text (missing text: "")."""
    quoted = claims.where((F.coalesce("snippet", F.lit("")) != "") & (F.coalesce("review_id", F.lit("")) != ""))
    joined = quoted.join(reviews.select("business_id", "review_id", "text"), ["business_id", "review_id"], "left")
    check = quote_check(F.col("snippet"), F.coalesce("text", F.lit("")))
    return joined.withColumn("check", check).drop("text").select("*", "check.*").drop("check")


def snippet_validity(checked: DataFrame) -> DataFrame:
    """M6."""
    return checked.agg(
        F.avg(F.col("valid").cast("int")).alias("snippet_validity"),
        F.count(F.lit(1)).alias("total_snippets"),
        F.count_if("valid").alias("valid_snippets"),
    )


def _claims_per_review(claims: DataFrame) -> DataFrame:
    """One row per (entity, review): its fields in order of first claim, last judgement each."""
    per_field = claims.groupBy("business_id", "review_id", F.upper("field").alias("f")).agg(
        F.min("pos").alias("first"), F.max_by("judgement", "pos").alias("j")
    )
    return per_field.groupBy("business_id", "review_id").agg(
        F.sort_array(F.collect_list(F.struct("first", "f", "j"))).alias("claimed")
    )


def judgement_checks(claims: DataFrame, incidents: DataFrame) -> DataFrame:
    """M7, row form: (business_id, review_id, field, correct), one row per incident and one
    per modifier that the method reported on."""
    joined = incidents.join(_claims_per_review(claims), ["business_id", "review_id"], "left")
    want_field = F.coalesce(F.nullif(F.upper("field"), F.lit("")), F.lit("INCIDENT_SEVERITY"))

    def pick(test) -> Column:
        return F.get(F.filter("claimed", test), F.lit(0))

    main = F.coalesce(pick(lambda c: c["f"] == want_field), pick(lambda c: same_field(c["f"], want_field)))
    judged = F.coalesce(known_value(main["j"], list(SEVERITY_POINTS)), F.lower(main["j"]))
    ok = F.coalesce(same_value(judged, F.col("value")), F.lit(False))
    def named(name: str) -> Column:
        return pick(lambda c: c["f"] == name)

    assurance = F.coalesce(*[named(n) for n in ASSURANCE_FIELDS])
    staff = named("STAFF_RESPONSE")

    def modifier(claim: Column, words: Sequence[str], label: str) -> Column:
        detected = known_value(claim["j"], words).isNotNull()
        return F.when(
            F.col("modifiers").isNotNull() & claim.isNotNull(),
            F.struct(claim["f"].alias("field"), (detected == F.array_contains("modifiers", label)).alias("correct")),
        )

    rows = F.array_compact(
        F.array(
            F.struct(want_field.alias("field"), ok.alias("correct")),
            modifier(assurance, ASSURANCE_WORDS, "False assurance"),
            modifier(staff, STAFF_WORDS, "Dismissive staff"),
        )
    )
    return joined.select("business_id", "review_id", F.explode(rows).alias("r")).select(
        "business_id", "review_id", "r.field", "r.correct"
    )


def judgement_accuracy(checks: DataFrame) -> DataFrame:
    """M7 per field; add the rows up for the overall accuracy."""
    return checks.groupBy("field").agg(
        F.count_if("correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )


def claim_points() -> Column:
    """Points of one claim: severity base points, or a modifier's points."""
    f = F.upper("field")
    severity = known_value(F.col("judgement"), list(SEVERITY_POINTS))
    base = F.lit(0)
    for level, pts in SEVERITY_POINTS.items():
        base = F.when(severity == level, F.lit(pts)).otherwise(base)
    assured = known_value(F.col("judgement"), ASSURANCE_WORDS).isNotNull()
    dismissed = known_value(F.col("judgement"), STAFF_WORDS).isNotNull()
    return (
        F.when(f == "INCIDENT_SEVERITY", base)
        .when(f.isin(ASSURANCE_FIELDS) & assured, F.lit(MODIFIER_POINTS["False assurance"]))
        .when((f == "STAFF_RESPONSE") & dismissed, F.lit(MODIFIER_POINTS["Dismissive staff"]))
        .otherwise(F.lit(0))
    )


def verdict_from_claims(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """M13, points form: score and verdict recomputed from the direct claims."""
    scored = claims.where("is_direct").groupBy("business_id").agg(
        F.sum(claim_points()).alias("computed_score"), F.count(F.lit(1)).alias("direct_claims")
    )
    out = entities.join(scored, "business_id", "left").fillna(0, ["computed_score", "direct_claims"])
    verdict = F.lit(DEFAULT_VERDICTS[0])
    for name, at in reversed(VERDICT_AT):
        verdict = F.when(F.col("computed_score") >= at, F.lit(name)).otherwise(verdict)
    return out.withColumn("computed_verdict", verdict)


def verdict_from_program(entities: DataFrame, claims: DataFrame, program: Mapping) -> DataFrame:
    """M13, program form: each claim is an extraction with one field."""
    from arbitra.operators.formula import run_program

    rows = claims.select(
        "business_id", "review_id", F.create_map(F.upper("field"), F.col("judgement")).alias("fields")
    )
    return run_program(rows, program, entities)


def verdict_support(predictions: DataFrame, claims: DataFrame) -> DataFrame:
    """M8: does the claimed evidence carry the claimed verdict and score?

    ``predictions`` has ``claimed_score`` as text.
    """
    p = predictions.where(F.col("verdict").isNotNull())
    rows = verdict_from_claims(p, claims)
    same = normalize_verdict(F.col("verdict")) == normalize_verdict(F.col("computed_verdict"))
    claimed = F.col("claimed_score").try_cast("double")
    close = F.abs(F.col("computed_score") - claimed) < 0.01
    return rows.agg(
        F.avg(F.coalesce(same, F.lit(False)).cast("int")).alias("verdict_support_rate"),
        F.count(F.lit(1)).alias("total"),
        F.avg(close.cast("int")).alias("score_consistency"),
        F.count(claimed).alias("score_total"),
    )


def verdict_consistency(predictions: DataFrame, verdicts: Sequence[str] | None = None) -> DataFrame:
    """M9: does the triggered rule name the claimed verdict?"""
    p = predictions.where(F.col("error").isNull() & F.col("verdict").isNotNull())
    named = F.nullif(verdict_from_rule(F.col("triggered_rule")), F.lit(""))
    same = normalize_verdict(named, verdicts) == normalize_verdict(F.col("verdict"), verdicts)
    return p.agg(
        F.avg(F.when(named.isNotNull(), F.coalesce(same, F.lit(False)).cast("int"))).alias("verdict_consistency"),
        F.count(named).alias("total"),
        F.count_if(named.isNull()).alias("skipped_no_rule"),
    )


def score_accuracy(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of claimed scores within 0.01 of the true one."""
    pairs = predictions.where(F.col("error").isNull()).select("business_id", F.col("claimed_score").try_cast("double").alias("c"))
    joined = pairs.join(truth.select("business_id", F.col("score").cast("double").alias("t")), "business_id")
    usable = joined.where(F.col("c").isNotNull() & F.col("t").isNotNull())
    return usable.agg(
        F.avg((F.abs(F.col("c") - F.col("t")) < 0.01).cast("int")).alias("score_accuracy"),
        F.count(F.lit(1)).alias("total"),
    )


def false_positive_rate(predictions: DataFrame, truth: DataFrame, claims: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """Share of entities with the lowest true verdict for which evidence was claimed."""
    negatives = truth.where(normalize_verdict(F.col("verdict"), verdicts) == verdicts[0]).select("business_id")
    ok = predictions.where(F.col("error").isNull()).select("business_id")
    claimed = claims.groupBy("business_id").agg(F.lit(1).alias("has"))
    rows = ok.join(negatives, "business_id").join(claimed, "business_id", "left")
    return rows.agg(
        F.coalesce(F.avg(F.coalesce("has", F.lit(0))), F.lit(0.0)).alias("false_positive_rate"),
        F.count("has").alias("false_positives"),
        F.count(F.lit(1)).alias("negatives"),
    )


def process_score(components: DataFrame) -> DataFrame:
    """Weighted mean in percent of the components that are not null."""
    weighted = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in PROCESS_WEIGHTS.items()],
    )
    weight = reduce(
        lambda a, b: a + b,
        [F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for n, w in PROCESS_WEIGHTS.items()],
    )
    return components.withColumn(
        "process_score", F.when(weight > 0, weighted / weight * 100).otherwise(F.lit(0.0))
    )


def evaluation_counts(predictions: DataFrame, truth: DataFrame, claims: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """(metric, value) rows of n_samples (all results), n_with_gt (those that are compared) and
    n_structured (those with an evidence list).

    A boolean column ``structured`` of the results decides the last, if there is one: a result with an
    empty list has no claims.  Without it a result counts whose entity has a claim.
    """
    if "structured" in predictions.columns:
        lists = predictions.where("structured")
    else:
        lists = predictions.join(claims.select("business_id").distinct(), "business_id", "left_semi")
    sizes = {"n_samples": predictions, "n_with_gt": scored_pairs(predictions, truth, verdicts), "n_structured": lists}
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in sizes.items()],
    )


def evaluation_report(
    predictions: DataFrame, truth: DataFrame, claims: DataFrame, incidents: DataFrame,
    reviews: DataFrame, verdicts: Sequence[str],
) -> DataFrame:
    """The seven metrics and what they were measured on, as (metric, value) rows."""
    pairs = scored_pairs(predictions, truth, verdicts)
    by_entity = evidence_by_entity(predictions, claims, incidents)
    checks = judgement_checks(claims, incidents)

    def row(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))

    evidence = evidence_validity(by_entity)
    both = evidence.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                    for m in ("evidence_precision", "evidence_recall")
                ]
            )
        ).alias("r")
    ).select("r.*")
    parts = [
        row(ordinal_auprc(pairs), "ordinal_auprc", "auprc"),
        row(macro_f1(pairs), "macro_f1", "macro_f1"),
        both,
        row(snippet_validity(snippet_checks(claims, reviews)), "snippet_validity", "snippet_validity"),
        row(checks.agg(F.avg(F.col("correct").cast("int")).alias("a")), "a", "judgement_accuracy"),
        row(verdict_consistency(predictions, verdicts), "verdict_consistency", "verdict_consistency"),
        evaluation_counts(predictions, truth, claims, verdicts),
    ]
    return reduce(DataFrame.unionByName, parts)
