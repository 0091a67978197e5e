"""Declarative policies turned into one aggregation over judgement rows.

A policy is a mapping::

    {"policy_id": ..., "verdicts": [lowest, ..., highest],
     "rules": [{"verdict", "label", "logic": "ANY" | "ALL" | "NONE", "conditions": [...],
                "default": bool}],
     "scoring": {"severity_field", "value_labels": {value: label}, "severity_points":
                 [(label, points)], "modifiers": [(label, points)], "modifier_fields":
                 [(field, value, label)], "cuisine_label": str, "recency": "text" | "max_age",
                 "recency_rules": [...], "thresholds": [...]}}

Judgement rows carry ``k, business_id, review_id, is_relevant, fields, date``.  Every condition
of every policy becomes one aggregate of a single ``groupBy(k, business_id)``, folded map-side,
so policies share one scan and one shuffle and a hot business costs one row per task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbitra.functions import scoring as sc
from arbitra.functions.conditions import all_of, equality_filter, firsthand, one_of
from arbitra.operators.topics import high_risk_cuisine

ENTITY = ["k", "business_id"]


def compare(left: Column, operator: str, right: Column) -> Column:
    return {
        ">=": left >= right, ">": left > right, "==": left == right,
        "<=": left <= right, "<": left < right, "!=": left != right,
    }[operator]


def join_judgments(reviews: DataFrame, judgments: DataFrame) -> DataFrame:
    """Reviews of the K data sets with their judgements; misses stay, as null fields."""
    return reviews.join(
        judgments.select("review_id", "is_relevant", "fields"), "review_id", "left"
    )


def judgment_misses(joined: DataFrame) -> DataFrame:
    """Reviews and misses per entity."""
    return joined.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("fields").isNull()).alias("misses")
    )


def _row_predicate(cond: Mapping, compat: bool) -> Column:
    """The rows a condition looks at: relevance, filter, requires, window, recency, except."""
    fields, date = F.col("fields"), sc.day(F.col("date"))
    parts = [F.coalesce("is_relevant", F.lit(False)), equality_filter(fields, cond.get("filter", {}))]
    if cond.get("requires") and not compat:
        parts.append(equality_filter(fields, cond["requires"]))
    if cond.get("within"):
        w = cond["within"]
        span = F.make_interval(
            F.lit(w.get("years", 0)), F.lit(w.get("months", 0)), F.lit(0), F.lit(w.get("days", 0))
        )
        reference = F.lit(w.get("reference", sc.REFERENCE_DATE)).cast("date")
        parts.append(date >= (reference - span).cast("date"))
    if cond.get("most_recent"):
        parts.append(F.col("_recent") <= cond["most_recent"])
    if cond.get("since"):
        parts.append(date >= F.lit(cond["since"]).cast("date"))
    if cond.get("since_event"):
        parts.append(date >= F.col(_event_column(cond["since_event"])))
    if cond.get("except"):
        parts.append(~equality_filter(fields, cond["except"]))
    return F.coalesce(all_of(parts), F.lit(False))


def _event_column(event: Mapping) -> str:
    return "_event_" + hashlib.sha1(_key(event).encode()).hexdigest()[:10]


def _key(cond: Mapping) -> str:
    return json.dumps({k: v for k, v in cond.items() if k != "text"}, sort_keys=True, default=str)


def _condition_aggregate(cond: Mapping, name: str, compat: bool) -> Column:
    hit = _row_predicate(cond, compat)
    kind = cond.get("type", "count_threshold")
    if kind in ("sum", "max", "min"):
        value = F.col("fields")[cond["value_field"]]
        points = cond.get("points")
        number = value.try_cast("double")
        if points:
            number = F.lit(None).cast("double")
            for v, p in points.items():
                number = F.when(value == v, F.lit(float(p))).otherwise(number)
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        return agg(F.when(hit, number)).alias(name)
    return F.count_if(hit).alias(name)


def _condition_truth(cond: Mapping, name: str) -> Column:
    kind = cond.get("type", "count_threshold")
    k, value = F.col("k"), F.col(name)
    if kind == "exists":
        return value >= 1
    if kind in ("count", "sum", "max", "min"):
        bound = sc.by_k(cond["threshold"], cond.get("threshold_by_k"), k)
        return F.coalesce(compare(value, cond.get("comparison", ">="), bound), F.lit(False))
    return value >= sc.by_k(cond.get("min_count", 1), cond.get("min_count_by_k"), k)


def _rule_truth(rule: Mapping, truths: Sequence[Column]) -> Column:
    if rule.get("logic", "ANY") == "ANY":
        return one_of(truths)
    return all_of(truths) if rule["logic"] == "ALL" else ~one_of(truths)


def _points_column(spec: Mapping) -> tuple[Column, Column, Column, Column]:
    """Eligibility, base label, points with modifiers, and applied modifier labels of a row."""
    fields = F.col("fields")
    value = fields[spec["severity_field"]]
    label = F.lit(None).cast("string")
    base = F.lit(0)
    for v, text in spec["value_labels"].items():
        label = F.when(value == v, F.lit(text)).otherwise(label)
        base = F.when(value == v, F.lit(sc.points_for(text, spec["severity_points"]))).otherwise(base)
    points, applied = base, []
    for name, wanted, text in spec.get("modifier_fields", []):
        pts = sc.points_for(text, spec["modifiers"])
        has = F.coalesce(fields[name] == wanted, F.lit(False))
        points = points + F.when(has, F.lit(pts)).otherwise(F.lit(0))
        if pts:
            applied.append(F.when(has, F.lit(text)))
    eligible = F.coalesce(
        F.coalesce("is_relevant", F.lit(False)) & firsthand(fields) & (value != "none") & label.isNotNull(),
        F.lit(False),
    )
    mods = F.array_compact(F.array(*applied)) if applied else F.array().cast("array<string>")
    return eligible, label, points, mods


def _recency(spec: Mapping) -> Column:
    rules = spec.get("recency_rules")
    if not rules:
        return F.lit(1.0)
    if spec.get("recency", "max_age") == "text":
        return sc.recency_from_text(F.col("date"), rules)
    return sc.recency_by_max_age(sc.age_years(F.col("date")), rules)


def incidents(judged: DataFrame, policy: Mapping) -> DataFrame:
    """A10, row form: one row per scored incident of a scoring policy."""
    spec = policy["scoring"]
    eligible, label, points, mods = _points_column(spec)
    weight = _recency(spec)
    return judged.where(eligible).select(
        F.lit(policy["policy_id"]).alias("policy_id"),
        *ENTITY,
        "review_id",
        F.lit(spec["severity_field"]).alias("field"),
        F.col("fields")[spec["severity_field"]].alias("value"),
        label.alias("label"),
        mods.alias("modifiers"),
        points.alias("points"),
        weight.alias("recency_weight"),
        (points * weight).cast("int").alias("weighted_points"),
    )


def evidence_rows(judged: DataFrame, policy_id: str, field: str, values: Sequence[str]) -> DataFrame:
    """A14, row form: reviews whose evidence field holds an evidence value."""
    get = lambda f: F.lower(F.trim(F.coalesce(F.col("fields")[f], F.lit(""))))
    # The two modifiers that are looked for.
    mods = F.array_compact(
        F.array(
            F.when(get("assurance_claim") == "true", F.lit("False assurance")),
            F.when(get("staff_response") == "dismissive", F.lit("Dismissive staff")),
        )
    )
    return judged.where(get(field).isin(list(values))).select(
        F.lit(policy_id).alias("policy_id"), *ENTITY, "review_id", F.lit(field).alias("field"),
        get(field).alias("value"), get("account_type").alias("account_type"), mods.alias("modifiers"),
    )


def evidence_lists(rows: DataFrame) -> DataFrame:
    """Rows as one list per entity, which holds at most K reviews."""
    keys = ["policy_id", *ENTITY]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*rest))).alias("incidents"),
        F.count(F.lit(1)).alias("n_incidents"),
    )


def policy_verdicts(
    judged: DataFrame,
    policies: Sequence[Mapping],
    entities: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """(policy_id, k, business_id, verdict, matched_rule, score,
    n_incidents) of every policy, in one pass.

    ``entities`` (k, business_id[, categories]) adds entities without rows and the categories
    for the cuisine modifier.  ``compat`` ignores ``requires``.
    """
    # Equal conditions of different rules and policies share one aggregate.
    unique = {_key(c): c for p in policies for r in p.get("rules", []) for c in r.get("conditions", [])}
    conditions = list(unique.values())
    names = {key: f"c{n}" for n, key in enumerate(unique)}
    rows = judged
    if any(c.get("most_recent") for c in conditions):
        newest = Window.partitionBy(*ENTITY).orderBy(F.desc("date"), F.col("review_id"))
        rows = rows.withColumn("_recent", F.row_number().over(newest))
    events = {_event_column(c["since_event"]): c["since_event"] for c in conditions if c.get("since_event")}
    for name, event in events.items():
        when = F.when(equality_filter(F.col("fields"), event), sc.day(F.col("date")))
        rows = rows.withColumn(name, F.min(when).over(Window.partitionBy(*ENTITY)))

    aggregates = [_condition_aggregate(c, names[_key(c)], compat) for c in conditions]
    for n, p in enumerate(policies):
        if p.get("scoring"):
            eligible, _, points, _ = _points_column(p["scoring"])
            weighted = (points * _recency(p["scoring"])).cast("int")
            aggregates += [
                F.sum(F.when(eligible, weighted).otherwise(F.lit(0))).alias(f"s{n}"),
                F.count_if(eligible).alias(f"n{n}"),
            ]
    totals = rows.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    if entities is not None:
        totals = entities.join(totals, ENTITY, "left")
    counted = [names[_key(c)] for c in conditions if c.get("type", "") not in ("sum", "max", "min")]
    counted += [f"{x}{n}" for n, p in enumerate(policies) if p.get("scoring") for x in "sn"]
    totals = totals.fillna(0, subset=counted)
    cuisine = (
        high_risk_cuisine(F.col("categories"))
        if entities is not None and "categories" in entities.columns
        else F.lit(False)
    )

    def outcome(n: int, p: Mapping) -> Column:
        default = next((r for r in p.get("rules", []) if r.get("default")), None)
        fallback = default["verdict"] if default else "Unknown"
        if p.get("scoring"):
            spec = p["scoring"]
            extra = sc.points_for(spec.get("cuisine_label", "High-risk cuisine"), spec["modifiers"])
            score = F.col(f"s{n}") + F.when(cuisine & (F.col(f"n{n}") > 0), F.lit(extra)).otherwise(F.lit(0))
            verdict = sc.verdict_for_score(score, spec["thresholds"], F.col("k"), fallback)
            rule = F.lit(None).cast("string")
            n_inc = F.col(f"n{n}")
        else:
            score, n_inc = F.lit(None).cast("long"), F.lit(None).cast("long")
            verdict = rule = None
            for r in p["rules"]:
                if r.get("default") or not r.get("conditions"):
                    continue
                hit = _rule_truth(r, [_condition_truth(c, names[_key(c)]) for c in r["conditions"]])
                text = F.lit(r.get("label"))
                verdict = F.when(hit, F.lit(r["verdict"])) if verdict is None else verdict.when(hit, F.lit(r["verdict"]))
                rule = F.when(hit, text) if rule is None else rule.when(hit, text)
            last = F.lit(default.get("label") if default else None).cast("string")
            verdict = verdict.otherwise(F.lit(fallback)) if verdict is not None else F.lit(fallback)
            rule = rule.otherwise(last) if rule is not None else last
        return F.struct(
            F.lit(p["policy_id"]).alias("policy_id"),
            verdict.alias("verdict"),
            rule.alias("matched_rule"),
            score.cast("long").alias("score"),
            n_inc.cast("long").alias("n_incidents"),
        )

    each = F.explode(F.array(*[outcome(n, p) for n, p in enumerate(policies)]))
    return totals.select(*ENTITY, each.alias("o")).select("o.policy_id", *ENTITY, "o.verdict", "o.matched_rule", "o.score", "o.n_incidents")


def score_breakdown(judged: DataFrame, spec: Mapping, year_rules=(), entities: DataFrame | None = None) -> DataFrame:
    """Severity counts, severity points, modifier points, recency adjustment, total.

    Differs from the policy score: only severity points are recency-weighted (by calendar
    year), account type must be first-hand, and the cuisine modifier needs no incident.
    """
    fields = F.col("fields")
    get = lambda f: fields[f]
    value = get(spec["severity_field"])
    eligible = F.coalesce(
        F.coalesce("is_relevant", F.lit(False)) & (get("account_type") == "firsthand") & (value != "none"),
        F.lit(False),
    )
    base = F.lit(0.0)
    for v, text in spec["value_labels"].items():
        base = F.when(value == v, F.lit(float(sc.points_for(text, spec["severity_points"])))).otherwise(base)
    weight = sc.recency_by_year(F.col("date"), year_rules)
    mods = F.lit(0.0)
    for name, wanted, text in spec["modifier_fields"]:
        pts = float(max(0, sc.points_for(text, spec["modifiers"])))
        mods = mods + F.when(get(name) == wanted, F.lit(pts)).otherwise(F.lit(0.0))
    add = lambda c: F.sum(F.when(eligible, c).otherwise(F.lit(0.0)))
    levels = list(spec["value_labels"])
    out = judged.groupBy(*ENTITY).agg(
        *[F.count_if(eligible & (value == v)).alias(f"n_{v}") for v in levels],
        add(base * weight).alias("severity_points"),
        add(mods).alias("modifier_points"),
        add(base - base * weight).alias("recency_adjustment"),
    )
    cuisine = F.lit(0.0)
    if entities is not None:
        out = entities.join(out, ENTITY, "left").fillna(0)
        pts = float(max(0, sc.points_for(spec.get("cuisine_label", "High-risk cuisine"), spec["modifiers"])))
        cuisine = F.when(high_risk_cuisine(F.col("categories")), F.lit(pts)).otherwise(F.lit(0.0))
    return out.withColumn("cuisine_points", cuisine).withColumn(
        "total_score", F.col("severity_points") + F.col("modifier_points") + F.col("cuisine_points")
    )


def verdict_distribution(verdicts: DataFrame, policies: Sequence[Mapping]) -> DataFrame:
    """Entities per (policy, k, verdict) with a row for every verdict of the policy."""
    known = None
    for p in policies:
        all_verdicts = F.array(*[F.lit(v) for v in p["verdicts"]])
        hit = F.col("policy_id") == p["policy_id"]
        known = F.when(hit, all_verdicts) if known is None else known.when(hit, all_verdicts)
    counted = verdicts.groupBy("policy_id", "k", "verdict").agg(F.count(F.lit(1)).alias("cnt"))
    grid = counted.select("policy_id", "k").distinct().withColumn("verdict", F.explode(known))
    full = grid.join(counted, ["policy_id", "k", "verdict"], "full")
    return full.withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def distribution_rollup(verdicts: DataFrame) -> DataFrame:
    """Counts per (k, verdict), per k and overall, with the share inside k."""
    rolled = verdicts.rollup("k", "verdict").agg(F.count(F.lit(1)).alias("cnt"))
    # A handful of rows per k: verdicts of the policies and their total.
    total = F.max("cnt").over(Window.partitionBy("k"))
    return rolled.withColumn("share", F.col("cnt") / total)


def imbalance_report(verdicts: DataFrame, above: float = 0.8) -> DataFrame:
    """(policy, k) whose most frequent verdict exceeds a share."""
    counted = verdicts.groupBy("policy_id", "k", "verdict").agg(F.count(F.lit(1)).alias("cnt"))
    top = counted.groupBy("policy_id", "k").agg(
        F.max_by("verdict", F.struct("cnt", "verdict")).alias("dominant"),
        (F.max("cnt") / F.sum("cnt")).alias("share"),
    )
    return top.where(F.col("share") > above)


def variant_difference(verdicts: DataFrame, left: str, right: str) -> DataFrame:
    """Counts per (k, verdict) under two policies and their difference."""
    def counts(policy: str, name: str) -> DataFrame:
        return (
            verdicts.where(F.col("policy_id") == policy)
            .groupBy("k", "verdict")
            .agg(F.count(F.lit(1)).alias(name))
        )

    both = counts(left, "left_cnt").join(counts(right, "right_cnt"), ["k", "verdict"], "full")
    return both.fillna(0, subset=["left_cnt", "right_cnt"]).withColumn(
        "delta", F.col("right_cnt") - F.col("left_cnt")
    )


# --- dimensions of policies and terms ----------------------------------------------------


def resolve_terms(references: DataFrame, terms: DataFrame) -> DataFrame:
    """``domain:TERM`` or bare ``TERM`` references joined to term rows.

    A bare name takes the first domain (smallest ``domain_ord``) that has it; an unresolved
    reference keeps a null domain.
    """
    parts = F.split("ref", ":")
    named = F.size(parts) == 2
    asked = references.withColumn("term_id", F.element_at(parts, -1)).withColumn(
        "asked_domain", F.when(named, parts[0])
    )
    first = terms.groupBy("term_id").agg(F.min_by("domain", "domain_ord").alias("first_domain"))
    found = asked.join(first, "term_id", "left").withColumn(
        "asked_domain", F.coalesce("asked_domain", "first_domain")
    )
    have = terms.select("term_id", F.col("domain").alias("asked_domain"), F.lit(True).alias("resolved")).distinct()
    return (
        found.join(have, ["term_id", "asked_domain"], "left")
        .select(
            "ref", "term_id",
            F.when(F.col("resolved"), F.col("asked_domain")).alias("domain"),
            F.coalesce("resolved", F.lit(False)).alias("resolved"),
        )
    )


def merged_schema(term_values: DataFrame) -> DataFrame:
    """Fields of all policy versions; the earliest version that has a field defines it.

    ``term_values`` has (version, field, ord, value_id).
    """
    first = term_values.groupBy("field").agg(F.min("version").alias("version"))
    return term_values.join(first, ["field", "version"]).select("field", "version", "ord", "value_id")


def evidence_values(term_values: DataFrame) -> DataFrame:
    """Values that count as evidence: all but the default one."""
    return (
        term_values.where(~F.coalesce("is_default", F.lit(False)))
        .groupBy("field")
        .agg(F.sort_array(F.collect_set("value_id")).alias("evidence_values"))
    )


def config_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that only one side has."""
    a = left.select(*keys, F.lit(True).alias("in_left")).distinct()
    b = right.select(*keys, F.lit(True).alias("in_right")).distinct()
    return (
        a.join(b, list(keys), "full")
        .where(F.col("in_left").isNull() | F.col("in_right").isNull())
        .select(*keys, F.when(F.col("in_left"), F.lit("left")).otherwise(F.lit("right")).alias("only_in"))
    )


def expand_policies(topics: DataFrame, variants: Sequence[str]) -> DataFrame:
    """Every topic with every variant; the variants are a literal list."""
    each = F.explode(F.array(*[F.lit(v) for v in variants]))
    return topics.withColumn("variant", each).withColumn("policy_id", F.concat("topic_id", "variant"))
