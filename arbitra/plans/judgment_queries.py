"""Votes, quotas, overrides, policy verdicts, formula programs, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions import scoring as sc
from arbitra.functions import text as tx
from arbitra.functions import values as vl
from arbitra.functions.conditions import (
    event_matches, fields_of, rich_filter, user_flag, user_number, with_values,
)
from arbitra.operators import formula, judgments, validation, verdicts
from arbitra.plans import adapters as ad
from arbitra.plans import catalog as cat
from arbitra.plans.oracle import full_upper, norm
from arbitra.plans.registry import longs, query, r6
from arbitra.session import dimension


def review_keys(spark, sf):
    return ad.table(spark, sf, "documents").select(F.lit(cat.TOPIC).alias("topic"), F.col("doc_id").cast("string").alias("review_id"))


@query("weighted_vote", ["votes"], "SELECT review_id, field, value, confidence FROM votes")
def _(spark, sf):
    """A6, A7, A8."""
    return judgments.vote(ad.raw_judgments(spark, sf), list(cat.FIELDS), cat.WEIGHTS).select("review_id", "field", "value", "confidence")


@query("voted_judgments", ["judg", "raw"], """
    SELECT review_id, is_relevant, incident_severity, account_type, assurance_claim, staff_response, first_model FROM judg
    JOIN (SELECT review_id, arg_min(model, ord) AS first_model FROM raw GROUP BY review_id) USING (review_id)""")
def _(spark, sf):
    """A6-A9, D10."""
    raw = ad.raw_judgments(spark, sf)
    first = judgments.first_metadata(raw.withColumn("first_model", F.col("model")), ["first_model"])
    f = F.col("fields")
    return ad.voted(spark, sf).join(first, ["topic", "review_id"]).select(
        "review_id", "is_relevant", *[f[n].alias(n) for n in cat.FIELDS], "first_model"
    )


@query("missing_extractions", ["stored"], """
    SELECT CAST(doc_id AS VARCHAR) AS review_id, model, run FROM documents, (VALUES ('m-large', 1), ('m-small-x', 1), ('m-small-x', 2), ('m-small-x', 3)) q(model, run)
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.review_id = CAST(doc_id AS VARCHAR) AND s.model = q.model AND s.run = q.run)""")
def _(spark, sf):
    """J6."""
    return judgments.missing_runs(review_keys(spark, sf), ad.stored_raw(spark, sf), cat.QUOTA).select("review_id", "model", *longs("run"))


@query("quota_complete", ["stored"], "SELECT review_id FROM stored GROUP BY review_id HAVING COUNT(DISTINCT model || run) = 4")
def _(spark, sf):
    """A32."""
    return judgments.quota_complete(ad.stored_raw(spark, sf), cat.QUOTA).select("review_id")


@query("vote_complete", ["votes"], """
    SELECT review_id, field, value, confidence FROM votes WHERE review_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def _(spark, sf):
    """A32 + A6."""
    v = judgments.vote_complete(ad.stored_raw(spark, sf), list(cat.FIELDS), cat.WEIGHTS, cat.QUOTA)
    return v.select("review_id", "field", "value", "confidence")


@query("vote_unaggregated", ["votes"], """
    SELECT review_id, field, value FROM votes WHERE review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
def _(spark, sf):
    """Labelled documents count as aggregated already."""
    done = ad.table(spark, sf, "labels").select(F.lit(cat.TOPIC).alias("topic"), F.col("doc_id").cast("string").alias("review_id"))
    v = judgments.vote_unaggregated(ad.raw_judgments(spark, sf), done, list(cat.FIELDS), cat.WEIGHTS)
    return v.select("review_id", "field", "value")


@query("raw_per_model", ["stored"], """
    SELECT model, COUNT(*) AS raw_rows, COUNT(DISTINCT review_id) AS reviews, MIN(run) AS first_run, MAX(run) AS last_run FROM stored GROUP BY model""")
def _(spark, sf):
    """A30."""
    return judgments.raw_per_model(ad.stored_raw(spark, sf)).select("model", *longs("raw_rows", "reviews", "first_run", "last_run"))


@query("extraction_completeness", ["stored"], """
    SELECT model, expected, cached, expected - cached AS missing FROM
        (SELECT model, COUNT(*) * n AS expected FROM documents, (VALUES ('m-large', 1), ('m-small-x', 3)) q(model, n) GROUP BY model, n)
        JOIN (SELECT model, COUNT(*) AS cached FROM stored GROUP BY model) USING (model)""")
def _(spark, sf):
    """A31."""
    return judgments.completeness(review_keys(spark, sf), ad.stored_raw(spark, sf), cat.QUOTA).select("model", "expected", "cached", "missing")


@query("apply_overrides", ["judg", "overrides"], """
    SELECT review_id, CASE WHEN toxic = 1 THEN 'severe' WHEN toxic = 0 THEN 'none' ELSE incident_severity END AS incident_severity,
           CASE WHEN toxic = 0 THEN 'secondhand' ELSE account_type END AS account_type, toxic IS NOT NULL AS override_applied, reason
    FROM judg LEFT JOIN overrides USING (review_id)""")
def _(spark, sf):
    """J7, U2."""
    out = judgments.apply_overrides(ad.voted(spark, sf), ad.overrides(spark, sf))
    f = F.col("fields")
    return out.select(
        "review_id", f["incident_severity"].alias("incident_severity"), f["account_type"].alias("account_type"),
        "override_applied", F.col("override_reason").alias("reason"),
    )


@query("latest_raw", ["raw"], """
    SELECT review_id, model, incident_severity FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY review_id, model ORDER BY run DESC) AS rn FROM raw) WHERE rn = 1""")
def _(spark, sf):
    """The newest run of each model replaces the older ones."""
    raw = ad.raw_judgments(spark, sf)
    out = judgments.upsert(raw.where("run = 1"), raw.where("run > 1"), ["topic", "review_id", "model"], [F.desc("run")])
    return out.select("review_id", "model", F.col("fields")["incident_severity"].alias("incident_severity"))


@query("first_written", ["raw"], "SELECT review_id, arg_min(staff_response, ord) AS staff_response FROM raw GROUP BY review_id")
def _(spark, sf):
    """S12."""
    rows = ad.raw_judgments(spark, sf).withColumn("text_hash", F.sha1("review_id")).withColumn("prompt_version", F.lit("v1"))
    out = judgments.first_written(rows.withColumn("created_at", F.col("ord")))
    return out.select("review_id", F.col("fields")["staff_response"].alias("staff_response"))


@query("topic_delete_count", ["raw"], "SELECT COUNT(*) AS removed FROM raw")
def _(spark, sf):
    """U11."""
    return judgments.delete_topic(ad.raw_judgments(spark, sf), cat.TOPIC)[1]


@query("judgment_misses", ["kreviews", "overrides"], """
    SELECT k, business_id, COUNT(*) AS reviews, COUNT(*) FILTER (WHERE o.review_id IS NULL) AS misses
    FROM kreviews LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS review_id FROM labels) o USING (review_id) GROUP BY k, business_id""")
def _(spark, sf):
    """Only labelled documents count as judged."""
    labelled = ad.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    known = ad.voted(spark, sf).join(labelled, "review_id", "left_semi")
    from arbitra.operators.datasets import k_scales

    scaled = k_scales(ad.reviews(spark, sf).drop("text"), cat.SCALES)
    return verdicts.judgment_misses(verdicts.join_judgments(scaled, known))


def _verdicts(spark, sf, *policies, compat=False):
    return verdicts.policy_verdicts(ad.judged(spark, sf), policies, ad.entities(spark, sf), compat)


@query("count_rule_verdict", ["verdicts"], "SELECT k, business_id, verdict, matched_rule FROM verdicts WHERE policy_id = 'S1P1'")
def _(spark, sf):
    """W1, J5, A12, A13."""
    return _verdicts(spark, sf, cat.ANY_POLICY).select("k", "business_id", "verdict", "matched_rule")


@query("all_rule_verdict", ["verdicts"], "SELECT k, business_id, verdict, matched_rule FROM verdicts WHERE policy_id = 'S1P3'")
def _(spark, sf):
    """A13, ALL logic."""
    return _verdicts(spark, sf, cat.ALL_POLICY).select("k", "business_id", "verdict", "matched_rule")


@query("compound_rule_verdict", ["verdicts"], "SELECT k, business_id, verdict FROM verdicts WHERE policy_id = 'S1P2'")
def _(spark, sf):
    """A12 with a second requirement per row."""
    return _verdicts(spark, sf, cat.COMPOUND_POLICY).select("k", "business_id", "verdict")


@query("point_score_verdict", ["verdicts"], "SELECT k, business_id, verdict, score, n_incidents FROM verdicts WHERE policy_id = 'S1V3'")
def _(spark, sf):
    """A10, J13, X23, X30, F3, F5, F6."""
    return _verdicts(spark, sf, cat.SCORE_POLICY).select("k", "business_id", "verdict", "score", "n_incidents")


@query("recency_score", ["verdicts"], "SELECT k, business_id, verdict, score, n_incidents FROM verdicts WHERE policy_id = 'S1V4'")
def _(spark, sf):
    """A10 with X27."""
    return _verdicts(spark, sf, cat.RECENCY_POLICY).select("k", "business_id", "verdict", "score", "n_incidents")


@query("text_recency_score", ["judged", "entities"], """
    SELECT k, business_id, COALESCE(s, 0) + CASE WHEN contains(lower(categories), 'thai') AND s IS NOT NULL THEN 7 ELSE 0 END AS score
    FROM entities LEFT JOIN (SELECT k, business_id, CAST(SUM(trunc(points * CASE WHEN age <= 1 THEN 1e0 WHEN age > 1 AND age <= 2 THEN 0.5e0 WHEN age > 2 THEN 0.25e0 ELSE 1e0 END)) AS BIGINT) AS s
        FROM judged WHERE scored GROUP BY k, business_id) USING (k, business_id)""")
def _(spark, sf):
    """A10 with X26."""
    return _verdicts(spark, sf, cat.TEXT_RECENCY_POLICY).select("k", "business_id", "score")


@query("all_policies", ["verdicts"], "SELECT policy_id, k, business_id, verdict, score FROM verdicts")
def _(spark, sf):
    """Five policies in one aggregation."""
    return ad.verdict_table(spark, sf).select("policy_id", "k", "business_id", "verdict", "score")


@query("window_rule_verdict", ["judged", "entities"], """
    SELECT k, business_id, CASE WHEN recent > 2 AND last5 >= 1 THEN 'Critical Risk'
                                WHEN since2019 >= 4 OR after_severe >= 6 OR total >= 40 THEN 'High Risk'
                                WHEN NOT COALESCE(peak >= 9, FALSE) THEN 'Low Risk' ELSE 'High Risk' END AS verdict
    FROM entities LEFT JOIN (
        SELECT k, business_id,
               COUNT(*) FILTER (WHERE is_relevant AND incident_severity IN ('moderate', 'severe') AND date >= '2019-01-01') AS recent,
               COUNT(*) FILTER (WHERE is_relevant AND incident_severity <> 'none' AND newest <= 5 AND account_type <> 'secondhand') AS last5,
               COUNT(*) FILTER (WHERE is_relevant AND staff_response = 'dismissive' AND date >= '2019-01-01') AS since2019,
               COUNT(*) FILTER (WHERE is_relevant AND incident_severity = 'mild' AND date >= first_severe) AS after_severe,
               SUM(p) FILTER (WHERE is_relevant) AS total, MAX(p) FILTER (WHERE is_relevant) AS peak
        FROM (SELECT *, CASE incident_severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 3 WHEN 'severe' THEN 9 END AS p,
                     ROW_NUMBER() OVER (PARTITION BY k, business_id ORDER BY date DESC, review_id) AS newest,
                     MIN(CASE WHEN incident_severity = 'severe' THEN date END) OVER (PARTITION BY k, business_id) AS first_severe FROM judged)
        GROUP BY k, business_id) USING (k, business_id)""")
def _(spark, sf):
    """L1-L9."""
    return _verdicts(spark, sf, cat.WINDOW_POLICY).select("k", "business_id", "verdict")


@query("score_incidents", ["judged"], """
    SELECT k, review_id, staff_response AS value, points, CAST(trunc(points * CASE WHEN age <= 1 THEN 1e0 WHEN age <= 2 THEN 0.5e0 ELSE 0.25e0 END) AS BIGINT) AS weighted_points,
           CAST(incident_severity IN ('mild', 'severe') AS BIGINT) AS n_modifiers FROM judged WHERE scored""")
def _(spark, sf):
    """A10, incident rows."""
    rows = verdicts.incidents(ad.judged(spark, sf), cat.RECENCY_POLICY)
    return rows.select("k", "review_id", "value", *longs("points", "weighted_points"), F.size("modifiers").cast("long").alias("n_modifiers"))


@query("score_breakdown", ["judged", "entities"], """
    SELECT k, business_id, COALESCE(n_granted, 0) AS n_granted, COALESCE(n_waved, 0) AS n_waved, ROUND(COALESCE(base, 0), 6) AS severity_points, COALESCE(mods, 0) AS modifier_points,
           ROUND(COALESCE(base, 0) + COALESCE(mods, 0) + CASE WHEN contains(lower(categories), 'thai') THEN 7 ELSE 0 END, 6) AS total_score
    FROM entities LEFT JOIN (
        SELECT k, business_id, COUNT(*) FILTER (WHERE staff_response = 'accommodated') AS n_granted, COUNT(*) FILTER (WHERE staff_response = 'dismissive') AS n_waved,
               SUM(CASE staff_response WHEN 'dismissive' THEN 9 ELSE 1 END * CASE WHEN y <= 2 THEN 1e0 WHEN y <= 4 THEN 0.5e0 ELSE 0.25e0 END) AS base,
               SUM(CASE incident_severity WHEN 'severe' THEN 12e0 WHEN 'mild' THEN 4e0 ELSE 0 END) AS mods
        FROM (SELECT *, 2022 - CAST(substr(date, 1, 4) AS INTEGER) AS y FROM judged) WHERE scored GROUP BY k, business_id) USING (k, business_id)""")
def _(spark, sf):
    """A11, X27."""
    out = verdicts.score_breakdown(ad.judged(spark, sf), cat.SCORE_POLICY["scoring"], cat.YEAR_RULES, ad.entities(spark, sf))
    return out.select(
        "k", "business_id", F.col("n_accommodated").cast("long").alias("n_granted"), F.col("n_dismissive").cast("long").alias("n_waved"),
        r6("severity_points"), r6("modifier_points"), r6("total_score"),
    )


@query("evidence_lists", ["judged"], """
    SELECT k, business_id, COUNT(*) AS n_incidents, string_agg(review_id, ',' ORDER BY review_id) AS ids FROM judged WHERE incident_severity IN ('mild', 'moderate', 'severe') GROUP BY k, business_id""")
def _(spark, sf):
    """A14."""
    rows = verdicts.evidence_rows(ad.judged(spark, sf), "S1P1", "incident_severity", ["mild", "moderate", "severe"])
    out = verdicts.evidence_lists(rows)
    return out.select("k", "business_id", "n_incidents", F.array_join("incidents.review_id", ",").alias("ids"))


@query("verdict_distribution", ["verdicts"], """
    SELECT policy_id, k, verdict, COUNT(business_id) AS cnt FROM (SELECT DISTINCT policy_id, k, v AS verdict FROM verdicts, (VALUES ('Low Risk'), ('High Risk'), ('Critical Risk')) x(v))
    LEFT JOIN verdicts USING (policy_id, k, verdict) GROUP BY policy_id, k, verdict""")
def _(spark, sf):
    """A16."""
    return verdicts.verdict_distribution(ad.verdict_table(spark, sf), cat.POLICIES)


@query("distribution_rollup", ["verdicts"], """
    SELECT k, verdict, cnt, ROUND(cnt / MAX(cnt) OVER (PARTITION BY k), 6) AS share FROM (SELECT k, verdict, COUNT(*) AS cnt FROM verdicts GROUP BY ROLLUP (k, verdict))""")
def _(spark, sf):
    """A17."""
    return verdicts.distribution_rollup(ad.verdict_table(spark, sf)).select("k", "verdict", "cnt", r6("share"))


@query("imbalance_report", ["verdicts"], """
    SELECT policy_id, k, arg_max(verdict, (cnt, verdict)) AS dominant, ROUND(MAX(cnt) / SUM(cnt), 6) AS share FROM
        (SELECT policy_id, k, verdict, COUNT(*) AS cnt FROM verdicts GROUP BY policy_id, k, verdict) GROUP BY policy_id, k HAVING MAX(cnt) / SUM(cnt) > 0.5""")
def _(spark, sf):
    """A18."""
    return verdicts.imbalance_report(ad.verdict_table(spark, sf), 0.5).select("policy_id", "k", "dominant", r6("share"))


@query("variant_diff", ["verdicts"], """
    SELECT k, verdict, COALESCE(a, 0) AS left_cnt, COALESCE(b, 0) AS right_cnt, COALESCE(b, 0) - COALESCE(a, 0) AS delta
    FROM (SELECT k, verdict, COUNT(*) AS a FROM verdicts WHERE policy_id = 'S1P1' GROUP BY k, verdict)
    FULL JOIN (SELECT k, verdict, COUNT(*) AS b FROM verdicts WHERE policy_id = 'S1P3' GROUP BY k, verdict) USING (k, verdict)""")
def _(spark, sf):
    """J18."""
    return verdicts.variant_difference(ad.verdict_table(spark, sf), "S1P1", "S1P3")


_PROGRAM = """SELECT *, goodwill - harshness * trade AS balance FROM (
        SELECT b.business_id, COUNT(*) FILTER (WHERE assurance_claim = 'true' AND staff_response <> 'dismissive') AS kept,
               COUNT(*) FILTER (WHERE assurance_claim = 'true' AND incident_severity IN ('moderate', 'severe')) AS broken,
               COALESCE(SUM(CASE staff_response WHEN 'accommodated' THEN 3e0 ELSE 1e0 END) FILTER (WHERE incident_severity IN ('none', 'mild')), 0) AS goodwill,
               COALESCE(SUM(CASE WHEN review_id IS NULL THEN 0e0 WHEN staff_response = 'dismissive' THEN 2.5e0 ELSE 0.5e0 END), 0) AS harshness,
               CASE WHEN contains(lower(categories), 'shop') THEN 0.5e0 WHEN contains(lower(categories), 'food') THEN 2e0 ELSE 1e0 END AS trade
        FROM businesses b LEFT JOIN (SELECT * FROM raw WHERE model = 'm-large' AND (incident_severity <> 'none' OR staff_response <> 'none' OR assurance_claim = 'true')) r
            USING (business_id) GROUP BY b.business_id, categories)"""


@query("formula_program", ["raw", "businesses"], f"""
    SELECT business_id, kept, broken, goodwill, harshness, trade, ROUND(balance, 6) AS balance,
           CASE WHEN balance > 6 THEN 'Low Risk' WHEN broken > kept THEN 'Critical Risk' ELSE 'High Risk' END AS verdict FROM ({_PROGRAM})""")
def _(spark, sf):
    """P1-P6, F14, UD5."""
    kept = formula.incidents_only(ad.large_model(spark, sf), cat.PROGRAM)
    out = formula.run_program(kept, cat.PROGRAM, ad.businesses(spark, sf), ["categories"])
    names = ["KEPT", "BROKEN", "GOODWILL", "HARSHNESS", "TRADE", "VERDICT"]
    return out.select("business_id", *[F.col(n).alias(n.lower()) for n in names], F.round("BALANCE", 6).alias("balance"))


_PAGE_KEYS = """SELECT key, MIN(page_id) AS pos, COUNT(*) AS value FROM (
        SELECT page_id, regexp_extract(url, '[^/?#]+/[a-z]+/[0-9]+', 0) AS key FROM pages) WHERE key <> '' GROUP BY key"""


@query("lookup_large_table", [], f"""
    SELECT p.page_id, COALESCE(h.value, 0) AS value FROM pages p LEFT JOIN (
        SELECT page_id, arg_min(t.value, t.pos) AS value FROM pages JOIN ({_PAGE_KEYS}) t ON contains(lower(url), lower(t.key)) GROUP BY page_id) h USING (page_id)""")
def _(spark, sf):
    """J12 with a table that grows with the data: addresses found inside page addresses."""
    pages = ad.table(spark, sf, "pages").select("page_id", "url")
    keyed = pages.select("page_id", F.regexp_extract("url", "[^/?#]+/[a-z]+/[0-9]+", 0).alias("key")).where("key <> ''")
    table = keyed.groupBy("key").agg(F.min("page_id").alias("pos"), F.count(F.lit(1)).alias("value"))
    return formula.lookup_joined(pages, F.col("url"), table, 0, "value").select("page_id", "value")


@query("triggered_rules", ["raw", "businesses"], f"""
    SELECT business_id, CASE WHEN balance > 6 THEN 'BALANCE > 6 (actual: BALANCE=' || CAST(balance AS VARCHAR) || ') → Low Risk'
                             WHEN broken > kept THEN 'BROKEN > KEPT (actual: KEPT=' || kept || ', BROKEN=' || broken || ') → Critical Risk'
                             ELSE 'else → High Risk' END AS rule FROM ({_PROGRAM})""")
def _(spark, sf):
    """P7, the text of every rule."""
    kept = formula.incidents_only(ad.large_model(spark, sf), cat.PROGRAM)
    out = formula.run_program(kept, cat.PROGRAM, ad.businesses(spark, sf), ["categories"])
    return out.select("business_id", formula.triggered_rule(out, cat.PROGRAM).alias("rule"))


_EVIDENCE = """SELECT business_id, review_id, field, judgement, ROW_NUMBER() OVER (PARTITION BY business_id ORDER BY review_id, i) AS n FROM (
        SELECT business_id, review_id, 0 AS i, 'incident_severity' AS field, incident_severity AS judgement FROM judg JOIN reviews USING (review_id) WHERE incident_severity <> 'none'
        UNION ALL SELECT business_id, review_id, 1, 'assurance_claim', assurance_claim FROM judg JOIN reviews USING (review_id) WHERE incident_severity <> 'none' AND assurance_claim = 'true'
        UNION ALL SELECT business_id, review_id, 2, 'staff_response', staff_response FROM judg JOIN reviews USING (review_id) WHERE incident_severity <> 'none' AND staff_response <> 'none')"""


def _incidents(spark, sf):
    """All reviews with an incident by their votes."""
    where = ad.reviews(spark, sf).select("review_id", "business_id")
    return ad.voted(spark, sf).where("fields['incident_severity'] <> 'none'").join(where, "review_id")


@query("field_evidence", ["judg", "reviews"], f"SELECT business_id, review_id, field, judgement, 'E' || n AS evidence_id FROM ({_EVIDENCE})")
def _(spark, sf):
    """F20."""
    return formula.evidence(_incidents(spark, sf), cat.PROGRAM)


@query("direct_evidence", ["judg", "reviews"], f"SELECT business_id, string_agg('E' || n, ',' ORDER BY n) AS ids FROM ({_EVIDENCE}) WHERE n <= 5 GROUP BY business_id")
def _(spark, sf):
    """P7."""
    rows = formula.evidence(_incidents(spark, sf), cat.PROGRAM)
    return formula.direct_evidence(rows).select("business_id", F.array_join("direct_evidence", ",").alias("ids"))


@query("threshold_texts", [], r"""
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN p_size || ' or more reviews name ' || p_name WHEN 'PROMO' THEN p_size || ' or more ' || p_name || ' seen'
           ELSE 'score is ' || CAST(p_retailprice AS BIGINT) || ' or higher for ' || p_name END AS text FROM part""")
def _(spark, sf):
    """X33."""
    parts = ad.table(spark, sf, "part")
    economy, promo = F.col("p_type") == "ECONOMY", F.col("p_type") == "PROMO"
    vague = F.when(economy, F.concat(F.lit("Several reviews name "), F.col("p_name"))).when(
        promo, F.concat(F.lit("7 or more "), F.col("p_name"), F.lit(" seen"))
    ).otherwise(F.concat(F.lit("score is 1 or higher for "), F.col("p_name")))
    price = F.when(~economy & ~promo, F.bround("p_retailprice").cast("long"))
    text = tx.score_threshold_text(tx.explicit_threshold(vague, F.col("p_size")), price)
    return parts.select("p_partkey", text.alias("text"))


def _pieces(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {norm('x')}), lambda x: length(x) >= 10)"


# The quotes of relevant rows, and all tiers of the quote check: whole, segments in reading order, shared words.
_QUOTED = rf"""
    SELECT COALESCE(trim(quote, ' '), '') = '' AS blank, COALESCE(q <> '' AND s <> '' AND (contains(s, q)
               OR len(present) > 0 AND len(present) / len(parts) >= 0.8 AND present = list_sort(list_distinct(present))
               OR len(words) >= 3 AND len(list_intersect(words, string_split(s, ' '))) / len(words) >= 0.8), FALSE) AS found
    FROM (SELECT *, list_distinct(string_split(q, ' ')) AS words, list_filter(list_transform(parts, lambda x:
                 CASE WHEN strpos(s, x) > 0 THEN strpos(s, x) ELSE strpos(s, regexp_replace(x, '[.,!?;:]+$', '')) END), lambda x: x > 0) AS present
          FROM (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN contains(quote, '...') AND len(b) > 0 THEN b ELSE w END AS parts FROM (
              SELECT quote, {norm('text')} AS s, {norm('quote')} AS q,
                     {_pieces(r"string_split(regexp_replace(quote, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1))")} AS a,
                     {_pieces("string_split(quote, '...')")} AS b, {_pieces("[quote]")} AS w
              FROM (SELECT text, CASE staff_response WHEN 'dismissive' THEN {full_upper('text')} WHEN 'accommodated' THEN 'zzz zzz qqq words never there' END AS quote
                    FROM raw JOIN reviews USING (review_id) WHERE model = 'm-large' AND is_relevant))))"""


@query("extraction_checks", ["raw", "reviews"], f"""
    SELECT COUNT(*) AS total_relevant, COUNT(*) FILTER (WHERE blank) AS rejected_no_quote, COUNT(*) FILTER (WHERE NOT blank AND NOT found) AS rejected_quote_not_found,
           COUNT(*) FILTER (WHERE NOT blank AND found) AS valid_quotes, COUNT(*) FILTER (WHERE NOT blank AND found) * 3 AS enum_valid, 0 AS enum_rejected
    FROM ({_QUOTED})""")
def _(spark, sf):
    """Dismissive rows quote the whole text, accommodated ones something else, others nothing."""
    text = ad.reviews(spark, sf).select("review_id", "text")
    staff = F.col("fields")["staff_response"]
    quote = F.when(staff == "dismissive", F.upper("text")).when(staff == "accommodated", F.lit("zzz zzz qqq words never there"))
    rows = ad.large_model(spark, sf).join(text, "review_id").withColumn("quote", quote)
    return formula.validation_counts(rows, cat.PROGRAM)


@query("rich_filter", ["raw"], """
    SELECT review_id, model, run FROM raw WHERE (incident_severity IN ('moderate', 'severe') OR staff_response = 'dismissive') AND account_type <> 'secondhand' AND assurance_claim = 'true'""")
def _(spark, sf):
    """F8, X8-X10."""
    cond = {
        "or": [{"Incident_Severity": ["Moderate incident", "severe"]}, {"field": "STAFF_RESPONSE", "equals": "Dismissive"}],
        "and": [{"field": "account_type", "not_equals": "secondhand"}], "assurance_claim": "true",
    }
    rows, value = with_values(ad.raw_judgments(spark, sf), sorted(fields_of(cond)), {"staff_response": cat.FIELDS["staff_response"]})
    return rows.where(rich_filter(value, cond)).select("review_id", "model", *longs("run"))


@query("event_filter", ["raw"], "SELECT review_id, model, run FROM raw WHERE (incident_severity = 'severe' OR staff_response = 'dismissive')")
def _(spark, sf):
    """F9."""
    conds = [{"field_id": "incident_severity", "values": ["severe"]}, {"field_id": "staff_response", "values": ["dismissive"]}]
    rows = ad.raw_judgments(spark, sf)
    lists = F.transform_values("fields", lambda _, v: F.array(v))
    return rows.where(event_matches(lists, conds, "ANY")).select("review_id", "model", *longs("run"))


@query("user_expressions", ["reviews"], """
    SELECT review_id, COALESCE(stars >= 3 AND useful > 2, FALSE) AS flag, ROUND(greatest(stars, useful) * 1.5e0, 6) AS number FROM reviews""")
def _(spark, sf):
    """UD4."""
    names = ["stars", "useful"]
    return ad.reviews(spark, sf).select(
        "review_id", user_flag("stars >= 3 and useful > 2", names).alias("flag"),
        F.round(user_number("greatest(stars, useful) * 1.5", names), 6).alias("number"),
    )


@query("enum_normalization", ["raw"], "SELECT review_id, model, run, incident_severity AS value, staff_response <> 'none' AS ok FROM raw")
def _(spark, sf):
    """Model wordings brought back to legal values."""
    s, staff = F.col("fields")["incident_severity"], F.col("fields")["staff_response"]
    wording = (
        F.when(s == "severe", "Anaphylactic shock").when(s == "moderate", "medium").when(s == "mild", " Slight rash ").otherwise("No allergy incident described")
    )
    return ad.raw_judgments(spark, sf).select(
        "review_id", "model", *longs("run"), vl.normalize_enum(wording, cat.FIELDS["incident_severity"]).alias("value"),
        (vl.repair_enum(staff, ["other", "dismissive", "accommodated"]) != "other").alias("ok"),
    )


@query("request_ids", ["raw"], """
    SELECT 'policy::G1_service::' || business_id || '::' || review_id || '::' || model || '::run' || run AS custom_id, review_id, CAST(run AS BIGINT) AS run FROM raw""")
def _(spark, sf):
    """X20."""
    rows = ad.raw_judgments(spark, sf)
    cid = vl.request_id(*[F.col(c) for c in ("topic", "business_id", "review_id", "model", "run")])
    parsed = rows.select(cid.alias("custom_id"), vl.parse_request_id(cid).alias("p"))
    return parsed.select("custom_id", "p.review_id", F.col("p.run").cast("long").alias("run"))


@query("policy_ids", ["verdicts"], """
    SELECT policy_id || business_id AS id, 'T' || (length(business_id) % 5) || 'P' || k % 7 AS policy_id,
           CASE WHEN k % 7 = 3 THEN 'T' || (length(business_id) % 5) || 'P3' ELSE CASE WHEN length(business_id) % 5 = 0 THEN 'service' ELSE 'T' || (length(business_id) % 5) END
                || CASE WHEN k % 7 = 2 THEN '_V2' ELSE '_V1' END END AS truth_id FROM verdicts""")
def _(spark, sf):
    """X37, J14."""
    pid = F.concat(F.lit("T"), (F.length("business_id") % 5).cast("string"), F.lit("P"), (F.col("k") % 7).cast("string"))
    return ad.verdict_table(spark, sf).select(
        F.concat("policy_id", "business_id").alias("id"), pid.alias("policy_id"), vl.truth_policy_id(pid, {"T0": "service"}).alias("truth_id")
    )


@query("review_ages", ["reviews"], "SELECT review_id, ROUND(date_diff('day', CAST(date AS DATE), DATE '2022-01-01') / 365.25e0, 6) AS age_years FROM reviews")
def _(spark, sf):
    """X28."""
    return ad.reviews(spark, sf).select("review_id", F.round(sc.age_years(F.col("date")), 6).alias("age_years"))


def term_values(spark, sf):
    """Field values seen per model as versions of a schema."""
    raw = ad.raw_judgments(spark, sf)
    return raw.select("model", F.explode("fields").alias("field", "value_id")).groupBy("model", "field", "value_id").agg(
        F.lit(0).alias("ord")
    ).withColumnRenamed("model", "version")


_TERMS = """(SELECT DISTINCT model AS version, field, value_id FROM (
    SELECT model, 'incident_severity' AS field, incident_severity AS value_id FROM raw UNION ALL SELECT model, 'account_type', account_type FROM raw
    UNION ALL SELECT model, 'assurance_claim', assurance_claim FROM raw UNION ALL SELECT model, 'staff_response', staff_response FROM raw))"""


@query("merged_schema", ["raw"], f"SELECT field, version, value_id FROM {_TERMS} WHERE version = 'm-large'")
def _(spark, sf):
    """U3."""
    return verdicts.merged_schema(term_values(spark, sf)).select("field", "version", "value_id")


@query("evidence_values", ["raw"], f"SELECT field, string_agg(DISTINCT value_id, ',' ORDER BY value_id) AS vals FROM {_TERMS} WHERE value_id NOT IN ('none', 'false') GROUP BY field")
def _(spark, sf):
    """U10."""
    rows = term_values(spark, sf).withColumn("is_default", F.col("value_id").isin("none", "false"))
    return verdicts.evidence_values(rows).select("field", F.array_join("evidence_values", ",").alias("vals"))


@query("config_difference", ["votes", "raw"], """
    SELECT review_id, CASE WHEN a IS NULL THEN 'right' ELSE 'left' END AS only_in FROM
        (SELECT review_id, value AS v, 1 AS a FROM votes WHERE field = 'incident_severity') l
        FULL JOIN (SELECT review_id, incident_severity AS v, 1 AS b FROM raw WHERE model = 'm-large') r USING (review_id, v) WHERE a IS NULL OR b IS NULL""")
def _(spark, sf):
    """Reviews whose vote differs from the large model."""
    s = F.col("fields")["incident_severity"].alias("v")
    out = verdicts.config_difference(ad.voted(spark, sf).select("review_id", s), ad.large_model(spark, sf).select("review_id", s), ["review_id", "v"])
    return out.select("review_id", "only_in")


@query("term_references", [], """
    SELECT DISTINCT p_type AS term_id, arg_min(p_brand, p_brand) AS domain, TRUE AS resolved FROM part GROUP BY p_type""")
def _(spark, sf):
    """Part types as terms, brands as domains; bare names take the first domain."""
    parts = ad.table(spark, sf, "part")
    terms = parts.select(F.col("p_brand").alias("domain"), F.col("p_brand").alias("domain_ord"), F.col("p_type").alias("term_id")).distinct()
    refs = parts.select(F.col("p_type").alias("ref")).distinct()
    return verdicts.resolve_terms(refs, terms).select("term_id", "domain", "resolved")


@query("policy_expansion", ["reviews"], "SELECT DISTINCT business_id || v AS policy_id FROM reviews, (VALUES ('P1'), ('P2'), ('P3')) x(v)")
def _(spark, sf):
    """U13."""
    topics = ad.reviews(spark, sf).select(F.col("business_id").alias("topic_id")).distinct()
    return verdicts.expand_policies(topics, ["P1", "P2", "P3"]).select("policy_id")


@query("illegal_values", ["raw"], """
    SELECT review_id, 'staff_response' AS field, staff_response AS value, 'unknown value' AS violation FROM raw WHERE model = 'm-large' AND staff_response = 'accommodated'
    UNION ALL SELECT review_id, 'assurance_claim', assurance_claim, 'unknown field' FROM raw WHERE model = 'm-large'""")
def _(spark, sf):
    """judgements against a schema that lacks a field and a value."""
    rows = [(f, v) for f, vs in cat.FIELDS.items() for v in vs if f != "assurance_claim" and v != "accommodated"]
    return validation.illegal_values(ad.large_model(spark, sf), dimension(spark, rows, "field string, value string"))


@query("duplicate_keys", ["stored"], "SELECT review_id, COUNT(*) AS n FROM stored GROUP BY review_id HAVING COUNT(*) > 1")
def _(spark, sf):
    """F22."""
    return validation.duplicate_keys(ad.stored_raw(spark, sf), ["review_id"])


@query("field_order", ["raw"], "SELECT review_id, 'account_type,incident_severity,assurance_claim,staff_response' AS names FROM raw WHERE model = 'm-large'")
def _(spark, sf):
    """X38, U12."""
    names = vl.preferred_order(F.map_keys("fields"), ["account_type", "unknown"])
    return ad.large_model(spark, sf).select("review_id", F.array_join(names, ",").alias("names"))
