"""SQL definitions of the adapters and shared intermediate tables, for the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Sequence

from arbitra.functions.text import WHITESPACE
from arbitra.plans import catalog as cat


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{WHITESPACE}', ' ', 'g'))"


def full_upper(text: str) -> str:
    """Upper case as Unicode and Spark have it; ``upper`` leaves characters that become several, as ß."""
    for several in (c for c in map(chr, range(0x10000)) if len(c.upper()) > 1):
        text = f"replace({text}, '{several}', '{several.upper()}')"
    return f"upper({text})"


def toks(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def _topic_union() -> str:
    def score(patterns, boost):
        parts = [f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w}e0{boost} ELSE 0 END" for p, w in patterns]
        return " + ".join(parts)

    selects = []
    for t in cat.TOPICS:
        gate = " OR ".join(f"contains(lower(text), '{k}')" for k in t["keywords"])
        boost = " * CASE WHEN stars <= 2 THEN 1.5e0 ELSE 1e0 END"
        selects.append(
            f"SELECT '{t['topic']}' AS topic, '{t['group']}' AS grp, review_id, business_id, pos, date, "
            f"{score(t['critical'], boost)} AS c, {score(t['high'], '')} AS h FROM reviews WHERE {gate}"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(selects) + ") WHERE c > 0 OR h > 0"


def _bm25_union() -> str:
    import re

    rows = []
    for q, text in cat.GATE_QUERIES.items():
        terms = [t.lower() for t in re.findall("[A-Za-z0-9]+", text)]
        rows += [f"('{q}', '{t}', {terms.count(t)}, {len(set(terms))})" for t in sorted(set(terms))]
    return ", ".join(rows)


POINTS = "CASE {c} WHEN 'severe' THEN 15 WHEN 'moderate' THEN 5 WHEN 'mild' THEN 2 ELSE 0 END"

_SCALES = ", ".join(f"({k})" for k in cat.SCALES)
_PRIMITIVES = ", ".join(
    f"('{p['primitive_id']}', '{p['label']}', {p['min_count']}, {int(p['label'] == 'Critical Risk')}, {i})"
    for i, p in enumerate(cat.PRIMITIVES)
)
_GATES = ", ".join(f"('{g}', '{p}', '{m}', '{s}')" for g, ps, m, s in cat.GATES for p in ps)

# name: (needed fragments, body)
FRAGMENTS: dict[str, tuple[list[str], str]] = {
    "reviews": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_id, doc_id AS user_id,
               CAST(1 + doc_id % 5 AS DOUBLE) AS stars, n_chars % 7 AS useful,
               strftime(DATE '2015-01-01' + CAST(doc_id * 37 % 2500 AS INTEGER), '%Y-%m-%d') AS date,
               text, lang, doc_id AS pos, n_chars
        FROM documents"""),
    "businesses": ([], """
        SELECT source AS business_id, upper(source) AS name,
               'City' || (CAST(substr(source, 4) AS INTEGER) % 4) AS city, 'ST' AS state,
               AVG(CAST(1 + doc_id % 5 AS DOUBLE)) AS stars, COUNT(*) AS review_count,
               CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'Thai, Restaurants'
                    WHEN 1 THEN 'Bars, Food' ELSE 'Shopping' END AS categories
        FROM documents GROUP BY source"""),
    "raw": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_id, model, run, ord, w,
               CASE WHEN h < 6 THEN 'severe' WHEN h < 18 THEN 'moderate' WHEN h < 35 THEN 'mild' ELSE 'none' END AS incident_severity,
               CASE WHEN g % 4 = 0 THEN 'secondhand' ELSE 'firsthand' END AS account_type,
               CASE WHEN g % 5 = 0 THEN 'true' ELSE 'false' END AS assurance_claim,
               CASE g % 3 WHEN 0 THEN 'dismissive' WHEN 1 THEN 'accommodated' ELSE 'none' END AS staff_response,
               h < 35 OR g % 2 = 0 AS is_relevant
        FROM (SELECT *, (q + run * 4 + length(model) * 5) % 101 AS h, (q * 3 + run * 13 + ord) % 97 AS g
              FROM (SELECT doc_id, source, (d * d * 31 + d * 7919) % 10007 AS q
                    FROM (SELECT doc_id, source, doc_id % 10007 AS d FROM documents)),
                   (VALUES ('m-large', 1, 2, 0), ('m-small-x', 1, 1, 1), ('m-small-x', 2, 1, 2), ('m-small-x', 3, 1, 3)) m(model, run, w, ord))"""),
    "stored": (["raw"], """
        SELECT * FROM raw WHERE run < 3 OR review_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""),
    "tally": (["raw"], """
        SELECT review_id, field, value, SUM(w) AS w, MIN(ord) AS ord FROM (
            SELECT review_id, w, ord, 'incident_severity' AS field, incident_severity AS value FROM raw
            UNION ALL SELECT review_id, w, ord, 'account_type', account_type FROM raw
            UNION ALL SELECT review_id, w, ord, 'assurance_claim', assurance_claim FROM raw
            UNION ALL SELECT review_id, w, ord, 'staff_response', staff_response FROM raw
            UNION ALL SELECT review_id, w, ord, 'is_relevant', CAST(is_relevant AS VARCHAR) FROM raw)
        GROUP BY review_id, field, value"""),
    "votes": (["tally"], """
        SELECT review_id, field, arg_max(value, w * 1000 - ord) AS value, ROUND(MAX(w) / SUM(w), 3) AS confidence
        FROM tally GROUP BY review_id, field"""),
    "judg": (["votes"], """
        SELECT review_id, MAX(CASE WHEN field = 'incident_severity' THEN value END) AS incident_severity,
               MAX(CASE WHEN field = 'account_type' THEN value END) AS account_type,
               MAX(CASE WHEN field = 'assurance_claim' THEN value END) AS assurance_claim,
               MAX(CASE WHEN field = 'staff_response' THEN value END) AS staff_response,
               BOOL_OR(field = 'is_relevant' AND value = 'true') AS is_relevant
        FROM votes GROUP BY review_id"""),
    "ranked": (["reviews"], """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY business_id ORDER BY date DESC, pos) AS rn FROM reviews"""),
    "kreviews": (["ranked"], f"SELECT k, ranked.* FROM ranked JOIN (VALUES {_SCALES}) t(k) ON rn <= k"),
    "judged": (["kreviews", "judg"], f"""
        SELECT kreviews.*, judg.* EXCLUDE (review_id),
               CASE staff_response WHEN 'dismissive' THEN 9 WHEN 'accommodated' THEN 1 ELSE 0 END
               + CASE incident_severity WHEN 'severe' THEN 12 WHEN 'mild' THEN 4 ELSE 0 END AS points,
               is_relevant AND account_type = 'firsthand' AND staff_response <> 'none' AS scored,
               date_diff('day', CAST(date AS DATE), DATE '2022-01-01') / 365.25e0 AS age
        FROM kreviews LEFT JOIN judg USING (review_id)"""),
    "entities": (["businesses"], f"SELECT business_id, categories, k FROM businesses, (VALUES {_SCALES}) t(k)"),
    "counts": (["judged", "entities"], """
        SELECT k, business_id, categories,
               COUNT(*) FILTER (WHERE rel AND incident_severity = 'severe' AND account_type = 'firsthand') AS c_severe,
               COUNT(*) FILTER (WHERE rel AND incident_severity = 'moderate' AND account_type = 'firsthand') AS c_moderate,
               COUNT(*) FILTER (WHERE rel AND incident_severity IN ('mild', 'moderate') AND account_type = 'firsthand') AS c_low,
               COUNT(*) FILTER (WHERE rel AND incident_severity IN ('moderate', 'severe') AND assurance_claim = 'true') AS c_assured,
               COUNT(*) FILTER (WHERE rel AND incident_severity = 'mild' AND staff_response = 'dismissive') AS c_staff,
               COUNT(*) FILTER (WHERE scored) AS n_inc,
               COALESCE(SUM(points) FILTER (WHERE scored), 0) AS s_plain,
               COALESCE(SUM(CAST(trunc(points * CASE WHEN age <= 1 THEN 1e0 WHEN age <= 2 THEN 0.5e0 ELSE 0.25e0 END) AS BIGINT)) FILTER (WHERE scored), 0) AS s_recent
        FROM (SELECT e.*, j.* EXCLUDE (k, business_id), COALESCE(j.is_relevant, FALSE) AS rel
              FROM entities e LEFT JOIN judged j USING (k, business_id))
        GROUP BY k, business_id, categories"""),
    "verdicts": (["counts"], """
        SELECT 'S1P1' AS policy_id, k, business_id,
               CASE WHEN c_severe >= 2 OR c_moderate >= 5 THEN 'Critical Risk'
                    WHEN c_moderate >= 2 OR c_low >= CASE k WHEN 10 THEN 3 ELSE 6 END THEN 'High Risk' ELSE 'Low Risk' END AS verdict,
               CASE WHEN c_severe >= 2 OR c_moderate >= 5 THEN 'CRITICAL'
                    WHEN c_moderate >= 2 OR c_low >= CASE k WHEN 10 THEN 3 ELSE 6 END THEN 'HIGH' ELSE 'LOW' END AS matched_rule,
               CAST(NULL AS BIGINT) AS score, CAST(NULL AS BIGINT) AS n_incidents FROM counts
        UNION ALL SELECT 'S1P3', k, business_id,
               CASE WHEN c_severe >= 2 AND c_moderate >= 5 THEN 'Critical Risk'
                    WHEN c_moderate >= 2 AND c_low >= CASE k WHEN 10 THEN 3 ELSE 6 END THEN 'High Risk' ELSE 'Low Risk' END,
               CASE WHEN c_severe >= 2 AND c_moderate >= 5 THEN 'CRITICAL'
                    WHEN c_moderate >= 2 AND c_low >= CASE k WHEN 10 THEN 3 ELSE 6 END THEN 'HIGH' ELSE 'LOW' END, NULL, NULL FROM counts
        UNION ALL SELECT 'S1P2', k, business_id,
               CASE WHEN c_assured >= 1 THEN 'Critical Risk' WHEN c_staff >= 1 THEN 'High Risk' ELSE 'Low Risk' END,
               CASE WHEN c_assured >= 1 THEN 'CRITICAL' WHEN c_staff >= 1 THEN 'HIGH' ELSE 'LOW' END, NULL, NULL FROM counts
        UNION ALL SELECT policy_id, k, business_id,
               CASE WHEN s >= CASE k WHEN 10 THEN 30 ELSE 70 END THEN 'Critical Risk'
                    WHEN s >= CASE k WHEN 10 THEN 11 ELSE 24 END THEN 'High Risk' ELSE 'Low Risk' END,
               NULL, CAST(s AS BIGINT), n_inc
        FROM (SELECT p AS policy_id, k, business_id, n_inc,
                     CASE p WHEN 'S1V3' THEN s_plain ELSE s_recent END
                     + CASE WHEN contains(lower(categories), 'thai') AND n_inc > 0 THEN 7 ELSE 0 END AS s
              FROM counts, (VALUES ('S1V3'), ('S1V4')) v(p))"""),
    "overrides": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS review_id, CASE WHEN toxic = 1 THEN 'read by hand' ELSE 'keyword' END AS reason, toxic
        FROM labels WHERE toxic = 1 OR quality = 0"""),
    "scored": (["reviews"], _topic_union()),
    "biz_scores": (["scored"], """
        SELECT *, CASE WHEN max_critical_score >= 4 THEN 'critical' ELSE 'high' END AS severity FROM (
            SELECT topic, grp, business_id, MAX(c) AS max_critical_score, MAX(h) AS max_high_score, SUM(c) AS total_critical_score,
                   SUM(h) AS total_high_score, COUNT(*) AS topic_reviews, COUNT(*) FILTER (WHERE c > 0) AS critical_review_count,
                   COUNT(*) FILTER (WHERE h > 0) AS high_review_count
            FROM scored GROUP BY topic, grp, business_id)
        WHERE max_critical_score >= 2 OR max_high_score >= 3"""),
    "cells": (["biz_scores"], """
        SELECT business_id, COUNT(*) AS cell_count, COUNT(DISTINCT topic) AS topic_count,
               SUM(CASE WHEN severity = 'critical' THEN max_critical_score ELSE max_high_score END) AS total_value,
               string_agg(topic || '|' || severity, ',' ORDER BY topic, severity) AS cells
        FROM biz_scores GROUP BY business_id"""),
    "docs": ([], "SELECT CAST(doc_id AS VARCHAR) AS review_id, n_chars, lang, text FROM documents"),
    "predictions": (["raw", "judg", "docs"], f"""
        SELECT r.review_id AS business_id,
               CASE r.incident_severity WHEN 'severe' THEN 'Critical Risk' WHEN 'moderate' THEN '''High Risk''' WHEN 'mild' THEN 'HIGH_RISK' ELSE 'Low Risk' END AS verdict,
               CASE r.incident_severity WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 WHEN 'mild' THEN 1 ELSE 0 END AS y_pred,
               CASE WHEN n_chars % 3 <> 0 THEN (n_chars % 100) / 10e0 END AS risk_score,
               CASE WHEN lang = 'es' THEN 'timeout' END AS error,
               CASE j.incident_severity WHEN 'severe' THEN 2 WHEN 'moderate' THEN 1 WHEN 'mild' THEN 0 END AS rule_ord,
               CASE WHEN lang = 'de' THEN NULL ELSE {POINTS.format(c='r.incident_severity')} END AS claimed_score
        FROM raw r JOIN docs USING (review_id) JOIN judg j USING (review_id) WHERE model = 'm-large'"""),
    "truth": (["judg"], f"""
        SELECT CAST(doc_id AS VARCHAR) AS business_id,
               CASE WHEN toxic = 1 THEN 'Critical Risk' WHEN quality = 0 THEN 'High Risk' ELSE 'Low Risk' END AS verdict,
               CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS y_true,
               {POINTS.format(c='incident_severity')} AS score
        FROM labels JOIN judg ON review_id = CAST(doc_id AS VARCHAR)"""),
    "pairs": (["predictions", "truth"], """
        SELECT business_id, y_pred, y_true, COALESCE(risk_score, y_pred * 5e0) AS risk_score
        FROM predictions JOIN truth USING (business_id) WHERE error IS NULL"""),
    "claims": (["raw", "reviews"], """
        SELECT business_id, review_id, e.field AS field, e.judgement AS judgement, snippet, lang, text, lang <> 'de' AS is_direct FROM (
            SELECT r.business_id, review_id, UNNEST([
                       {'field': 'INCIDENT_SEVERITY', 'judgement': incident_severity || ' incident'},
                       CASE WHEN assurance_claim = 'true' THEN {'field': 'ASSURANCE_OF_SAFETY', 'judgement': 'Yes'} END,
                       {'field': 'STAFF_RESPONSE', 'judgement': staff_response}]) AS e,
                   lang, text,
                   CASE lang WHEN 'en' THEN substring(text, 11, 80) WHEN 'fr' THEN 'not said anywhere in it'
                        ELSE substring(text, 1, 40) || '... ' || right(text, 30) END AS snippet
            FROM raw r JOIN reviews v USING (review_id) WHERE model = 'm-large' AND incident_severity <> 'none')
        WHERE e IS NOT NULL"""),
    "incidents": (["judg", "reviews"], """
        SELECT business_id, review_id, incident_severity AS value, assurance_claim = 'true' AS assured, staff_response = 'dismissive' AS dismissed
        FROM judg JOIN reviews USING (review_id) WHERE is_relevant AND incident_severity <> 'none'"""),
    "biz_pred": (["raw"], f"""
        SELECT business_id, total, CASE WHEN total >= 60 THEN 'Critical Risk' WHEN total >= 4 THEN 'HIGH_RISK' ELSE 'Low Risk' END AS verdict
        FROM (SELECT business_id, SUM({POINTS.format(c='incident_severity')}) AS total FROM raw WHERE model = 'm-large' GROUP BY business_id)"""),
    "usage": ([], """
        SELECT *, prompt_tokens / 1000000e0 * pin + completion_tokens / 1000000e0 * pout AS cost_usd FROM (
            SELECT event_id, ts, event_type AS model, user_id, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, value AS latency_ms,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) AS completion_tokens,
                   CASE event_type WHEN 'view' THEN 0.05e0 WHEN 'click' THEN 0.25e0 WHEN 'purchase' THEN 1.25e0 WHEN 'signup' THEN 2.5e0 ELSE 1e0 END AS pin,
                   CASE event_type WHEN 'view' THEN 0.4e0 WHEN 'click' THEN 2e0 WHEN 'purchase' THEN 10e0 WHEN 'signup' THEN 10e0 ELSE 3e0 END AS pout
            FROM events)"""),
    "doc_tokens": ([], f"SELECT CAST(doc_id AS VARCHAR) AS review_id, {toks('text')} AS tok FROM documents"),
    "postings": (["doc_tokens"], """
        SELECT review_id, token, COUNT(*) AS tf FROM (SELECT review_id, UNNEST(tok) AS token FROM doc_tokens) GROUP BY review_id, token"""),
    "bm25": (["doc_tokens", "postings"], f"""
        SELECT query_id, review_id, SUM(times * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * (dl / (avg_len + 1e-9))) + 1e-9)) AS score
        FROM (VALUES {_bm25_union()}) q(query_id, token, times, needed)
        JOIN postings USING (token)
        JOIN (SELECT token, COUNT(*) AS df FROM postings GROUP BY token) USING (token)
        JOIN (SELECT review_id, len(tok) AS dl FROM doc_tokens) USING (review_id),
             (SELECT COUNT(*) AS n, AVG(len(tok)) AS avg_len FROM doc_tokens)
        GROUP BY query_id, review_id, needed HAVING COUNT(*) = needed"""),
    "prims": ([], f"SELECT * FROM (VALUES {_PRIMITIVES}) p(primitive_id, label, min_count, top, ord)"),
    "gate_members": ([], f"SELECT * FROM (VALUES {_GATES}) g(gate_id, primitive_id, modality, polarity)"),
    "pools": (["bm25", "gate_members", "prims"], """
        SELECT primitive_id, modality, polarity, review_id, COALESCE(MAX(score), 0) AS score
        FROM (SELECT primitive_id, modality, polarity, CAST(doc_id AS VARCHAR) AS review_id FROM documents, prims,
                     (VALUES ('bm25'), ('emb')) m(modality), (VALUES ('pos'), ('neg')) s(polarity)) grid
        LEFT JOIN (SELECT m.*, b.review_id, b.score FROM gate_members m JOIN bm25 b ON b.query_id = m.gate_id) x
             USING (primitive_id, modality, polarity, review_id)
        GROUP BY primitive_id, modality, polarity, review_id"""),
    "z": (["pools"], f"""
        SELECT primitive_id, review_id,
               MAX(CASE WHEN polarity = 'pos' THEN r END) - {cat.GAMMA} * MAX(CASE WHEN polarity = 'neg' THEN r END) AS z
        FROM (SELECT *, (RANK() OVER (PARTITION BY primitive_id, modality, polarity ORDER BY score) - 1
                      + (COUNT(*) OVER (PARTITION BY primitive_id, modality, polarity, score) - 1) / 2e0)
                      / (COUNT(*) OVER (PARTITION BY primitive_id, modality, polarity) - 1) AS r
              FROM (SELECT * REPLACE (ROUND(score, 9) AS score) FROM pools))
        GROUP BY primitive_id, review_id"""),
    "zb": (["z"], f"""
        SELECT z.*, len(list_filter(edges, lambda e: e < z)) AS bin FROM z JOIN (
            SELECT primitive_id, quantile_cont(z, [{', '.join(str(i / cat.BINS) for i in range(1, cat.BINS))}]) AS edges FROM z GROUP BY primitive_id)
        USING (primitive_id)"""),
    "tags": (["raw", "prims"], """
        SELECT review_id, business_id, primitive_id,
               CAST(CASE ord WHEN 0 THEN incident_severity = 'severe' WHEN 1 THEN incident_severity = 'moderate' AND account_type = 'firsthand'
                        ELSE incident_severity = 'mild' OR staff_response = 'dismissive' END AS BIGINT) AS y
        FROM (SELECT r.* EXCLUDE (ord) FROM raw r JOIN labels ON CAST(doc_id AS VARCHAR) = review_id WHERE model = 'm-large'), prims"""),
    "calib": (["tags", "zb", "prims"], f"""
        SELECT primitive_id, bin, 1e0 + COALESCE(SUM(CAST(y > 0 AS INTEGER)), 0) AS alpha, 1e0 + COALESCE(SUM(CAST(y <= 0 AS INTEGER)), 0) AS beta
        FROM (SELECT primitive_id, CAST(bin AS BIGINT) AS bin FROM prims, range({cat.BINS}) b(bin)) grid
        LEFT JOIN (SELECT t.*, zb.bin FROM tags t JOIN zb USING (primitive_id, review_id)) x USING (primitive_id, bin)
        GROUP BY primitive_id, bin"""),
    "open_z": (["zb", "tags", "reviews"], """
        SELECT zb.*, business_id FROM zb JOIN reviews USING (review_id) WHERE review_id NOT IN (SELECT review_id FROM tags)"""),
    "open_bins": (["open_z"], "SELECT business_id, primitive_id, bin, COUNT(*) AS n FROM open_z GROUP BY business_id, primitive_id, bin"),
    "deficits": (["tags", "prims", "businesses"], """
        SELECT b.business_id, p.*, COALESCE(n, 0) AS n, greatest(0, min_count - COALESCE(n, 0)) AS deficit
        FROM businesses b CROSS JOIN prims p
        LEFT JOIN (SELECT business_id, primitive_id, SUM(y) AS n FROM tags WHERE y > 0 GROUP BY business_id, primitive_id) t
             ON t.business_id = b.business_id AND t.primitive_id = p.primitive_id"""),
}


def sql(needs: Sequence[str], body: str, recursive: bool = False) -> str:
    """The body after a WITH clause of everything it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in FRAGMENTS[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        add(n)
    if recursive:
        return "WITH RECURSIVE " + ",\n".join([f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})" for n in ordered] + [body])
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered) + "\n" + body
