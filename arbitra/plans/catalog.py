"""Configuration used by the registered queries: topics, policies, programs, gates, prices."""

from __future__ import annotations

SCALES = [10, 25, 50]
QUOTA = {"m-large": 1, "m-small-x": 3}
WEIGHTS = {"m-large": 2, "m-small-x": 1}
TOPIC = "G1_service"

FIELDS = {
    "incident_severity": ["none", "mild", "moderate", "severe"],
    "account_type": ["firsthand", "secondhand"],
    "assurance_claim": ["false", "true"],
    "staff_response": ["none", "accommodated", "dismissive"],
}

TOPICS = [
    {
        "topic": "G1_service", "group": "G1", "keywords": ["ing", "sch"],
        "critical": [("thing", 2.0), ("erble", 1.5), ("nicht", 2.5)],
        "high": [("tion", 1.0), ("attion", 1.5), ("erung", 2.0)],
    },
    {
        "topic": "G1_price", "group": "G1", "keywords": ["ea", "que"],
        "critical": [("thanedble", 3.0), ("eau[a-z]", 1.5), ("ent [a-z]+ing", 2.0)],
        "high": [("antion", 1.5), ("mente", 2.0)],
    },
    {
        "topic": "G1_place", "group": "G1", "keywords": ["th", "ch"],
        "critical": [("ontion", 2.0), ("enkeit", 2.5)],
        "high": [("retion", 1.5), ("outre", 2.0), ("ering", 1.0)],
    },
    {
        "topic": "G2_noise", "group": "G2", "keywords": ["on", "de"],
        "critical": [("license", 3.0), ("password|secret", 2.0)],
        "high": [("copyright", 2.0), ("@[a-z]+", 1.5)],
    },
]
CELLS = [(t["topic"], s) for t in TOPICS for s in ("critical", "high")]

VERDICTS = ["Low Risk", "High Risk", "Critical Risk"]


def _count(severity, n, by_k=None, **extra):
    return {
        "type": "count_threshold",
        "filter": {"incident_severity": severity, "account_type": "firsthand"},
        "min_count": n, "min_count_by_k": by_k or {}, **extra,
    }


ANY_POLICY = {
    "policy_id": "S1P1",
    "verdicts": VERDICTS,
    "rules": [
        {"verdict": "Critical Risk", "label": "CRITICAL", "logic": "ANY",
         "conditions": [_count("severe", 2), _count("moderate", 5)]},
        {"verdict": "High Risk", "label": "HIGH", "logic": "ANY",
         "conditions": [_count("moderate", 2), _count(["mild", "moderate"], 6, {10: 3})]},
        {"verdict": "Low Risk", "label": "LOW", "default": True},
    ],
}
ALL_POLICY = {
    "policy_id": "S1P3",
    "verdicts": VERDICTS,
    "rules": [{**r, "logic": "ALL"} if not r.get("default") else r for r in ANY_POLICY["rules"]],
}
COMPOUND_POLICY = {
    "policy_id": "S1P2",
    "verdicts": VERDICTS,
    "rules": [
        {"verdict": "Critical Risk", "label": "CRITICAL", "logic": "ANY", "conditions": [
            {"type": "compound", "filter": {"incident_severity": ["moderate", "severe"]},
             "requires": {"assurance_claim": "true"}, "min_count": 1},
        ]},
        {"verdict": "High Risk", "label": "HIGH", "logic": "ANY", "conditions": [
            {"type": "exists", "filter": {"staff_response": "dismissive", "incident_severity": "mild"}},
        ]},
        {"verdict": "Low Risk", "label": "LOW", "default": True},
    ],
}
WINDOW_POLICY = {
    "policy_id": "S1P4",
    "verdicts": VERDICTS,
    "rules": [
        {"verdict": "Critical Risk", "label": "RECENT", "logic": "ALL", "conditions": [
            {"type": "count", "filter": {"incident_severity": ["moderate", "severe"]},
             "within": {"years": 3}, "threshold": 2, "comparison": ">"},
            {"type": "exists", "filter": {"incident_severity": ["mild", "moderate", "severe"]},
             "most_recent": 5, "except": {"account_type": "secondhand"}},
        ]},
        {"verdict": "High Risk", "label": "SINCE", "logic": "ANY", "conditions": [
            {"type": "count", "filter": {"staff_response": "dismissive"}, "since": "2019-01-01",
             "threshold": 4, "comparison": ">="},
            {"type": "count", "filter": {"incident_severity": "mild"},
             "since_event": {"incident_severity": "severe"}, "threshold": 6, "comparison": ">="},
            {"type": "sum", "filter": {}, "value_field": "incident_severity",
             "points": {"mild": 1, "moderate": 3, "severe": 9}, "threshold": 40, "comparison": ">="},
        ]},
        {"verdict": "Low Risk", "label": "QUIET", "logic": "NONE", "conditions": [
            {"type": "max", "filter": {}, "value_field": "incident_severity",
             "points": {"mild": 1, "moderate": 3, "severe": 9}, "threshold": 9, "comparison": ">="},
        ]},
        {"verdict": "High Risk", "label": "OTHER", "default": True},
    ],
}
# How guests' wishes are met: every answered wish counts, harm to the guest makes it worse.
SCORE_POLICY = {
    "policy_id": "S1V3",
    "verdicts": VERDICTS,
    "rules": [{"verdict": "Low Risk", "label": "LOW", "default": True}],
    "scoring": {
        "severity_field": "staff_response",
        "value_labels": {"accommodated": "Wish granted", "dismissive": "Wish waved off"},
        "severity_points": [("Wish granted", 1), ("Wish waved off", 9)],
        "modifiers": [("Guest was harmed", 12), ("Guest was bothered", 4), ("Crowded trade", 7)],
        "modifier_fields": [("incident_severity", "severe", "Guest was harmed"),
                            ("incident_severity", "mild", "Guest was bothered")],
        "cuisine_label": "Crowded trade",
        "thresholds": [
            {"verdict": "Critical Risk", "min_score": 70, "min_score_by_k": {10: 30}},
            {"verdict": "High Risk", "min_score": 24, "min_score_by_k": {10: 11}},
        ],
    },
}
RECENCY_POLICY = {
    **SCORE_POLICY,
    "policy_id": "S1V4",
    "scoring": {
        **SCORE_POLICY["scoring"],
        "recency": "max_age",
        "recency_rules": [
            {"age": "within the last 1 year", "weight": "all of it", "max_age_years": 1.0, "weight_multiplier": 1.0},
            {"age": "1 to 2 years back", "weight": "one half", "max_age_years": 2.0, "weight_multiplier": 0.5},
            {"age": "over 2 years back", "weight": "one quarter", "max_age_years": 999, "weight_multiplier": 0.25},
        ],
    },
}
TEXT_RECENCY_POLICY = {
    **RECENCY_POLICY, "policy_id": "S1V5", "scoring": {**RECENCY_POLICY["scoring"], "recency": "text"},
}
POLICIES = [ANY_POLICY, ALL_POLICY, COMPOUND_POLICY, SCORE_POLICY, RECENCY_POLICY]
YEAR_RULES = [("within", 0, 2, 1.0), ("range", 3, 4, 0.5), ("older", 4, 0, 0.25)]

# Promises made to guests: kept ones and goodwill against harshness, by trade.
PROGRAM = {
    "extract": {
        "none_values": ["none", "n/a", "false"],
        "fields": [
            {"name": f.upper(), "type": "enum", "values": dict.fromkeys(FIELDS[f], "")}
            for f in ("incident_severity", "assurance_claim", "staff_response")
        ],
    },
    "compute": [
        {"name": "KEPT", "op": "count",
         "where": {"ASSURANCE_CLAIM": "true", "STAFF_RESPONSE": ["none", "accommodated"]}},
        {"name": "BROKEN", "op": "count",
         "where": {"ASSURANCE_CLAIM": "true", "INCIDENT_SEVERITY": ["moderate", "severe"]}},
        {"name": "GOODWILL", "op": "sum", "where": {"INCIDENT_SEVERITY": ["none", "mild"]},
         "expr": "CASE WHEN STAFF_RESPONSE = 'accommodated' THEN 3 ELSE 1 END"},
        {"name": "HARSHNESS", "op": "case", "source": "STAFF_RESPONSE",
         "rules": [{"when": "dismissive", "then": 2.5}, {"else": 0.5}]},
        {"name": "TRADE", "op": "lookup", "source": "context.categories",
         "table": {"shop": 0.5, "food": 2.0}, "default": 1.0},
        {"name": "BALANCE", "op": "expr", "expr": "GOODWILL - HARSHNESS * TRADE"},
        {"name": "VERDICT", "op": "case", "source": "BALANCE",
         "rules": [{"when": "> 6", "then": "Low Risk"}, {"when": "BROKEN > KEPT", "then": "Critical Risk"},
                   {"else": "High Risk"}]},
    ],
    "output": ["VERDICT", "BALANCE", "KEPT", "BROKEN"],
}

GATE_QUERIES = {
    "g_service_pos": "thing erble", "g_service_neg": "nicht", "g_price_pos": "thanedble",
    "g_price_neg": "que mente", "g_place_pos": "the of", "g_place_neg": "outre outre eau",
}
PRIMITIVES = [
    {"primitive_id": "Critical Risk_clause_1", "label": "Critical Risk", "min_count": 2, "logic": "ALL",
     "conditions": [{"field_id": "incident_severity", "values": ["severe"]}]},
    {"primitive_id": "Critical Risk_clause_2", "label": "Critical Risk", "min_count": 4, "logic": "ALL",
     "conditions": [{"field_id": "incident_severity", "values": ["moderate"]},
                    {"field_id": "account_type", "values": ["firsthand"]}]},
    {"primitive_id": "High Risk_clause_1", "label": "High Risk", "min_count": 3, "logic": "ANY",
     "conditions": [{"field_id": "staff_response", "values": ["dismissive"]},
                    {"field_id": "incident_severity", "values": ["mild"]}]},
]
PRIMITIVE_IDS = [p["primitive_id"] for p in PRIMITIVES]
RULES = [
    {"label": "Critical Risk", "connective": "ALL", "primitive_ids": PRIMITIVE_IDS[:2]},
    {"label": "High Risk", "connective": "ANY", "primitive_ids": PRIMITIVE_IDS[2:]},
]
GATES = [
    ("g_service_pos", [PRIMITIVE_IDS[0], PRIMITIVE_IDS[2]], "bm25", "pos"),
    ("g_service_neg", [PRIMITIVE_IDS[0]], "bm25", "neg"),
    ("g_price_pos", [PRIMITIVE_IDS[1]], "bm25", "pos"),
    ("g_price_neg", [PRIMITIVE_IDS[1], PRIMITIVE_IDS[2]], "bm25", "neg"),
    ("g_place_pos", [PRIMITIVE_IDS[0], PRIMITIVE_IDS[1]], "bm25", "pos"),
    ("g_place_neg", [PRIMITIVE_IDS[2]], "bm25", "neg"),
]
BINS, GAMMA = 5, 0.5

PRICES = {"view": (0.05, 0.40), "click": (0.25, 2.0), "purchase": (1.25, 10.0), "signup": (2.5, 10.0)}
