from pyspark.sql import functions as F

from arbitra.operators import judgments as jd
from arbitra.operators import verdicts as vd
from arbitra.functions import scoring as sc
from arbitra.plans import catalog as cat

RAW = "topic string, review_id string, model string, run int, ord int, is_relevant boolean, fields map<string,string>, date string"
WEIGHTS = {"big": 2, "small": 1}


def raw(spark, rows):
    return spark.createDataFrame([("t", r, m, n, o, rel, f, "2020-01-01") for r, m, n, o, rel, f in rows], RAW)


def votes(spark, rows):
    got = jd.vote(raw(spark, rows), ["sev"], WEIGHTS).collect()
    return {(r["review_id"], r["field"]): (r["value"], r["confidence"]) for r in got}


def test_weights_ties_and_missing(spark):
    rows = [
        ("a", "big", 1, 0, True, {"sev": "mild"}), ("a", "small", 1, 1, True, {"sev": "severe"}), ("a", "small", 2, 2, False, {"sev": "severe"}),
        ("b", "small", 1, 0, None, {}), ("b", "other", 1, 1, False, {"sev": "mild"}), ("b", "big", 1, 2, True, {"sev": "mild"}),
    ]
    got = votes(spark, rows)
    assert got["a", "sev"] == ("mild", 0.5)          # 2 against 1 + 1: first voted wins
    assert got["b", "sev"] == ("mild", 0.75)         # a missing field votes "none"
    assert got["a", "is_relevant"][0] == "true" and got["b", "is_relevant"] == ("false", 0.5)


def test_declared_path_equals_general_path(spark):
    import random

    rng = random.Random(9)
    rows = []
    for i in range(300):
        for o in range(rng.randint(1, 5)):
            fields = {n: rng.choice(["none", "mild", "severe"] + (["weird"] if i % 10 == 0 else [])) for n in ("sev", "x") if rng.random() < 0.8}
            rows.append((f"r{i}", rng.choice(["big", "small", "other"]), o, o, rng.choice([True, False, None]), fields))
    df = raw(spark, rows)
    key = lambda r: (r["review_id"], r["is_relevant"], sorted(r["fields"].items()), sorted(r["confidence"].items()))
    general = sorted(key(r) for r in jd.aggregate(df, ["sev", "x"], WEIGHTS).collect())
    declared = sorted(key(r) for r in jd.aggregate(df, {"sev": ["none", "mild", "severe"], "x": ["mild", "severe"]}, WEIGHTS).collect())
    assert declared == general and len(general) == 300
    assert any("weird" in dict(k[2]).values() for k in general)


def test_confidence_shares_add_up(spark):
    rows = [("a", "small", i, i, True, {"sev": v}) for i, v in enumerate(["x", "y", "y", "z", "y"])]
    assert votes(spark, rows)["a", "sev"] == ("y", 0.6)


def test_hot_review_votes(spark):
    many = spark.range(20000).select(
        F.lit("t").alias("topic"), F.lit("hot").alias("review_id"), F.lit("small").alias("model"), F.col("id").cast("int").alias("run"),
        F.col("id").cast("int").alias("ord"), F.lit(True).alias("is_relevant"), F.create_map(F.lit("sev"), F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("fields"), F.lit("").alias("date"),
    )
    got = {r["field"]: r["value"] for r in jd.vote(many, ["sev"], WEIGHTS).collect()}
    assert got == {"sev": "b", "is_relevant": "true"}


def test_overrides_manual_first(spark):
    judged = jd.aggregate(raw(spark, [("a", "big", 1, 0, True, {"sev": "mild", "x": "1"}), ("b", "big", 1, 0, True, {"sev": "mild"})]), ["sev", "x"], WEIGHTS)
    over = spark.createDataFrame(
        [("t", "a", 1, {"sev": "none"}, "keyword"), ("t", "a", 0, {"sev": "severe", "new": "v"}, "read")],
        "topic string, review_id string, priority int, corrected map<string,string>, reason string",
    )
    got = {r["review_id"]: r for r in jd.apply_overrides(judged, over).collect()}
    assert got["a"]["fields"] == {"sev": "severe", "x": "1", "new": "v"} and got["a"]["override_reason"] == "read"
    assert not got["b"]["override_applied"]


def test_missing_runs_and_quota(spark):
    rows = [("a", "big", 1, 0, True, {}), ("a", "small", 2, 1, True, {}), ("b", "big", 1, 0, True, {}), ("b", "small", 1, 1, True, {}), ("b", "small", 2, 2, True, {}), ("b", "small", 2, 3, True, {})]
    quota = {"big": 1, "small": 2}
    reviews = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "topic string, review_id string")
    got = {(r["review_id"], r["model"], r["run"]) for r in jd.missing_runs(reviews, raw(spark, rows), quota).collect()}
    assert got == {("a", "small", 1), ("c", "big", 1), ("c", "small", 1), ("c", "small", 2)}
    assert [r["review_id"] for r in jd.quota_complete(raw(spark, rows), quota).collect()] == ["b"]


def test_schema_hash_check(spark):
    meta = spark.createDataFrame([("t", "h1")], "topic string, term_hash string")
    assert jd.schema_current(meta, "t", "h1").first()["current"]
    assert not jd.schema_current(meta, "t", "h2").first()["current"]
    assert jd.schema_current(meta, "new", "h2").first()["current"]


# --- policies ----------------------------------------------------------------------------

JUDGED = "k int, business_id string, review_id string, is_relevant boolean, fields map<string,string>, date string"


def judged(spark, rows):
    data = [(k, b, str(i), rel, f, d) for i, (k, b, rel, f, d) in enumerate(rows)]
    return spark.createDataFrame(data, JUDGED)


def f(severity, account="firsthand", **more):
    return {"incident_severity": severity, "account_type": account, **more}


def test_verdict_for_score_bounds(spark):
    thresholds = [{"verdict": "Good", "min_score": 10, "min_score_by_k": {25: 5}}, {"verdict": "Great", "min_score": 20}, {"verdict": "Bad", "max_score": -5}, {"verdict": "Awful", "max_score": -50}]
    df = spark.createDataFrame([(s, k) for s in (25, 12, 7, 0, -5, -60) for k in (25, 200)], "s int, k int")
    got = {(r["s"], r["k"]): r["v"] for r in df.select("s", "k", sc.verdict_for_score(F.col("s"), thresholds, F.col("k"), "Fair").alias("v")).collect()}
    assert [got[s, 200] for s in (25, 12, 7, 0, -5, -60)] == ["Great", "Good", "Fair", "Fair", "Bad", "Awful"]
    assert got[7, 25] == "Good"


def test_truncation_recency_and_cuisine(spark):
    rows = [
        (200, "a", True, f("severe", staff_response="accommodated"), "2018-05-01"),  # (1 + 12) / 4 -> 3
        (200, "a", True, f("none", staff_response="dismissive"), "2020-06-01"),      # 9 / 2 -> 4
        (200, "a", False, f("severe", staff_response="dismissive"), "2021-06-01"),
        (200, "a", True, f("severe", "secondhand", staff_response="dismissive"), "2021-06-01"),
        (200, "a", True, {"staff_response": "accommodated"}, None),                  # no account, no date: 1
        (200, "b", True, f("severe", staff_response="none"), "2021-01-01"),
    ]
    entities = spark.createDataFrame([(200, "a", "Thai"), (200, "b", "Thai"), (200, "c", None)], "k int, business_id string, categories string")
    got = {r["business_id"]: r for r in vd.policy_verdicts(judged(spark, rows), [cat.RECENCY_POLICY], entities).collect()}
    assert (got["a"]["score"], got["a"]["n_incidents"]) == (3 + 4 + 1 + 7, 3)
    assert (got["b"]["score"], got["c"]["score"], got["c"]["verdict"]) == (0, 0, "Low Risk")


def test_recency_dialects(spark):
    dates = ["2021-06-01", "2020-06-01", "2018-06-01", "2017-01-01", "bad", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    rules = cat.RECENCY_POLICY["scoring"]["recency_rules"]
    out = df.select(
        sc.recency_from_text(F.col("d"), rules).alias("t"), sc.recency_by_max_age(sc.age_years(F.col("d")), rules).alias("m"),
        sc.recency_by_year(F.col("d"), cat.YEAR_RULES).alias("y"),
        sc.recency_from_text(F.col("d"), [{"age": "Within 6 months", "weight": "full"}, {"age": "6 months to 1 year", "weight": "half"}]).alias("u"),
    ).collect()
    assert [r["t"] for r in out] == [1.0, 0.5, 0.25, 0.25, 1.0, 1.0]
    assert [r["m"] for r in out] == [1.0, 0.5, 0.25, 0.25, 1.0, 1.0]
    assert [r["y"] for r in out] == [1.0, 1.0, 0.5, 0.25, 1.0, 1.0]
    assert {r["u"] for r in out} == {1.0}


def test_rules_requires_and_compat(spark):
    rows = [(25, "a", True, f("severe", assurance_claim="false"), "2020-01-01"), (25, "b", True, f("severe", assurance_claim="true"), "2020-01-01")]
    strict = {r["business_id"]: r["verdict"] for r in vd.policy_verdicts(judged(spark, rows), [cat.COMPOUND_POLICY]).collect()}
    loose = {r["business_id"]: r["verdict"] for r in vd.policy_verdicts(judged(spark, rows), [cat.COMPOUND_POLICY], compat=True).collect()}
    assert strict == {"a": "Low Risk", "b": "Critical Risk"} and set(loose.values()) == {"Critical Risk"}


def test_rule_ladder_skips_text_only_rules(spark):
    policy = {"policy_id": "p", "verdicts": ["L", "H"], "rules": [{"verdict": "H", "label": "X", "logic": "ALL", "conditions": []}, {"verdict": "L", "label": "D", "default": True}]}
    rows = [(25, "a", True, f("severe"), "2020-01-01")]
    got = vd.policy_verdicts(judged(spark, rows), [policy, {**policy, "policy_id": "q", "rules": policy["rules"][:1]}]).collect()
    assert {(r["policy_id"], r["verdict"], r["matched_rule"]) for r in got} == {("p", "L", "D"), ("q", "Unknown", None)}


def test_term_references(spark):
    terms = spark.createDataFrame([("shared", 0, "A"), ("allergy", 1, "A"), ("allergy", 1, "B")], "domain string, domain_ord int, term_id string")
    refs = spark.createDataFrame([("A",), ("allergy:A",), ("B",), ("shared:B",), ("C",)], "ref string")
    got = {r["ref"]: (r["domain"], r["resolved"]) for r in vd.resolve_terms(refs, terms).collect()}
    assert got == {"A": ("shared", True), "allergy:A": ("allergy", True), "B": ("allergy", True), "shared:B": (None, False), "C": (None, False)}
