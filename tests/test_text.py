import re

import pytest
from pyspark.sql import functions as F

from arbitra.functions import jsontext as js
from arbitra.functions import text as tx
from arbitra.functions import values as vl

SOURCE = "The soup was cold.  We waited an hour! Then my son got very sick that night. Staff were kind."


def brute(quote, source):
    """The rules in plain words, for comparison."""
    norm = lambda s: " ".join(s.lower().split())
    q, s = norm(quote), norm(source)
    if not q or not s:
        return False, "no_match"
    if q in s:
        return True, "exact"
    segs = [norm(p) for p in re.split(r"(?<=[.!?])\s+", quote) if len(norm(p)) >= 10]
    if not segs and "..." in quote:
        segs = [norm(p) for p in quote.split("...") if len(norm(p)) >= 10]
    if not segs and len(q) >= 10:
        segs = [q]
    at = []
    for g in segs:
        p = s.find(g)
        at.append(p if p >= 0 else s.find(g.rstrip(".,!?;:")))
    seen = [p for p in at if p >= 0]
    if segs and len(seen) / len(segs) >= 0.8 and all(b > max(seen[: i + 1]) for i, b in enumerate(seen[1:])):
        return True, "multi_span"
    words = set(q.split())
    if len(words) >= 3 and len(words & set(s.split())) / len(words) >= 0.8:
        return True, "word_overlap"
    return False, "no_match"


@pytest.mark.parametrize(
    "quote",
    [
        "soup was cold", "The soup was COLD. Then my son got very sick that night.", "Then my son got very sick that night. The soup was cold.",
        "the soup was hot and bad", "soup cold hour sick night staff", "We waited an hour... Staff were kind", "", "   ", "ok", "We waited an hour, then my son got very sick!",
        "The soup was cold. something never said here at all. We waited an hour!", "a b", "waited an hour! then my son",
    ],
)
def test_quote_tiers(spark, quote):
    row = spark.createDataFrame([(quote, SOURCE)], "q string, s string").select(tx.quote_check(F.col("q"), F.col("s")).alias("c")).first()["c"]
    assert (row["valid"], row["match_type"]) == brute(quote, SOURCE)


def test_quote_without_source(spark):
    row = spark.createDataFrame([("abc def ghi", None)], "q string, s string").select(tx.quote_check(F.col("q"), F.col("s")).alias("c")).first()["c"]
    assert not row["valid"] and row["positions"] == []


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_enum_wordings(spark):
    legal = ["none", "mild", "moderate", "severe"]
    words = {"no reaction": "none", "Life-threatening event": "severe", "MEDIUM": "moderate", "slight itch": "mild", "purple": "purple", "not severe": "severe", "no": "none"}
    got = one(spark, *[vl.normalize_enum(F.lit(w), legal) for w in words])
    assert list(got) == list(words.values())


def test_loose_equality(spark):
    cases = [("moderate incident", "Moderate", True), ("mild reaction", "mild risk", True), ("none", "mild", False), ("", "mild", True)]
    got = one(spark, *[vl.loosely_equal(F.lit(a), F.lit(b)) for a, b, _ in cases])
    assert list(got) == [c for *_, c in cases]


def test_labels_rules_and_fields(spark):
    verdicts = ["Low Risk", "High Risk"]
    got = one(
        spark, vl.normalize_verdict(F.lit(" 'HIGH_RISK' "), verdicts), vl.normalize_verdict(F.lit("''")), vl.verdict_from_rule(F.lit("a → b → Low Risk")),
        vl.verdict_from_rule(F.lit("x -> y")), vl.verdict_from_rule(F.lit("none")), vl.same_field(F.lit("INCIDENT_SEVERITY"), F.lit("severity")),
        vl.known_value(F.lit("Moderate incident"), ["mild", "moderate"]), vl.field(F.create_map(F.lit("StAff"), F.lit("x")), "STAFF"),
    )
    assert list(got) == ["High Risk", None, "Low Risk", "y", None, True, "moderate", "x"]


def test_ids(spark):
    got = one(
        spark, vl.parse_request_id(F.lit("policy::t::b::r::m::run7")), vl.parse_request_id(F.lit("policy::t::b")), vl.parse_sample_id(F.lit("sample::r::b")),
        vl.truth_policy_id(F.lit("T1P2"), {"T1": "safety"}), vl.truth_policy_id(F.lit("T1P3"), {}), vl.truth_policy_id(F.lit("G1_x_V3"), {}), vl.model_quota(F.lit("a:1, b.c:3")),
    )
    assert got[0].asDict() == {"topic": "t", "business_id": "b", "review_id": "r", "model": "m", "run": 7}
    assert got[1] is None and got[2]["business_id"] == "b"
    assert list(got)[3:] == ["safety_V2", "T1P3", "G1_x_V3", {"a": 1, "b.c": 3}]


def test_json_answers(spark):
    cases = {'```json\n{"a": 1}\n```': {"a": "1"}, '{"a": 1} and more': None, "```\n{\"b\": [1]}\n```": {"b": "[1]"}, "nothing": None, "{'a': 1}": None}
    got = one(spark, *[js.string_map(js.unfenced(F.lit(c))) for c in cases])
    assert list(got) == list(cases.values())
    loose = one(spark, js.string_map(js.json_object(F.lit('well {"a": "x"} done'))))
    assert loose[0] == {"a": "x"}


def test_phrases_and_thresholds(spark):
    got = one(
        spark, tx.phrases(F.lit("Severe (e.g. hospital visit, shock) including swelling")), tx.explicit_threshold(F.lit("Several reviews praise it"), F.lit(3)),
        tx.explicit_threshold(F.lit("Consistent reports of noise"), F.lit(2)), tx.explicit_threshold(F.lit("5 or more reviews agree"), F.lit(2)),
        tx.explicit_threshold(F.lit("{min_count} or more say so"), F.lit(4)), tx.explicit_threshold(F.lit("All is well"), F.lit(4)),
        tx.score_threshold_text(F.lit("Total score is 12 or higher"), F.lit(-7)),
    )
    assert got[0][:3] == ["e.g. hospital visit", "shock", "hospital visit"] and "swelling" in got[0]
    assert list(got)[1:] == ["3 or more reviews praise it", "2 or more reports of noise", "2 or more reviews agree", "4 or more say so", "All is well", "Total score is -7 or higher"]


def test_blocks(spark):
    prompt = "head\n==========\nAgenda\n==========\nthe rules\n==========\nL0 primitives\n==========\nSEVERITY\n- none: nothing\n- mild: a bit\nACCOUNT\n- own: self"
    got = one(
        spark, tx.prompt_section(F.lit(prompt), "agenda"), tx.field_definitions(tx.prompt_section(F.lit(prompt), "L0[:\\s]")),
        tx.between_anchors(F.lit("a<b>c</b>d"), F.lit("<b>"), F.lit("</b>")), tx.between_anchors(F.lit("a"), F.lit("x"), F.lit("y")),
    )
    assert got[0] == "the rules"
    assert [(f["field"], f["values"]) for f in got[1]] == [("severity", ["none", "mild"]), ("account", ["own"])]
    assert got[2] == "<b>c</b>" and got[3] is None


def test_quote_places_are_first_occurrences(spark):
    source = "alpha beta gamma. delta epsilon zeta; alpha beta gamma. Eta theta iota kappa"
    quotes = [
        "Alpha beta gamma. Delta epsilon zeta.", "delta epsilon zeta! alpha beta gamma.",
        "nowhere to be seen. delta epsilon zeta.", "eta theta iota",
    ]
    df = spark.createDataFrame([(q, source) for q in quotes], "q string, s string")
    got = {r["q"]: (r["c"]["match_type"], r["c"]["positions"]) for r in df.select("q", tx.quote_check(F.col("q"), F.col("s")).alias("c")).collect()}
    assert got["Alpha beta gamma. Delta epsilon zeta."] == ("multi_span", [0, 18])
    assert got["nowhere to be seen. delta epsilon zeta."] == ("no_match", [-1, 18])
    assert got["delta epsilon zeta! alpha beta gamma."][1] == [18, 0] and got["delta epsilon zeta! alpha beta gamma."][0] != "multi_span"
    assert got["eta theta iota"][0] == "exact" and got["eta theta iota"][1] == [source.lower().index("eta theta iota")]
