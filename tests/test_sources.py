import json
import os

import pytest
from pyspark.sql import functions as F

from arbitra.operators import evaluation as ev
from arbitra.operators import topics, usage, validation
from arbitra.sources import exchange, files, stores


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))
    return path


def test_registry_and_samples(spark, scratch):
    put(scratch, "a.jsonl", '{"id": "x", "query": "q1"}\n\n{"id": "", "query": "q2", "extra": 5}\n')
    put(scratch, "list.json", [{"id": "1"}, {"id": "2"}])
    put(scratch, "obj.json", {"samples": [{"id": "3", "context": "c"}]})
    put(scratch, "t.csv", "a,b\n1,2\n")
    put(scratch, "t.tsv", "a\tb\n1\t2\n")
    assert files.load(spark, f"{scratch}/a.jsonl").count() == 2
    assert files.load(spark, f"{scratch}/list.json").count() == 2
    assert [r["id"] for r in files.load(spark, f"{scratch}/obj.json").collect()] == ["3"]
    assert files.load(spark, f"{scratch}/t.csv").columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.load(spark, f"{scratch}/t.tsv")
    files.register_extension(".tsv", lambda s, p: s.read.option("sep", "\t").option("header", True).csv(p))
    assert files.load(spark, f"{scratch}/t.tsv").first()["b"] == "2"
    rows = files.load(spark, f"{scratch}/a.jsonl").withColumn("pos", F.when(F.col("query") == "q1", 0).otherwise(1))
    got = {r["query"]: r for r in files.samples(rows).collect()}
    assert got["q1"]["sample_id"] == "x" and got["q2"]["sample_id"] == "2" and got["q2"]["metadata"] == {"extra": "5"}


def test_topic_hit_files(spark, scratch):
    entry = {"business_id": "b", "name": "N1", "city": "c", "state": "s", "stars": 3.5, "review_count": 9, "categories": "x", "max_critical_score": 5.0}
    put(scratch, "hits/G1_a.json", {"critical_list": [entry], "high_list": []})
    put(scratch, "hits/G2_b.json", {"critical_list": [], "high_list": [{**entry, "name": "N2", "max_high_score": 4.0}, {**entry, "business_id": "d"}]})
    hits = files.read_topic_hits(spark, f"{scratch}/hits/*.json")
    assert {(r["topic"], r["severity"], r["business_id"]) for r in hits.collect()} == {("G1_a", "critical", "b"), ("G2_b", "high", "b"), ("G2_b", "high", "d")}
    assert {r["business_id"]: r["name"] for r in files.first_listed(hits).collect()}["b"] == "N1"


def test_truth_and_runs(spark, scratch):
    gt = {"verdict": "High Risk", "score": 5, "incidents": [{"review_id": "r", "severity_field": "s", "severity_value": "mild", "modifiers": []}]}
    put(scratch, "gt.json", {"policy_id": "P", "k": 25, "restaurants": {"b": {"name": "n", "ground_truth": gt}, "c": {"ground_truth": {}}}})
    got = {r["business_id"]: r for r in files.read_truth(spark, f"{scratch}/gt.json").collect()}
    assert got["b"]["verdict"] == "High Risk" and got["b"]["incidents"][0]["review_id"] == "r" and got["c"]["verdict"] == "Unknown"
    run = {"run_id": "x", "method": "m", "policy_id": "p", "mode": "batch", "accuracy": 0.5, "results": [{"business_id": "b", "latency_ms": 5.0}]}
    put(scratch, "out/run_3/results.json", run)
    put(scratch, "out/run_4/results.json", "{broken")
    runs = files.read_runs(spark, f"{scratch}/out/run_*/results.json")
    assert [(r["run_number"], r["accuracy"]) for r in runs.collect()] == [(3, 0.5)]
    assert files.run_items(runs).first()["latency_ms"] == 5.0
    files.write_run(runs.drop("results"), files.run_items(runs), files.run_items(runs), f"{scratch}/store")
    assert spark.read.parquet(f"{scratch}/store/run_items").count() == 1


def test_specs_gates_and_documents(spark, scratch):
    spec = {
        "verdict_rules": {"labels": ["H", "L"], "default_label": "L", "order": ["H", "L"], "rules": [
            {"label": "H", "connective": "ALL", "clauses": [{"min_count": 0, "conditions": [{"field_id": "S", "values": ["x"]}]}, {"min_count": 3, "logic": "ANY"}]},
            {"label": "L", "default": True}]},
        "terms": [{"field_id": "S", "values": [{"value_id": "x", "description": "d"}]}],
    }
    path = put(scratch, "spec.json", spec)
    got = files.read_spec_primitives(spark, path).orderBy("primitive_id").collect()
    assert [(r["primitive_id"], r["min_count"], r["logic"], r["connective"]) for r in got] == [("H_clause_1", 1, "ALL", "ALL"), ("H_clause_2", 3, "ANY", "ALL")]
    assert files.read_spec_terms(spark, path).first()["value_id"] == "x"
    gate = {"gate_id": "g", "primitive_ids": ["p"], "modality": "bm25", "polarity": "pos", "query": "A  b"}
    lib = put(scratch, "gates.json", {"gates": [gate, {**gate, "gate_id": "h", "query": "a b"}]})
    gates = files.read_gates(spark, lib)
    assert [r["gate_id"] for r in gates.collect()] == ["g"]
    files.write_gates(gates, f"{scratch}/gates_out")
    doc = put(scratch, "store.json", {"t": {"r1": {"is_allergy_related": True, "sev": "mild", "date": "2020-01-01", "stars": 4, "useful": 2}}})
    row = files.read_judgment_document(spark, doc).first()
    assert (row["topic"], row["review_id"], row["is_relevant"], row["fields"], row["stars"]) == ("t", "r1", True, {"sev": "mild"}, 4.0)


def test_policy_and_term_files(spark, scratch):
    put(scratch, "pol/P1.yaml", """
policy_id: P1
normative:
  scoring: {field_mapping: {severity_field: s, value_mappings: {bad: Bad one}}, severity_points: [{label: Bad one, points: 3}], thresholds: [{verdict: H, min_score: 3}]}
  decision:
    verdicts: [L, H]
    rules: [{verdict: L, label: LOW, default: true}]
""")
    child = put(scratch, "pol/P2.yaml", "policy_id: P2\nextends: P1\nnormative:\n  decision: {verdicts: [L, H], rules: [{verdict: H, label: ALL, default: true}]}\n")
    policy = files.policy_from_document(files.load_policy(child))
    assert policy["policy_id"] == "P2" and policy["scoring"]["severity_points"] == [("Bad one", 3)] and policy["rules"][0]["verdict"] == "H"
    terms = put(scratch, "terms.yaml", "SEV:\n  default: none\n  values: [{id: none}, {id: mild}]\n")
    rows = files.load_terms(spark, {"shared": terms}).collect()
    assert [(r["value_id"], r["is_default"]) for r in rows] == [("none", True), ("mild", False)]


def test_stores(spark, scratch):
    tags = stores.verified_tags(f"{scratch}/tags")
    row = lambda t, y: spark.createDataFrame([("r", "h", "v", t, y)], "review_id string, text_hash string, prompt_version string, created_at int, y int")
    tags.append(row(2, 9))
    tags.append(row(1, 7))
    assert [r["y"] for r in tags.read(spark).collect()] == [7]
    agg = stores.aggregated_judgments(f"{scratch}/agg")
    agg.append(spark.createDataFrame([("t", "r", 1, "old")], "topic string, review_id string, aggregated_at int, v string"))
    agg.append(spark.createDataFrame([("t", "r", 2, "new")], "topic string, review_id string, aggregated_at int, v string"))
    assert [r["v"] for r in agg.read(spark).collect()] == ["new"]
    wanted = spark.createDataFrame([("t", "r"), ("t", "s")], "topic string, review_id string")
    assert [r["review_id"] for r in agg.missing(wanted).collect()] == ["s"]


def test_requests_are_chunked_and_written(spark, scratch):
    missing = spark.createDataFrame([("t", str(i), "m", 1) for i in range(5)], "topic string, review_id string, model string, run int")
    reviews = spark.createDataFrame([(str(i), "b", "text %d" % i) for i in range(5)], "review_id string, business_id string, text string")
    lines = usage.chunked(exchange.requests(missing, reviews, {"sev": {"none": "n"}}, "x"), 2)
    exchange.write_requests(lines, f"{scratch}/req")
    back = spark.read.text(f"{scratch}/req")
    assert back.groupBy("model", "chunk").count().orderBy("chunk").select("count").toPandas()["count"].tolist() == [2, 2, 1]
    body = json.loads(back.first()["value"])
    assert body["custom_id"].startswith("policy::t::b::") and "SEV: none" in body["body"]["messages"][0]["content"]


def test_costs(spark):
    prices = usage.price_table(spark, {"small": (0.05, 0.40)})
    calls = spark.createDataFrame([("small", 1_000_000, 1_000_000), ("unknown", 1_000_000, 1_000_000)], "model string, prompt_tokens long, completion_tokens long")
    got = {r["model"]: r["cost_usd"] for r in usage.with_cost(calls, prices).collect()}
    assert abs(got["small"] - 0.45) < 1e-12 and abs(got["unknown"] - 4.0) < 1e-12


def test_nested_results(spark):
    parsed = {"verdict": "High Risk", "evidences": [{"evidence_id": "E1", "review_id": "r", "field": "INCIDENT_SEVERITY", "judgement": "mild", "snippet": "s"}], "justification": {"direct_evidence": ["E9"]}}
    schema = ("business_id string, parsed struct<verdict:string, evidences:array<struct<evidence_id:string, review_id:string, field:string, judgement:string, snippet:string>>, "
              "justification:struct<direct_evidence:array<string>>>, error string")
    df = spark.createDataFrame([("b", parsed, None), ("c", {"verdict": "x", "evidences": None, "justification": None}, "boom")], schema)
    assert [(r["evidence_id"], r["is_direct"]) for r in ev.flatten_claims(df).collect()] == [("E1", False)]
    assert ev.without_errors(df).count() == 1


def test_metric_edges(spark):
    pairs = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 1, 1, 0.7)], "business_id string, y_true int, y_pred int, risk_score double")
    assert ev.ordinal_auprc(pairs).first()["ordinal_auprc"] is None        # one class only
    assert ev.macro_f1(pairs).first()["macro_f1"] == 1.0
    assert ev.macro_f1(pairs.limit(1)).first()["macro_f1"] == 0.0
    even = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 2, 1, 1.0), ("c", 1, 1, 1.0), ("d", 0, 2, 1.0)], pairs.schema)
    row = ev.ordinal_auprc(even).first()                                    # equal scores share a threshold
    assert (row["auprc_ge_high"], row["auprc_ge_critical"]) == (0.5, 0.25)
    parts = spark.createDataFrame([(1.0, 0.5, 0.0, 1.0, None)], "incident_precision double, severity_accuracy double, modifier_accuracy double, verdict_support_rate double, snippet_validity double")
    assert abs(ev.process_score(parts).first()["process_score"] - (0.35 + 0.15 + 0.15) / 0.95 * 100) < 1e-9


def test_clause_violations(spark):
    legal = spark.createDataFrame([("S", "x")], "field string, value string")
    schema = "clause_id string, min_count int, logic string, conditions array<struct<field_id:string, values:array<string>>>"
    rows = [("ok", 1, "ALL", [("S", ["x"])]), ("bad", 0, "XOR", [("S", ["y"]), ("T", ["x"])]), ("empty", 1, "ANY", [])]
    got = {(r["clause_id"], r["violation"]) for r in validation.clause_violations(spark.createDataFrame(rows, schema), legal).collect()}
    assert {c for c, _ in got} == {"bad", "empty"} and ("bad", "unknown value S y") in got and ("bad", "unknown field T") in got and len(got) == 5


def test_topic_prefilter_drops_what_patterns_would_hit(spark):
    df = spark.createDataFrame([("1", "b", "peanut reaction", 1.0), ("2", "b", "reaction only", 1.0), ("3", "b", "PEANUT Reaction", 5.0)], "review_id string, business_id string, text string, stars double")
    topic = [{"topic": "t", "keywords": ["peanut"], "critical": [("reaction", 2.0)], "high": [("peanut", 1.0)]}]
    got = {r["review_id"]: (r["critical_score"], r["critical_matches"]) for r in topics.score_reviews(df, topic).collect()}
    assert got == {"1": (3.0, ["reaction"]), "3": (2.0, ["reaction"])}
    custom = topics.score_reviews(df, topic, lambda d, t: F.length("text").cast("double"))
    assert {r["critical_score"] for r in custom.collect()} == {15.0}
