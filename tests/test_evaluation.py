"""What an evaluation was measured on."""

from arbitra.operators.evaluation import evaluation_counts


def test_counts_of_results_pairs_and_lists(spark):
    rows = [("a", "Low Risk", None, True), ("b", "High Risk", None, True), ("c", "High Risk", "timeout", False), ("d", "Low Risk", None, False)]
    results = spark.createDataFrame(rows, "business_id string, verdict string, error string, structured boolean").selectExpr("*", "double(null) AS risk_score")
    truth = spark.createDataFrame([("a", "Low Risk"), ("c", "Low Risk"), ("d", None)], "business_id string, verdict string")
    claims = spark.createDataFrame([("a", "E1"), ("a", "E2")], "business_id string, evidence_id string")
    verdicts = ["Low Risk", "High Risk", "Critical Risk"]
    count = lambda df: {r.metric: r.value for r in evaluation_counts(df, truth, claims, verdicts).collect()}
    assert count(results) == {"n_samples": 4.0, "n_with_gt": 1.0, "n_structured": 2.0}
    assert count(results.drop("structured")) == {"n_samples": 4.0, "n_with_gt": 1.0, "n_structured": 1.0}
    assert count(results.limit(0)) == {"n_samples": 0.0, "n_with_gt": 0.0, "n_structured": 0.0}


def test_average_precision_of_each_level(spark):
    from arbitra.operators.evaluation import ordinal_auprc

    def brute(rows, level):
        total = sum(y >= level for y, _ in rows)
        if total in (0, len(rows)):
            return None
        out = 0.0
        for score in sorted({s for _, s in rows}, reverse=True):
            above = [y for y, s in rows if s >= score]
            here = sum(y >= level for y, s in rows if s == score)
            out += here / total * sum(y >= level for y in above) / len(above)
        return out

    rows = [(i * 7 % 3, float(i * 5 % 11)) for i in range(60)]
    for data in (rows, [(min(y, 1), s) for y, s in rows], [(0, 1.0)], []):
        df = spark.createDataFrame(data, "y_true int, risk_score double")
        got = ordinal_auprc(df).first()
        want = [brute(data, 1), brute(data, 2)]
        known = [w for w in want if w is not None]
        want.append(sum(known) / len(known) if known else None)
        assert [g if g is None else round(g, 9) for g in got] == [w if w is None else round(w, 9) for w in want]
