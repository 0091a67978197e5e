import math
import random

import numpy as np
from pyspark.sql import functions as F

from arbitra.functions.scoring import beta_cdf, beta_quantiles
from arbitra.operators import active as ac
from arbitra.operators import retrieval as rt
from arbitra.operators import selection

GATES = [("g1", ["p"], "emb", "pos"), ("g2", ["p"], "emb", "pos"), ("g3", ["p"], "bm25", "neg")]


def gates(spark, rows=GATES):
    return spark.createDataFrame(rows, "gate_id string, primitive_ids array<string>, modality string, polarity string")


def scores(spark, table):
    rows = [(g, f"r{i}", float(s)) for g, vs in table.items() for i, s in enumerate(vs)]
    return spark.createDataFrame(rows, "gate_id string, review_id string, score double")


def pool(spark, n=3, businesses=1):
    return spark.createDataFrame([(f"r{i}", f"b{i % businesses}") for i in range(n)], "review_id string, business_id string")


TABLE = {"g1": [0.1, 0.2, 0.3], "g2": [0.2, 0.1, 0.4], "g3": [0.0, 1.5, 0.0]}


def test_max_pool(spark):
    got = ac.max_pool(gates(spark), scores(spark, {k: TABLE[k] for k in ("g1", "g2")})).orderBy("review_id").collect()
    assert [r["score"] for r in got] == [0.2, 0.2, 0.4]


def z_of(spark, g, s, n=3):
    return {r["review_id"]: r["z"] for r in ac.contrast(g, s, pool(spark, n), ["p", "q"], 0.5).where("primitive_id = 'p'").collect()}


def test_contrast_with_an_absent_pool_and_unscored_primitive(spark):
    got = z_of(spark, gates(spark), scores(spark, TABLE))
    # emb positives rank .25 .25 1, absent pools .5, bm25 negatives .25 1 .25
    assert got == {"r0": 0.5 - 0.25, "r1": 0.5 - 0.5, "r2": 1.0 - 0.25}
    q = ac.contrast(gates(spark), scores(spark, TABLE), pool(spark), ["q"], 0.5).collect()
    assert {r["z"] for r in q} == {0.25}


def test_incremental_scoring_equals_full(spark):
    first, later = scores(spark, {"g1": TABLE["g1"]}), scores(spark, {k: TABLE[k] for k in ("g2", "g3")})
    todo = rt.missing_gates(gates(spark), first)
    assert {r["gate_id"] for r in todo.collect()} == {"g2", "g3"}
    assert z_of(spark, gates(spark), first.union(later)) == z_of(spark, gates(spark), scores(spark, TABLE))


def test_gate_dedupe(spark):
    rows = [(0, ["b", "a"], "bm25", "pos", "Peanut  Allergy"), (1, ["a", "b"], "bm25", "pos", "peanut allergy "), (2, ["a", "b"], "emb", "pos", "peanut allergy")]
    df = spark.createDataFrame(rows, "pos int, primitive_ids array<string>, modality string, polarity string, query string")
    kept = rt.dedupe_gates(df)
    assert sorted(r["pos"] for r in kept.collect()) == [0, 2]
    ids = {r["gate_id"] for r in rt.with_gate_ids(df).collect()}
    assert len(ids) == 2 and all(len(i) == 12 for i in ids)


def test_beta_quantiles():
    a, b = np.array([1.0, 1.0, 5.0, 3.0, 400.0]), np.array([1.0, 19.0, 2.0, 3.0, 9000.0])
    q = beta_quantiles(a, b, 0.95)
    assert abs(q[0] - 0.95) < 1e-9
    assert abs(q[1] - (1 - 0.05 ** (1 / 19))) < 1e-9
    x = np.linspace(0, 1, 400_001)
    for i in range(5):
        logs = (a[i] - 1) * np.log(np.maximum(x, 1e-300)) + (b[i] - 1) * np.log(np.maximum(1 - x, 1e-300))
        density = np.exp(logs + math.lgamma(a[i] + b[i]) - math.lgamma(a[i]) - math.lgamma(b[i]))
        mass = np.trapezoid(density[x <= q[i]], x[x <= q[i]])
        assert abs(mass - 0.95) < 2e-3
    assert np.allclose(beta_cdf(np.array([0.3, 0.7]), 2.0, 3.0), [0.3483, 0.9163], atol=1e-6)


PRIMS = [
    {"primitive_id": "p", "label": "Critical", "min_count": 2, "conditions": []}, {"primitive_id": "q", "label": "High", "min_count": 1, "conditions": []},
]
RULES = [{"label": "Critical", "connective": "ANY", "primitive_ids": ["p"]}, {"label": "High", "connective": "ALL", "primitive_ids": ["q"]}]


def bound(spark, tags, n=6):
    z = spark.createDataFrame([(p, f"r{i}", i / n, i % 2) for p in ("p", "q") for i in range(n)], "primitive_id string, review_id string, z double, bin int")
    rows = [(f"r{i}", "b0", p, y) for i, p, y in tags]
    t = spark.createDataFrame(rows, "review_id string, business_id string, primitive_id string, y int")
    cal = spark.createDataFrame([(p, b, 0.1) for p in ("p", "q") for b in (0, 1)], "primitive_id string, bin int, u double")
    entities = pool(spark, n).select("business_id").distinct()
    counts = ac.positive_counts(t)
    open_bins = ac.bin_counts(ac.unverified(z, t), pool(spark, n))
    rho = ac.default_bound(entities, counts, open_bins, cal, RULES, PRIMS).first()["rho"]
    verdict = ac.rule_verdicts(entities, counts, RULES, PRIMS).first()["verdict"]
    return rho, verdict


def test_bound_falls_with_negatives_and_verdicts_follow_counts(spark):
    before, v0 = bound(spark, [(0, "p", 0), (0, "q", 0)])
    after, v1 = bound(spark, [(i, p, 0) for i in (0, 1, 2) for p in ("p", "q")])
    assert after <= before and v0 is None and v1 is None
    assert abs(before - (0.5 / 2 + 0.5)) < 1e-12
    assert bound(spark, [(0, "q", 1), (0, "p", 0)])[1] == "High"
    assert bound(spark, [(0, "q", 1), (0, "p", 2)])[1] == "Critical"


def test_calibration_is_deterministic_and_has_a_prior(spark):
    z = spark.createDataFrame([("p", "r0", 0.1, 0), ("p", "r1", 0.2, 1)], "primitive_id string, review_id string, z double, bin int")
    tags = spark.createDataFrame([("r0", "b", "p", 3), ("r1", "b", "p", 0)], "review_id string, business_id string, primitive_id string, y int")
    got = [tuple(r) for r in ac.calibrate(tags, z, ["p", "q"], 3, 0.05).orderBy("primitive_id", "bin").collect()]
    again = [tuple(r) for r in ac.calibrate(tags, z, ["p", "q"], 3, 0.05).orderBy("primitive_id", "bin").collect()]
    assert got == again and len(got) == 6
    assert got[0][2:5] == (2.0, 1.0, 2 / 3) and got[1][2:5] == (1.0, 2.0, 1 / 3) and got[2][2:5] == (1.0, 1.0, 0.5)


def test_stop_reasons(spark):
    v = spark.createDataFrame([("a", "High"), ("b", None), ("c", None)], "business_id string, verdict string")
    r = spark.createDataFrame([("a", 0.9), ("b", 0.005), ("c", 0.3)], "business_id string, rho double")
    got = {x["business_id"]: (x["verdict"], x["stop_reason"]) for x in ac.stop_check(v, r, "Low").collect()}
    assert got == {"a": ("High", "rule_satisfied"), "b": ("Low", "bound"), "c": (None, None)}
    assert {x["business_id"]: x["stop_reason"] for x in ac.stop_check(v, r, "Low", exhausted=True).collect()}["c"] == "exhausted"


def test_batch_selection_follows_the_stages(spark):
    rng = random.Random(4)
    n, bins = 60, 3
    rows = [(p, f"r{i:02d}", 0.0, rng.randrange(bins)) for p in ("p", "q") for i in range(n)]
    z = spark.createDataFrame(rows, "primitive_id string, review_id string, z double, bin int")
    score = {f"r{i:02d}": rng.random() for i in range(n)}
    s = spark.createDataFrame([(r, f"b{int(r[1:]) % 4}", v) for r, v in score.items()], "review_id string, business_id string, score double")
    cal = spark.createDataFrame([(p, b, 1.0 + b, 2.0) for p in ("p", "q") for b in range(bins)], "primitive_id string, bin int, alpha double, beta double")
    got = ac.select_batch(s, z, cal, 12, 0.25, 2, seed=3, focus_business="b1").orderBy("pick").collect()
    assert len({r["review_id"] for r in got}) == len(got) == 12
    stages = [r["stage"] for r in got]
    assert stages == ["closeout"] * 3 + ["coverage"] * 2 + ["exploit"] * 4 + ["explore"] * 3
    mine = sorted((r for r in score if int(r[1:]) % 4 == 1), key=lambda r: -score[r])[:3]
    assert [r["review_id"] for r in got[:3]] == mine
    taken = {r["review_id"] for r in got[:5]}
    assert [r["review_id"] for r in got[5:9]] == sorted((r for r in score if r not in taken), key=lambda r: -score[r])[:4]


def brute_cover(businesses, universe, target):
    held, picks = dict.fromkeys(universe, 0), []
    for level in range(1, target + 1):
        while len(picks) < target:
            needy = {c for c in universe if held[c] < level}
            rest = [b for b in businesses if b not in picks]
            best = min(rest, key=lambda b: (-len(needy & businesses[b][0]), -businesses[b][1], b), default=None)
            if not needy or best is None or not needy & businesses[best][0]:
                break
            picks.append(best)
            for c in businesses[best][0]:
                held[c] += 1
    return picks


def test_greedy_cover_matches_brute_force(spark):
    rng = random.Random(11)
    universe = [(t, s) for t in "abcd" for s in ("critical", "high")]
    businesses = {f"b{i:03d}": (set(rng.sample(universe, rng.randint(1, 3))), float(rng.randint(1, 6))) for i in range(80)}
    df = spark.createDataFrame([(b, sorted(c), v) for b, (c, v) in businesses.items()], "business_id string, cells array<struct<topic:string,severity:string>>, total_value double")
    want = brute_cover(businesses, universe, 25)
    got = [r["business_id"] for r in selection.greedy_cover(df, universe, 25).orderBy("pick").collect()]
    assert got == want
    # With few candidates at a time old gains decide when new ones are needed.
    for window in (1, 4):
        assert [r["business_id"] for r in selection.greedy_cover(df, universe, 12, window).orderBy("pick").collect()] == want[:12]
    assert selection.greedy_cover(df, [("z", "high")], 5).collect() == [] and selection.greedy_cover(df, [], 5).collect() == []


def test_bm25_of_rows(spark):
    words = ["ab", "cd", "ef", "gh"]
    rng = random.Random(2)
    docs = spark.createDataFrame([(str(i), " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)], "review_id string, text string")
    queries = {"one": "ab", "two": "cd ef", "twice": "ab ab", "none": "zz", "empty": "!!"}
    a = {(r["query_id"], r["review_id"]): r["score"] for r in rt.bm25(docs, queries).collect()}
    assert all(abs(a["twice", d] - 2 * s) < 1e-9 for (q, d), s in a.items() if q == "one")
    # Many other queries beside change nothing, and rows with one id keep their own scores.
    many = queries | {f"q{i}": f"x{i} y{i}" for i in range(300)}
    b = {(r["query_id"], r["review_id"]): r["score"] for r in rt.bm25(docs, many).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    same = rt.bm25(docs.withColumn("review_id", F.lit("1")), {"one": "ab"}).collect()
    assert sorted(round(r["score"], 9) for r in same) == sorted(round(s, 9) for (q, _), s in a.items() if q == "one")


def test_beta_quantiles_of_large_counts_and_of_any_batch():
    a, b = np.array([1e8, 3e8, 2.0, 0.05, np.nan, 0.0]), np.array([2e8, 1e3, 1e8, 4.0, 1.0, 1.0])
    q = beta_quantiles(a, b, 0.95)
    sd = np.sqrt(1e8 * 2e8 / (3e8**2 * 3e8))
    assert abs((q[0] - 1 / 3) / sd - 1.6448536) < 1e-3
    assert np.allclose(beta_cdf(q[:4], a[:4], b[:4]), 0.95, atol=1e-6) and np.isnan(q[4:]).all()
    assert [float(beta_quantiles(a[i : i + 1], b[i : i + 1], 0.95)[0]) for i in range(4)] == q[:4].tolist()
    assert beta_quantiles(a[:4], b[:4], 1.0).tolist() == [1.0] * 4
