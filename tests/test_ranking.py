import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbitra.functions import ranking


def average_ranks(values):
    v = np.array(values, dtype=float)
    n = len(v)
    below = (v[None, :] < v[:, None]).sum(axis=1)
    ties = (v[None, :] == v[:, None]).sum(axis=1)
    return (below + (ties - 1) / 2) / max(n - 1, 1)


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, id int, v double")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 0.0, 0.5, 1.0, 2.5, -3.0]), min_size=1, max_size=30))
def test_rank_normalize_matches_brute_force(spark, values):
    got = {r["id"]: r["r"] for r in ranking.rank_normalize(frame(spark, values), ["k"], "v", "r").collect()}
    want = average_ranks(values)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(len(values)))
    assert abs(np.mean(list(got.values())) - 0.5) < 1e-9 or len(values) == 1


def test_equal_values_rank_one_half(spark):
    rows = ranking.rank_normalize(frame(spark, [7.0] * 9), ["k"], "v", "r").collect()
    assert {r["r"] for r in rows} == {0.5}


def test_hot_value_and_hot_key(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.zeros(3000), rng.normal(size=5000)])
    df = frame(spark, values).union(frame(spark, values[:50], "b"))
    got = {(r["k"], r["id"]): r["r"] for r in ranking.rank_normalize(df, ["k"], "v", "r").collect()}
    order = np.argsort(values, kind="stable")
    sorted_v = values[order]
    first = np.searchsorted(sorted_v, values, "left")
    last = np.searchsorted(sorted_v, values, "right") - 1
    want = (first + last) / 2 / (len(values) - 1)
    assert max(abs(got["a", i] - want[i]) for i in range(len(values))) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_are_linear_and_exact(spark, n):
    values = np.random.default_rng(n).integers(0, 20, n).astype(float)
    got = {r["p"]: r["quantile"] for r in ranking.quantiles(frame(spark, values), ["k"], "v", [0.1, 0.5, 0.7, 1.0]).collect()}
    for p, q in got.items():
        assert abs(q - np.quantile(values, p)) < 1e-9


def test_bins_follow_digitize(spark):
    values = np.round(np.random.default_rng(3).normal(size=300), 1)
    got = {r["id"]: r["b"] for r in ranking.quantile_bins(frame(spark, values), ["k"], "v", 5, "b").collect()}
    edges = np.quantile(values, [0.2, 0.4, 0.6, 0.8])
    want = np.digitize(values, edges, right=True)
    assert [got[i] for i in range(300)] == list(want)


def test_global_row_number(spark):
    values = np.random.default_rng(5).integers(0, 40, 500)
    df = frame(spark, values)
    rows = ranking.global_row_number(df, [F.desc("v"), F.col("id")], "rank").collect()
    want = sorted(range(500), key=lambda i: (-values[i], i))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 501))


def test_large_limits_are_salted_and_whole(spark):
    df = spark.range(6000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 6000).alias("v"))
    rows = ranking.top_per_key(df, ["k"], [F.desc("v")], 1500).collect()
    assert sorted(r["v"] for r in rows) == list(range(4500, 6000))
    assert all(r["rn"] == 6000 - r["v"] for r in rows)


def test_null_values_and_keys_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0)], "k string, v double")
    ranks = {(r["k"], r["v"]): r["r"] for r in ranking.rank_normalize(df, ["k"], "v", "r").collect()}
    assert ranks == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("a", None): None, (None, 2.0): None}
    bins = {(r["k"], r["v"]): r["b"] for r in ranking.quantile_bins(df, ["k"], "v", 2, "b").collect()}
    assert bins == {("a", 1.0): 0, ("a", 3.0): 1, ("a", None): None, (None, 2.0): None}


def test_number_per_key_with_a_hot_and_a_null_key(spark):
    import random

    from arbitra.functions.ranking import number_per_key

    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {(r.k, r.n): (r.v, r.i) for r in number_per_key(df, ["k"], [F.col("v"), F.desc("i")], "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -r[2])), 1):
            want[k, n] = (v, i)
    assert got == want and number_per_key(df.limit(0), ["k"], [F.col("v")], "n").collect() == []


def test_totals_of_a_table_against_brute_force(spark):
    rng = np.random.default_rng(11)
    values = [None, None, *np.round(rng.normal(size=900), 2).tolist(), *[0.25] * 600]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, w int").repartition(7)
    got = ranking.prefix_totals(df, [], "v", {"_n": F.count(F.lit(1)), "_w": F.sum("w")}).collect()
    order = lambda v: float("-inf") if v is None else v
    rows = [(order(v), i % 3) for i, v in enumerate(values)]
    assert len(got) == len(set(values))
    for r in got:
        at = order(r["v"])
        assert (r["_n"], r["before__n"], r["total__n"]) == (sum(v == at for v, _ in rows), sum(v < at for v, _ in rows), len(rows))
        assert (r["before__w"], r["total__w"]) == (sum(w for v, w in rows if v < at), sum(w for _, w in rows))


def test_totals_of_an_empty_table(spark):
    assert ranking.prefix_totals(spark.createDataFrame([], "v double"), [], "v", {"_n": F.count(F.lit(1))}).collect() == []
