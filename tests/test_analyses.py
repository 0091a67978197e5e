"""Correlation of columns that may not vary."""

import math

import pytest

from arbitra.operators.analyses import coverage_correlation


@pytest.mark.parametrize("rows, want", [
    ([(1, 2), (2, 4), (3, 7), (9, None), (None, 5)], 0.993399),
    ([(3, 1), (2, 2), (1, 3)], -1.0),
    ([(i, 8) for i in range(49)] + [(50, None)], math.nan),  # every business covers all topics
    ([(7, i) for i in range(49)], math.nan),
    ([(5, 3)], math.nan),
    ([(5, None)], None),
    ([], None),
])
def test_coverage_correlation(spark, rows, want):
    df = spark.createDataFrame(rows, "review_count long, coverage long").repartition(5)
    got = coverage_correlation(df).first()
    assert got.n == len(rows)
    assert (got.correlation is None) == (want is None)
    assert want is None or got.correlation == pytest.approx(want, abs=1e-6, nan_ok=True)
