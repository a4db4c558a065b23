from __future__ import annotations

import math

import numpy as np

from marketloom.operators import numeric


def test_power_and_shin_meet_their_equations(spark):
    rows = spark.createDataFrame([("a", [2.1, 1.7]), ("b", [1.8, 3.5, 4.5]), ("c", [2.0]), ("d", [1.0, 3.0]), ("e", None), ("f", [5.0, 5.0])], "m string, p array<double>")
    power = {r["m"]: r for r in numeric.devigged(rows, "m", "p", "power").collect()}
    assert abs(sum(power["a"]["probabilities"]) - 1) < 1e-9 and abs(sum(power["b"]["probabilities"]) - 1) < 1e-9
    assert all(power[m]["parameter"] is None and power[m]["probabilities"] is None for m in "cde")
    shin = {r["m"]: r for r in numeric.devigged(rows, "m", "p", "shin").collect()}
    z, q = shin["b"]["parameter"], [1 / x for x in (1.8, 3.5, 4.5)]
    want = [(math.sqrt(z * z + 4 * (1 - z) * x * x / sum(q)) - z) / (2 * (1 - z)) for x in q]
    assert np.allclose(shin["b"]["probabilities"], want) and abs(sum(want) - 1) < 1e-9
    assert shin["f"]["parameter"] is None  # no margin


def test_fallback_to_shares_and_roots_outside_the_bracket(spark):
    rows = spark.createDataFrame([("a", [1.8, 3.5, 4.5], "SHIN"), ("b", [5.0, 5.0, 5.0], "SHIN"), ("c", [2.1, 1.7], "POWER"), ("d", [1.0000001, 1.0000001], "POWER"), ("e", [0.5, 2.0], "POWER"), ("f", [3.0, 3.0], None)], "m string, p array<double>, how string")
    got = {r["m"]: r for r in numeric.devigged_or_shares(rows, "m", "p", "how").collect()}
    assert [got[m]["method"] for m in "abcdef"] == ["SHIN", "MULTIPLICATIVE_FALLBACK", "POWER", "MULTIPLICATIVE_FALLBACK", None, "POWER"]
    assert got["b"]["parameter"] is None and np.allclose(got["b"]["probabilities"], [1 / 3] * 3) and got["e"]["probabilities"] is None
    assert all(abs(sum(got[m]["probabilities"]) - 1) < 1e-12 for m in "abcdf")
    power = numeric.devigged(rows.where("m = 'd'"), "m", "p", "power").first()
    assert power["parameter"] is None and power["probabilities"] is None


def test_poisson_rate_inverts(spark):
    rows = spark.createDataFrame([(2.5, 0.5), (0.5, 0.3), (2.5, 1.0), (2.5, None), (None, 0.5)], "line double, p double")
    got = [r["rate"] for r in numeric.poisson_rates(rows, "line", "p", "rate").collect()]
    above = lambda rate, n: 1 - sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(n + 1))
    assert abs(above(got[0], 2) - 0.5) < 1e-9 and abs(above(got[1], 0) - 0.3) < 1e-9 and got[2:] == [None, None, None]


def test_weighted_median_and_curve(spark):
    rows = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 9.0, 3.0)], "k string, v double, w double")
    assert numeric.weighted_median(rows, "k", "v", "w", []).first()["median"] == 9.0
    points = spark.createDataFrame([("k", 1.0, 0.5), ("k", 2.0, 0.4), ("k", 3.0, 0.39)], "k string, x double, y double")
    assert [(r["prev_at"], r["x"]) for r in numeric.curve_breaks(points, ["k"], "x", "y", 0.035).collect()] == [(1.0, 2.0)]
