"""Every evaluator on hand-made series, against the plain statement of its rule."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.mining import patterns as P
from ledgerlens.mining.config import Measure, ViewConfig
from ledgerlens.mining.stats import t_two_sided
from tests import brute

CONFIG = ViewConfig("x", ("a",), ("t",), (Measure("v"),), ("v",))

CATEGORICAL = {
    "too_short": [5, 1], "all_zero": [0, 0, 0, 0], "constant": [7, 7, 7, 7, 7], "one_big": [100, 10, 11, 9, 10, 12],
    "rest_constant": [50, 10, 10, 10], "rest_constant_low": [1, 10, 10, 10], "negative_even": [-10, -30, -5, -90],
    "max_tie": [100, 100, 10, 11, 9, 10], "two_high": [90, 100, 10, 11, 9, 10, 12], "two_low": [1, 2, 50, 51, 49, 52, 50],
    "second_zero": [9, 0, 0, 0], "second_negative": [9, -1, -2, -1], "majority": [100, 20, 10, 5], "even": [100, 101, 99, 98],
    "sum_zero": [5, -5, 0], "two_rest_const": [30, 40, 5, 5, 5],
}
TEMPORAL = {
    "short": [1, 2, 3], "zeros": [0] * 14, "constant": [5] * 14, "up": list(range(1, 11)), "down": list(range(10, 0, -1)),
    "n10_spike": [1] * 9 + [100], "n11_spike": [1] * 10 + [100], "spike_below": [50, 51, 49, 50, 52, 48, 50, 51, 49, 50, 51, -400],
    "step_const": [1] * 6 + [9] * 6, "step": [1, 2, 1, 2, 1, 2, 20, 21, 20, 22, 21, 20], "peak": [1, 3, 6, 9, 7, 4, 2],
    "valley": [9, 6, 3, 1, 4, 7, 8], "edge_peak": [9, 7, 5, 3, 2, 1], "flat_steps": [1, 1, 1, 9, 1, 1, 1],
    "period_3": [1, 5, 9] * 5, "period_4": [1, 4, 2, 9] * 4, "period_6": [1, 2, 9, 3, 7, 2] * 2, "period_12": list(range(12)) * 2,
    "noise": [3, 9, 2, 8, 4, 7, 1, 6, 5, 3, 8, 2, 9], "rho_half": [1, 3, 2, 5, 4, 7, 6, 9, 8, 3, 2, 1, 4, 5, 9, 8],
    "nulls": [None, 2, 4, None, 8, 16, 32], "all_null": [None] * 6,
}


def run(spark, cases, temporal):
    rows = [
        (name, i, f"L{i:03d}", float(v)) for name, values in cases.items() for i, v in enumerate(values) if v is not None
    ]
    pts = spark.createDataFrame(rows, "s string, code int, label string, value double")
    stats = P.temporal_stats(pts, ["s"]) if temporal else P.categorical_stats(pts, ["s"])
    tests = P.TEMPORAL if temporal else P.CATEGORICAL
    got = stats.select("s", P.hits_column(tests, CONFIG).alias("h")).collect()
    return {r["s"]: {h["type"]: h["highlight"] for h in r["h"]} for r in got}


def expected(cases, kinds):
    fns = brute.tests(CONFIG)
    out = {}
    for name, values in cases.items():
        s = pd.Series({f"L{i:03d}": float(v) for i, v in enumerate(values) if v is not None}, dtype=float)
        if len(s):
            found = {k: fns[k](s) for k in kinds}
            out[name] = {k: v for k, v in found.items() if v is not None}
    return out


def test_categorical_series(spark):
    assert run(spark, CATEGORICAL, False) == expected(CATEGORICAL, P.CATEGORICAL)


def test_temporal_series(spark):
    assert run(spark, TEMPORAL, True) == expected(TEMPORAL, P.TEMPORAL)


def test_known_verdicts(spark):
    cat, tem = run(spark, CATEGORICAL, False), run(spark, TEMPORAL, True)
    assert cat["one_big"]["OUTSTANDING_1"] == "L000"
    assert cat["negative_even"] == {"EVENNESS": "EVEN"} or "EVENNESS" in cat["negative_even"]
    assert cat["majority"]["ATTRIBUTION"] == "L000"
    assert "OUTLIER" not in tem["n10_spike"] and tem["n11_spike"]["OUTLIER"] == "L010:ABOVE"
    assert tem["step_const"]["CHANGE_POINT"] == "L006"
    assert tem["peak"]["UNIMODALITY"] == "PEAK|L003" and "UNIMODALITY" not in tem["edge_peak"]
    assert "UNIMODALITY" not in tem["flat_steps"]
    assert tem["period_12"]["SEASONALITY"] == "PERIOD_12"
    assert tem["zeros"] == {}


def test_random_series(spark):
    rng = np.random.default_rng(7)
    cat = {f"c{i}": list(np.round(rng.gamma(0.7, 50, rng.integers(2, 9)), 2)) for i in range(150)}
    tem = {f"t{i}": list(np.round(np.cumsum(rng.normal(0.3, 5, rng.integers(3, 30))), 2)) for i in range(150)}
    assert run(spark, cat, False) == expected(cat, P.CATEGORICAL)
    assert run(spark, tem, True) == expected(tem, P.TEMPORAL)


# critical values of a printed t table
@pytest.mark.parametrize("df,t,p", [(1, 12.706, 0.05), (5, 2.571, 0.05), (10, 3.169, 0.01), (26, 2.056, 0.05), (78, 2.640, 0.01)])
def test_t_tail(df, t, p):
    assert t_two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, rel=2e-3)


@given(st.floats(0.0, 50.0), st.floats(1.0, 200.0))
@settings(max_examples=60, deadline=None)
def test_t_tail_by_quadrature(t, df):
    start = math.atan(t / math.sqrt(df))

    def area(a):
        x = np.linspace(a, math.pi / 2, 20001)
        y = np.maximum(np.cos(x), 0) ** (df - 1)
        return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    assert t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(area(start) / area(0.0), rel=1e-3, abs=1e-12)


@pytest.mark.parametrize("t, df, p", [
    (12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (2.750, 30, 0.01), (1.960, 1e7, 0.05), (2.576, 1e7, 0.01)])
def test_two_sided_t_against_printed_tables(t, df, p):
    from ledgerlens.mining.stats import t_two_sided

    assert t_two_sided(np.array([t]), np.array([float(df)]))[0] == pytest.approx(p, rel=2e-3)
