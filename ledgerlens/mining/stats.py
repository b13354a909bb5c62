"""Two-sided t-distribution tail as a vectorised helper for Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOG_GAMMA = np.frompyfunc(__import__("math").lgamma, 1, 1)


def _log_gamma(x):
    return _LOG_GAMMA(x).astype(float)


def t_two_sided(t, df):
    """P(|T| >= |t|) = I_x(df/2, 1/2) at x = df / (df + t^2), by a continued fraction."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(np.broadcast(t, df).shape, np.nan)
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out[ok & np.isinf(t)] = 0.0
    ok &= np.isfinite(t)
    if not ok.any():
        return out
    a, b = df[ok] / 2.0, np.full(ok.sum(), 0.5)
    t2 = t[ok] ** 2
    x, y = df[ok] / (df[ok] + t2), t2 / (df[ok] + t2)
    with np.errstate(divide="ignore"):
        front = np.exp(
            _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
            + a * np.log(x) + b * np.log(np.where(y > 0, y, 1.0))
        ) * np.where(y > 0, 1.0, 0.0)
    direct = x < (a + 1) / (a + b + 2)
    res = np.where(
        direct,
        front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, y))
        / np.where(direct, a, b),
        1.0 - front * _beta_fraction(np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, y))
        / np.where(direct, a, b),
    )
    out[ok] = np.where(y == 0, 1.0, res)
    return out


def _beta_fraction(a, b, x, eps=1e-15):
    # the fraction settles within a number of rounds that grows with the root of its parameters
    rounds = 200 + int(20 * np.sqrt(np.max(np.maximum(a, b), initial=1.0)))
    tiny = 1e-300

    def away(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / away(1.0 + even * d)
        c = away(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / away(1.0 + odd * d)
        c = away(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < eps):
            break
    return h


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)))
