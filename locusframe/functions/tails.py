"""Tail probabilities of the t and chi-square distributions as vectorised column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _each(f, x):
    """A scalar function of the standard library over an array, once for each different value (degrees of freedom repeat)."""
    x = np.asarray(x, float)
    values, place = np.unique(x, return_inverse=True)
    return np.array([f(v) for v in values], float)[place].reshape(x.shape)


def _log_beta(a, b):
    """log B(a, b); where one argument is large, by the asymptotic series of the ratio of gammas.

    The difference of two large log-gammas loses as many digits as they have in common.
    """
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    large, small = np.maximum(a, b), np.minimum(a, b)
    plain = large < 1e4
    at = np.where(plain, large, 1.0)
    direct = _each(math.lgamma, at) - _each(math.lgamma, at + np.where(plain, small, 0.0))

    def rest(z):  # log-gamma beyond Stirling's main terms
        return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)

    far = np.where(plain, 1e4, large)
    total = far + small
    series = -(far - 0.5) * np.log1p(small / far) - small * np.log(total) + small + rest(far) - rest(total)
    return np.where(plain, direct, series) + _each(math.lgamma, small)


def _beta_fraction(x, a, b):
    """Continued fraction of the incomplete beta function (modified Lentz recurrence)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        before = h.copy()
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-15 * np.abs(h)):
            return h
    if np.any(np.abs(h - before) > 1e-9 * np.abs(h)):
        raise ArithmeticError("the continued fraction of the incomplete beta function did not settle")
    return h


def betainc(a, b, x, rest=None):
    """Regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x where that is known more exactly than x."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, 1.0 - np.asarray(x, float) if rest is None else rest)))
    inside = (x > 0) & (y > 0)
    log_x = np.where(y < 0.5, np.log1p(-np.where(y < 0.5, y, 0.0)), np.log(np.where(inside, x, 1.0)))
    log_y = np.where(x < 0.5, np.log1p(-np.where(x < 0.5, x, 0.0)), np.log(np.where(inside, y, 1.0)))
    front = np.exp(a * log_x + b * log_y - _log_beta(a, b))
    low = x < (a + 1.0) / (a + b + 2.0)
    direct = front * _beta_fraction(np.where(low, x, 0.0), a, b) / a
    mirror = 1.0 - front * _beta_fraction(np.where(low, 0.0, y), b, a) / b
    out = np.where(low, direct, mirror)
    return np.where(x <= 0, 0.0, np.where(y <= 0, 1.0, out))


def t_two_sided(t, df):
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    # beyond a million degrees of freedom the tail is the normal one at an adjusted t, exact to the square of 1/df
    many = safe_df > 1e6
    few_df, total = np.where(many, 1.0, safe_df), np.where(many, 1.0, safe_df) + safe_t * safe_t
    z = np.abs(safe_t) * (1.0 - 1.0 / (4.0 * safe_df)) / np.sqrt(1.0 + safe_t * safe_t / (2.0 * safe_df))
    p = np.where(many, _each(math.erfc, np.where(many, z, 0.0) / math.sqrt(2.0)),
                 betainc(few_df / 2.0, 0.5, few_df / total, safe_t * safe_t / total))
    return np.where(ok, p, np.where(np.isinf(t), 0.0, np.nan))


def chi2_1_sf(x):
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return _each(math.erfc, np.sqrt(np.maximum(np.asarray(x, float), 0.0) / 2.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_1_pvalue(x: pd.Series) -> pd.Series:
    return pd.Series(chi2_1_sf(x.to_numpy(float)))
