"""Student t quantiles and tail probabilities.

The quantile is a column expression: a table for small degrees of freedom that
Catalyst folds to one literal, and the Cornish-Fisher series above it, where the
neglected term is below 1e-10. The tail probability needs the incomplete beta
function and is the only Arrow function here.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# executors need not have this package installed to run the tail probability
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLE_SIZE = 200


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20000):
        for coefficient in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + coefficient * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coefficient / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-15):
            break
    return h


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN where undefined."""
    t = np.abs(np.asarray(t, dtype=float))
    df = np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    tt, nu = t[ok], df[ok]
    a, b = nu / 2.0, np.full_like(nu, 0.5)
    # x = nu / (nu + t^2); the complement is formed directly to keep small t exact
    x, y = nu / (nu + tt * tt), tt * tt / (nu + tt * tt)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log(y))
    direct = x < (a + 1.0) / (a + b + 2.0)
    p = np.empty_like(tt)
    if direct.any():
        p[direct] = front[direct] * _beta_fraction(a[direct], b[direct], x[direct]) / a[direct]
    rest = ~direct
    if rest.any():
        p[rest] = 1.0 - front[rest] * _beta_fraction(b[rest], a[rest], y[rest]) / b[rest]
    out[ok] = np.clip(p, 0.0, 1.0)
    return out


def _cornish_fisher(z: float, df: str) -> str:
    """SQL for the series around the normal quantile ``z``."""
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    terms = [f"{g!r}D / power({df}, {i})" for i, g in enumerate((g1, g2, g3, g4), start=1)]
    return f"({z!r}D + {' + '.join(terms)})"


@lru_cache(maxsize=16)
def quantile_table(level: float = 0.95) -> tuple[float, ...]:
    """Two-sided ``level`` quantiles for 1..TABLE_SIZE degrees of freedom, by bisection."""
    alpha = 1.0 - level
    df = np.arange(1, TABLE_SIZE + 1, dtype=float)
    lo = np.zeros_like(df)
    hi = np.full_like(df, 2.0 / alpha + 10.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = two_sided_p(mid, df) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return tuple(float(v) for v in (lo + hi) / 2)


def t_quantile(df: str, level: float = 0.95) -> str:
    """SQL for the half-width multiplier of a two-sided ``level`` interval.

    ``df`` is an integer column or expression; NULL below one degree of freedom.
    """
    table = ", ".join(f"{v!r}D" for v in quantile_table(level))
    z = NormalDist().inv_cdf(0.5 + level / 2)
    return (
        f"CASE WHEN {df} < 1 THEN NULL"
        f" WHEN {df} <= {TABLE_SIZE} THEN element_at(array({table}), CAST({df} AS INT))"
        f" ELSE {_cornish_fisher(z, df)} END"
    )


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    p = two_sided_p(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(~np.isnan(p))
