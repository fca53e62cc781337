"""Tail probabilities for test statistics (χ², Student t).

Spark SQL has no special functions, and the statistics themselves are
computed by Spark aggregates; only the final p-value of each test row needs
the regularised incomplete gamma / beta function.  They are applied with a
pandas UDF over the (one-row-per-test) result frame.  Algorithms: series and
Lentz continued fractions for P(a, x) and I_x(a, b) (standard textbook forms).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_MAX_IT = 10_000


def _gamma_p_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAX_IT):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    else:
        raise ArithmeticError("the series did not converge")
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_fraction(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_IT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    else:
        raise ArithmeticError("the series did not converge")
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_p_series(a, x)
    return _gamma_q_fraction(a, x)


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for X ~ χ²(dof)."""
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    return gamma_q(dof / 2.0, x / 2.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAX_IT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    else:
        raise ArithmeticError("the series did not converge")
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or dof is None or dof <= 0 or math.isnan(t) or math.isnan(dof):
        return float("nan")
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def _chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, dof)])


def chi2_p(stat: Column, dof: Column) -> Column:
    """Column: χ² upper-tail probability (applied to one-row-per-test frames)."""
    return _chi2_sf_udf(stat.cast("double"), dof.cast("double"))


def t_p(t: Column, dof: Column) -> Column:
    """Column: two-sided Student-t probability."""
    return _t_p_udf(t.cast("double"), dof.cast("double"))
