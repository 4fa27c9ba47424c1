"""Gamma-family special functions: SQL expressions and one vectorised UDF.

The expressions shift the argument up by ``SHIFT`` and use the asymptotic series
there; the error is below 1e-11 for positive arguments.  They are text, so that
they can be nested in lambda functions and stay small in a plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFT = 8
HALF_LOG_TWO_PI = 0.9189385332046727


def _shifted_sum(term: str) -> str:
    """Sum of ``term`` in k over the unit steps that the shift skips."""
    return f"aggregate(sequence(0, {SHIFT - 1}), 0D, (acc, k) -> acc + {term})"


def lgamma_sql(x: str) -> str:
    z = f"({x} + {SHIFT})"
    series = f"1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - 1 / (1680 * pow({z}, 7))"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {HALF_LOG_TWO_PI}D + {series} - {_shifted_sum(f'ln({x} + k)')})"


def digamma_sql(x: str) -> str:
    z = f"({x} + {SHIFT})"
    series = f"1 / (12 * pow({z}, 2)) - 1 / (120 * pow({z}, 4)) + 1 / (252 * pow({z}, 6)) - 1 / (240 * pow({z}, 8))"
    return f"(ln({z}) - 0.5D / {z} - ({series}) - {_shifted_sum(f'1 / ({x} + k)')})"


def trigamma_sql(x: str) -> str:
    z = f"({x} + {SHIFT})"
    series = f"1 / {z} + 1 / (2 * pow({z}, 2)) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5)) + 1 / (42 * pow({z}, 7))"
    return f"({series} + {_shifted_sum(f'1 / (({x} + k) * ({x} + k))')})"


# Shapes from here on are integrated; below, series and continued fraction need a few hundred steps at most.
LARGE_SHAPE = 500.0
NODES, WEIGHTS = np.polynomial.legendre.leggauss(96)
# Standard deviations from the mode beyond which nothing is left in double precision.
REACH = 12.0


def _integrated(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For large shapes: the density, a bell of width sqrt(a), integrated from z to the end of the nearer tail.

    In u = t / a - 1 the logarithm of the density has no large terms that cancel, so shapes of 1e8 lose no digits.
    """
    width = REACH / np.sqrt(a)
    u = z / a - 1
    below = u < 0
    far = np.where(below, np.maximum(-width, -1.0), width)
    low, high = np.minimum(u, far), np.maximum(u, far)
    at = (low + high)[:, None] / 2 + (high - low)[:, None] / 2 * NODES
    with np.errstate(all="ignore"):
        log = a[:, None] * (np.log1p(at) - at) - np.log1p(at)
        tail = (np.exp(log) * WEIGHTS).sum(1) * (high - low) / 2
    # Logarithm of a**a e**-a / gamma(a), with the start of the usual series.
    tail *= np.exp(0.5 * np.log(a / (2 * np.pi)) - 1 / (12 * a) + 1 / (360 * a**3))
    tail = np.where(np.abs(u) >= width, 0.0, tail)
    return np.where(below, tail, 1.0 - tail)


def lower_incomplete(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, elementwise; the steps it takes are bounded for every shape."""
    out = np.full(a.shape, np.nan)
    out[(z <= 0) & np.isfinite(a)] = 0.0
    large = (a >= LARGE_SHAPE) & np.isfinite(a) & (z > 0)
    if large.any():
        out[large] = _integrated(a[large], z[large])
        out[~large] = lower_incomplete(a[~large], z[~large])
        return out
    front = np.array([math.lgamma(v) if np.isfinite(v) and v > 0 else np.nan for v in a])
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(z) - z - front)

    low = (z > 0) & (z < a + 1)
    if low.any():
        al, zl = a[low], z[low]
        term = 1.0 / al
        total = term.copy()
        k = 0
        while np.any(term > total * 1e-16):  # ends: z / (a + k) falls below any share
            k += 1
            term = term * zl / (al + k)
            total = total + term
        out[low] = total * front[low]

    high = (z > 0) & (z >= a + 1)
    if high.any():
        # Modified Lentz evaluation of the continued fraction of the upper tail.
        ah, zh = a[high], z[high]
        b = zh + 1 - ah
        c = np.full(zh.shape, 1e300)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 10 * int(LARGE_SHAPE)):  # the fraction ends long before, also for huge z
            an = -k * (k - ah)
            b = b + 2
            d = 1.0 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = 1.0 - h * front[high]
    return out


@F.pandas_udf(T.DoubleType())
def _gamma_cdf(x: pd.Series, shape: pd.Series, loc: pd.Series, scale: pd.Series) -> pd.Series:
    a = shape.to_numpy(dtype=float, na_value=np.nan)
    z = (x - loc).to_numpy(dtype=float, na_value=np.nan) / scale.to_numpy(dtype=float, na_value=np.nan)
    return pd.Series(lower_incomplete(a, z))


def gamma_cdf(x: Column, shape: Column, loc: Column, scale: Column) -> Column:
    """Gamma distribution function; NULL where a parameter is NULL."""
    return _gamma_cdf(x, shape, loc, scale)
