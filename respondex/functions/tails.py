"""Tails of three distributions, vectorised: the only Python in the library's numeric paths."""

from __future__ import annotations

from math import erfc, lgamma

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(lgamma, otypes=[float])


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    small = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.maximum(x, small)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < small, small, d)
        f = d.copy()
        for m in range(1, 300):
            up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            for step in (up, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + step * d
                c = 1 + step / c
                d = 1 / np.where(np.abs(d) < small, small, d)
                c = np.where(np.abs(c) < small, small, c)
                f = f * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
                break
    out = np.where(x <= 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


@pandas_udf(DoubleType())
def student_t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t; null where t or df is missing."""
    x, n = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(x) & np.isfinite(n) & (n > 0)
    x, n = np.where(ok, x, 0.0), np.where(ok, n, 1.0)
    return pd.Series(np.where(ok, np.clip(beta_fraction(n / 2, np.full_like(n, 0.5), n / (n + x * x)), 0, 1), np.nan)).where(ok, None)


@pandas_udf(DoubleType())
def normal_sf2(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    x = np.abs(z.to_numpy(float)) / 2**0.5
    return pd.Series(np.fromiter(map(erfc, x), float, len(x))).where(~np.isnan(x), None)


@pandas_udf(DoubleType())
def hypergeom_tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided (greater) Fisher p of the table (a, b; c, d), for all rows at once.

    Terms are added from the one nearest the mode outward, until all have vanished: from a up if a
    is above the mode, else 1 less those from a - 1 down.  So a first term too small for a
    double stands for a tail that is.
    """
    cells = np.stack([x.to_numpy(float) for x in (a, b, c, d)])
    ok = ~np.isnan(cells).any(axis=0)
    a, b, c, d = np.where(ok, cells, 0.0)
    row, col, n = a + b, a + c, a + b + c + d
    top = int(n.max(initial=0)) + 1
    if top <= 1 << 20:  # a table of log factorials serves all cells
        factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
        log_factorial = lambda x: factorials[x.astype(np.int64)]
    else:
        log_factorial = lambda x: _lgamma(x + 1)
    sides = log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col)
    upper = a > np.floor((row + 1) * (col + 1) / (n + 2))
    k, least, most = np.where(upper, a, a - 1), np.maximum(0, row + col - n), np.minimum(row, col)
    some = k >= least
    x = np.where(some, k, a)
    term = np.where(some, np.exp(sides - log_factorial(n) - sum(map(log_factorial, (x, row - x, col - x, n - row - col + x)))), 0.0)
    total = term.copy()
    live = np.flatnonzero(some & np.where(upper, k < most, k > least) & (term > 0))
    while len(live):
        x, r, m, rest, up = k[live], row[live], col[live], n[live] - row[live] - col[live], upper[live]
        term[live] *= np.where(up, (r - x) * (m - x) / ((x + 1) * (rest + x + 1)), x * (rest + x) / ((r - x + 1) * (m - x + 1)))
        k[live] += np.where(up, 1, -1)
        total[live] += term[live]
        live = live[np.where(up, k[live] < most[live], k[live] > least[live]) & (term[live] >= total[live] * 1e-17)]
    return pd.Series(np.clip(np.where(upper, total, 1 - total), 0.0, 1.0)).where(ok, None)
