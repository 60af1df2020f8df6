"""digamma, trigamma and lgamma for numpy arrays (no scipy in the image).

digamma / trigamma: shift x up to >= 10 with the recurrences
psi(x) = psi(x+1) - 1/x and psi1(x) = psi1(x+1) + 1/x^2, then the
asymptotic (Bernoulli) series; absolute error below 1e-13 for x > 0.
"""

from __future__ import annotations

import math

import numpy as np

_SHIFT = 10.0


def digamma(x):
    x = np.asarray(x, dtype=np.float64)
    xx = x.copy()
    res = np.zeros_like(xx)
    while True:
        m = xx < _SHIFT
        if not m.any():
            break
        res[m] -= 1.0 / xx[m]
        xx[m] += 1.0
    f = 1.0 / (xx * xx)
    series = f * (1.0 / 12 - f * (1.0 / 120 - f * (1.0 / 252 - f * (1.0 / 240 - f * (
        1.0 / 132 - f * (691.0 / 32760 - f / 12.0))))))
    return res + np.log(xx) - 0.5 / xx - series


def trigamma(x):
    x = np.asarray(x, dtype=np.float64)
    xx = x.copy()
    res = np.zeros_like(xx)
    while True:
        m = xx < _SHIFT
        if not m.any():
            break
        res[m] += 1.0 / (xx[m] * xx[m])
        xx[m] += 1.0
    f = 1.0 / (xx * xx)
    series = (1.0 / xx) * (1.0 + f * (1.0 / 6 - f * (1.0 / 30 - f * (1.0 / 42 - f * (
        1.0 / 30 - f * (5.0 / 66 - f * 691.0 / 2730))))))
    return res + series + 0.5 * f


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, dtype=np.float64)), dtype=np.float64)


def dirichlet_expectation(alpha: np.ndarray) -> np.ndarray:
    """E[log theta] for theta ~ Dir(alpha), row-wise for a matrix."""
    a = np.asarray(alpha, dtype=np.float64)
    if a.ndim == 1:
        return digamma(a) - digamma(a.sum())
    return digamma(a) - digamma(a.sum(axis=1))[:, None]


def log_sum_exp(x: np.ndarray, axis=-1) -> np.ndarray:
    a = np.max(x, axis=axis, keepdims=True)
    return np.squeeze(a, axis=axis) + np.log(np.sum(np.exp(x - a), axis=axis))
