"""Special functions as column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: shifted up by 8, then Stirling's series."""
    x = x.cast("double")
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    shifted = (z - 0.5) * F.log(z) - z + _HALF_LOG_TAU + series
    # two logarithms of four factors each, so that the product of large x does not overflow
    low, high = x * (x + 1) * (x + 2) * (x + 3), (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return shifted - F.log(low) - F.log(high)


def log_rising(x: Column, n: Column) -> Column:
    """ln of x (x+1) ... (x+n-1), that is lnΓ(x+n) - lnΓ(x); short products need no gamma function."""
    x = x.cast("double")
    return F.when(n == 0, 0.0).when(n == 1, F.log(x)).when(n == 2, F.log(x) + F.log(x + 1)).otherwise(lgamma(x + n) - lgamma(x))


def sum_log(a: Column, b: Column, c: Column) -> Column:
    """Sum of ln(j + c) for j = a..b; 0 for an empty range."""
    return F.when(b < a, 0.0).otherwise(lgamma(c + b + 1) - lgamma(c + a))


def kl_term(p: Column, q: Column, smoothing: float = 1e-4) -> Column:
    """One entry of the smoothed, not renormalised divergence of p from q."""
    return (p + smoothing) * F.log((p + smoothing) / (q + smoothing))
