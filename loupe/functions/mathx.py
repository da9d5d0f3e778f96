"""Numeric column expressions Spark SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation of the gamma function, g = 7, nine
# coefficients (the widely published set; relative error about 1e-15).
LANCZOS_G = 7
LANCZOS_COEF = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x >= 0.5 (all uses here are x = n + 1, n >= 0)."""
    z = x - F.lit(1.0)
    a = F.lit(LANCZOS_COEF[0])
    for i, c in enumerate(LANCZOS_COEF[1:], start=1):
        a = a + F.lit(c) / (z + F.lit(float(i)))
    t = z + F.lit(LANCZOS_G + 0.5)
    return (F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.log(t) - t + F.log(a))


def log_factorial(n: Column) -> Column:
    return lgamma(n.cast("double") + F.lit(1.0))
