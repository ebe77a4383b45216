"""Two-sided p-values as native Column expressions (no SciPy, no UDF).

Both are Simpson sums over a fixed grid, built with ``aggregate(sequence(0, N), ...)``; they are
evaluated on one-row frames, so their cost is nil. Accuracy against textbook critical values:
1.959964 -> 0.05 (normal), (2.228139, 10 df) -> 0.05, (12.7062, 1 df) -> 0.05 (see tests).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000          # Simpson intervals (even)
NORMAL_SPAN = 12.0    # integrate the normal tail over [|z|, |z| + 12]; the rest is < 1e-32
T_CUTOFF = 40.0       # for df > 30 the t tail beyond |t| = 40 is negligible


def _simpson(lo: Column, hi: Column, f) -> Column:
    """Simpson's rule for f over [lo, hi] with STEPS intervals."""
    h = (hi - lo) / STEPS

    def step(acc, i):
        w = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return acc + w * f(lo + i.cast("double") * h)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), step) * h / 3.0


def normal_two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by integrating the standard normal density over the upper tail."""
    a = F.abs(z)
    tail = _simpson(a, a + NORMAL_SPAN, lambda x: F.exp(-(x * x) / 2.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail * (2.0 / math.sqrt(2.0 * math.pi))))


def student_t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for Student's t with (real) df >= 1.

    With t = sqrt(df) * tan(theta) the density becomes proportional to cos(theta)^(df - 1), so
    p = integral over [theta0, theta_max] / integral over [0, theta_max], theta0 = atan(|t| / sqrt(df)).
    """
    root = F.sqrt(df)
    theta0 = F.atan(F.abs(t) / root)
    theta_max = F.when(df <= 30, F.lit(math.pi / 2)).otherwise(F.atan(F.lit(T_CUTOFF) / root))
    dens = lambda th: F.pow(F.cos(th), df - 1.0)
    upper = F.when(theta0 >= theta_max, F.lit(0.0)).otherwise(_simpson(theta0, theta_max, dens))
    whole = _simpson(F.lit(0.0), theta_max, dens)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), upper / whole))
