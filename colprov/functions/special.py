"""Special functions as column expressions, so tests of significance stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, brought back by the recurrence."""
    z = x + 10
    shift = F.lit(0.0)
    for k in range(10):
        shift = shift + F.log(x + k)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def binomial_two_sided(b: Column, n: Column) -> Column:
    """Exact two-sided binomial p at 1/2, summing every outcome no likelier than
    ``b`` (slack 1e-12); 1 when ``n`` is 0.

    Outcomes further than 40 standard deviations from the middle have no weight
    in double precision and are not enumerated, so the work grows with sqrt(n).
    """
    n_ = n.cast("double")
    reach = F.ceil(20 * F.sqrt(n_) + 1)
    lo = F.greatest(F.lit(0.0), F.floor(n_ / 2 - reach)).cast("long")
    hi = F.least(n_, F.ceil(n_ / 2 + reach)).cast("long")
    # the observed count may lie outside the enumerated middle: its mass is then 0
    ks = F.sequence(lo, hi)

    def pmf(k):
        k_ = k.cast("double")
        return F.exp(ln_gamma(n_ + 1) - ln_gamma(k_ + 1) - ln_gamma(n_ - k_ + 1) - n_ * math.log(2.0))

    # slack relative as well as absolute, since pmf(k) and pmf(n-k) differ in the last bits
    limit = pmf(b) * (1 + 1e-9) + 1e-12
    total = F.aggregate(
        ks, F.lit(0.0), lambda acc, k: acc + F.when(pmf(k) <= limit, pmf(k)).otherwise(F.lit(0.0))
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom, by the closed
    trigonometric sums for odd and even ``df``."""
    d = df.cast("long")
    theta = F.atan(F.abs(t) / F.sqrt(d.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    terms = F.greatest(F.floor((d - 1) / 2).cast("long"), F.lit(1).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def odd_step(acc, k):
        # cos, (2/3) cos^3, (2*4)/(3*5) cos^5 ...
        term = F.when(k == 1, c).otherwise(acc["term"] * c * c * (2 * k - 2) / (2 * k - 1))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    def even_step(acc, k):
        # 1, (1/2) cos^2, (1*3)/(2*4) cos^4 ...
        term = acc["term"] * c * c * (2 * k - 1) / (2 * k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    odd_sum = F.when(d == 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("long"), terms), start, odd_step, lambda a: a["total"])
    )
    even_sum = F.lit(1.0) + F.when(d == 2, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("long"), terms), start, even_step, lambda a: a["total"])
    )
    inside = F.when(d % 2 == 1, 2 / math.pi * (theta + s * odd_sum)).otherwise(s * even_sum)
    return F.greatest(F.lit(0.0), 1 - inside)


def normal_upper(z: Column) -> Column:
    """P(Z > z), by the Abramowitz-Stegun 7.1.26 approximation (error < 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)
