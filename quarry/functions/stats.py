"""Statistics as Spark column expressions (no scipy/statsmodels needed)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col_
from quarry.functions.walk import let

def _range_1_to(k: Column) -> Column:
    """``[1..k]`` as longs, empty when k < 1 (``sequence`` counts down otherwise)."""
    return F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))


# Stirling's series: the coefficients of 1/x, 1/x^3, .. of ln(x!) - (x + 1/2) ln x + x - ln(2 pi) / 2
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_EXACT = [0.0] + [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) for x in range(1, 16)]


def _stirling_error(x: Column) -> Column:
    """What Stirling's formula leaves of ln(x!), for whole x >= 1: a table, then the series."""
    square = 1.0 / (x * x)
    series = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = F.lit(c) + series * square
    table = F.array(*map(F.lit, _EXACT))
    return F.when(x < len(_EXACT), F.get(table, x.cast("int"))).otherwise(series / x)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without cancellation where x is near the mean."""
    d = x - mean
    v = d / (x + mean)
    # 2 x sum v^(2j+1) / (2j+1) + d v, for small v: ten terms leave less than 1e-17 of the first
    powers = F.lit(0.0)
    for j in reversed(range(1, 11)):
        powers = (powers + 1.0 / (2 * j + 1)) * (v * v)
    return F.when(F.abs(v) < 0.1, d * v + 2 * x * v * powers).otherwise(x * F.log(x / mean) - d)


def binom_half_pmf(k, n) -> Column:
    """P(X = k) for X ~ Binomial(n, 1/2), by the deviance from the mean (Loader 2000): no term grows with n."""
    k, n = col_(k).cast("double"), col_(n).cast("double")
    half = n / 2
    log_p = (_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, half) - _deviance(n - k, half)
             + 0.5 * F.log(n / (2 * math.pi * k * (n - k))))
    return F.when((k == 0) | (k == n), F.pow(F.lit(0.5), n)).otherwise(F.exp(log_p))


def binom_half_cdf(k, n) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2), the regularised incomplete beta function I(n - k, k + 1) at 1/2.

    P(X = k) times the continued fraction of the ratio of the tail to its last term.  Below the
    mean it needs a number of steps of the order of the square root of n, far from it a few; the
    upper half follows by symmetry.  No array has a length of the order of k.
    """
    k, n = col_(k).cast("double"), col_(n).cast("double")
    upper = 2 * k >= n
    low = F.when(upper, n - k - 1).otherwise(k)  # P(X <= k) = 1 - P(X <= n - k - 1)

    def cdf(x: Column) -> Column:
        tail = F.when(x["low"] < 0, F.lit(0.0)).otherwise(binom_half_pmf(x["low"], x["n"]) * _tail_ratio(x["low"], x["n"]))
        return F.when(x["upper"], 1.0 - tail).otherwise(tail)

    return let(F.struct(low.alias("low"), n.alias("n"), upper.alias("upper")), cdf)


def _tail_ratio(k: Column, n: Column) -> Column:
    """P(X <= k) / P(X = k) = 1 + k/(n-k+1) (1 + (k-1)/(n-k+2) (1 + ..)) for 2 k < n.

    The series is the hypergeometric F(-k, 1; n-k+1; -1); its Gauss continued fraction
    1 / (1 + c1 / (1 + c2 / ..)) is evaluated from behind, from the step where what is left is
    below the precision.  It ends by itself after 2 k steps.
    """
    gap = (n - 2 * k) / F.sqrt(n)  # standard deviations below the mean
    steps = F.least(2 * k, F.ceil(4 * F.sqrt(n) / (1 + gap)) + 40).cast("long")

    def fraction(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            j = F.floor((x["steps"] - i + 1) / 2).cast("double")  # from the last coefficient to the first
            at = x["b"] + 2 * j
            odd = -(x["k"] - j) * (x["b"] + j) / (at * (at + 1))
            even = j * (x["b"] + x["k"] + j) / ((at - 1) * at)
            return 1.0 + F.when((x["steps"] - i) % 2 == 0, odd).otherwise(even) / acc

        return 1.0 / F.aggregate(_range_1_to(x["steps"]), F.lit(1.0), step)

    return let(F.struct(steps.alias("steps"), k.alias("k"), (n - k).alias("b")), fraction)


def mcnemar_exact(n10, n01) -> tuple[Column, Column]:
    """Exact two-sided McNemar test: (statistic, p-value).

    statistic = min(n10, n01); p = min(1, 2 * BinomCDF(statistic; n10+n01, 1/2)).
    """
    n10, n01 = col_(n10).cast("long"), col_(n01).cast("long")
    stat = F.least(n10, n01)
    p = F.least(F.lit(1.0), 2.0 * binom_half_cdf(stat, n10 + n01))
    return stat, p


def odds_ratio(passed_1, failed_1, passed_2, failed_2) -> Column:
    """(p1/f1)/(p2/f2); null when any ratio is undefined."""
    r1 = F.try_divide(col_(passed_1).cast("double"), col_(failed_1).cast("double"))
    r2 = F.try_divide(col_(passed_2).cast("double"), col_(failed_2).cast("double"))
    return F.try_divide(r1, r2)


def pass_at_k(n, c, k: int) -> Column:
    """Unbiased pass@k for one problem with n samples, c correct.

    1 - prod_{i<k} (n-c-i) / (n-i); null when there are fewer than k
    samples, which cannot tell; 0 when c = 0; 1 when n-c < k.
    """
    n, c = col_(n).cast("double"), col_(c).cast("double")
    missed = F.lit(1.0)
    for i in range(min(k, 16)):
        missed = missed * ((n - c - i) / (n - i))
    if k > 16:
        missed = F.aggregate(F.sequence(F.lit(16), F.lit(k - 1)), missed, lambda acc, i: acc * ((n - c - i) / (n - i)))
    return (F.when(n < k, F.lit(None).cast("double"))
            .when(c == 0, F.lit(0.0))
            .when(n - c < k, F.lit(1.0))
            .otherwise(1.0 - missed))
