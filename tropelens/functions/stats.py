"""Statistics: column expressions where sums suffice, plain Python where only a handful of numbers is left."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval; null for n = 0."""
    p, zz = k / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n))
    return F.when(n > 0, (middle - half) / (1 + zz / n)), F.when(n > 0, (middle + half) / (1 + zz / n))


def kappa(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Cohen's kappa of two binary raters from counts; null if chance agreement is 1."""
    agree = (n - a - b + 2 * both) / n
    chance = (a * b + (n - a) * (n - b)) / (n * n)
    return F.when(chance < 1, (agree - chance) / (1 - chance))


def gwet_ac1(both: Column, a: Column, b: Column, n: Column) -> Column:
    agree, q = (n - a - b + 2 * both) / n, (a + b) / (2 * n)
    chance = 2 * q * (1 - q)
    return F.when(chance < 1, (agree - chance) / (1 - chance))


def positive_agreement(both: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * both / (a + b))


#: Coefficients of a rational approximation of the complementary error function, from the constant term on.
TAIL = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def upper_tail(z: Column) -> Column:
    """P(normal > z), with a relative error below 1.2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    power = F.lit(TAIL[-1])
    for c in reversed(TAIL[:-1]):
        power = c + t * power
    half = 0.5 * t * F.exp(-x * x + power)
    return F.when(z >= 0, half).otherwise(1 - half)


def log_gamma(x: Column) -> Column:
    """For x > 0, by Stirling's series at x + 8 and the recursion down from there."""
    z, down = x + 8, F.lit(0.0)
    for k in range(8):
        down += F.log(x + k)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - down


def beta_share(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 <= x <= 1, by its continued fraction, evaluated from the back, on
    the side of the mean where it converges in about sqrt(max(a, b)) terms."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(tail: Column, m: Column) -> Column:
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
            return 1 + odd / (1 + even / tail)

        whole = F.aggregate(F.sequence(F.lit(terms), F.lit(0), F.lit(-1)), F.lit(1.0), lambda tail, m: step(tail, m.cast("double")))
        return F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / (a * whole)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x <= (a + 1) / (a + b + 2), fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))


def student_tail(t_squared: Column, df: Column) -> Column:
    """Two-sided p of Student's t; over 10,000 degrees of freedom by a normal deviate that corrects for them."""
    far = 2 * upper_tail((1 - 1 / (4 * df)) * F.sqrt(t_squared / (1 + t_squared / (2 * df))))
    return F.when(df > 10_000, far).otherwise(beta_share(df / 2, F.lit(0.5), df / (df + t_squared)))


def tail_sql(z: str) -> str:
    """upper_tail() for another engine."""
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t = f"(1 / (1 + 0.5::DOUBLE * {x}))"
    power = f"{TAIL[-1]}::DOUBLE"
    for c in reversed(TAIL[:-1]):
        power = f"({c}::DOUBLE + {t} * {power})"
    half = f"(0.5::DOUBLE * {t} * exp(-{x} * {x} + {power}))"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """All tables with the same margins that are no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d
    weight = lambda x: math.exp(log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col))
    seen = weight(a) * (1 + 1e-7)
    return min(1.0, sum(w for x in range(max(0, col - (n - row)), min(row, col) + 1) if (w := weight(x)) <= seen))


def sign_test(up: int, n: int) -> float:
    """Two-sided exact binomial test of up against n - up at one half."""
    k = min(up, n - up)
    return min(1.0, 2 * sum(math.exp(log_choose(n, i) - n * math.log(2)) for i in range(k + 1))) if n else 1.0
