"""Scalar column functions: pairing, guarded logs, discrete distributions, hash uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) drawn from the md5 of the key's parts, joined by bars: reruns and other engines agree."""
    text = F.concat_ws("|", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def pairing(a: Column, b: Column, unordered: bool = False) -> Column:
    """Cantor's pairing number of two naturals; unordered pairs take the smaller as the second."""
    s = (a + b).cast("long")
    return F.shiftright(s * (s + 1), 1) + (F.least(a, b) if unordered else b)


def unpairing(z: Column) -> tuple[Column, Column]:
    """The pair of a pairing number up to 2**62. The root is taken in doubles and then set right in whole numbers."""
    z = z.cast("long")
    w = F.floor((F.sqrt(8 * z.cast("double") + 1) - 1) / 2).cast("long")
    least = lambda k: F.shiftright(k * (k + 1), 1)  # noqa: E731  the first number of diagonal k
    w = w + F.when(least(w) > z, F.when(least(w - 1) > z, -2).otherwise(-1)).when(least(w + 1) <= z, F.when(least(w + 2) <= z, 2).otherwise(1)).otherwise(0)
    b = z - least(w)
    return w - b, b


def safe_log(x: Column, least: float = 1e-12) -> Column:
    return F.ln(F.greatest(x, F.lit(least)))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda acc, k: acc + F.ln(k.cast("double")))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    return F.exp(log_choose(n, k) + k * F.ln(p) + (n - k) * F.ln(1 - p))


def poisson_pmf(k: Column, mean: Column) -> Column:
    return F.exp(k * F.ln(mean) - mean - log_factorial(k))


def hypergeometric_pmf(k: Column, good: Column, bad: Column, draws: Column) -> Column:
    return F.exp(log_choose(good, k) + log_choose(bad, draws - k) - log_choose(good + bad, draws))


def detectability_limit(mean_degree: Column) -> Column:
    """The mixing rate beyond which communities of a planted partition cannot be told: 1 - 1 / sqrt(<k>)."""
    return 1 - 1 / F.sqrt(mean_degree)


def equal_split(total: Column, parts: Column, index: Column) -> Column:
    """total in parts integers as equal as can be, the remainder to the first."""
    return F.floor(total / parts) + F.when(index < total % parts, 1).otherwise(0)


def power_law_mean(least: float, most: float, exponent: float) -> float:
    """Mean of the continuous power law x**-exponent on [least, most]."""

    def integral(a: float, b: float, power: float) -> float:
        return math.log(b / a) if abs(power + 1) < 1e-10 else (b ** (power + 1) - a ** (power + 1)) / (power + 1)

    return integral(least, most, 1 - exponent) / integral(least, most, -exponent)


def power_law_least(mean: float, most: float, exponent: float) -> float:
    """The lower cut-off whose power law has that mean, by bisection to 1e-7; ValueError out of range."""
    low, high = 1.0, float(most)
    if not power_law_mean(low, most, exponent) <= mean <= most:
        raise ValueError("the mean degree is out of the power law's range")
    while high - low > 1e-7:
        mid = (low + high) / 2
        low, high = (mid, high) if power_law_mean(mid, most, exponent) < mean else (low, mid)
    return (low + high) / 2


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(at most k of n)."""
    return F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda acc, j: acc + binomial_pmf(j, n, p))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(k or more of n)."""
    return F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda acc, j: acc + binomial_pmf(j, n, p))


def integer_average(least: Column, most: Column, exponent: float) -> Column:
    """Mean of the law h ** -exponent on the integers least..most."""
    h = F.sequence(least.cast("int"), most.cast("int"))
    total = lambda power: F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double"), F.lit(power)))
    return total(1 - exponent) / total(-exponent)


def largest_degree(n: Column, whole_up: bool = False) -> Column:
    """The default bound of degrees (rounded down) or community sizes (rounded up) of a benchmark graph: sqrt(10 n)."""
    root = F.sqrt(10.0 * n)
    return (F.ceil(root) if whole_up else F.floor(root)).cast("long")


def parsed_number(text: Column) -> Column:
    """A plain decimal ([-]digits[.digits], no exponent) as a double; null for other text."""
    return F.when(text.rlike(r"^-?\d*\.?\d*$") & text.rlike(r"\d"), text.try_cast("double"))


def half_down(x: Column) -> Column:
    """The nearest whole number; halves go towards zero, and negative numbers are cut."""
    whole = x.cast("long")
    return whole + F.when(x - whole > 0.5, 1).otherwise(0)


def pieces(text: Column, separators: str) -> Column:
    """text split at any of the characters, without empty pieces."""
    return F.filter(F.split(text, "[" + "".join("\\" + c for c in separators) + "]"), lambda x: x != "")
