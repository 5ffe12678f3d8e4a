"""Two-sided p-values of t and z statistics, for summary-sized frames.

Spark SQL has no distribution functions. Student's is an expression of built-in functions: the continued fraction of
the incomplete beta function is folded from its last term over an array of term numbers, so no Python worker takes part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond, the statistic is carried over to this many degrees by way of the normal one of equal tail, whose error is of
# the order of 1 / dof^2: a longer fraction would change no digit.
NORMAL_BEYOND = 1e6
# By so much the argument of the gamma ratio is raised before its series is used.
SHIFT = 40


def _gamma_ratio(h: Column) -> Column:
    """Gamma(h + 1/2) / Gamma(h) for h > 0."""
    z = h + SHIFT
    series = F.lit(0.0)
    for c in (-399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):  # coefficients of its expansion in 1 / z
        series = series / z + c
    steps = F.sequence(F.lit(0), F.lit(SHIFT - 1))
    return F.aggregate(steps, F.sqrt(z) * series, lambda acc, i: acc * (h + i) / (h + i + 0.5))


def _beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, ``terms`` pairs of terms deep."""

    def before(acc: Column, m: Column) -> Column:
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + even / (1 + odd / acc)

    tail = F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0), before)
    return 1 / (1 - (a + b) * x / (a + 1) / tail)


def student_p(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom.

    NULL where either is NULL or not a number, or without degrees of freedom; 0 for an infinite ``t``.
    """
    t, dof = t.cast("double"), dof.cast("double")
    z2 = t * t * F.pow(1 - 1 / (4 * dof), F.lit(2)) / (1 + t * t / (2 * dof))
    left = F.pow(F.lit(1 - 1 / (4 * NORMAL_BEYOND)), F.lit(2)) - z2 / (2 * NORMAL_BEYOND)
    many = dof > NORMAL_BEYOND
    square = F.when(many, F.when(left > 0, z2 / left).otherwise(F.lit(math.inf))).otherwise(t * t)
    # each value is named once: an expression as wide as its uses would be evaluated at every one of them
    given = F.struct(square.alias("q"), F.least(dof, F.lit(NORMAL_BEYOND)).alias("n"))

    def p(g: Column) -> Column:
        q, n = g["q"], g["n"]
        x, y, h = n / (n + q), q / (n + q), n / 2
        tail = x < (h + 1) / (h + 2.5)
        a, b = F.when(tail, h).otherwise(0.5), F.when(tail, F.lit(0.5)).otherwise(h)
        front = _gamma_ratio(h) / math.sqrt(math.pi) * F.exp(-h * F.log1p(q / n)) * F.sqrt(y)
        terms = (200 + 3 * F.sqrt(h)).cast("int")
        parts = F.struct(a.alias("a"), b.alias("b"), F.when(tail, x).otherwise(y).alias("x"), front.alias("f"), terms.alias("m"), tail.alias("tail"))

        def value(s: Column) -> Column:
            part = s["f"] * _beta_fraction(s["a"], s["b"], s["x"], s["m"]) / s["a"]
            return F.when(s["tail"], part).otherwise(1 - part)

        return F.transform(F.array(parts), value)[0]

    known = t.isNotNull() & dof.isNotNull() & ~F.isnan(t) & ~F.isnan(dof) & (dof > 0)
    finite = F.transform(F.array(given), p)[0]
    return F.when(known & ((t * t == math.inf) | (square == math.inf)), 0.0).when(known, finite)


def normal_two_sided(z: float | None) -> float | None:
    if z is None or math.isnan(z):
        return None
    return math.erfc(abs(z) / math.sqrt(2.0))
