"""Tail probabilities and quantiles as column expressions.

Spark has no error, gamma or chi-square function, so the finite sums and
series from the standard tables are written with ``aggregate``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F



def _let(value: Column, body) -> Column:
    """Evaluate once, use many times."""
    return F.transform(F.array(value), body)[0]


def z_value(level: float) -> float:
    """Two-sided normal quantile: 1.95996… for level 0.95."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: power series up to 3, continued fraction beyond."""
    density = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("term"), z.alias("sum")),
        lambda s, i: _let(
            s["term"] * z * z / (2 * i + 1),
            lambda term: F.struct(term.alias("term"), (s["sum"] + term).alias("sum")),
        ),
        lambda s: F.lit(0.5) - density * s["sum"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda f, i: z + i / f,
        lambda f: density / f,
    )
    return F.when(z <= 3, series).otherwise(fraction)


def chi2_tail(q: Column, df: int) -> Column:
    """P(chi-square with ``df`` degrees of freedom > q), closed form.

    Even ``df`` is a finite Poisson sum; odd ``df`` adds a normal tail.
    """
    if df <= 0:
        raise ValueError("degrees of freedom must be positive")
    half = F.exp(-q / 2)
    total = F.lit(0.0)
    if df % 2 == 0:
        term = F.lit(1.0)
        for j in range(df // 2):
            total = total + term
            term = term * (q / 2) / (j + 1)
        return half * total
    term = F.sqrt(q) * F.lit(math.sqrt(2 / math.pi))
    for r in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * q / (2 * r + 1)
    return 2 * normal_tail(F.sqrt(q)) + half * total


def t_value(level: float, df: Column) -> Column:
    """Two-sided Student quantile with ``df`` degrees of freedom per row.

    From 30 degrees on, the four-term expansion around the normal quantile;
    below, bisection on the exact finite sum for whole degrees of freedom.
    """
    z = z_value(level)
    expansion = (
        F.lit(z)
        + (z**3 + z) / 4 / df
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (df * df * df)
        + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z)
        / 92160 / (df * df * df * df)
    )
    nu = df.cast("int")

    def central(angle: Column) -> Column:
        """P(|T| <= sqrt(nu)·tan(angle))."""
        c, s = F.cos(angle), F.sin(angle)
        odd = nu % 2 == 1
        first = F.when(odd, c).otherwise(F.lit(1.0))
        steps = F.when(odd, (nu - 3) / 2).otherwise((nu - 2) / 2).cast("int")
        terms = F.aggregate(
            F.slice(F.sequence(F.lit(1), F.lit(16)), 1, F.greatest(steps, F.lit(0))),
            F.struct(first.alias("term"), first.alias("sum")),
            lambda a, i: _let(
                a["term"] * c * c * F.when(odd, 2.0 * i / (2 * i + 1)).otherwise(
                    (2.0 * i - 1) / (2 * i)),
                lambda term: F.struct(term.alias("term"), (a["sum"] + term).alias("sum")),
            ),
            lambda a: a["sum"],
        )
        return (
            F.when(nu == 1, angle * F.lit(2 / math.pi))
            .when(odd, (angle + s * terms) * F.lit(2 / math.pi))
            .otherwise(s * terms)
        )

    exact = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2).alias("hi")),
        lambda b, _: _let(
            (b["lo"] + b["hi"]) / 2,
            lambda mid: F.when(
                central(mid) < level, F.struct(mid.alias("lo"), b["hi"].alias("hi"))
            ).otherwise(F.struct(b["lo"].alias("lo"), mid.alias("hi"))),
        ),
        lambda b: F.sqrt(nu.cast("double")) * F.tan((b["lo"] + b["hi"]) / 2),
    )
    return F.when(df >= 30, expansion).when(df >= 1, exact)
