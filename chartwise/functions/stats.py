"""Closed-form statistics as Column expressions, plus vectorised p-value UDFs.

Everything here runs on already aggregated rows (counts, means, variances),
so the per-row cost is nil; the p-value functions are Arrow-batched pandas
UDFs because neither Spark nor standard SQL has ``erfc`` or the incomplete
beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chartwise.functions.columns import col_, fround

# Fixed values that must equal the reference's: z of the 95 % interval, the
# 1-df chi-square critical value for p < .05, effect-size cut-offs and
# significance levels.
Z95 = 1.96
CHI2_CRIT_05 = 3.841458820694124
EFFECT_CUTS = (0.2, 0.5, 0.8)
EFFECT_NAMES = ("negligible", "small", "medium", "large")
STAR_LEVELS = ((0.001, "★★★"), (0.01, "★★"), (0.05, "★"))


def _rate(s, n) -> Column:
    return F.when(n > 0, s / n).otherwise(F.lit(0.0))


def wilson_bounds(s, n, z: float = Z95, digits: int = 4) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; (0, 0) when n = 0."""
    s, n = col_(s).cast("double"), col_(n).cast("double")
    p = _rate(s, n)
    z2 = z * z
    nn = F.when(n > 0, n)
    d = F.lit(1.0) + F.lit(z2) / nn
    c = (p + F.lit(z2) / (F.lit(2.0) * nn)) / d
    m = (F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / nn + F.lit(z2) / (F.lit(4.0) * nn * nn))) / d
    lo = F.when(n > 0, fround(F.greatest(F.lit(0.0), c - m), digits)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, fround(F.least(F.lit(1.0), c + m), digits)).otherwise(F.lit(0.0))
    return lo, hi


def cohen_h(p1, p2, digits: int = 4) -> Column:
    p1, p2 = col_(p1), col_(p2)
    a = F.lit(2.0) * F.asin(F.sqrt(F.greatest(F.lit(0.0), p1)))
    b = F.lit(2.0) * F.asin(F.sqrt(F.greatest(F.lit(0.0), p2)))
    return fround(F.abs(a - b), digits)


def effect_label(h) -> Column:
    h = col_(h)
    return (F.when(h < EFFECT_CUTS[0], EFFECT_NAMES[0])
            .when(h < EFFECT_CUTS[1], EFFECT_NAMES[1])
            .when(h < EFFECT_CUTS[2], EFFECT_NAMES[2])
            .otherwise(EFFECT_NAMES[3]))


def stars(p) -> Column:
    p = col_(p)
    out = None
    for level, mark in STAR_LEVELS:
        out = F.when(p < level, mark) if out is None else out.when(p < level, mark)
    return out.when(p.isNotNull(), "")


def chi2_2x2(sa, na, sb, nb, clamp_cells: bool = False) -> Column:
    """Pearson chi-square of the 2x2 table [[sa, na-sa], [sb, nb-sb]], no Yates.

    ``clamp_cells`` lifts every cell to at least 1 first.  Without it a table
    with an empty margin has no statistic (NULL).
    """
    a, c = col_(sa).cast("double"), col_(sb).cast("double")
    b, d = col_(na).cast("double") - a, col_(nb).cast("double") - c
    if clamp_cells:
        one = F.lit(1.0)
        a, b, c, d = F.greatest(a, one), F.greatest(b, one), F.greatest(c, one), F.greatest(d, one)
    n = a + b + c + d
    den = (a + b) * (c + d) * (a + c) * (b + d)
    num = n * (a * d - b * c) * (a * d - b * c)
    return F.when(den > 0, num / den)


def lift(ra, rb, digits: int = 4) -> Column:
    ra, rb = col_(ra), col_(rb)
    return F.when(rb > 0, fround((ra - rb) / rb, digits))


def winner(ra, rb, name_a, name_b) -> Column:
    """a if its rate is strictly higher, else b (ties go to b)."""
    return F.when(col_(ra) > col_(rb), col_(name_a)).otherwise(col_(name_b))


def r_to_t(r, n) -> Column:
    """t statistic of a correlation with n - 2 degrees of freedom."""
    r, n = col_(r), col_(n).cast("double")
    return F.when(F.abs(r) < 1.0, r * F.sqrt((n - 2.0) / (F.lit(1.0) - r * r)))


def welch_t(m1, v1, n1, m0, v0, n0) -> tuple[Column, Column]:
    """Welch t statistic and Satterthwaite degrees of freedom."""
    se1 = col_(v1) / col_(n1).cast("double")
    se0 = col_(v0) / col_(n0).cast("double")
    se = se1 + se0
    t = F.when(se > 0, (col_(m1) - col_(m0)) / F.sqrt(se))
    dof = F.when(se > 0, se * se / (se1 * se1 / (col_(n1) - 1.0) + se0 * se0 / (col_(n0) - 1.0)))
    return t, dof


# ---------------------------------------------------------------- p-values

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    if not (np.isfinite(t) and np.isfinite(dof)) or dof <= 0:
        return float("nan")
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_1df_p(x: float) -> float:
    return math.erfc(math.sqrt(x / 2.0))


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with 1 degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else chi2_1df_p(float(v))).astype("float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value (works for fractional degrees of freedom)."""
    out = [None if (pd.isna(a) or pd.isna(b) or b <= 0) else betainc_reg(float(b) / 2.0, 0.5, float(b) / (float(b) + float(a) ** 2))
           for a, b in zip(t, dof)]
    return pd.Series(out, dtype="float64")
