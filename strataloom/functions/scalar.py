"""Scalar functions: genotype decoding, map distances, Phred, rounding, tail probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gt_dosage(gt: Column) -> Column:
    """Sum of the allele numbers of a GT string; null where an allele is missing or there is none."""
    alleles = F.split(gt, r"[/|]")
    known = F.forall(alleles, lambda a: a.rlike(r"^[0-9]+$"))
    return F.when(known, F.aggregate(F.transform(alleles, lambda a: F.try_to_number(a, F.lit("999")).cast("int")), F.lit(0), lambda s, a: s + a))


def ds_dosage(fields: Column) -> Column:
    """The DS entry of a FORMAT map as double, null for a dot."""
    return F.nullif(F.element_at(fields, "DS"), F.lit(".")).cast("double")


def phred(q: Column) -> Column:
    """Quality of a character, null for a space (unknown)."""
    return F.when(q != " ", F.ascii(q) - 33)


def haldane(d: Column) -> Column:
    return (1 - F.exp(-2 * d)) / 2


def haldane_inv(r: Column) -> Column:
    return -F.log(1 - 2 * r) / 2


def kosambi(d: Column) -> Column:
    return F.tanh(2 * d) / 2


def kosambi_inv(r: Column) -> Column:
    return F.log((1 + 2 * r) / (1 - 2 * r)) / 4


def round_to(x: Column, step: float) -> Column:
    """Nearest multiple of step; zero, infinities and nulls stay. The quotient is truncated after adding a half."""
    rounded = (x / step + F.when(x < 0, -0.5).otherwise(0.5)).cast("long") * F.lit(float(step))
    return F.when((x == 0) | (F.abs(x) == float("inf")), x).otherwise(rounded)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if not (x >= 0 and a > 0):
        return math.nan
    if x == 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float | None, df: int = 1) -> float | None:
    if x is None or not math.isfinite(x) or x < 0:
        return None
    return math.erfc(math.sqrt(x / 2)) if df == 1 else upper_gamma(df / 2, x / 2)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of non-negative values, to a relative 1e-13: series below 2, continued fraction above."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    low = x < 2
    y = x[low]
    term = total = y.copy()
    for n in range(1, 60):
        term = -term * y * y / n
        total = total + term / (2 * n + 1)
    out[low] = 1 - 2 / np.sqrt(np.pi) * total
    y = x[~low]
    tail = y.copy()
    for k in range(120, 0, -1):
        tail = y + k / 2 / tail
    with np.errstate(under="ignore"):
        out[~low] = np.exp(-y * y) / np.sqrt(np.pi) / tail
    return out


def chi2_sf(x: Column, df: int = 1) -> Column:
    """Upper tail of the chi-square distribution: built in for 2 degrees of freedom, else an Arrow function over whole
    batches for 1 and value by value for others. Null for what is negative or no number."""
    if df == 2:
        return F.exp(-x / 2)

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        if df != 1:
            return values.map(lambda v: chi2_tail(v, df))
        known = np.isfinite(values.to_numpy(float)) & (values.to_numpy(float) >= 0)
        out = np.full(len(values), np.nan)
        out[known] = erfc(np.sqrt(values.to_numpy(float)[known] / 2))
        return pd.Series(out).where(pd.Series(known), None)

    return tail(x.cast("double"))


@F.pandas_udf(DoubleType())
def GAMMA(values: pd.Series) -> pd.Series:
    """The gamma function; null at its poles, past the largest number and for what is no number."""

    def one(v):
        try:
            return math.gamma(v) if v == v else None
        except (ValueError, OverflowError):
            return None

    return values.astype(float).map(one)


@F.pandas_udf(DoubleType())
def PHI(values: pd.Series) -> pd.Series:
    """The standard normal distribution function."""
    v = values.to_numpy(float)
    half = erfc(np.abs(np.nan_to_num(v)) / np.sqrt(2)) / 2
    return pd.Series(np.where(np.isnan(v), np.nan, np.where(v > 0, 1 - half, half)))


def gamma(x: Column) -> Column:
    return GAMMA(x.cast("double"))


def normal_cdf(x: Column) -> Column:
    return PHI(x.cast("double"))
