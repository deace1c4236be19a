"""Numeric expressions: safe ratios and correlations, significance of a correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numeric_text(col: Column) -> Column:
    """A number written with thousands separators and blanks; NULL when it is not one."""
    return F.trim(F.replace(col.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den with NULL for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def positive_or_zero(col: Column) -> Column:
    return F.when(col > 0, col.cast("double")).otherwise(F.lit(0.0))


#: Share of a sum of squares below which a variance out of sums is rounding residue.
VARIANCE_FLOOR = 1e-12


def variance_from_sums(n, sx, sxx) -> Column:
    """Sum of squared deviations out of plain sums; 0 when only rounding residue is left."""
    v = sxx - sx * sx / n
    return F.when(v > VARIANCE_FLOOR * sxx, v).otherwise(F.lit(0.0))


def corr_from_sums(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson correlation out of plain sums, NULL when either side does not vary."""
    cov = sxy - sx * sy / n
    vx, vy = variance_from_sums(n, sx, sxx), variance_from_sums(n, sy, syy)
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate correlation that is NULL, not an error, without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_t(r: Column, n: Column) -> Column:
    """|r| * sqrt(n-2) / sqrt(1-r^2), the weight of evidence behind a correlation."""
    capped = F.least(F.abs(r), F.lit(0.999999))
    t = F.abs(r) * F.sqrt((n - 2).cast("double")) / F.sqrt(1.0 - capped * capped)
    return F.when(n < 3, F.lit(0.0)).otherwise(t)


def corr_threshold(n_obs: Column, n_pairs: Column) -> Column:
    """Lower bound of |r| worth a look after testing ``n_pairs`` pairs."""
    z = 2.575 + F.sqrt(F.log(n_pairs.cast("double")))
    bound = F.least(F.lit(0.99), F.tanh(z / F.sqrt((n_obs - 3).cast("double"))))
    return F.when((n_obs <= 3) | (n_pairs <= 0), F.lit(1.0)).otherwise(bound)
