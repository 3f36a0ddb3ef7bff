"""Guarded arithmetic and moment-based statistics as column expressions.

Spark 4 runs in ANSI mode, where ``/`` by zero and ``corr`` on a constant column raise.
Ratios here go through ``try_divide`` (NULL on a zero denominator) and callers decide where
the reference turns that NULL into 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den as a double, NULL when den is 0 or NULL."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def ratio_or_zero(num, den) -> Column:
    """Guarded ratio: 0.0 when undefined."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def pearson_from_moments(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson correlation from the six raw moments; NULL for a constant column.

    The moments must be integral (sums over 0/1 or other integer columns): the numerator and
    variance terms are computed in exact DECIMAL(38,0) arithmetic, so a constant column gives
    exactly 0 variance instead of rounding noise, and n * sum cannot overflow.
    """
    n, sx, sy, sxx, syy, sxy = (_col(c).cast("decimal(38,0)") for c in (n, sx, sy, sxx, syy, sxy))
    cov = n * sxy - sx * sy
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    den = F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double"))
    ratio_ = F.try_divide(cov.cast("double"), F.when(den > 0, den))
    # rounding may leave [-1, 1]; least and greatest skip NULL, so it is kept apart
    return F.when(ratio_.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio_)))


# Fixed value: two-sided 95 % standard-normal quantile used by the survival confidence band.
Z_95 = 1.959963984540054
