"""Survival analysis (K1–K3): event table, Kaplan–Meier curve and its 95 % band.

Input is a durations frame ``(group, duration[, observed])``.  Durations are first reduced to
distinct times per group; the running sums that define the at-risk count, the product-limit
estimate (as a sum of logs) and Greenwood's variance term are computed by the two-level
:func:`running_totals`, so a long curve is spread over range partitions instead of one task.
A NULL group is a group of its own; a NULL duration or observed flag fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.functions.stats import Z_95
from orgpulse.operators.common import broadcast_if_small, holding, largest_group, running_totals
from orgpulse.session import materialize

T_COL = "t"


def _event_table(durations: DataFrame, group: str, duration: str, observed: str | None):
    """Event table with the group size ``_N``, and the row count of the largest group."""
    def required(c: F.Column, name: str) -> F.Column:
        return F.when(c.isNull(), F.raise_error(F.lit(f"survival: NULL in column {name}"))).otherwise(c)

    obs = required(F.col(observed).cast("bigint"), observed) if observed else F.lit(1).cast("bigint")
    d = durations.select(F.col(group), required(F.col(duration).cast("double"), duration).alias(T_COL), obs.alias("_o"))
    # small (groups x distinct times) and read several times below: written once
    per_t = materialize(d.groupBy(group, T_COL).agg(F.count(F.lit(1)).alias("removed"), F.sum("_o").alias("observed")),
                        "survival-times")
    sizes = per_t.groupBy(group).agg(F.sum("removed").alias("_N"))
    zero = sizes.select(group, F.lit(0.0).alias(T_COL), F.lit(0).cast("bigint").alias("removed"),
                        F.lit(0).cast("bigint").alias("observed"))
    table = per_t.unionByName(zero).groupBy(group, T_COL) \
        .agg(F.sum("removed").alias("removed"), F.sum("observed").alias("observed"))
    largest = largest_group(table, [group])
    cum = running_totals(table, by=[group], order=[T_COL], sums=["removed"], largest=largest)
    sizes, _ = broadcast_if_small(sizes.withColumnRenamed(group, "_group"))
    out = (cum.join(sizes, F.col(group).eqNullSafe(F.col("_group")))
            .select(group, T_COL, "removed", "observed",
                    (F.col("removed") - F.col("observed")).alias("censored"),
                    F.when(F.col(T_COL) == 0.0, F.col("_N")).otherwise(F.lit(0)).cast("bigint").alias("entrance"),
                    (F.col("_N") - F.col("cum_removed") + F.col("removed")).alias("at_risk"), "_N"))
    return holding(out, sizes, cum), largest


def event_table(durations: DataFrame, group: str, duration: str, observed: str | None = None) -> DataFrame:
    """K1: per group and distinct time (plus time 0): removed, observed, censored, entrance,
    at_risk — the layout of a product-limit fitter's event table."""
    table = _event_table(durations, group, duration, observed)[0]
    return holding(table.drop("_N"), table)


def _curve(durations: DataFrame, group: str, duration: str, observed: str | None) -> DataFrame:
    """S(t) and Greenwood's running variance term per group and time.

    With m_i = n_i - d_i survivors of time i (n at risk, d events, c censored there),
    S(t_k) = prod_{i<=k} m_i / n_i = (m_k / N) * prod_{i<k} m_i / (m_i - c_i), because
    n_{i+1} = m_i - c_i.  Without censoring every factor of the product is exactly 1, so S is
    the exact ratio m_k / N (no log/exp rounding); with censoring the product is a running
    sum of logs.  S is exactly 0 once every subject at risk has had the event (T14)."""
    table, largest = _event_table(durations, group, duration, observed)  # same groups below
    n = F.col("at_risk").cast("double")
    d = F.col("observed").cast("double")
    m = F.col("at_risk") - F.col("observed")
    nxt = m - F.col("censored")
    terms = table.select(
        group, T_COL, "_N", m.alias("_m"),
        F.when((F.col("censored") > 0) & (nxt > 0), F.log(m.cast("double") / nxt.cast("double")))
        .otherwise(F.lit(0.0)).alias("_lc"),
        # Greenwood term d / (n (n - d)); infinite when d = n, then taken as 0.
        F.when(F.col("observed") < F.col("at_risk"), d / (n * (n - d))).otherwise(F.lit(0.0)).alias("_gw"))
    sums = running_totals(terms, by=[group], order=[T_COL], sums=["_lc", "_gw"], largest=largest)
    correction = F.exp(F.col("cum__lc") - F.col("_lc"))
    surv = F.col("_m").cast("double") / F.col("_N").cast("double") * correction
    return holding(sums.select(group, T_COL, surv.alias("survival"), F.col("cum__gw").alias("_v")), table, sums)


def km_curve(durations: DataFrame, group: str, duration: str, observed: str | None = None) -> DataFrame:
    """K2: Kaplan–Meier S(t) per group at every time of the event table."""
    curve = _curve(durations, group, duration, observed)
    return holding(curve.drop("_v"), curve)


def km_band(durations: DataFrame, group: str, duration: str, observed: str | None = None,
            z: float = Z_95) -> DataFrame:
    """K3: S(t) with the exponential-Greenwood band
    ``exp(-exp(ln(-ln S) ± z sqrt(V) / ln S))``; NULL where S is 0 or 1."""
    s = _curve(durations, group, duration, observed)
    ln_s = F.log(F.col("survival"))
    inner = F.log(-ln_s)
    spread = F.lit(z) * F.sqrt(F.col("_v")) / ln_s
    defined = (F.col("survival") > 0.0) & (F.col("survival") < 1.0)
    return holding(s.select(group, T_COL, "survival",
                            F.when(defined, F.exp(-F.exp(inner - spread))).alias("lower"),
                            F.when(defined, F.exp(-F.exp(inner + spread))).alias("upper")), s)
