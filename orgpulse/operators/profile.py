"""Profiling (A13–A16): frequency tables, ``describe``, ``info`` and correlations.

Quantiles are exact (linear interpolation between the two order statistics around
``(n - 1) * p``, as pandas does) yet distributed: whole numbers and times by selection over refined
histograms (:mod:`orgpulse.operators.selection`); other numbers are reduced to distinct values with
counts, ranked by the two-level :func:`running_totals`, and the few target ranks are looked up
with a broadcast of the (#columns × #probabilities) target table.  No column is collected into
one aggregation buffer.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgpulse.functions.stats import pearson_from_moments
from orgpulse.functions.timefns import micros_between
from orgpulse.operators.common import broadcast_if_small, holding, running_totals
from orgpulse.operators.selection import order_statistics
from orgpulse.session import materialize

DESCRIBE_PROBS = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values of ``column`` with their row counts, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(column)))


def exact_quantiles(long: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Per ``key``, linear-interpolated quantiles of ``value`` (NULLs ignored).

    Returns ``key, prob, lo_value, hi_value, frac``; the quantile is
    ``lo_value + frac * (hi_value - lo_value)`` (left to the caller, which knows the type)."""
    vals = long.filter(F.col(value).isNotNull())
    # read three times below: written once
    vc = materialize(vals.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    cum = running_totals(vc, by=[key], order=[value], sums=["_c"]) \
        .select(key, value, (F.col("cum__c") - F.col("_c")).alias("_from"), F.col("cum__c").alias("_to"))
    targets = (vc.groupBy(key).agg(F.sum("_c").alias("_n"))
               .select(key, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "_n")
               .withColumn("_pos", (F.col("_n") - 1).cast("double") * F.col("prob"))
               .select(F.col(key).alias("_key"), "prob", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"),
                       (F.col("_pos") - F.floor("_pos")).alias("frac")))
    # targets has (#keys × #probs) rows, a measured bound: it is broadcast and the ranked distinct
    # values are streamed once; a value's rank range holds the lower rank, the upper one, or both
    small, _ = broadcast_if_small(targets)
    hit = lambda rank: (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_to"))
    found = cum.join(small, F.col(key).eqNullSafe(F.col("_key")) & (hit("_lo") | hit("_hi")))
    return holding(found.groupBy(F.col("_key").alias(key), "prob").agg(
        F.max(F.when(hit("_lo"), F.col(value))).alias("lo_value"),
        F.max(F.when(hit("_hi"), F.col(value))).alias("hi_value"), F.first("frac").alias("frac")), small, cum)


def _quantiles(df: DataFrame, columns: Sequence[str], integral: set[str]) -> DataFrame:
    """column_name, prob, lo_value, hi_value, frac of the DESCRIBE_PROBS quantiles (NULLs left out): whole
    numbers by selection, others over their sorted distinct values."""
    spark, parts = df.sparkSession, []
    whole = [c for c in columns if c in integral]
    if whole:
        q = {c: f"`{c}`" for c in whole}
        got = df.agg(*[f(q[c]).alias(f"{k}{n}") for n, c in enumerate(whole) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        bounds = {c: (got[f"n{n}"], got[f"lo{n}"], got[f"hi{n}"]) for n, c in enumerate(whole) if got[f"n{n}"]}
        at = {(c, p): (n - 1) * p for c, (n, _, _) in bounds.items() for p in DESCRIBE_PROBS}
        found = order_statistics(df, bounds, {c: sorted({r for p in DESCRIBE_PROBS for r in (math.floor(at[c, p]), math.ceil(at[c, p]))})
                                              for c in bounds})
        rows = [(c, p, float(found[c, math.floor(x)][0]), float(found[c, math.ceil(x)][0]), x - math.floor(x)) for (c, p), x in at.items()]
        schema = "column_name string, prob double, lo_value double, hi_value double, frac double"
        parts.append(spark.createDataFrame(rows, schema))
    if rest := [c for c in columns if c not in integral]:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in rest])))
        parts.append(exact_quantiles(long, "column_name", "v", DESCRIBE_PROBS))
    return reduce(lambda a, b: a.unionByName(b), parts)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pandas-style ``describe`` of numeric and timestamp columns, long form
    ``(column_name, stat, value, value_ts)``.

    Numeric columns: count, mean, std (sample), min, 25%, 50%, 75%, max in ``value``.
    Timestamp columns: count in ``value``; mean, min, quartiles and max in ``value_ts``,
    computed in exact integer microseconds (mean and interpolation floored to a microsecond);
    no std, as pandas gives none for datetimes.  Other types are rejected."""
    kinds = {}
    for f in df.schema.fields:
        if f.name in columns:
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
                kinds[f.name] = "ts"
            elif isinstance(f.dataType, T.NumericType):
                kinds[f.name] = "num"
            else:
                raise ValueError(f"describe: {f.name} is {f.dataType.simpleString()}, not numeric or datetime")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    def numeric(c: str) -> F.Column:  # NaN counts as missing
        if isinstance(df.schema[c].dataType, T.IntegralType):
            return F.col(c).cast("bigint")
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x

    as_num = {c: (micros_between(epoch, F.col(c).cast("timestamp_ntz")) if k == "ts" else numeric(c))
              for c, k in kinds.items()}
    integral = {c for c, k in kinds.items() if k == "ts" or isinstance(df.schema[c].dataType, T.IntegralType)}

    def aggs(as_num: dict) -> list:
        return [a for c in kinds for a in column_aggs(c, as_num[c])]

    def column_aggs(c: str, x: F.Column) -> list:
        aggs = [F.count(x).cast("double").alias(f"{c}|count"),
                 F.min(x).cast("double").alias(f"{c}|min"), F.max(x).cast("double").alias(f"{c}|max")]
        if kinds[c] == "ts":
            # exact integer mean of epoch microseconds, floored to a microsecond
            aggs.append(F.floor(F.try_divide(F.sum(x.cast("decimal(38,0)")), F.count(x))).cast("double")
                        .alias(f"{c}|mean_us"))
        else:
            # exact integer sum, one rounding to double, one division
            exact_mean = F.try_divide(F.sum(x.cast("decimal(38,0)")).cast("double"), F.count(x).cast("double"))
            aggs += [(exact_mean if c in integral else F.avg(x)).alias(f"{c}|mean"),
                     F.stddev_samp(x).alias(f"{c}|std")]
        return aggs

    # read by every pass below: the numbers alone, written once
    df = materialize(df.select(*[as_num[c].alias(c) for c in kinds]), "describe")
    as_num = {c: F.col(f"`{c}`") for c in kinds}
    wide = df.agg(*aggs(as_num))
    simple = []
    for c, k in kinds.items():
        stats = ["count", "mean", "std", "min", "max"] if k == "num" else ["count", "mean_us", "min", "max"]
        for s in stats:
            simple.append(F.struct(F.lit(c).alias("column_name"), F.lit("mean" if s == "mean_us" else s).alias("stat"),
                                   F.col(f"`{c}|{s}`").alias("v")))
    basic = wide.select(F.inline(F.array(*simple)))

    q = _quantiles(df, kinds, integral)
    is_ts = F.col("column_name").isin([c for c, k in kinds.items() if k == "ts"])
    interp = F.when(is_ts, F.col("lo_value") + F.floor(F.col("frac") * (F.col("hi_value") - F.col("lo_value")))) \
        .otherwise(F.col("lo_value") + F.col("frac") * (F.col("hi_value") - F.col("lo_value")))
    quart = q.select("column_name", F.concat((F.col("prob") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"),
                     interp.alias("v"))
    both = basic.unionByName(quart)
    ts_val = F.timestamp_add("MICROSECOND", F.col("v").cast("bigint"), epoch)
    as_ts = is_ts & (F.col("stat") != "count")
    return both.select("column_name", "stat",
                       F.when(as_ts, F.lit(None).cast("double")).otherwise(F.col("v")).alias("value"),
                       F.when(as_ts, ts_val).alias("value_ts"))


def column_profile(df: DataFrame) -> DataFrame:
    """``info()`` — per column its non-null count and type, one aggregate pass."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"_{i}").alias("non_null"),
                     F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema.fields)]
    return wide.select(F.inline(F.array(*rows)))


def _comoments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations of doubles in one pass.  ``covar_pop`` and ``var_pop`` keep counts, means and centred
    (co-)moments, updated per row and merged between tasks by the rule of Chan, Golub and LeVeque, so large offsets
    (epoch seconds) don't cancel.  A pair goes by the rows that have both values; NaN counts as missing."""
    def value(c: str) -> str:
        q = "`" + c.replace("`", "``") + "`"
        return f"CASE WHEN NOT isnan(CAST({q} AS DOUBLE)) THEN CAST({q} AS DOUBLE) END"

    values = df.selectExpr(*[f"{value(c)} AS _x{i}" for i, c in enumerate(columns)])
    aggs = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        aggs += [f"covar_pop(_x{i}, _x{j}) AS _c{i}_{j}", f"var_pop(CASE WHEN _x{j} IS NOT NULL THEN _x{i} END) AS _v{i}_{j}",
                 f"var_pop(CASE WHEN _x{i} IS NOT NULL THEN _x{j} END) AS _w{i}_{j}"]
    moments = values.agg(*[F.expr(a) for a in aggs])
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            k = f"{min(i, j)}_{max(i, j)}"
            rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_c{k}").alias("c"),
                                 F.col(f"_v{k}").alias("v"), F.col(f"_w{k}").alias("w")))
    # rounding may leave [-1, 1]
    ratio = F.col("c") / (F.sqrt("v") * F.sqrt("w"))
    return moments.select(F.inline(F.array(*rows))).select("col_a", "col_b", F.when(
        (F.col("v") > 0) & (F.col("w") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))).alias("corr"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of numeric or boolean columns, long form
    ``(col_a, col_b, corr)``; NULL where a column is constant (no ANSI error).  Columns of
    other types are rejected.

    Integer and boolean columns (0/1 goal flags): one aggregate pass collects the raw moments (n, sums, cross
    products of the upper triangle), which are exact; they are unpivoted to one row per ordered pair, so the
    correlation formula is a single small expression applied to len(columns)^2 rows.  The many similar
    expressions are given as SQL text (one JVM call each).  With any other column all pairs go by centred
    co-moments (:func:`_comoments`)."""
    columns = list(columns)
    for c in columns:
        if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            raise ValueError(f"correlation_matrix: {c} is {df.schema[c].dataType.simpleString()}, not a number")
    if not all(isinstance(df.schema[c].dataType, (T.IntegralType, T.BooleanType)) for c in columns):
        return _comoments(df, columns)
    q = ["`" + c.replace("`", "``") + "`" for c in columns]
    aggs = ["count(1) AS _n"] + [f"sum(CAST({c} AS BIGINT)) AS _s{i}" for i, c in enumerate(q)]
    aggs += [f"sum(CAST({q[i]} AS BIGINT) * CAST({q[j]} AS BIGINT)) AS _p{i}_{j}"
             for i, j in combinations_with_replacement(range(len(q)), 2)]
    moments = df.agg(*[F.expr(a) for a in aggs])

    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    structs = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            p = lambda x, y: f"_p{min(x, y)}_{max(x, y)}"
            structs.append(f"named_struct('col_a', {lit(a)}, 'col_b', {lit(b)}, 'n', _n, 'sa', _s{i}, "
                           f"'sb', _s{j}, 'saa', {p(i, i)}, 'sbb', {p(j, j)}, 'sab', {p(i, j)})")
    pairs = moments.selectExpr(f"inline(array({', '.join(structs)}))")
    return pairs.select("col_a", "col_b",
                        pearson_from_moments("n", "sa", "sb", "saa", "sbb", "sab").alias("corr"))
