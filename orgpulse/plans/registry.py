"""Registry of named queries: key → (Spark callable, optional DuckDB oracle SQL).

Every registered callable takes ``(spark, sf_dir)``, reads the supplied tables under
``sf_dir`` and returns a DataFrame.  Doubles are rounded to 6 places on the way out, the
same rounding the oracle SQL applies, so results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orgpulse.operators.common import holding

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles as ``round(x * 10^d) / 10^d`` on the binary value (half away from zero).

    ``F.round(x, d)`` rounds the shortest decimal form instead, which differs on values such
    as 0.0640625 whose binary value lies just below the tie; the scaled form is the rule SQL
    engines such as DuckDB apply to doubles, so both sides of a comparison round alike."""
    scale = f"1e{digits}"
    exprs = []
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(f"round(CAST({name} AS DOUBLE) * {scale}) / {scale} AS {name}")
        else:
            exprs.append(name)
    # one SQL projection: a single call into the JVM instead of several per column
    return df.selectExpr(*exprs)


def register(key: str, oracle: str | None = None):
    if key in _QUERIES:
        raise ValueError(f"query {key!r} registered twice")

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = fn(spark, sf_dir)
            return holding(round_doubles(found), found)

        run.__name__ = f"query_{key}"
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn

    return deco


def all_queries() -> dict[str, QueryFn]:
    from orgpulse.plans import queries as _q  # noqa: F401  (registers on import)
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    from orgpulse.plans import queries as _q  # noqa: F401
    return dict(_ORACLES)
