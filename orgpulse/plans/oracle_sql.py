"""Hand-written DuckDB SQL used as the independent oracle for registered queries.

Tables ``orders`` and ``events`` are views over the supplied parquet files.  Conventions:
doubles rounded to 6 places, integer sums cast to BIGINT, elapsed seconds with
``date_sub('second', a, b)`` (exact floor), weekday as ``isodow - 1``.
"""

from __future__ import annotations

# Fixture A: orders as an organization event log.
EV_A = """ev AS (
    SELECT o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS organization_id,
           o_orderpriority AS activity_name, o_orderstatus AS activity_detail,
           CAST(o_orderdate AS TIMESTAMP) AS "timestamp"
    FROM orders)"""

# Fixture B: the events table with the JSON key as detail.
EV_B = """ev AS (
    SELECT event_id, CAST(user_id AS VARCHAR) AS organization_id, event_type AS activity_name,
           json_extract_string(props, '$.k') AS activity_detail, CAST(ts AS TIMESTAMP) AS "timestamp"
    FROM events)"""

# (goal name, SQL predicate, min count) — fixture A vocabulary.
GOALS_A = [
    ("urgent", "activity_name = '1-URGENT'", 2),
    ("high", "activity_name = '2-HIGH'", 1),
    ("medium", "activity_name = '3-MEDIUM'", 1),
    ("low", "activity_name = '5-LOW'", 1),
    ("unspecified", "activity_name = '4-NOT SPECIFIED' AND activity_detail IN ('F', 'O')", 2),
]
LABELS_A = {"urgent": "Urgent Orders", "high": "High Orders", "medium": "Medium Orders",
            "low": "Low Orders", "unspecified": "Unspecified Orders"}

_B_DETAILS_20 = ", ".join(f"'{i}'" for i in range(20))
_B_DETAILS_12 = ", ".join(f"'{i}'" for i in range(12))
GOALS_B = [
    ("signup", f"activity_name = 'signup' AND activity_detail IN ({_B_DETAILS_20})", 2),
    ("click", f"activity_name = 'click' AND activity_detail IN ({_B_DETAILS_20})", 2),
    ("purchase", f"activity_name = 'purchase' AND activity_detail IN ({_B_DETAILS_20})", 1),
    ("error", f"activity_name = 'error' AND activity_detail IN ({_B_DETAILS_20})", 1),
    ("view", f"activity_name = 'view' AND activity_detail IN ({_B_DETAILS_12})", 2),
]


def profile_cte(goals) -> str:
    """Per-organization aggregate: first/last event, per-goal count and first matching time."""
    parts = []
    for name, pred, _ in goals:
        parts.append(f"count(*) FILTER (WHERE {pred}) AS n_{name}")
        parts.append(f'min("timestamp") FILTER (WHERE {pred}) AS f_{name}')
    return f"""prof AS (
    SELECT organization_id, min("timestamp") AS first_ts, max("timestamp") AS last_ts,
           {', '.join(parts)}
    FROM ev GROUP BY organization_id)"""


def flags_cte(goals) -> str:
    cols = ", ".join(f"CASE WHEN n_{n} >= {k} THEN 1 ELSE 0 END AS goal_{n}" for n, _, k in goals)
    return f"flags AS (SELECT organization_id, {cols} FROM prof)"


def all_met_sql(goals) -> str:
    return " AND ".join(f"goal_{n} = 1" for n, _, _ in goals)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


A_BASE = with_ctes(EV_A, profile_cte(GOALS_A), flags_cte(GOALS_A))


def running_marks_cte(goals) -> str:
    """W2 as a running window: per event the running count of each goal, ``met`` when all
    reach their minimum, and the completing mark on the first met event."""
    counts = ", ".join(f"sum(CASE WHEN {p} THEN 1 ELSE 0 END) OVER w AS c_{n}" for n, p, _ in goals)
    met = " AND ".join(f"c_{n} >= {k}" for n, _, k in goals)
    return f"""run AS (
    SELECT *, {counts} FROM ev
    WINDOW w AS (PARTITION BY organization_id ORDER BY "timestamp", event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
met AS (SELECT *, ({met}) AS m FROM run),
marks AS (
    SELECT *, m AND sum(CASE WHEN m THEN 1 ELSE 0 END) OVER w2 = 1 AS completes_activation FROM met
    WINDOW w2 AS (PARTITION BY organization_id ORDER BY "timestamp", event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


STAGING_CTE = """stg AS (
    SELECT *, min("timestamp") OVER (PARTITION BY organization_id) AS first_activity_timestamp,
           date_sub('second', min("timestamp") OVER (PARTITION BY organization_id), "timestamp")
               AS time_since_first_activity
    FROM ev)"""


def check_rows(rows, source: str) -> str:
    """UNION ALL of check rows ``(name, observed_sql, expected_sql | None, passed_sql | None)``."""
    parts = []
    for name, obs, exp, passed in rows:
        exp_sql = "CAST(NULL AS BIGINT)" if exp is None else f"CAST({exp} AS BIGINT)"
        if passed is None:
            passed = "true" if exp is None else f"({obs}) = ({exp})"
        parts.append(f"""SELECT '{name}' AS "check", CAST({obs} AS BIGINT) AS observed, {exp_sql} AS expected,
       coalesce({passed}, false) AS passed FROM {source}""")
    return "\nUNION ALL\n".join(parts)
