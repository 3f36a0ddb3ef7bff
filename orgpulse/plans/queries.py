"""Registered queries: each key of SURVEY §2 as a Spark callable plus its DuckDB oracle.

Fixture A (``orders`` read as an event log) is the main input; fixture B (``events``) is
used where sub-second times, weekdays/hours or the JSON detail matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.functions.goals import DETAIL, EVENT_ID, NAME, ORG, TS
from orgpulse.functions.stats import Z_95
from orgpulse.functions.timefns import day_of_week, hour_of_day
from orgpulse.operators import classify as C
from orgpulse.operators import colocated as B
from orgpulse.operators import distinct as D
from orgpulse.operators import features as F_
from orgpulse.operators import goals as G
from orgpulse.operators import journey as J
from orgpulse.operators import metrics as M
from orgpulse.operators import profile as P
from orgpulse.operators import quality as Q
from orgpulse.operators import survival as S
from orgpulse.operators.common import consecutive_ids
from orgpulse.operators.recurrent import fit as fit_recurrent
from orgpulse.operators.recurrent import recurrent_predictions
from orgpulse.operators.staging import stage, stage_window
from orgpulse.plans.marts import built, built_by_org, checked, raw_events
from orgpulse.plans.oracle_sql import (
    A_BASE, EV_A, EV_B, GOALS_A, GOALS_B, LABELS_A, STAGING_CTE, all_met_sql, check_rows, flags_cte,
    profile_cte, running_marks_cte, with_ctes,
)
from orgpulse.plans.registry import register
from orgpulse.session import materialize, scratch_path
from orgpulse.sources.adapters import ORDER_GOALS, STREAM_GOALS, fixture_a, fixture_b, orders_as_events
from orgpulse.sources.csv import read_events_csv, write_events_csv
from orgpulse.sources.inference import infer_csv_schema
from orgpulse.sources.rejects import load_events_csv
from orgpulse.sources.sinks import write_and_read
from orgpulse.sources.tables import read_table

A_ADVANCED = ORDER_GOALS[-1]


def _profile_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.org_goal_profile(fixture_a(spark, sf_dir), ORDER_GOALS)


def _union_rows(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


# --------------------------------------------------------------------------------------
# sources, staging
# --------------------------------------------------------------------------------------

@register("staging_events", with_ctes(EV_B) + """
SELECT event_id, organization_id, activity_name, activity_detail, "timestamp",
       min("timestamp") OVER (PARTITION BY organization_id) AS first_activity_timestamp,
       date_sub('second', min("timestamp") OVER (PARTITION BY organization_id), "timestamp")
           AS time_since_first_activity
FROM ev""")
def q_staging_events(spark, sf_dir):
    """M1 on fixture B: first activity per organization and whole seconds since it."""
    return stage(fixture_b(spark, sf_dir))


@register("staging_events_window", with_ctes(EV_A) + """
SELECT event_id, organization_id, activity_name, activity_detail, "timestamp",
       min("timestamp") OVER (PARTITION BY organization_id) AS first_activity_timestamp,
       date_sub('second', min("timestamp") OVER (PARTITION BY organization_id), "timestamp")
           AS time_since_first_activity
FROM ev""")
def q_staging_events_window(spark, sf_dir):
    """W1 on fixture A: the window form of staging."""
    return stage_window(fixture_a(spark, sf_dir))


@register("consecutive_event_ids", with_ctes(EV_A) + """
SELECT row_number() OVER (ORDER BY organization_id, "timestamp", event_id) AS new_id, event_id FROM ev""")
def q_consecutive_event_ids(spark, sf_dir):
    """Ids 1..n in (organization, timestamp, event id) order."""
    return consecutive_ids(fixture_a(spark, sf_dir), [ORG, TS, EVENT_ID], id_col="new_id").select("new_id", EVENT_ID)


@register("events_by_activity", with_ctes(EV_A) + """
SELECT event_id, organization_id, activity_name, activity_detail, "timestamp"
FROM ev WHERE activity_name = '1-URGENT'""")
def q_events_by_activity(spark, sf_dir):
    """events of one activity (pushed into the parquet scan)."""
    return fixture_a(spark, sf_dir).filter(F.col(NAME) == "1-URGENT")


@register("events_head", with_ctes(EV_A) + """
SELECT event_id, organization_id, activity_name, activity_detail, "timestamp",
       first_activity_timestamp, time_since_first_activity
FROM (SELECT *, min("timestamp") OVER (PARTITION BY organization_id) AS first_activity_timestamp,
             date_sub('second', min("timestamp") OVER (PARTITION BY organization_id), "timestamp")
                 AS time_since_first_activity FROM ev)
ORDER BY event_id LIMIT 5""")
def q_events_head(spark, sf_dir):
    """O2: first five staged events by id (a top-k, no global sort)."""
    ev = fixture_a(spark, sf_dir)
    head = ev.orderBy(EVENT_ID).limit(5)
    # the first activity of the five events' organizations only
    theirs = ev.join(F.broadcast(head.select(ORG).distinct()), ORG, "left_semi")
    return stage(theirs).join(F.broadcast(head.select(EVENT_ID)), EVENT_ID, "left_semi").orderBy(EVENT_ID).limit(5)


@register("event_time_parts", with_ctes(EV_B) + """
SELECT event_id, organization_id, "timestamp", CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
       CAST(hour("timestamp") AS INTEGER) AS hour_of_day
FROM ev""")
def q_event_time_parts(spark, sf_dir):
    """Weekday (Monday = 0) and hour per event."""
    ev = fixture_b(spark, sf_dir)
    return ev.select(EVENT_ID, ORG, TS, day_of_week(F.col(TS)).alias("day_of_week"),
                     hour_of_day(F.col(TS)).alias("hour_of_day"))


# --------------------------------------------------------------------------------------
# per-organization aggregates and marts
# --------------------------------------------------------------------------------------

@register("goal_counts", A_BASE + """
SELECT organization_id, n_urgent, n_high, n_medium, n_low, n_unspecified FROM prof""")
def q_goal_counts(spark, sf_dir):
    """A5: conditional counts per organization."""
    return G.goal_counts(_profile_a(spark, sf_dir), ORDER_GOALS)


@register("goal_first_seconds", A_BASE + "SELECT organization_id, " + ", ".join(
    f"date_sub('second', first_ts, f_{n}) AS first_s_{n}" for n, _, _ in GOALS_A) + " FROM prof")
def q_goal_first_seconds(spark, sf_dir):
    """Conditional minimum of seconds since first activity per organization."""
    return G.goal_first_seconds(_profile_a(spark, sf_dir), ORDER_GOALS)


@register("org_activity_span", A_BASE + """
SELECT organization_id, first_ts AS first_event, last_ts AS last_event,
       round(date_sub('microsecond', first_ts, last_ts) / 86400e6, 6) AS span_days
FROM prof""")
def q_org_activity_span(spark, sf_dir):
    """First and last event per organization."""
    return G.org_activity_span(_profile_a(spark, sf_dir))


@register("goal_flags", A_BASE + "SELECT * FROM flags")
def q_goal_flags(spark, sf_dir):
    """M2: the goals mart."""
    return G.goal_flags(_profile_a(spark, sf_dir), ORDER_GOALS)


@register("fully_activated", A_BASE + f"SELECT organization_id FROM flags WHERE {all_met_sql(GOALS_A)}")
def q_fully_activated(spark, sf_dir):
    """M3: the activation mart."""
    flags = G.goal_flags(_profile_a(spark, sf_dir), ORDER_GOALS)
    return G.fully_activated(flags, ORDER_GOALS)


# --------------------------------------------------------------------------------------
# metrics
# --------------------------------------------------------------------------------------

@register("activation_rate", A_BASE + f"""
SELECT count(*) FILTER (WHERE {all_met_sql(GOALS_A)}) AS activated_orgs,
       count(organization_id) AS total_orgs,
       round(coalesce(CAST(count(*) FILTER (WHERE {all_met_sql(GOALS_A)}) AS DOUBLE)
                      / nullif(count(organization_id), 0), 0.0), 6) AS activation_rate
FROM flags""")
def q_activation_rate(spark, sf_dir):
    """M4."""
    return M.activation_rate(_profile_a(spark, sf_dir), ORDER_GOALS)


@register("activated_span_days", A_BASE + f"""
SELECT count(*) AS activated_orgs,
       round(coalesce(avg(date_sub('microsecond', p.first_ts, p.last_ts) / 86400e6), 0.0), 6) AS avg_days
FROM prof p WHERE p.organization_id IN (SELECT organization_id FROM flags WHERE {all_met_sql(GOALS_A)})""")
def q_activated_span_days(spark, sf_dir):
    """M5 (the reference's time_to_activation)."""
    return M.activated_span_days(_profile_a(spark, sf_dir), ORDER_GOALS)


_SPAN = A_BASE + f"""
SELECT count(*) AS activated_orgs,
       round(coalesce(avg(date_sub('microsecond', first_ts, last_ts) / 86400e6), 0.0), 6) AS avg_days
FROM prof WHERE organization_id IN (SELECT organization_id FROM flags WHERE {all_met_sql(GOALS_A)})"""


@register("activated_span_days_from_mart", _SPAN)
def q_activated_span_days_from_mart(spark, sf_dir):
    """M5 through J4: semi-join with the activation mart, written and read back (S3)."""
    tables = built(spark, fixture_a(spark, sf_dir), ORDER_GOALS)
    return M.activated_span_days(_profile_a(spark, sf_dir), ORDER_GOALS, activated=tables.table("activation"))


@register("goal_completion_rates", A_BASE + _union_rows([
    f"""SELECT '{n}' AS goal, '{LABELS_A[n]}' AS label, CAST(sum(goal_{n}) AS BIGINT) AS completed_orgs,
       count(*) AS total_orgs, round(CAST(sum(goal_{n}) AS DOUBLE) / nullif(count(*), 0), 6) AS rate
FROM flags""" for n, _, _ in GOALS_A]))
def q_goal_completion_rates(spark, sf_dir):
    """M6."""
    return M.goal_completion_rates(_profile_a(spark, sf_dir), ORDER_GOALS)


_ENGAGEMENT = with_ctes(EV_A) + """
SELECT activity_detail, count(DISTINCT organization_id) AS engaged_orgs,
       (SELECT count(DISTINCT organization_id) FROM ev) AS total_orgs,
       round(CAST(count(DISTINCT organization_id) AS DOUBLE)
             / nullif((SELECT count(DISTINCT organization_id) FROM ev), 0), 6) AS rate
FROM ev
WHERE activity_name = '4-NOT SPECIFIED' AND activity_detail IN ('F', 'O')
GROUP BY activity_detail"""


@register("feature_engagement", _ENGAGEMENT)
def q_feature_engagement(spark, sf_dir):
    """M7 (the reference's advanced_features_rate)."""
    return M.feature_engagement(fixture_a(spark, sf_dir), A_ADVANCED)


@register("feature_engagement_merged", _ENGAGEMENT)
def q_feature_engagement_merged(spark, sf_dir):
    """M7 and A4 from monthly distinct states, merged without reading the events again."""
    return D.feature_engagement_from(*D.monthly_engagement(fixture_a(spark, sf_dir), A_ADVANCED))


@register("engaged_orgs_by_month", with_ctes(EV_A, """hit AS (
    SELECT activity_detail, organization_id, CAST(date_trunc('month', "timestamp") AS DATE) AS month FROM ev
    WHERE activity_name = '4-NOT SPECIFIED' AND activity_detail IN ('F', 'O'))""", """months AS (
    SELECT activity_detail, month, count(DISTINCT organization_id) AS engaged_orgs FROM hit GROUP BY 1, 2)""") + """
SELECT activity_detail, month, engaged_orgs,
       (SELECT count(DISTINCT organization_id) FROM hit h WHERE h.activity_detail = m.activity_detail
        AND h.month <= m.month AND year(h.month) = year(m.month)) AS year_to_date,
       (SELECT count(DISTINCT organization_id) FROM hit h WHERE h.activity_detail = m.activity_detail) AS all_months
FROM months m""")
def q_engaged_orgs_by_month(spark, sf_dir):
    """A2/A4 at three levels from one monthly state: month, year to date, all months."""
    return D.engaged_by_month(D.monthly_engagement(fixture_a(spark, sf_dir), A_ADVANCED)[0])


@register("goal_times", A_BASE + _union_rows([
    f"""SELECT '{n}' AS goal, '{LABELS_A[n]}' AS label,
       count(*) FILTER (WHERE n_{n} >= {k}) AS orgs_reached,
       round(avg(CASE WHEN n_{n} >= {k} THEN date_sub('second', first_ts, f_{n}) END) / 86400.0, 6) AS avg_days
FROM prof""" for n, _, k in GOALS_A]))
def q_goal_times(spark, sf_dir):
    """M8 (the reference's goal_achievement_times)."""
    return M.goal_times(_profile_a(spark, sf_dir), ORDER_GOALS)


WITHIN_DAYS = 120


@register("goal_reached_within_days", A_BASE + _union_rows([
    f"""SELECT '{n}' AS goal, '{LABELS_A[n]}' AS label, CAST({WITHIN_DAYS} AS DOUBLE) AS days,
       round(coalesce(avg(CASE WHEN n_{n} >= {k} AND date_sub('second', first_ts, f_{n}) <= {WITHIN_DAYS} * 86400
                          THEN 1.0 ELSE 0.0 END), 0.0), 6) AS probability
FROM prof""" for n, _, k in GOALS_A]))
def q_goal_reached_within_days(spark, sf_dir):
    """Share of organizations reaching each goal within 120 days."""
    return M.goal_reached_within_days(_profile_a(spark, sf_dir), ORDER_GOALS, WITHIN_DAYS)


# --------------------------------------------------------------------------------------
# journeys
# --------------------------------------------------------------------------------------

_MARKS_A = with_ctes(EV_A, running_marks_cte(GOALS_A))


@register("completing_events", _MARKS_A + """
SELECT event_id, organization_id, activity_name, activity_detail, "timestamp", completes_activation
FROM marks""")
def q_completing_events(spark, sf_dir):
    """The event that completes activation, flagged on every event."""
    return J.completing_events(fixture_a(spark, sf_dir), ORDER_GOALS)


@register("activating_events", _MARKS_A + """
SELECT event_id, organization_id, "timestamp" FROM marks WHERE completes_activation""")
def q_activating_events(spark, sf_dir):
    """F8: only the events whose boolean flag is set."""
    return J.completing_events(fixture_a(spark, sf_dir), ORDER_GOALS).filter(F.col(J.COMPLETES)).select(EVENT_ID, ORG, TS)


_EV_A_NULL = EV_A.replace("CAST(o_custkey AS VARCHAR)", "CAST(nullif(o_custkey % 10, 7) AS VARCHAR)")


def _null_org_events(spark, sf_dir):
    """Fixture A in ten organizations, the one ending in 7 without an id."""
    customer = F.col("o_custkey") % 10
    orders = read_table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(customer != 7, customer))
    return orders_as_events(orders)


@register("completing_events_null_org", with_ctes(_EV_A_NULL, running_marks_cte(GOALS_A)) + """
SELECT event_id, organization_id, "timestamp", completes_activation FROM marks""")
def q_completing_events_null_org(spark, sf_dir):
    """W2/M10 with a kept NULL organization: it is a group like any other."""
    return J.completing_events(_null_org_events(spark, sf_dir), ORDER_GOALS).select(EVENT_ID, ORG, TS, J.COMPLETES)


@register("activation_times", _MARKS_A + """,
firsts AS (SELECT organization_id, min("timestamp") AS first_ts FROM ev GROUP BY organization_id)
SELECT m.organization_id, m.event_id, m."timestamp" AS completing_timestamp,
       date_sub('second', f.first_ts, m."timestamp") AS seconds_since_first,
       round(date_sub('second', f.first_ts, m."timestamp") / 86400.0, 6) AS days_since_first
FROM marks m JOIN firsts f USING (organization_id)
WHERE m.completes_activation""")
def q_activation_times(spark, sf_dir):
    """O3: per activated organization its completing event and the time to it."""
    return J.activation_times(fixture_a(spark, sf_dir), ORDER_GOALS)


@register("completing_event_rate", _MARKS_A + """
SELECT count(DISTINCT organization_id) FILTER (WHERE completes_activation) AS activated_orgs,
       count(DISTINCT organization_id) AS total_orgs,
       round(100.0 * count(DISTINCT organization_id) FILTER (WHERE completes_activation)
             / nullif(count(DISTINCT organization_id), 0), 6) AS percent
FROM marks""")
def q_completing_event_rate(spark, sf_dir):
    """Count and percentage of organizations with a completing event."""
    return J.completing_event_rate(fixture_a(spark, sf_dir), ORDER_GOALS)


_TTG_PROFILE_A = """prof AS (
    SELECT organization_id, min("timestamp") AS first_ts,
           count(*) FILTER (WHERE activity_name = '1-URGENT') AS n_urgent,
           min("timestamp") FILTER (WHERE activity_name = '1-URGENT') AS f_urgent,
           count(*) FILTER (WHERE activity_name = '2-HIGH') AS n_high,
           min("timestamp") FILTER (WHERE activity_name = '2-HIGH') AS f_high,
           count(*) FILTER (WHERE activity_name = '3-MEDIUM') AS n_medium,
           min("timestamp") FILTER (WHERE activity_name = '3-MEDIUM') AS f_medium,
           count(*) FILTER (WHERE activity_name = '5-LOW') AS n_low,
           min("timestamp") FILTER (WHERE activity_name = '5-LOW') AS f_low,
           count(DISTINCT activity_detail) FILTER (WHERE activity_name = '4-NOT SPECIFIED'
                                                   AND activity_detail IN ('F', 'O')) AS n_unspecified,
           min("timestamp") FILTER (WHERE activity_name = '4-NOT SPECIFIED'
                                    AND activity_detail IN ('F', 'O')) AS f_unspecified
    FROM ev GROUP BY organization_id),
ttg AS (""" + _union_rows([
    f"""SELECT organization_id, '{n}' AS goal, date_sub('second', first_ts, f_{n}) / 86400.0 AS days
    FROM prof WHERE n_{n} >= {k}""" for n, _, k in GOALS_A]) + ")"


@register("time_to_goal", with_ctes(EV_A, _TTG_PROFILE_A) + """
SELECT organization_id, goal, round(days, 6) AS days FROM ttg""")
def q_time_to_goal(spark, sf_dir):
    """M9: days to each reached goal per organization (distinct details for the detail goal)."""
    return J.time_to_goal(fixture_a(spark, sf_dir), ORDER_GOALS)


_TTG_LABEL_B = with_ctes(EV_B, profile_cte(GOALS_B)).replace("count(*) FILTER", "count(DISTINCT activity_detail) FILTER")


@register("time_to_goal_stream", _TTG_LABEL_B + "\n" + _union_rows([
    f"""SELECT organization_id, '{n}' AS goal, '{n.capitalize()}' AS label,
       round(date_sub('second', first_ts, f_{n}) / 86400.0, 6) AS days FROM prof WHERE n_{n} >= {k}""" for n, _, k in GOALS_B]))
def q_time_to_goal_stream(spark, sf_dir):
    """M9 on fixture B: five goals with distinct details, with the label that curves carry."""
    return J.time_to_goal(fixture_b(spark, sf_dir), STREAM_GOALS, with_label=True)


# --------------------------------------------------------------------------------------
# sources and sinks that write
# --------------------------------------------------------------------------------------

@register("raw_events", with_ctes(EV_A) + """
SELECT event_id, coalesce(organization_id, 'nan') AS organization_id, activity_name,
       activity_detail, "timestamp" FROM ev""")
def q_raw_events(spark, sf_dir):
    """The raw table written with overwrite semantics and read back."""
    raw = raw_events(fixture_a(spark, sf_dir))
    return write_and_read(spark, raw, scratch_path(spark, "raw_events"))


@register("events_from_csv", with_ctes(EV_A) + """
SELECT organization_id, activity_name, activity_detail, "timestamp" FROM ev""")
def q_events_from_csv(spark, sf_dir):
    """Events exported in the raw CSV layout and read back with the CSV source."""
    path = scratch_path(spark, "events_csv")
    write_events_csv(fixture_a(spark, sf_dir), path)
    return read_events_csv(spark, path, with_event_id=False)


@register("events_from_csv_by_name", with_ctes(EV_A) + """
SELECT organization_id, activity_name || ' "q", x' || chr(10) || 'y' AS activity_name, activity_detail, "timestamp",
       CAST(event_id AS VARCHAR) AS note FROM ev""")
def q_events_from_csv_by_name(spark, sf_dir):
    """An export with its columns in another order and case, an extra column, quotes and line
    feeds inside quoted values."""
    path = scratch_path(spark, "events_csv_by_name")
    fixture_a(spark, sf_dir).select(
        F.col(EVENT_ID).alias("Note"), F.col(TS).alias("Timestamp"), F.col(DETAIL).alias("activity_detail"),
        F.concat(F.col(NAME), F.lit(' "q", x\ny')).alias("ACTIVITY_NAME"), F.col(ORG).alias("Organization_Id")) \
        .write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return read_events_csv(spark, path, with_event_id=False, multi_line=True, extra_columns=True)


_NUMBERS_SQL = """num AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders),
cells AS (
    SELECT r, 'organization_id' AS "column", CAST(o_custkey AS VARCHAR) AS v FROM num
    UNION ALL SELECT r, 'activity_name', o_orderpriority FROM num
    UNION ALL SELECT r, 'activity_detail', o_orderstatus FROM num
    UNION ALL SELECT r, 'timestamp', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') FROM num
    UNION ALL SELECT r, 'amount', CASE WHEN o_orderkey % 97 = 3 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE CAST(o_custkey AS VARCHAR) END FROM num
    UNION ALL SELECT r, 'code', CASE WHEN r = n THEN 'x7' WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(o_orderkey % 1000 AS VARCHAR) END FROM num
    UNION ALL SELECT r, 'flag', CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'FALSE' END FROM num
    UNION ALL SELECT r, 'mixed', CASE WHEN o_orderkey % 89 = 7 THEN '12' ELSE 'true' END FROM num
    UNION ALL SELECT r, 'day', strftime(o_orderdate, '%Y-%m-%d') FROM num
    UNION ALL SELECT r, 'nothing', CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE 'n/a' END FROM num),
classed AS (
    SELECT "column", r, CASE WHEN v IN ('NA', 'null', 'n/a') THEN NULL WHEN lower(v) IN ('true', 'false') THEN 'bool'
                             WHEN regexp_full_match(v, '[0-9]+') THEN 'int' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float'
                             WHEN TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 'timestamp' ELSE 'text' END AS c FROM cells),
firsts AS (
    SELECT "column", count(*) FILTER (WHERE c IS NULL) AS nulls, min(r) FILTER (WHERE c = 'bool') AS b,
           min(r) FILTER (WHERE c = 'int') AS i, min(r) FILTER (WHERE c = 'float') AS f,
           min(r) FILTER (WHERE c = 'timestamp') AS t, min(r) FILTER (WHERE c = 'text') AS x
    FROM classed GROUP BY "column"),
texts AS (
    SELECT *, least(x, CASE WHEN b IS NOT NULL AND i IS NOT NULL THEN greatest(b, i) END,
                    CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN greatest(b, f) END,
                    CASE WHEN b IS NOT NULL AND t IS NOT NULL THEN greatest(b, t) END,
                    CASE WHEN i IS NOT NULL AND t IS NOT NULL THEN greatest(i, t) END,
                    CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN greatest(f, t) END) AS w FROM firsts)"""


def _export_with_extras(spark, sf_dir):
    """Orders in key order as an export whose extra columns need every kind of type."""
    orders = read_table(spark, sf_dir, "orders")
    key, org, last = F.col("o_orderkey"), F.col("o_custkey").cast("string"), orders.agg(F.max("o_orderkey")).first()[0]
    path = scratch_path(spark, "events_csv_extras")
    orders.orderBy("o_orderkey").select(
        F.col("o_custkey").alias("ORGANIZATION_ID"), F.col("o_orderpriority").alias("ACTIVITY_NAME"),
        F.col("o_orderstatus").alias("ACTIVITY_DETAIL"), F.col("o_orderdate").cast("timestamp_ntz").alias("TIMESTAMP"),
        F.when(key % 97 == 3, F.concat(org, F.lit(".5"))).otherwise(org).alias("Amount"),
        F.when(key == last, "x7").when(key % 5 == 0, "NA").otherwise((key % 1000).cast("string")).alias("code"),
        F.when(F.col("o_orderstatus") == "F", "True").otherwise("FALSE").alias("flag"),
        F.when(key % 89 == 7, "12").otherwise("true").alias("mixed"),
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("day"),
        F.when(key % 2 == 0, "null").otherwise("n/a").alias("nothing")) \
        .write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


@register("csv_inferred_schema", "WITH " + _NUMBERS_SQL + """
SELECT "column", CASE WHEN w IS NOT NULL THEN 'text' WHEN f IS NOT NULL THEN 'float' WHEN i IS NOT NULL THEN 'int'
                      WHEN b IS NOT NULL THEN 'bool' WHEN t IS NOT NULL THEN 'timestamp' ELSE 'null' END AS type,
       nulls, coalesce(w, f, i, b, t) AS first_row
FROM texts""")
def q_csv_inferred_schema(spark, sf_dir):
    """The types of all columns of an export, and the row that decided each."""
    return infer_csv_schema(spark, _export_with_extras(spark, sf_dir))


@register("events_from_csv_typed", with_ctes(EV_A) + """
SELECT ev.organization_id, ev.activity_name, ev.activity_detail, ev."timestamp",
       CASE WHEN event_id % 97 = 3 THEN CAST(organization_id AS DOUBLE) + 0.5 ELSE CAST(organization_id AS DOUBLE) END AS amount,
       CASE WHEN event_id = (SELECT max(event_id) FROM ev) THEN 'x7' WHEN event_id % 5 = 0 THEN NULL
            ELSE CAST(event_id % 1000 AS VARCHAR) END AS code,
       activity_detail = 'F' AS flag, CASE WHEN event_id % 89 = 7 THEN '12' ELSE 'true' END AS mixed,
       CAST(CAST("timestamp" AS DATE) AS TIMESTAMP) AS day, CAST(NULL AS VARCHAR) AS nothing
FROM ev""")
def q_events_from_csv_typed(spark, sf_dir):
    """The same export read with its extra columns in the inferred types."""
    return read_events_csv(spark, _export_with_extras(spark, sf_dir), with_event_id=False, extra_columns="infer")


@register("csv_rejects", with_ctes(EV_A) + """, marked AS (
    SELECT *, CASE WHEN event_id % 11 = 0 THEN '31.02.' || CAST(event_id % 3 AS VARCHAR) WHEN event_id % 13 = 0 THEN 'NA' END AS bad
    FROM ev)
SELECT 'rejected' AS outcome, 'timestamp' AS reason, bad AS raw, activity_name, count(*) AS rows FROM marked
WHERE bad IS NOT NULL AND bad <> 'NA' GROUP BY bad, activity_name
UNION ALL SELECT 'accepted', NULL, NULL, activity_name, count(*) FROM marked WHERE bad IS NULL OR bad = 'NA' GROUP BY activity_name""")
def q_csv_rejects(spark, sf_dir):
    """An export with unparsable and missing timestamps, loaded with its rejects set aside."""
    path = scratch_path(spark, "events_csv_bad")
    fixture_a(spark, sf_dir).select(
        F.col(ORG).alias("ORGANIZATION_ID"), F.col(NAME).alias("ACTIVITY_NAME"), F.col(DETAIL).alias("ACTIVITY_DETAIL"),
        F.when(F.col(EVENT_ID) % 11 == 0, F.concat(F.lit("31.02."), (F.col(EVENT_ID) % 3).cast("string")))
        .when(F.col(EVENT_ID) % 13 == 0, "NA").otherwise(F.col(TS).cast("string")).alias("TIMESTAMP")) \
        .write.option("header", True).csv(path)
    load = load_events_csv(spark, path)
    accepted = load.events.groupBy(NAME).count().select(
        F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("raw"),
        NAME, F.col("count").alias("rows"))
    return accepted.union(load.rejects.groupBy("reason", "raw", NAME).count().select(
        F.lit("rejected"), "reason", "raw", NAME, "count"))


# --------------------------------------------------------------------------------------
# data quality
# --------------------------------------------------------------------------------------

def _checked_a(spark, sf_dir, check):
    return checked(spark, fixture_a(spark, sf_dir), ORDER_GOALS, check)


_Q_BASE = with_ctes(EV_A, profile_cte(GOALS_A), flags_cte(GOALS_A), STAGING_CTE)
_ALL_A = all_met_sql(GOALS_A)


@register("table_counts", _Q_BASE + """, c AS (SELECT
    (SELECT count(*) FROM ev) AS raw_rows, (SELECT count(DISTINCT organization_id) FROM ev) AS raw_orgs,
    (SELECT count(*) FROM stg) AS staging_rows,
    (SELECT count(DISTINCT organization_id) FROM stg) AS staging_orgs,
    (SELECT count(*) FROM flags) AS goal_rows,
    (SELECT count(*) FROM flags WHERE """ + _ALL_A + """) AS activation_rows)
""" + check_rows([
    ("raw_rows", "raw_rows", None, None), ("staging_rows", "staging_rows", "raw_rows", None),
    ("raw_orgs", "raw_orgs", None, None), ("staging_orgs", "staging_orgs", "raw_orgs", None),
    ("goal_rows", "goal_rows", "staging_orgs", None),
    ("activation_rows", "activation_rows", "goal_rows", "activation_rows <= goal_rows")], "c"))
def q_table_counts(spark, sf_dir):
    """V1, V4."""
    return _checked_a(spark, sf_dir, Q.table_counts)


@register("check_nulls", with_ctes(EV_A) + check_rows([
    ("null_organization_id", "count(*) FILTER (WHERE organization_id IS NULL)", "0", None),
    ("null_activity_name", "count(*) FILTER (WHERE activity_name IS NULL)", "0", None),
    ("null_timestamp", 'count(*) FILTER (WHERE "timestamp" IS NULL)', "0", None)], "ev"))
def q_check_nulls(spark, sf_dir):
    """V2."""
    return Q.check_nulls(fixture_a(spark, sf_dir))


@register("check_time_range", with_ctes(EV_A) + """
SELECT 'timestamp_range' AS "check", min("timestamp") AS min_timestamp, max("timestamp") AS max_timestamp,
       coalesce(min("timestamp") <= max("timestamp"), false) AS passed
FROM ev""")
def q_check_time_range(spark, sf_dir):
    """V3."""
    return Q.check_time_range(fixture_a(spark, sf_dir))


_COVERAGE = _Q_BASE + """, c AS (
    SELECT count(DISTINCT s.organization_id) AS staging_orgs, count(DISTINCT g.organization_id) AS goal_orgs
    FROM stg s LEFT JOIN flags g ON s.organization_id = g.organization_id)
""" + check_rows([("staging_org_count", "staging_orgs", None, None),
                  ("trial_goals_org_count", "goal_orgs", "staging_orgs", None)], "c")


@register("check_org_coverage", _COVERAGE)
def q_check_org_coverage(spark, sf_dir):
    """V5 (J3: left join staging → goals)."""
    return _checked_a(spark, sf_dir, Q.check_org_coverage)


@register("org_intersection", _Q_BASE + """, c AS (SELECT
    (SELECT count(DISTINCT organization_id) FROM ev) AS raw_orgs,
    (SELECT count(DISTINCT organization_id) FROM stg) AS staging_orgs,
    (SELECT count(DISTINCT organization_id) FROM flags) AS goal_orgs,
    (SELECT count(*) FROM (SELECT organization_id FROM ev INTERSECT SELECT organization_id FROM stg
                           INTERSECT SELECT organization_id FROM flags)) AS common_orgs)
""" + check_rows([("raw_orgs", "raw_orgs", None, None), ("staging_orgs", "staging_orgs", "raw_orgs", None),
                  ("goal_orgs", "goal_orgs", "raw_orgs", None),
                  ("common_orgs", "common_orgs", "raw_orgs", None)], "c"))
def q_org_intersection(spark, sf_dir):
    """V6 (U1: three-way INTERSECT)."""
    return _checked_a(spark, sf_dir, Q.org_intersection)


@register("check_atomic_values", with_ctes(EV_A, STAGING_CTE) + check_rows([
    ("non_atomic_values", "count(*) FILTER (WHERE activity_name LIKE '%;%' OR activity_detail LIKE '%;%')",
     "0", None)], "stg"))
def q_check_atomic_values(spark, sf_dir):
    """V7 (F4)."""
    return _checked_a(spark, sf_dir, Q.check_atomic_values)


@register("check_flag_domain", A_BASE + check_rows([
    (f"goal_{n}", f"count(DISTINCT goal_{n})", "2", f"count(DISTINCT goal_{n}) <= 2") for n, _, _ in GOALS_A],
    "flags"))
def q_check_flag_domain(spark, sf_dir):
    """V8 (A3: several COUNT DISTINCT)."""
    return _checked_a(spark, sf_dir, lambda t: Q.check_flag_domain(t.table("goals"), ORDER_GOALS))


@register("check_constraints", _Q_BASE + """, act AS (SELECT organization_id FROM flags WHERE """ + _ALL_A
          + """), c AS (SELECT
    (SELECT count(*) - count(DISTINCT event_id) FROM stg) AS stg_dup,
    (SELECT count(*) FILTER (WHERE event_id IS NULL) FROM stg) AS stg_id_null,
    (SELECT count(*) FILTER (WHERE organization_id IS NULL) FROM stg) AS stg_org_null,
    (SELECT count(*) FILTER (WHERE "timestamp" IS NULL) FROM stg) AS stg_ts_null,
    (SELECT count(*) FILTER (WHERE first_activity_timestamp IS NULL) FROM stg) AS stg_first_null,
    (SELECT count(*) - count(DISTINCT organization_id) FROM flags) AS goal_dup,
    (SELECT count(*) FILTER (WHERE organization_id IS NULL) FROM flags) AS goal_org_null,
    (SELECT count(*) FILTER (WHERE """ + " OR ".join(f"goal_{n} IS NULL" for n, _, _ in GOALS_A)
          + """) FROM flags) AS goal_flag_null,
    (SELECT count(*) - count(DISTINCT organization_id) FROM act) AS act_dup,
    (SELECT count(*) FILTER (WHERE organization_id IS NULL) FROM act) AS act_org_null,
    (SELECT count(*) FROM flags WHERE organization_id NOT IN (SELECT organization_id FROM stg)) AS goal_orphans,
    (SELECT count(*) FROM act WHERE organization_id NOT IN (SELECT organization_id FROM flags)) AS act_orphans)
""" + check_rows([(n, c, "0", None) for n, c in [
    ("staging.id_duplicates", "stg_dup"), ("staging.id_nulls", "stg_id_null"),
    ("staging.organization_id_nulls", "stg_org_null"), ("staging.timestamp_nulls", "stg_ts_null"),
    ("staging.first_activity_timestamp_nulls", "stg_first_null"),
    ("goals.organization_id_duplicates", "goal_dup"), ("goals.organization_id_nulls", "goal_org_null"),
    ("goals.flag_nulls", "goal_flag_null"), ("activation.organization_id_duplicates", "act_dup"),
    ("activation.organization_id_nulls", "act_org_null"),
    ("goals.organizations_missing_in_staging", "goal_orphans"),
    ("activation.organizations_missing_in_goals", "act_orphans")]], "c"))
def q_check_constraints(spark, sf_dir):
    """V9: keys, NOT NULL and foreign keys checked (Spark enforces none of them)."""
    return _checked_a(spark, sf_dir, lambda t: Q.check_constraints(t, ORDER_GOALS))


@register("tables_not_empty", _Q_BASE + """, c AS (SELECT
    (SELECT count(*) FROM ev) AS r, (SELECT count(*) FROM stg) AS s, (SELECT count(*) FROM flags) AS g,
    (SELECT count(*) FROM flags WHERE """ + _ALL_A + """) AS a)
""" + check_rows([("raw_rows", "r", None, "r > 0"), ("staging_rows", "s", None, "s > 0"),
                  ("goals_rows", "g", None, "g > 0"), ("activation_rows", "a", None, "a > 0")], "c"))
def q_tables_not_empty(spark, sf_dir):
    """V10 (S5: list the tables of the build, count each)."""
    return _checked_a(spark, sf_dir, Q.tables_not_empty)


_TOTALS = _Q_BASE + """, per_org AS (
    SELECT organization_id, """ + ", ".join(
        f"CASE WHEN sum(CASE WHEN {p} THEN 1 ELSE 0 END) >= {k} THEN 1 ELSE 0 END AS r_{n}"
        for n, p, k in GOALS_A) + """
    FROM stg GROUP BY organization_id),
c AS (SELECT * FROM (SELECT """ + ", ".join(f"sum(r_{n}) AS r_{n}" for n, _, _ in GOALS_A) + """ FROM per_org)
      CROSS JOIN (SELECT """ + ", ".join(f"sum(goal_{n}) AS m_{n}" for n, _, _ in GOALS_A) + """ FROM flags))
""" + check_rows([(f"goal_{n}", f"r_{n}", f"m_{n}", None) for n, _, _ in GOALS_A], "c")


@register("check_goal_totals", _TOTALS)
def q_check_goal_totals(spark, sf_dir):
    """Goal totals recomputed from staging equal the goals mart."""
    return _checked_a(spark, sf_dir, lambda t: Q.check_goal_totals(t, ORDER_GOALS))


def _laid_out_a(spark, sf_dir):
    return built_by_org(spark, fixture_a(spark, sf_dir), ORDER_GOALS)


@register("org_coverage_laid_out", _COVERAGE)
def q_org_coverage_laid_out(spark, sf_dir):
    """V5 on tables bucketed by organization: the join has no shuffle below it."""
    return B.check_org_coverage(_laid_out_a(spark, sf_dir))


@register("goal_totals_laid_out", _TOTALS)
def q_goal_totals_laid_out(spark, sf_dir):
    """V11 on tables bucketed by organization."""
    return B.check_goal_totals(_laid_out_a(spark, sf_dir), ORDER_GOALS)


@register("activated_span_days_laid_out", _SPAN)
def q_activated_span_days_laid_out(spark, sf_dir):
    """M5 through J4 on tables bucketed by organization."""
    tables = _laid_out_a(spark, sf_dir)
    return B.activated_span_days(tables.table("events"), tables.table("activation"))


# --------------------------------------------------------------------------------------
# profiling
# --------------------------------------------------------------------------------------

@register("activity_name_counts", with_ctes(EV_A) + """
SELECT activity_name, count(*) AS count FROM ev WHERE activity_name IS NOT NULL GROUP BY activity_name""")
def q_activity_name_counts(spark, sf_dir):
    """value_counts of the activity name."""
    return P.value_counts(fixture_a(spark, sf_dir), NAME)


@register("activity_detail_counts", with_ctes(EV_A) + """
SELECT activity_detail, count(*) AS count FROM ev WHERE activity_detail IS NOT NULL GROUP BY activity_detail""")
def q_activity_detail_counts(spark, sf_dir):
    """value_counts of the activity detail."""
    return P.value_counts(fixture_a(spark, sf_dir), DETAIL)


def _describe_ts_sql(col: str) -> str:
    return f"""SELECT '{col}' AS column_name, 'count' AS stat, CAST(count(x) AS DOUBLE) AS value,
       CAST(NULL AS TIMESTAMP) AS value_ts FROM (SELECT epoch_us({col}) AS x FROM stg)
UNION ALL SELECT '{col}', 'mean', NULL, make_timestamp(CAST(sum(x) // count(x) AS BIGINT))
    FROM (SELECT epoch_us({col}) AS x FROM stg)
UNION ALL SELECT '{col}', 'min', NULL, min({col}) FROM stg
UNION ALL SELECT '{col}', 'max', NULL, max({col}) FROM stg
UNION ALL SELECT '{col}', CAST(CAST(p * 100 AS INTEGER) AS VARCHAR) || '%', NULL,
       make_timestamp(CAST(lo + floor(frac * (hi - lo)) AS BIGINT))
    FROM (SELECT p, min(x) FILTER (WHERE r = floor((n - 1) * p)) AS lo,
                 min(x) FILTER (WHERE r = ceil((n - 1) * p)) AS hi,
                 any_value((n - 1) * p - floor((n - 1) * p)) AS frac
          FROM (SELECT epoch_us({col}) AS x, row_number() OVER (ORDER BY epoch_us({col})) - 1 AS r,
                       count(*) OVER () AS n FROM stg WHERE {col} IS NOT NULL)
          CROSS JOIN (VALUES (0.25), (0.5), (0.75)) t(p)
          GROUP BY p)"""


_S = "time_since_first_activity"


@register("describe_events", with_ctes(EV_B, STAGING_CTE) + f"""
SELECT '{_S}' AS column_name, 'count' AS stat, CAST(count({_S}) AS DOUBLE) AS value, CAST(NULL AS TIMESTAMP) AS value_ts FROM stg
UNION ALL SELECT '{_S}', 'mean', round(avg({_S}), 6), NULL FROM stg
UNION ALL SELECT '{_S}', 'std', round(stddev_samp({_S}), 6), NULL FROM stg
UNION ALL SELECT '{_S}', 'min', CAST(min({_S}) AS DOUBLE), NULL FROM stg
UNION ALL SELECT '{_S}', 'max', CAST(max({_S}) AS DOUBLE), NULL FROM stg
UNION ALL SELECT '{_S}', '25%', round(quantile_cont({_S}, 0.25), 6), NULL FROM stg
UNION ALL SELECT '{_S}', '50%', round(quantile_cont({_S}, 0.5), 6), NULL FROM stg
UNION ALL SELECT '{_S}', '75%', round(quantile_cont({_S}, 0.75), 6), NULL FROM stg
UNION ALL {_describe_ts_sql('"timestamp"').replace("'\"timestamp\"'", "'timestamp'")}
UNION ALL {_describe_ts_sql('first_activity_timestamp')}""")
def q_describe_events(spark, sf_dir):
    """describe() of the staged events' numeric and datetime columns (fixture B)."""
    staged = stage(fixture_b(spark, sf_dir))
    return P.describe(staged, [TS, "first_activity_timestamp", _S])


@register("column_profile", with_ctes(EV_A, STAGING_CTE) + _union_rows([
    f"SELECT '{c}' AS column_name, count({q}) AS non_null, '{t}' AS dtype FROM stg" for c, q, t in [
        ("event_id", "event_id", "bigint"), ("organization_id", "organization_id", "string"),
        ("activity_name", "activity_name", "string"), ("activity_detail", "activity_detail", "string"),
        ("timestamp", '"timestamp"', "timestamp_ntz"),
        ("first_activity_timestamp", "first_activity_timestamp", "timestamp_ntz"),
        ("time_since_first_activity", "time_since_first_activity", "bigint")]]))
def q_column_profile(spark, sf_dir):
    """info() of the staged events."""
    return P.column_profile(stage(fixture_a(spark, sf_dir)))


@register("goal_correlation", A_BASE + _union_rows([
    f"""SELECT 'goal_{a}' AS col_a, 'goal_{b}' AS col_b,
       round(CASE WHEN isnan(corr(goal_{a}, goal_{b})) THEN NULL ELSE corr(goal_{a}, goal_{b}) END, 6) AS corr
FROM flags""" for a, _, _ in GOALS_A for b, _, _ in GOALS_A]))
def q_goal_correlation(spark, sf_dir):
    """Correlation matrix of the goal flags."""
    flags = G.goal_flags(_profile_a(spark, sf_dir), ORDER_GOALS)
    return P.correlation_matrix(flags, [g.column for g in ORDER_GOALS])


# --------------------------------------------------------------------------------------
# survival
# --------------------------------------------------------------------------------------

_SURV_BASE = with_ctes(EV_A, _TTG_PROFILE_A) + """,
sizes AS (SELECT goal, count(*) AS n_total FROM ttg GROUP BY goal),
per_t AS (SELECT goal, days AS t, count(*) AS removed FROM ttg GROUP BY goal, days
          UNION ALL SELECT goal, 0.0, 0 FROM sizes),
tab AS (SELECT goal, t, CAST(sum(removed) AS BIGINT) AS removed FROM per_t GROUP BY goal, t),
et AS (SELECT goal, t, removed, removed AS observed, CAST(0 AS BIGINT) AS censored,
              CAST(CASE WHEN t = 0 THEN n_total ELSE 0 END AS BIGINT) AS entrance,
              CAST(n_total - coalesce(sum(removed) OVER (PARTITION BY goal ORDER BY t
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_risk,
              CAST(n_total - sum(removed) OVER (PARTITION BY goal ORDER BY t
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / n_total AS survival
       FROM tab JOIN sizes USING (goal))
"""


def _durations_a(spark, sf_dir):
    return J.time_to_goal(fixture_a(spark, sf_dir), ORDER_GOALS)


@register("survival_event_table", _SURV_BASE + """
SELECT goal, round(t, 6) AS t, removed, observed, censored, entrance, at_risk FROM et""")
def q_survival_event_table(spark, sf_dir):
    """K1: event table of time-to-goal durations (all observed, as in the reference)."""
    return S.event_table(_durations_a(spark, sf_dir), "goal", "days")


@register("survival_curve", _SURV_BASE + """
SELECT goal, round(t, 6) AS t, round(survival, 6) AS survival FROM et""")
def q_survival_curve(spark, sf_dir):
    """K2: Kaplan–Meier curve per goal (oracle: 1 - cumulative share, exact without censoring)."""
    return S.km_curve(_durations_a(spark, sf_dir), "goal", "days")


@register("survival_band", _SURV_BASE + f""", gw AS (
    SELECT *, sum(CASE WHEN observed < at_risk
                       THEN observed / (CAST(at_risk AS DOUBLE) * (at_risk - observed)) ELSE 0.0 END)
              OVER (PARTITION BY goal ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM et)
SELECT goal, round(t, 6) AS t, round(survival, 6) AS survival,
       round(CASE WHEN survival > 0 AND survival < 1
                  THEN exp(-exp(ln(-ln(survival)) - {Z_95} * sqrt(v) / ln(survival))) END, 6) AS lower,
       round(CASE WHEN survival > 0 AND survival < 1
                  THEN exp(-exp(ln(-ln(survival)) + {Z_95} * sqrt(v) / ln(survival))) END, 6) AS upper
FROM gw""")
def q_survival_band(spark, sf_dir):
    """K3: 95 % exponential-Greenwood band around the curve."""
    return S.km_band(_durations_a(spark, sf_dir), "goal", "days")


# --------------------------------------------------------------------------------------
# features and classifier (fixture B)
# --------------------------------------------------------------------------------------

_TF_CTE = """tf AS (
    SELECT organization_id,
           avg(isodow("timestamp") - 1) AS day_of_week_mean,
           stddev_samp(isodow("timestamp") - 1) AS day_of_week_std,
           avg(hour("timestamp")) AS hour_of_day_mean,
           stddev_samp(hour("timestamp")) AS hour_of_day_std,
           min("timestamp") AS start_time, max("timestamp") AS end_time,
           date_sub('microsecond', min("timestamp"), max("timestamp")) / 86400e6 AS trial_duration
    FROM ev GROUP BY organization_id)"""
_B_GOAL_COLS = ", ".join(f"goal_{n}" for n, _, _ in GOALS_B)
_B_FEATURES = [f"goal_{n}" for n, _, _ in GOALS_B[1:]] + [
    "day_of_week_mean", "day_of_week_std", "hour_of_day_mean", "hour_of_day_std", "start_time", "end_time",
    "trial_duration"]
_MATRIX_B = with_ctes(EV_B, profile_cte(GOALS_B), flags_cte(GOALS_B), _TF_CTE) + """,
feat AS (SELECT * FROM flags JOIN tf USING (organization_id)),
mat AS (SELECT organization_id, goal_signup AS label, """ + ", ".join(
    f"epoch_us({c}) / 1e6 AS {c}" if c in ("start_time", "end_time") else c for c in _B_FEATURES) + """ FROM feat),
spl AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(organization_id || '-42'), 1, 8)) AS BIGINT) % 100 < 20
                       THEN 'test' ELSE 'train' END AS split FROM mat)
"""


def _round_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("goal_") else c for c in cols)


@register("org_time_features", with_ctes(EV_B, _TF_CTE) + """
SELECT organization_id, round(day_of_week_mean, 6) AS day_of_week_mean, round(day_of_week_std, 6) AS day_of_week_std,
       round(hour_of_day_mean, 6) AS hour_of_day_mean, round(hour_of_day_std, 6) AS hour_of_day_std,
       start_time, end_time, round(trial_duration, 6) AS trial_duration FROM tf""")
def q_org_time_features(spark, sf_dir):
    """L1: weekday / hour statistics and trial duration per organization."""
    return F_.org_time_features(fixture_b(spark, sf_dir))


@register("org_features", _MATRIX_B + f"""
SELECT organization_id, {_B_GOAL_COLS}, round(day_of_week_mean, 6) AS day_of_week_mean,
       round(day_of_week_std, 6) AS day_of_week_std, round(hour_of_day_mean, 6) AS hour_of_day_mean,
       round(hour_of_day_std, 6) AS hour_of_day_std, start_time, end_time,
       round(trial_duration, 6) AS trial_duration FROM feat""")
def q_org_features(spark, sf_dir):
    """L2: goal flags joined with time features (one aggregation in Spark)."""
    return F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)


@register("org_feature_matrix", _MATRIX_B + f"SELECT organization_id, label, {_round_sql(_B_FEATURES)} FROM mat")
def q_org_feature_matrix(spark, sf_dir):
    """L3: numeric feature matrix and label (target: the first goal)."""
    feats = F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)
    return F_.feature_matrix(feats, STREAM_GOALS[0].column)


def _split_b(spark, sf_dir):
    feats = F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)
    return F_.train_test_split(F_.feature_matrix(feats, STREAM_GOALS[0].column))


@register("train_test_split", _MATRIX_B + f"SELECT organization_id, label, {_round_sql(_B_FEATURES)}, split FROM spl")
def q_train_test_split(spark, sf_dir):
    """L4: deterministic 20 % hash split (md5 of organization id and seed 42)."""
    return _split_b(spark, sf_dir)


@register("train_test_split_exact", _MATRIX_B + """
SELECT organization_id, label, CASE WHEN row_number() OVER (
           ORDER BY CAST(('0x' || substr(md5(organization_id || '-42'), 1, 15)) AS BIGINT), organization_id)
           <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM mat""")
def q_train_test_split_exact(spark, sf_dir):
    """L4: exactly ceil(20 %) of the organizations as test rows."""
    feats = F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)
    matrix = F_.feature_matrix(feats, STREAM_GOALS[0].column).select(ORG, F_.LABEL)
    return F_.exact_split(matrix)


_STATS_B = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _B_FEATURES)


@register("standardized_features", _MATRIX_B + f""",
st AS (SELECT {_STATS_B} FROM spl WHERE split = 'train')
SELECT organization_id, split, label, """ + ", ".join(
    f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 6) AS {c}" for c in _B_FEATURES)
          + " FROM spl CROSS JOIN st")
def q_standardized_features(spark, sf_dir):
    """Standardised with train-row mean and population std."""
    return F_.standardize(_split_b(spark, sf_dir))


@register("feature_correlation", _MATRIX_B + _union_rows([
    f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
       round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS corr FROM mat"""
    for a in _B_FEATURES for b in _B_FEATURES]))
def q_feature_correlation(spark, sf_dir):
    """Correlation matrix of the numeric features, epoch seconds among them (fixture B)."""
    feats = F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)
    matrix = F_.feature_matrix(feats, STREAM_GOALS[0].column)
    return P.correlation_matrix(matrix, F_.feature_columns(matrix))


@register("threshold_predictions", with_ctes(EV_B, _TF_CTE) + """
SELECT organization_id, round(hour_of_day_mean / 23.0, 6) AS probability,
       CASE WHEN hour_of_day_mean / 23.0 > 0.5 THEN 1 ELSE 0 END AS prediction FROM tf""")
def q_threshold_predictions(spark, sf_dir):
    """the classifier's strict threshold on a deterministic score (mean hour of day / 23)."""
    scored = F_.org_time_features(fixture_b(spark, sf_dir)).select(
        ORG, (F.col("hour_of_day_mean") / 23.0).alias(C.PROBABILITY))
    return C.predict(scored)


@register("goal_classifier")
def q_goal_classifier(spark, sf_dir):
    """Logistic regression on the train rows, probabilities and predictions on the
    test rows (no oracle: a fitted model)."""
    return C.train_and_predict(F_.standardize(_split_b(spark, sf_dir)))


@register("goal_recurrent_classifier")
def q_goal_recurrent_classifier(spark, sf_dir):
    """The two-layer recurrent network, 50 epochs on the train rows, predictions on the test rows."""
    feats = F_.org_features(fixture_b(spark, sf_dir), STREAM_GOALS)
    scaled = materialize(F_.standardize(F_.exact_split(F_.feature_matrix(feats, STREAM_GOALS[0].column))), "recurrent-rows")
    return materialize(recurrent_predictions(scaled, fit_recurrent(scaled)), "recurrent-predictions")


@register("goal_classifier_report")
def q_goal_classifier_report(spark, sf_dir):
    """L8 on the fitted classifier's test predictions (rows only)."""
    return C.classification_report(C.train_and_predict(F_.standardize(_split_b(spark, sf_dir))))


@register("classification_report", _MATRIX_B + """,
base AS (SELECT s.label AS y, f.goal_click AS p FROM spl s JOIN flags f USING (organization_id)
         WHERE s.split = 'test'),
classes AS (SELECT y AS c FROM base UNION SELECT p FROM base),
per AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y = c) AS support,
               count(*) FILTER (WHERE p = c) AS predicted
        FROM classes CROSS JOIN base GROUP BY c),
m AS (SELECT c, coalesce(CAST(tp AS DOUBLE) / nullif(predicted, 0), 0.0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
             coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1, support, tp FROM per)
SELECT CAST(c AS VARCHAR) AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(support), 0), 0.0), 6),
       CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM m""")
def q_classification_report(spark, sf_dir):
    """L8 with a deterministic predictor (the click goal's flag predicts the signup goal on
    the test organizations), so the report arithmetic has an oracle."""
    split = _split_b(spark, sf_dir).filter(F.col("split") == "test")
    preds = split.select(F.col("label"), F.col("goal_click").alias("prediction"))
    return C.classification_report(preds)
