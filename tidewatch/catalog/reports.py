"""Historical reports."""

from tidewatch.catalog.base import FAILED, act, query, r2
from tidewatch.operators import reports as R
from tidewatch.sources.adapters import activities as A


def rate(total="total_activities", failed="failed_activities"):
    return r2(f"(CAST({total} AS DOUBLE)-{failed})/{total}*100")


VOL = f"count(activity_id) AS total_activities, {FAILED} AS failed_activities, {r2('sum(duration_seconds)')} AS total_duration, {r2('avg(duration_seconds)')} AS avg_duration"


def volume(key, alias, where="true"):
    return f"(SELECT *, {rate()} AS success_rate FROM (SELECT {key} AS {alias}, {VOL} FROM act WHERE {where} GROUP BY 1))"


KM = f"""SELECT count(*) AS total_activities, {FAILED} AS failed_activities,
 {rate('count(*)', FAILED)} AS success_rate_percent, {r2('sum(duration_seconds)/3600')} AS total_duration_hours,
 {r2('avg(duration_seconds)')} AS average_duration_seconds FROM act"""


@query("key_measurables", act(KM))
def _(s, d):
    return R.key_measurables(A(s, d))


@query("measurables_long", act(f""", km AS ({KM}) SELECT m.metric, m.value, m.unit, '30 days' AS period FROM km,
 (SELECT unnest([1,2,3,4]) AS i) n, LATERAL (SELECT (['Total Activities','Failed Activities','Success Rate','Total Duration'])[i] AS metric,
 ([CAST(total_activities AS DOUBLE), CAST(failed_activities AS DOUBLE), success_rate_percent, total_duration_hours])[i] AS value,
 (['count','count','percentage','hours'])[i] AS unit) m"""))
def _(s, d):
    return R.measurables_long(A(s, d), 30)


_DIMS = [("time_date", "CAST(CAST(start_time AS DATE) AS VARCHAR)")] + [(c, c) for c in ("location", "domain", "submitted_by", "created_by", "last_updated_by", "item_type", "status")]
_STATS = " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {e} AS group_key, count(*) AS total_activities, {FAILED} AS failed_activities, {r2('sum(duration_seconds)')} AS total_duration_seconds, {r2('avg(duration_seconds)')} AS average_duration_seconds FROM act WHERE {e} IS NOT NULL GROUP BY 2"
    for n, e in _DIMS
)
STATS = f"SELECT *, {rate()} AS success_rate_percent, {r2('CAST(total_activities AS DOUBLE)/(SELECT count(*) FROM act)*100')} AS percentage_of_total FROM ({_STATS})"


@query("dimension_stats", act(STATS))
def _(s, d):
    return R.dimension_stats(A(s, d))


@query("dimension_summary", act(f""", st AS ({STATS}) SELECT dimension, count(*) AS total_groups,
 first(group_key ORDER BY total_activities DESC, group_key) AS most_active,
 first(group_key ORDER BY success_rate_percent, total_activities DESC, group_key) AS least_reliable FROM st GROUP BY 1"""))
def _(s, d):
    return R.dimension_summary(R.dimension_stats(A(s, d)))


DAILY = volume("CAST(start_time AS DATE)", "date")


@query("daily_trends", act(f"SELECT * FROM {DAILY}"))
def _(s, d):
    return R.daily_trends(A(s, d))


@query("weekly_trends", act(f"SELECT * FROM {volume('CAST(week(start_time) AS INTEGER)', 'week')}"))
def _(s, d):
    return R.weekly_trends(A(s, d))


@query("yearly_weekly_trends", act(f"""SELECT *, {rate()} AS success_rate FROM (SELECT CAST(isoyear(start_time) AS INTEGER) AS iso_year,
 CAST(week(start_time) AS INTEGER) AS week, {VOL} FROM act GROUP BY 1,2)"""))
def _(s, d):
    return R.weekly_trends(A(s, d), with_year=True)


@query("trend_summary", act(f"""SELECT first(date ORDER BY total_activities DESC, date) AS most_active_day, first(date ORDER BY success_rate, date) AS least_reliable_day,
 {r2('avg(total_activities)')} AS average_daily_activities, {r2('avg(success_rate)')} AS average_daily_success_rate FROM {DAILY}"""))
def _(s, d):
    return R.trend_summary(R.daily_trends(A(s, d)))


@query("daily_trend_report", act(f"""SELECT date, total_activities, failed_activities, success_rate AS success_rate_percent,
 total_duration AS total_duration_seconds, avg_duration AS average_duration_seconds FROM {DAILY}"""))
def _(s, d):
    return R.daily_trend_report(A(s, d))


HFI = f"""SELECT item_id, first(item_name ORDER BY start_time, event_id) AS item_name, first(item_type ORDER BY start_time, event_id) AS item_type,
 {r2(f"CAST({FAILED} AS DOUBLE)/count(status)*100")} AS failure_rate_percent, count(status) AS total_attempts,
 'Find out why these runs keep failing' AS recommendation FROM act WHERE item_id IS NOT NULL GROUP BY 1
 HAVING {r2(f"CAST({FAILED} AS DOUBLE)/count(status)*100")} > 20"""


@query("high_failure_items", act(HFI))
def _(s, d):
    return R.high_failure_items(A(s, d))


@query("high_activity_users", act(f"""SELECT submitted_by AS user, count(activity_id) AS total_activities, {r2('count(activity_id)/90')} AS daily_average
 FROM act WHERE submitted_by IS NOT NULL GROUP BY 1 HAVING count(activity_id) > 50"""))
def _(s, d):
    return R.high_activity_users(A(s, d))


PD = f"""SELECT domain, {r2(f"CAST({FAILED} AS DOUBLE)/count(status)*100")} AS failure_rate_percent, count(status) AS total_activities,
 {r2('avg(duration_seconds)')} AS average_duration FROM act WHERE domain IS NOT NULL GROUP BY 1
 HAVING {r2(f"CAST({FAILED} AS DOUBLE)/count(status)*100")} > 20"""


@query("problem_domains", act(PD))
def _(s, d):
    return R.problem_domains(A(s, d))


@query("failures_by_type", act("SELECT item_type, count(*) AS failure_count FROM act WHERE status='Failed' GROUP BY 1"))
def _(s, d):
    return R.failure_breakdown(A(s, d))["by_type"]


TOPF = """SELECT item_id, item_name, item_type, count(*) AS failure_count FROM act WHERE status='Failed' AND item_id IS NOT NULL
 GROUP BY 1,2,3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10"""


@query("top_failing_items", act(TOPF))
def _(s, d):
    return R.failure_breakdown(A(s, d))["top_items"]


@query("failures_per_day", act("SELECT CAST(start_time AS DATE) AS date, count(*) AS failure_count FROM act WHERE status='Failed' GROUP BY 1"))
def _(s, d):
    return R.failure_breakdown(A(s, d))["by_day"]


@query("failure_analysis", act(f"SELECT *, CASE WHEN failure_count > 10 THEN 'High' WHEN failure_count > 5 THEN 'Medium' ELSE 'Low' END AS severity FROM ({TOPF})"))
def _(s, d):
    return R.failure_analysis(A(s, d))


USERS = volume("submitted_by", "\"user\"", "submitted_by IS NOT NULL")


@query("user_volume", act(f"SELECT * FROM {USERS}"))
def _(s, d):
    return R.user_volume(A(s, d))["all"]


TOPU = f"SELECT * FROM {USERS} ORDER BY total_activities DESC, \"user\" LIMIT 10"


@query("top_users_by_volume", act(TOPU))
def _(s, d):
    return R.user_volume(A(s, d))["top"]


@query("low_success_users", act(f"SELECT * FROM {USERS} WHERE success_rate < 80"))
def _(s, d):
    return R.user_volume(A(s, d))["low_success"]


@query("user_performance", act(f"""SELECT "user", total_activities, failed_activities, success_rate AS success_rate_percent, total_duration AS total_duration_seconds,
 avg_duration AS average_duration_seconds, {r2('total_activities/90')} AS daily_average_activities,
 CASE WHEN success_rate < 70 OR total_activities > 100 THEN 'High' WHEN success_rate < 85 OR total_activities > 50 THEN 'Medium' ELSE 'Low' END AS risk_level FROM ({TOPU})"""))
def _(s, d):
    return R.user_performance(A(s, d))


DOM = f"""(SELECT *, {r2('CAST(total_activities AS DOUBLE)/(SELECT count(*) FROM act)*100')} AS percentage_of_total FROM {volume('domain', 'domain', 'domain IS NOT NULL')} v
 JOIN (SELECT domain, {r2('stddev_samp(duration_seconds)')} AS duration_std FROM act GROUP BY 1) USING (domain))"""


@query("domain_summary", act(f"SELECT * FROM {DOM}"))
def _(s, d):
    return R.domain_summary(A(s, d))


@query("domain_comparison", act(f""", dm AS (SELECT * FROM {DOM})
 (SELECT 'best_performing' AS kind, domain, success_rate, total_activities FROM dm ORDER BY success_rate DESC, domain LIMIT 1)
 UNION ALL (SELECT 'worst_performing', domain, success_rate, total_activities FROM dm ORDER BY success_rate, domain LIMIT 1)"""))
def _(s, d):
    return R.domain_comparison(R.domain_summary(A(s, d)))


@query("domain_performance", act(f"""SELECT domain, total_activities, failed_activities, success_rate AS success_rate_percent, total_duration AS total_duration_seconds,
 avg_duration AS average_duration_seconds, percentage_of_total AS percentage_of_total_activities FROM {DOM}"""))
def _(s, d):
    return R.domain_performance(A(s, d))


@query("recommendations", act(f""", km AS ({KM}), iss AS (SELECT (SELECT count(*) FROM ({HFI})) + (SELECT count(*) FROM ({PD})) AS n),
 busy AS (SELECT count(*) AS n FROM ({TOPU}) WHERE total_activities > 50), weak AS (SELECT count(*) AS n FROM {DOM} WHERE success_rate < 80)
 SELECT 'reliability' AS category, 'high' AS priority, 'Too few runs succeed' AS title, CAST(success_rate_percent AS VARCHAR) AS evidence FROM km WHERE success_rate_percent < 85
 UNION ALL SELECT 'performance','medium','Items or domains fail too often', CAST(n AS VARCHAR) FROM iss WHERE n > 0
 UNION ALL SELECT 'capacity','medium','Users above the activity limit', CAST(n AS VARCHAR) FROM busy WHERE n > 0
 UNION ALL SELECT 'quality','high','Domains below the success target', CAST(n AS VARCHAR) FROM weak WHERE n > 0"""))
def _(s, d):
    a = A(s, d)
    return R.recommendations(R.key_measurables(a), R.high_failure_items(a), R.problem_domains(a), R.user_volume(a)["top"], R.domain_summary(a))


@query("activities_master", act("""SELECT event_id, activity_id, workspace_id, workspace_name, item_id, item_name, item_type, activity_type, status, invoke_type,
 start_time, end_time, CAST(start_time AS DATE) AS date, CAST(hour(start_time) AS INTEGER) AS hour, duration_seconds, duration_seconds/60 AS duration_minutes,
 submitted_by, created_by, last_updated_by, domain, location, object_url, failure_reason, error_message, error_code, root_activity_id FROM act"""))
def _(s, d):
    return R.activities_master(A(s, d))


@query("compute_analysis", act(f"""SELECT coalesce(submitted_by,'Unknown') AS "user", item_name, item_type, count(*) AS total_runs,
 count(*) FILTER (WHERE status='Succeeded') AS successful_runs, {FAILED} AS failed_runs, count(*) FILTER (WHERE duration_seconds IS NULL) AS unknown_runs,
 {r2(f'CAST({FAILED} AS DOUBLE)/count(*)*100', 1)} AS failure_rate_percent, coalesce({r2('avg(duration_seconds)', 1)}, 0.0) AS avg_duration_seconds,
 coalesce({r2('sum(duration_seconds)', 1)}, 0.0) AS total_duration_seconds, max(start_time) AS last_run_time
 FROM act WHERE item_type IN ('SparkJob','Notebook','DataPipeline','SparkJobDefinition','Lakehouse') GROUP BY 1,2,3"""))
def _(s, d):
    return R.compute_analysis(A(s, d))


@query("daily_export_summary", act(f""", raw AS (SELECT submitted_by AS UserId, workspace_id AS WorkspaceId, activity_type AS Activity, status AS Status, duration_seconds*1000 AS DurationMs FROM act)
 SELECT 'overall' AS summary_type, '2024-01-31' AS date, 'total_activities' AS metric, CAST(count(*) AS DOUBLE) AS value FROM raw
 UNION ALL SELECT 'overall','2024-01-31','unique_users', count(DISTINCT UserId) FROM raw
 UNION ALL SELECT 'overall','2024-01-31','unique_workspaces', count(DISTINCT WorkspaceId) FROM raw
 UNION ALL SELECT 'by_activity_type','2024-01-31','activity_'||Activity, count(*) FROM raw GROUP BY 3
 UNION ALL SELECT 'by_status','2024-01-31','status_'||Status, count(*) FROM raw GROUP BY 3
 UNION ALL SELECT 'duration_stats','2024-01-31','avg_duration_ms', {r2('avg(DurationMs)')} FROM raw
 UNION ALL SELECT 'duration_stats','2024-01-31','max_duration_ms', max(DurationMs) FROM raw"""))
def _(s, d):
    from pyspark.sql import functions as F

    raw = A(s, d).select(
        F.col("submitted_by").alias("UserId"), F.col("workspace_id").alias("WorkspaceId"), F.col("activity_type").alias("Activity"),
        F.col("status").alias("Status"), (F.col("duration_seconds") * 1000).alias("DurationMs"),
    )
    return R.daily_export_summary(raw, "2024-01-31")


@query("run_summary", act(f"""SELECT count(*) AS total_activities, {FAILED} AS failed_activities, {rate('count(*)', FAILED)} AS success_rate_percent,
 {r2('sum(duration_seconds)/3600')} AS total_duration_hours, count(DISTINCT workspace_id) AS unique_workspaces, count(DISTINCT submitted_by) AS unique_users,
 count(DISTINCT domain) AS unique_domains, count(DISTINCT item_type) AS unique_item_types, 30 AS analysis_period_days FROM act"""))
def _(s, d):
    return R.run_summary(A(s, d), 30)


_PLAT = "(item_type <> 'Custom' OR activity_type IN ('RunArtifact','ExecuteNotebook','ReadLakehouse'))"


@query("first_seen_workspaces", act(f"SELECT workspace_id AS id, first(workspace_name ORDER BY start_time, event_id) AS display_name FROM act WHERE workspace_id <> '' AND {_PLAT} GROUP BY 1"))
def _(s, d):
    return R.first_seen(A(s, d))["workspaces"]


@query("first_seen_items", act(f"SELECT item_id AS id, first(item_name ORDER BY start_time, event_id) AS display_name, first(item_type ORDER BY start_time, event_id) AS type FROM act WHERE item_id <> '' AND {_PLAT} GROUP BY 1"))
def _(s, d):
    return R.first_seen(A(s, d))["items"]
