"""Interactive and failure analyses."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import ACT, FAILED, JOBS, act, lab, query
from tidewatch.functions.labels import analysis_labels, is_failed
from tidewatch.operators import analysis as N
from tidewatch.sources.adapters import ITEM_TYPES, activities as A, jobs as J, table


def L(s, d):
    return analysis_labels(A(s, d).filter(is_failed()))


OK = "count(*) FILTER (WHERE status='Succeeded')"


@query("overview", act("""SELECT count(*) AS total_activities, count(DISTINCT workspace_name) AS unique_workspaces, count(DISTINCT item_name) AS unique_items,
 count(DISTINCT item_type) AS unique_item_types, count(DISTINCT activity_type) AS unique_activity_types, count(DISTINCT submitted_by) AS unique_users,
 count(*) FILTER (WHERE duration_seconds > 0) AS with_duration, avg(duration_seconds) FILTER (WHERE duration_seconds > 0) AS avg_duration,
 max(duration_seconds) FILTER (WHERE duration_seconds > 0) AS max_duration, min(duration_seconds) FILTER (WHERE duration_seconds > 0) AS min_duration FROM act"""))
def _(s, d):
    return N.overview(A(s, d))


@query("status_breakdown", act("SELECT status, count(*) AS activity_count, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM act)*100 AS share_percent FROM act GROUP BY 1"))
def _(s, d):
    return N.status_breakdown(A(s, d))


@query("workspace_activity", act("""SELECT workspace_name, count(*) AS activity_count, count(DISTINCT item_name) AS unique_items,
 count(DISTINCT activity_type) AS unique_activity_types, count(DISTINCT submitted_by) AS unique_users FROM act GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(s, d):
    return N.workspace_activity(A(s, d))


for _name, _cols, _k in (("workspace", ["workspace_name"], 20), ("activity_type", ["activity_type"], 10), ("item", ["item_name", "item_type"], 15)):
    _c = ", ".join(_cols)

    @query(f"failures_by_{_name}", act(f"SELECT {_c}, count(*) AS failure_count FROM act WHERE status='Failed' GROUP BY {_c} ORDER BY failure_count DESC, {_c} LIMIT {_k}"))
    def _(s, d, cols=_cols, k=_k):
        return N.failures_by(A(s, d), cols, k)


@query("user_activity", act(f"SELECT submitted_by, count(*) AS activity_count, {FAILED} AS failures, {OK} AS successes FROM act WHERE submitted_by IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def _(s, d):
    return N.user_activity(A(s, d))


@query("users_with_most_failures", act(f"SELECT submitted_by, count(*) AS activity_count, {FAILED} AS failures, {OK} AS successes FROM act WHERE submitted_by IS NOT NULL GROUP BY 1 HAVING {FAILED} > 0 ORDER BY 3 DESC, 1 LIMIT 10"))
def _(s, d):
    return N.user_activity(A(s, d), 10, "failures")


@query("failure_reasons", act("""SELECT failure_reason, count(*) AS failure_count,
 CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM act WHERE status='Failed' AND failure_reason IS NOT NULL)*100 AS share_percent
 FROM act WHERE status='Failed' AND failure_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""))
def _(s, d):
    return N.failure_reasons(A(s, d))


@query("recent_days", act(f"SELECT CAST(start_time AS DATE) AS date, count(*) AS activity_count, {FAILED} AS failures, {OK} AS successes FROM act GROUP BY 1 ORDER BY 1 DESC LIMIT 15"))
def _(s, d):
    return N.time_duration(A(s, d))["by_date"]


@query("duration_by_status", act("""SELECT status, count(*) AS activity_count, avg(duration_seconds) AS avg_duration, max(duration_seconds) AS max_duration,
 min(duration_seconds) AS min_duration FROM act WHERE duration_seconds > 0 GROUP BY 1"""))
def _(s, d):
    return N.time_duration(A(s, d))["by_status"]


@query("longest_activities", act("SELECT event_id, workspace_name, item_name, item_type, status, duration_seconds FROM act WHERE duration_seconds > 0 ORDER BY duration_seconds DESC, event_id LIMIT 10"))
def _(s, d):
    return N.time_duration(A(s, d))["longest"]


_MIN = "CAST(date_diff('microsecond', job_start_time, job_end_time) AS DOUBLE)/60000000"


@query("job_summary", f"""WITH {JOBS} SELECT count(*) AS total_runs, count(*) FILTER (WHERE job_status='Failed') AS failed_runs,
 CAST(count(*) FILTER (WHERE job_status<>'Failed') AS DOUBLE)/count(*)*100 AS success_percent,
 round(avg({_MIN}), 6) AS avg_minutes, max({_MIN}) AS max_minutes FROM jobs""")
def _(s, d):
    return N.job_analysis(J(s, d))["summary"].withColumn("avg_minutes", F.round("avg_minutes", 6))


@query("job_failing_items", f"WITH {JOBS} SELECT item_id, count(*) AS failure_count FROM jobs WHERE job_status='Failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return N.job_analysis(J(s, d))["top_items"]


@query("job_failure_reasons", f"WITH {JOBS} SELECT job_failure_reason, count(*) AS failure_count FROM jobs WHERE job_status='Failed' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return N.job_analysis(J(s, d))["top_reasons"]


KPI = f"""count(*) AS total_activities, {FAILED} AS failed_activities, CAST(count(*)-{FAILED} AS DOUBLE)/count(*)*100 AS success_rate,
 avg(duration_seconds)/60 AS avg_duration_minutes, sum(duration_seconds)/3600 AS total_duration_hours"""


@query("workspace_summary", act(f"""SELECT workspace_id, workspace_name, {KPI}, count(DISTINCT submitted_by) AS unique_users, count(DISTINCT item_id) AS unique_items,
 min(start_time) AS first_activity, max(start_time) AS last_activity FROM act GROUP BY 1,2"""))
def _(s, d):
    return N.workspace_summary(A(s, d))


@query("user_summary", act(f""", fav AS (SELECT submitted_by, first(item_type ORDER BY n DESC, item_type) AS most_used_item_type FROM
 (SELECT submitted_by, item_type, count(*) AS n FROM act GROUP BY 1,2) GROUP BY 1)
 SELECT b.*, most_used_item_type FROM (SELECT submitted_by, {KPI}, count(DISTINCT workspace_id) AS unique_workspaces, count(DISTINCT item_id) AS unique_items FROM act GROUP BY 1) b
 LEFT JOIN fav ON b.submitted_by IS NOT DISTINCT FROM fav.submitted_by"""))
def _(s, d):
    return N.user_summary(A(s, d))


@query("item_type_performance", act(f"""SELECT item_type, activity_type, {KPI}, max(duration_seconds) AS max_duration, quantile_cont(duration_seconds, 0.5) AS p50_duration,
 round(quantile_cont(duration_seconds, 0.95), 6) AS p95_duration FROM act GROUP BY 1,2"""))
def _(s, d):
    df = N.item_type_performance(A(s, d))
    return df.withColumn("p95_duration", F.round("p95_duration", 6))


_ipt = ", ".join(f"""count(*) FILTER (WHERE item_type='{t}') AS "{t}\"""" for t in ITEM_TYPES)


@query("hourly_pivot", act(f"SELECT CAST(hour(start_time) AS INTEGER) AS hour, {_ipt} FROM act GROUP BY 1"))
def _(s, d):
    return N.hourly_pivot(A(s, d), ITEM_TYPES)


@query("error_distribution", act("""SELECT error_code, error_message, count(*) AS occurrence_count, count(DISTINCT workspace_id) AS affected_workspaces,
 count(DISTINCT item_id) AS affected_items, min(start_time) AS first_occurrence, max(start_time) AS last_occurrence FROM act WHERE status='Failed' GROUP BY 1,2"""))
def _(s, d):
    return N.error_distribution(A(s, d))


@query("custom_report", act(f"SELECT domain, invoke_type, count(*) AS runs, sum(duration_seconds) AS seconds, max(start_time) AS newest FROM act GROUP BY 1,2"))
def _(s, d):
    return N.custom_report(A(s, d), ["domain", "invoke_type"], {"runs": F.count(F.lit(1)), "seconds": F.sum("duration_seconds"), "newest": F.max("start_time")})


@query("failure_stats_summary", lab("SELECT count(*) AS total_failures, count(DISTINCT workspace) AS unique_workspaces, count(DISTINCT item_name) AS unique_items FROM lab"))
def _(s, d):
    return N.failure_stats(L(s, d))["summary"]


@query("failure_stats_items", lab("SELECT workspace, item_name, item_type, count(*) AS failure_count FROM lab GROUP BY 1,2,3 ORDER BY 4 DESC,1,2,3 LIMIT 10"))
def _(s, d):
    return N.failure_stats(L(s, d))["top_items"]


@query("failure_stats_users", lab("SELECT user_name, count(*) AS failure_count FROM lab WHERE user_name IS NOT NULL GROUP BY 1"))
def _(s, d):
    return N.failure_stats(L(s, d))["by_user"]


@query("failure_stats_messages", lab("SELECT error_message, count(*) AS failure_count FROM lab GROUP BY 1"))
def _(s, d):
    return N.failure_stats(L(s, d))["by_message"]


@query("newest_failures", lab("SELECT event_id, start_time, workspace, item_name, user_name, error_message FROM lab ORDER BY start_time DESC, event_id LIMIT 20"))
def _(s, d):
    return N.failure_stats(L(s, d))["newest"]


for _name, _probs in (("percentiles", N.PERCENTILES), ("deciles", N.DECILES)):
    _u = " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(duration_seconds, {p}), 6) AS quantile FROM lab WHERE duration_seconds > 0" for p in _probs)

    @query(f"duration_{_name}", lab(_u))
    def _(s, d, probs=_probs):
        return N.duration_percentiles(L(s, d), probs).withColumn("quantile", F.round("quantile", 6))


@query("duration_statistics", lab("""SELECT count(*) AS with_duration, avg(duration_seconds) AS mean, min(duration_seconds) AS min, max(duration_seconds) AS max,
 count(*) FILTER (WHERE duration_seconds <= 30) AS quick_count, count(*) FILTER (WHERE duration_seconds >= 300) AS long_count,
 quantile_cont(duration_seconds, 0.5) AS median FROM lab WHERE duration_seconds > 0"""))
def _(s, d):
    return N.duration_statistics(L(s, d))


@query("longest_failures", lab("SELECT event_id, workspace, item_name, item_type, duration_seconds FROM lab WHERE duration_seconds > 0 ORDER BY duration_seconds DESC, event_id LIMIT 10"))
def _(s, d):
    return N.longest(L(s, d))


_hours = ", ".join(f"""count(*) FILTER (WHERE hour(start_time)={h}) AS "{h}\"""" for h in range(24))


@query("heatmap_date_hour", lab(f"SELECT CAST(start_time AS DATE) AS date, {_hours} FROM lab GROUP BY 1"))
def _(s, d):
    df = L(s, d).withColumns({"date": F.to_date("start_time"), "hour": F.hour("start_time")})
    return N.heatmap(df, ["date"], "hour", range(24))


@query("heatmap_workspace_type", lab(f"SELECT workspace, {_ipt} FROM lab GROUP BY 1"))
def _(s, d):
    return N.heatmap(L(s, d), ["workspace"], "item_type", ITEM_TYPES)


@query("heatmap_user_hour", lab(f"SELECT user_name, {_hours} FROM lab WHERE user_name IS NOT NULL GROUP BY 1"))
def _(s, d):
    return N.heatmap(L(s, d).withColumn("hour", F.hour("start_time")), ["user_name"], "hour", range(24))


@query("heatmap_error_type", lab(f"SELECT error_message, {_ipt} FROM lab GROUP BY 1"))
def _(s, d):
    return N.heatmap(L(s, d), ["error_message"], "item_type", ITEM_TYPES)


@query("mean_duration_by_type", lab("SELECT item_type, avg(duration_seconds) AS mean_duration FROM lab WHERE duration_seconds > 0 GROUP BY 1"))
def _(s, d):
    return N.mean_duration(L(s, d))


@query("failure_hierarchy", lab("""SELECT workspace, item_type, item_name, count(*) AS failures, CAST(grouping_id(workspace, item_type, item_name) AS INTEGER) AS level
 FROM lab GROUP BY ROLLUP (workspace, item_type, item_name)"""))
def _(s, d):
    return N.hierarchy_counts(L(s, d))


@query("top_error_timeline", lab(""", top AS (SELECT error_message FROM lab GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
 SELECT error_message, CAST(start_time AS DATE) AS date, count(*) AS failure_count FROM lab WHERE error_message IN (SELECT error_message FROM top) GROUP BY 1,2"""))
def _(s, d):
    return N.top_error_timeline(L(s, d))


_CATS = ["workspace", "item_name", "item_type", "error_message"]
_codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE AS {c}_code" for c in _CATS)
_corr = ", ".join(f"round(corr(duration_seconds, {c}_code), 6) AS {c}" for c in _CATS)


@query("factor_correlation", lab(f", e AS (SELECT *, {_codes} FROM lab WHERE duration_seconds IS NOT NULL) SELECT {_corr} FROM e"))
def _(s, d):
    return N.factor_correlation(L(s, d), _CATS).select(*[F.round(c, 6).alias(c) for c in _CATS])


@query("bipartite_weights", lab("SELECT workspace, item_type, count(*) AS weight FROM lab GROUP BY 1,2 HAVING count(*) > 1"))
def _(s, d):
    return N.bipartite_weights(L(s, d))


@query("error_cooccurrence", lab(""", seen AS (SELECT DISTINCT user_name, date_trunc('hour', start_time) AS w, error_message FROM lab WHERE user_name IS NOT NULL)
 SELECT a.error_message, b.error_message AS other_message, count(*) AS pair_count FROM seen a JOIN seen b USING (user_name, w)
 WHERE a.error_message < b.error_message GROUP BY 1,2 ORDER BY 3 DESC,1,2 LIMIT 10"""))
def _(s, d):
    return N.error_cooccurrence(L(s, d))


@query("executive_metrics", lab("""SELECT count(*) AS total_failures, count(DISTINCT workspace) AS unique_workspaces, count(DISTINCT user_name) AS unique_users,
 count(DISTINCT item_name) AS unique_items, CAST(date_diff('day', min(start_time), max(start_time)) + 1 AS INTEGER) AS analysis_period_days,
 CAST(count(*) AS DOUBLE)/(date_diff('day', min(start_time), max(start_time)) + 1) AS daily_avg_failures,
 CAST(count(*) FILTER (WHERE duration_seconds > 0) AS DOUBLE)/count(*)*100 AS duration_coverage,
 avg(duration_seconds) FILTER (WHERE duration_seconds > 0) AS avg_failure_duration, max(duration_seconds) FILTER (WHERE duration_seconds > 0) AS max_failure_duration,
 quantile_cont(duration_seconds, 0.5) FILTER (WHERE duration_seconds > 0) AS median_failure_duration FROM lab"""))
def _(s, d):
    return N.executive_metrics(L(s, d))


@query("duration_distribution", lab("""SELECT CASE WHEN duration_seconds <= 30 THEN '<30s' WHEN duration_seconds <= 300 THEN '30s-5m' WHEN duration_seconds <= 3600 THEN '5m-1h' ELSE '>1h' END AS bucket,
 count(*) AS failures FROM lab WHERE duration_seconds > 0 GROUP BY 1"""))
def _(s, d):
    return N.duration_distribution(L(s, d))


@query("user_impact", lab(""", u AS (SELECT user_name, count(*) AS n FROM lab WHERE user_name IS NOT NULL GROUP BY 1)
 SELECT CASE WHEN n = 1 THEN '1 failure' WHEN n <= 5 THEN '2-5 failures' WHEN n <= 10 THEN '6-10 failures' ELSE '>10 failures' END AS bucket, count(*) AS users FROM u GROUP BY 1"""))
def _(s, d):
    return N.user_impact(L(s, d))


@query("worst_performers", lab("""(SELECT workspace AS name, count(*) AS failures, 'worst_workspace' AS role FROM lab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
 UNION ALL (SELECT user_name, count(*), 'most_errors_user' FROM lab WHERE user_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
 UNION ALL (SELECT item_type, count(*), 'worst_item_type' FROM lab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""))
def _(s, d):
    return N.worst_performers(L(s, d))


@query("top_messages_with_share", lab("""SELECT error_message, count(*) AS failure_count, CAST(count(*) AS DOUBLE)/(SELECT count(*) FROM lab)*100 AS share_percent
 FROM lab GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""))
def _(s, d):
    return N.top_with_share(L(s, d), ["error_message"])


@query("distinct_executions", act("SELECT activity_type, count(*) AS events, count(DISTINCT coalesce(root_activity_id, event_id)) AS executions FROM act GROUP BY 1"))
def _(s, d):
    return N.distinct_executions(A(s, d), ["activity_type"])


@query("inventory_by_type", "SELECT p_brand AS workspace_id, p_type AS item_type, count(*) AS items FROM part GROUP BY 1,2")
def _(s, d):
    return N.inventory_by_type(table(s, d, "part").selectExpr("p_brand as workspace_id", "p_type as item_type"))


@query("inventory_health", f"""WITH {JOBS}, ran AS (SELECT item_id, max(job_start_time) AS last_run FROM jobs GROUP BY 1),
 f AS (SELECT count(*) AS total_items, count(last_run) AS items_with_jobs, count(*) FILTER (WHERE last_run >= TIMESTAMP '2024-01-25') AS items_with_recent_jobs
 FROM (SELECT DISTINCT 'item_'||p_partkey AS item_id FROM part) LEFT JOIN ran USING (item_id)),
 g AS (SELECT *, CAST((total_items > 0)::INT + (items_with_jobs > 0)::INT + (items_with_recent_jobs > 0)::INT AS INTEGER) AS health_score FROM f)
 SELECT *, health_score/3*100 AS health_percent FROM g""")
def _(s, d):
    import datetime

    items = table(s, d, "part").selectExpr("concat('item_', p_partkey) as item_id")
    return N.inventory_health(items, J(s, d), datetime.datetime(2024, 1, 25))



_HEALTH = f"""{JOBS}, ran AS (SELECT item_id, count(*) AS runs, count(*) FILTER (WHERE job_start_time >= TIMESTAMP '2024-01-25') AS recent FROM jobs GROUP BY 1),
 it AS (SELECT 'item_'||p_partkey AS item_id, p_brand AS workspace_id FROM part WHERE p_size > 2),
 f AS (SELECT w.workspace_id, w.workspace_id AS workspace_name, count(it.item_id) AS total_items, count(runs) AS monitorable_items, CAST(coalesce(sum(recent),0) AS BIGINT) AS recent_jobs
  FROM (SELECT DISTINCT p_brand AS workspace_id FROM part UNION SELECT DISTINCT p_type FROM part) w LEFT JOIN it USING (workspace_id) LEFT JOIN ran USING (item_id) GROUP BY 1),
 h AS (SELECT *, CAST(CASE WHEN total_items=0 THEN 0 WHEN monitorable_items=0 THEN 1 ELSE 2 END + (recent_jobs > 0)::INT AS INTEGER) AS health_score FROM f),
 hh AS (SELECT *, health_score/3*100 AS health_percent, CASE WHEN total_items=0 THEN 'no items' WHEN monitorable_items=0 THEN 'no items with jobs' END AS issue FROM h)"""


def _health(s, d):
    import datetime

    part = table(s, d, "part")
    spaces = part.selectExpr("p_brand as workspace_id").union(part.selectExpr("p_type")).distinct().withColumn("workspace_name", F.col("workspace_id"))
    items = part.filter("p_size > 2").selectExpr("concat('item_', p_partkey) as item_id", "p_brand as workspace_id")
    return N.workspace_health(spaces, items, J(s, d), datetime.datetime(2024, 1, 25))


@query("workspace_health", f"WITH {_HEALTH} SELECT * FROM hh")
def _(s, d):
    return _health(s, d)


@query("health_recommendations", f"""WITH {_HEALTH} SELECT 'activity' AS type, 'high' AS priority, count(*) AS affected, count(*) AS total FROM hh HAVING sum(recent_jobs)=0
 UNION ALL SELECT 'coverage', 'medium', CAST(sum(monitorable_items) AS BIGINT), CAST(sum(total_items) AS BIGINT) FROM hh HAVING sum(monitorable_items) < sum(total_items)*0.5
 UNION ALL SELECT 'health', 'medium', count(*) FILTER (WHERE health_percent < 50), count(*) FROM hh HAVING count(*) FILTER (WHERE health_percent < 50) > 0""")
def _(s, d):
    return N.health_recommendations(_health(s, d))


@query("duration_buckets", act("""SELECT CASE WHEN duration_seconds < 60 THEN '< 1 min' WHEN duration_seconds < 300 THEN '1-5 min' WHEN duration_seconds < 900 THEN '5-15 min'
 WHEN duration_seconds < 3600 THEN '15-60 min' ELSE '> 1 hour' END AS bucket, count(*) AS activity_count FROM act WHERE duration_seconds IS NOT NULL GROUP BY 1"""))
def _(s, d):
    from tidewatch.functions.labels import duration_bucket

    return A(s, d).filter("duration_seconds is not null").groupBy(duration_bucket("duration_seconds").alias("bucket")).agg(F.count(F.lit(1)).alias("activity_count"))
