"""Dimensions, facts and marts."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import ACT, FACT, act, fact, query, r2, sk
from tidewatch.operators import dimensions as D
from tidewatch.operators import facts as FA
from tidewatch.plans import marts as M
from tidewatch.sources.adapters import activities as A, table

DAY = "2024-02-01"


def X(s, d):
    return FA.fact_from_log(A(s, d))


def dims(s, d):
    return FA.build_dims(A(s, d), as_of=DAY)


_CAL = """SELECT date_sk, full_date, CAST(isodow(full_date) AS INTEGER) AS day_of_week, dayname(full_date) AS day_of_week_name,
 CAST(day(full_date) AS INTEGER) AS day_of_month, CAST(dayofyear(full_date) AS INTEGER) AS day_of_year, CAST(week(full_date) AS INTEGER) AS week_of_year,
 CAST(month(full_date) AS INTEGER) AS month_number, monthname(full_date) AS month_name, CAST(quarter(full_date) AS INTEGER) AS quarter, CAST(year(full_date) AS INTEGER) AS year,
 isodow(full_date) > 5 AS is_weekend, isodow(full_date) <= 5 AS is_weekday,
 CAST(CASE WHEN month(full_date) >= 7 THEN year(full_date)+1 ELSE year(full_date) END AS INTEGER) AS fiscal_year,
 CAST(CASE WHEN month(full_date) >= 7 THEN (month(full_date)-7)//3+1 ELSE (month(full_date)+5)//3+1 END AS INTEGER) AS fiscal_quarter FROM cal"""


@query("dim_date", f"""WITH cal AS (SELECT CAST(d AS DATE) AS full_date, CAST(strftime(d,'%Y%m%d') AS INTEGER) AS date_sk FROM
 (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d FROM orders)) {_CAL}""")
def _(s, d):
    return D.dim_date_for(table(s, d, "orders"), "o_orderdate")


_VER = f"true AS is_current, DATE '{DAY}' AS effective_from, CAST(NULL AS DATE) AS effective_to, 1 AS version"


@query("dim_workspace", fact(f"""SELECT w.*, 'Workspace' AS workspace_type, CAST(NULL AS VARCHAR) AS capacity_id, f.domain, f.location, {_VER} FROM dim_ws w JOIN
 (SELECT workspace_id, first(domain ORDER BY start_time, event_id) AS domain, first(location ORDER BY start_time, event_id) AS location FROM act WHERE workspace_id <> '' GROUP BY 1) f USING (workspace_id)"""))
def _(s, d):
    return D.dim_workspace(A(s, d), as_of=DAY)


@query("dim_item", fact(f"""SELECT i.*, f.workspace_id, f.workspace_name, CASE WHEN item_type='Custom' THEN 'Unknown' WHEN item_type IN ('Report','SemanticModel') THEN 'Power BI' ELSE 'Fabric' END AS platform,
 item_type NOT IN ('Custom','Report','SemanticModel') AS is_fabric_native, CAST(NULL AS VARCHAR) AS source_type, CAST(NULL AS VARCHAR) AS source_database,
 CAST(NULL AS VARCHAR) AS source_connection_id, {_VER} FROM dim_item i JOIN (SELECT item_id, r.w AS workspace_id, r.n AS workspace_name FROM
 (SELECT item_id, first(struct_pack(w := workspace_id, n := workspace_name) ORDER BY start_time, event_id) AS r FROM act WHERE item_id <> '' GROUP BY 1)) f USING (item_id)"""))
def _(s, d):
    return D.dim_item(A(s, d), as_of=DAY)


@query("dim_user", fact(f"""SELECT *, split_part(user_principal_name,'@',1) AS user_display_name, CAST(NULL AS VARCHAR) AS department, 'Low' AS risk_level,
 'Regular' AS activity_tier, {_VER} FROM dim_user"""))
def _(s, d):
    return D.dim_user(A(s, d), as_of=DAY)


@query("dim_item_with_lineage", f"""WITH last AS (SELECT p_partkey, max(l_suppkey) AS s FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
 SELECT 'p'||p_partkey AS item_id, CASE WHEN s IS NULL THEN 'OneLake' WHEN s % 2 = 0 THEN 'AdlsGen2' ELSE 'Snowflake' END AS source_type,
 CAST(NULL AS VARCHAR) AS source_database, CAST(NULL AS VARCHAR) AS source_connection_id FROM last""")
def _(s, d):
    from tidewatch.sources.adapters import lineage_records

    items = table(s, d, "part").selectExpr("concat('p', p_partkey) as item_id")
    return D.attach_lineage(items, lineage_records(s, d))


FACT_COLS = """event_id, activity_id, date_sk, time_sk, activity_date, workspace_sk, item_sk, user_sk, activity_type_sk, status_sk, CAST(NULL AS VARCHAR) AS job_instance_id,
 root_activity_id, invoke_type, duration_seconds, duration_seconds/60 AS duration_minutes, duration_seconds/3600 AS duration_hours, is_failed, is_success, is_long_running,
 record_count, 'activity_log' AS source_system"""


@query("fact_activity", fact(f"SELECT {FACT_COLS} FROM fact"))
def _(s, d):
    a = A(s, d)
    return FA.fact_activity(a, FA.stored(FA.build_dims(a, as_of=DAY)))


@query("fact_from_log", fact(f"SELECT {FACT_COLS} FROM fact"))
def _(s, d):
    return X(s, d)


DAILYF = f"""SELECT *, {r2('CAST(successful_activities AS DOUBLE)/total_activities*100')} AS success_rate, {r2('CAST(failed_activities AS DOUBLE)/total_activities*100')} AS failure_rate FROM
 (SELECT date_sk, workspace_sk, CAST(sum(record_count) AS BIGINT) AS total_activities, CAST(sum(is_success) AS BIGINT) AS successful_activities, CAST(sum(is_failed) AS BIGINT) AS failed_activities,
 sum(duration_seconds) AS total_duration_seconds, avg(duration_seconds) AS avg_duration_seconds, max(duration_seconds) AS max_duration_seconds, min(duration_seconds) AS min_duration_seconds,
 CAST(sum(is_long_running) AS BIGINT) AS long_running_count, count(DISTINCT user_sk) AS unique_users, count(DISTINCT item_sk) AS unique_items
 FROM fact WHERE workspace_sk IS NOT NULL GROUP BY 1,2)"""


@query("fact_daily_metrics", fact(DAILYF))
def _(s, d):
    return FA.daily_metrics(X(s, d))


@query("fact_user_metrics", fact(""", um AS (SELECT activity_date, date_sk, user_sk, CAST(sum(record_count) AS BIGINT) AS total_activities, CAST(sum(is_failed) AS BIGINT) AS failed_activities,
 sum(duration_seconds) AS total_duration_seconds, count(DISTINCT workspace_sk) AS unique_workspaces, count(DISTINCT item_sk) AS unique_items,
 count(DISTINCT activity_type_sk) AS unique_activity_types, CAST(sum(is_failed) AS DOUBLE)/sum(record_count)*100 AS failure_rate FROM fact WHERE user_sk IS NOT NULL GROUP BY 1,2,3)
 SELECT *, round(avg(total_activities) OVER w, 6) AS activities_avg, round(avg(failure_rate) OVER w, 6) AS risk_score FROM um
 WINDOW w AS (PARTITION BY user_sk ORDER BY activity_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""))
def _(s, d):
    df = FA.user_metrics(X(s, d))
    return df.withColumns({c: F.round(c, 6) for c in ("activities_avg", "risk_score")})


@query("key_completeness", fact("""SELECT 'workspace' AS dimension, count(*) AS fact_rows, count(*) FILTER (WHERE workspace_sk IS NULL) AS null_keys, CAST(0 AS BIGINT) AS orphan_rows FROM fact
 UNION ALL SELECT 'item', count(*), count(*) FILTER (WHERE item_sk IS NULL), 0 FROM fact UNION ALL SELECT 'user', count(*), count(*) FILTER (WHERE user_sk IS NULL), 0 FROM fact
 UNION ALL SELECT 'activity_type', count(*), 0, 0 FROM fact UNION ALL SELECT 'status', count(*), 0, 0 FROM fact"""))
def _(s, d):
    k = dims(s, d)
    return FA.key_completeness(
        X(s, d),
        {"workspace": (k.workspace, "workspace_sk"), "item": (k.item, "item_sk"), "user": (k.user, "user_sk"),
         "activity_type": (k.activity_type, "activity_type_sk"), "status": (k.status, "status_sk")},
    )


for _name, _sql in {
    "dim_user": "SELECT DISTINCT submitted_by FROM act",
    "dim_item": "SELECT DISTINCT item_id, item_name, item_type, workspace_name FROM act",
    "dim_workspace": "SELECT DISTINCT workspace_id, workspace_name, domain, location FROM act",
}.items():

    @query(f"semantic_{_name}", act(_sql))
    def _(s, d, name=_name):
        from tidewatch.operators.reports import activities_master

        return FA.semantic_views(activities_master(A(s, d), ordered=False))[name]


@query("semantic_dim_date", f"WITH {ACT}, {FACT}, cal AS (SELECT * FROM days) {_CAL}")
def _(s, d):
    from tidewatch.operators.reports import activities_master

    return FA.semantic_views(activities_master(A(s, d), ordered=False))["dim_date"]


# ---- marts -------------------------------------------------------------------------
_AGG = "CAST(sum(record_count) AS BIGINT) AS activity_count"
_FL = "CAST(sum(is_failed) AS BIGINT) AS failed"
_U, _I, _W = "count(DISTINCT user_sk) AS unique_users", "count(DISTINCT item_sk) AS unique_items", "count(DISTINCT workspace_sk) AS unique_workspaces"
_D = "sum(duration_seconds) AS total_duration"
_FR = r2("CAST(failed AS DOUBLE)/activity_count*100") + " AS failure_rate"
_HR = r2("total_duration/3600") + " AS duration_hrs"


@query("top_workspaces", fact(f"""SELECT t.*, workspace_name, environment, {_HR}, {_FR} FROM (SELECT workspace_sk, {_AGG}, {_U}, {_D}, {_FL} FROM fact WHERE workspace_sk IS NOT NULL
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t LEFT JOIN dim_ws USING (workspace_sk)"""))
def _(s, d):
    return M.top_workspaces(X(s, d), dims(s, d))


TYPES = f"""(SELECT *, {r2('100*(1-CAST(failed AS DOUBLE)/activity_count)')} AS success_rate FROM (SELECT activity_type_sk, {_AGG}, {_FL} FROM fact GROUP BY 1) JOIN dim_type USING (activity_type_sk))"""


@query("activity_types_top", fact(f"SELECT * FROM {TYPES} ORDER BY activity_count DESC, activity_type_sk LIMIT 15"))
def _(s, d):
    return M.activity_types(X(s, d), dims(s, d))["top"]


@query("activity_types_with_failures", fact(f"SELECT * FROM {TYPES} WHERE failed > 0"))
def _(s, d):
    return M.activity_types(X(s, d), dims(s, d))["with_failures"]


@query("daily_trend_mart", fact(f""", dm AS ({DAILYF}) SELECT date_sk, CAST(sum(total_activities) AS BIGINT) AS total_activities, CAST(sum(unique_users) AS BIGINT) AS unique_users,
 CAST(sum(failed_activities) AS BIGINT) AS failed_activities, any_value(full_date) AS full_date, any_value(dayname(full_date)) AS day_of_week_name
 FROM dm JOIN days USING (date_sk) GROUP BY 1 ORDER BY full_date DESC LIMIT 14"""))
def _(s, d):
    a = A(s, d)
    return M.daily_trend(FA.daily_metrics(FA.fact_from_log(a)), D.dim_date_for(a))


@query("failure_totals", fact("SELECT count(*) AS total_activities, count(*) FILTER (WHERE is_failed=1) AS failed_activities, CAST(count(*) FILTER (WHERE is_failed=0) AS DOUBLE)/count(*)*100 AS success_rate FROM fact"))
def _(s, d):
    return M.failure_overview(X(s, d), dims(s, d))["totals"]


@query("failures_by_status", fact("SELECT status_sk, status_code, count(*) AS failures FROM fact JOIN dim_stat USING (status_sk) WHERE is_failed=1 GROUP BY 1,2"))
def _(s, d):
    return M.failure_overview(X(s, d), dims(s, d))["by_status"]


@query("failures_by_type_top", fact("SELECT activity_type_sk, activity_type, count(*) AS failures FROM fact JOIN dim_type USING (activity_type_sk) WHERE is_failed=1 GROUP BY 1,2 ORDER BY 3 DESC, 2 LIMIT 5"))
def _(s, d):
    return M.failure_overview(X(s, d), dims(s, d))["top_types"]


@query("top_items", fact(f"""SELECT t.*, item_name, item_type, item_category FROM (SELECT item_sk, {_AGG}, {_U}, {_D}, {_FL} FROM fact GROUP BY 1) t JOIN dim_item USING (item_sk)
 ORDER BY activity_count DESC, item_sk LIMIT 10"""))
def _(s, d):
    return M.top_items(X(s, d), dims(s, d))


@query("by_hour", fact("SELECT CAST(hour_24 AS INTEGER) AS hour_24, time_period, CAST(sum(record_count) AS BIGINT) AS total_activities FROM fact JOIN slots USING (time_sk) GROUP BY 1,2"))
def _(s, d):
    return M.by_hour(X(s, d), D.dim_time(s))


@query("top_users", fact(f"""SELECT t.*, user_principal_name, domain, user_type FROM (SELECT user_sk, {_AGG}, {_I}, {_W}, {_FL} FROM fact GROUP BY 1) t JOIN dim_user USING (user_sk)
 ORDER BY activity_count DESC, user_sk LIMIT 10"""))
def _(s, d):
    return M.top_users(X(s, d), dims(s, d))


@query("by_weekday", fact(f"""SELECT CAST(isodow(full_date) AS INTEGER) AS day_of_week, dayname(full_date) AS day_of_week_name, isodow(full_date) > 5 AS is_weekend,
 CAST(sum(activity_count) AS BIGINT) AS activity_count, avg(unique_users) AS unique_users, CAST(sum(failed) AS BIGINT) AS failed
 FROM (SELECT date_sk, {_AGG}, {_U}, {_FL} FROM fact GROUP BY 1) JOIN days USING (date_sk) GROUP BY 1,2,3"""))
def _(s, d):
    a = A(s, d)
    return M.by_weekday(FA.fact_from_log(a), D.dim_date_for(a))


@query("by_environment", fact(f"SELECT *, {_HR}, {_FR} FROM (SELECT environment, {_AGG}, {_U}, {_I}, {_W}, {_D}, {_FL} FROM fact JOIN dim_ws USING (workspace_sk) GROUP BY 1)"))
def _(s, d):
    return M.by_environment(X(s, d), dims(s, d))


@query("by_category", fact(f"SELECT *, {_FR} FROM (SELECT item_category, {_AGG}, {_I}, {_U}, {_FL} FROM fact JOIN dim_item USING (item_sk) GROUP BY 1)"))
def _(s, d):
    return M.by_category(X(s, d), dims(s, d))


@query("long_running", fact("""SELECT f.*, item_name, item_type, workspace_name FROM (SELECT event_id, item_sk, workspace_sk, duration_seconds FROM fact WHERE is_long_running=1
 ORDER BY duration_seconds DESC, event_id LIMIT 10) f LEFT JOIN dim_item USING (item_sk) LEFT JOIN dim_ws USING (workspace_sk)""").replace("f.*, item_name, item_type, workspace_name", "f.event_id, f.item_sk, f.workspace_sk, f.duration_seconds, item_name, item_type, workspace_name"))
def _(s, d):
    return M.long_running(X(s, d), dims(s, d))


@query("collaboration", fact(f"""SELECT *, {r2('CAST(activity_count AS DOUBLE)/unique_users', 1)} AS activities_per_user FROM (SELECT workspace_sk, workspace_name, environment, {_U}, {_I}, {_AGG}
 FROM fact JOIN dim_ws USING (workspace_sk) GROUP BY 1,2,3 ORDER BY unique_users DESC, workspace_sk LIMIT 10)"""))
def _(s, d):
    return M.collaboration(X(s, d), dims(s, d))


@query("monthly", fact(f"""SELECT *, {_FR} FROM (SELECT CAST(year(full_date) AS INTEGER) AS year, CAST(month(full_date) AS INTEGER) AS month_number, monthname(full_date) AS month_name,
 {_AGG}, {_U}, {_I}, {_FL} FROM fact JOIN days USING (date_sk) GROUP BY 1,2,3 ORDER BY 1 DESC, 2 DESC LIMIT 12)"""))
def _(s, d):
    a = A(s, d)
    return M.monthly(FA.fact_from_log(a), D.dim_date_for(a))


def views(s, d):
    a = A(s, d)
    M.register_views(FA.fact_from_log(a), FA.build_dims(a, as_of=DAY), D.dim_date_for(a), D.dim_time(s), replace=True)


@query("failure_rate_sql", fact("""SELECT workspace_name, CAST(sum(is_failed) AS BIGINT) AS failures, CAST(sum(record_count) AS BIGINT) AS total,
 CAST(sum(is_failed)*100.0::DOUBLE/sum(record_count) AS DOUBLE) AS failure_rate FROM fact JOIN dim_ws USING (workspace_sk) WHERE activity_date >= DATE '2024-01-24' GROUP BY 1"""))
def _(s, d):
    views(s, d)
    return M.failure_rate_sql(s, "2024-01-31")


@query("longest_items_sql", fact("""SELECT item_name, item_type, workspace_name, sum(duration_seconds)/3600 AS total_hours, avg(duration_seconds)/60 AS avg_minutes
 FROM fact JOIN dim_item USING (item_sk) JOIN dim_ws USING (workspace_sk) GROUP BY 1,2,3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 10"""))
def _(s, d):
    views(s, d)
    return M.longest_items_sql(s)


@query("business_hours_sql", fact("SELECT time_period, is_business_hours, count(*) AS activity_count, CAST(sum(is_failed) AS BIGINT) AS failures FROM fact JOIN slots USING (time_sk) GROUP BY 1,2"))
def _(s, d):
    views(s, d)
    return M.business_hours_sql(s)


# A second, join-heavy fact: order lines under their orders.
@query("order_status_mart", """SELECT o_orderstatus AS status, c_mktsegment AS domain, n_name AS workspace_name, count(*) AS activity_count, count(DISTINCT l_partkey) AS unique_items,
 count(DISTINCT o_custkey) AS unique_users, max(l_quantity) AS max_duration FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,3""")
def _(s, d):
    line = table(s, d, "lineitem").selectExpr("l_orderkey", "l_partkey as item_sk", "l_quantity as duration_seconds")
    orders = table(s, d, "orders").selectExpr("o_orderkey as l_orderkey", "o_custkey as user_sk", "o_orderstatus as status")
    cust = table(s, d, "customer").selectExpr("c_custkey as user_sk", "c_mktsegment as domain", "c_nationkey as workspace_sk")
    nation = table(s, d, "nation").selectExpr("n_nationkey as workspace_sk", "n_name as workspace_name")
    joined = M.join_dims(line.join(orders, "l_orderkey"), {"user_sk": cust, "workspace_sk": nation})
    return joined.groupBy("status", "domain", "workspace_name").agg(
        F.count(F.lit(1)).alias("activity_count"), F.countDistinct("item_sk").alias("unique_items"),
        F.countDistinct("user_sk").alias("unique_users"), F.max("duration_seconds").alias("max_duration"),
    )
