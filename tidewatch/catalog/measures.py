"""BI measures."""

from tidewatch.catalog.base import fact, query
from tidewatch.catalog.star import X, dims
from tidewatch.operators import dimensions as D
from tidewatch.operators import facts as FA
from tidewatch.operators import ranking as RK
from tidewatch.plans import measures as B
from tidewatch.sources.adapters import activities as A

AS_OF = "2024-01-30"


def n(cond="true"):
    return f"CAST(sum(record_count) FILTER (WHERE {cond}) AS BIGINT)"


T, FL = n(), n("is_failed=1")


def span(a, b):
    return n(f"activity_date BETWEEN DATE '{a}' AND DATE '{b}'")


TODAY, YDAY = span(AS_OF, AS_OF), span("2024-01-29", "2024-01-29")
L7, L28, P7 = span("2024-01-24", AS_OF), span("2024-01-03", AS_OF), span("2024-01-17", "2024-01-23")
MTD, PM, YTD, PMTD = span("2024-01-01", AS_OF), span("2023-12-01", "2023-12-31"), span("2024-01-01", AS_OF), span("2023-12-01", "2023-12-30")


def pct(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE)/{b}*100 END"


def chg(a, b):
    return pct(f"(coalesce({a},0)-{b})", b)


WS = ["workspace_sk"]


def g(sel, where="true"):
    return fact(f"SELECT workspace_sk, {sel} FROM fact WHERE {where} GROUP BY 1")


@query("measure_totals", g(f"{T} AS total_activities, {FL} AS failed_activities, {n('is_failed=0')} AS successful_activities"))
def _(s, d):
    return B.totals(X(s, d), WS)


@query("measure_totals_overall", fact(f"SELECT {T} AS total_activities, {FL} AS failed_activities, {n('is_failed=0')} AS successful_activities FROM fact"))
def _(s, d):
    return B.totals(X(s, d))


@query("measure_rates", g(f"{pct(f'({T}-coalesce({FL},0))', T)} AS success_rate, {pct(FL, T)} AS failure_rate"))
def _(s, d):
    return B.rates(X(s, d), WS)


def dc(c):
    return f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"


@query("measure_active_counts", fact(f"SELECT date_sk, {dc('user_sk')} AS active_users, {dc('workspace_sk')} AS active_workspaces, {dc('item_sk')} AS active_items FROM fact GROUP BY 1"))
def _(s, d):
    return B.active_counts(X(s, d), ["date_sk"])


@query("measure_durations", g("""sum(duration_seconds)/3600 AS total_duration_hours, sum(duration_seconds)/60 AS total_duration_minutes,
 avg(duration_seconds)/60 AS avg_duration_minutes, avg(duration_seconds) AS avg_duration_seconds, max(duration_seconds)/3600 AS max_duration_hours"""))
def _(s, d):
    return B.durations(X(s, d), WS)


@query("measure_long_running", g(f"{n('is_long_running=1')} AS long_running_activities, {pct(n('is_long_running=1'), T)} AS long_running_rate"))
def _(s, d):
    return B.long_running_rate(X(s, d), WS)


@query("measure_day_values", g(f"{TODAY} AS activities_today, {YDAY} AS activities_yesterday", f"activity_date BETWEEN DATE '2024-01-29' AND DATE '{AS_OF}'"))
def _(s, d):
    return B.day_values(X(s, d), AS_OF, WS)


@query("measure_period_values", g(f"{L7} AS activities_last_7, {L28} AS activities_last_28, {P7} AS activities_previous_7", f"activity_date BETWEEN DATE '2024-01-03' AND DATE '{AS_OF}'"))
def _(s, d):
    return B.period_values(X(s, d), AS_OF, WS)


CHG = f"""{TODAY} AS activities_today, {YDAY} AS activities_yesterday, {L7} AS activities_last_7, {P7} AS activities_previous_7,
 {chg(TODAY, YDAY)} AS dod_change_pct, {chg(L7, P7)} AS wow_change_pct"""


@query("measure_change_pct", g(CHG, f"activity_date BETWEEN DATE '2024-01-17' AND DATE '{AS_OF}'"))
def _(s, d):
    return B.change_pct(X(s, d), AS_OF, WS)


@query("measure_to_date", g(f"{MTD} AS activities_mtd, {PM} AS activities_previous_month, {YTD} AS activities_ytd", f"activity_date BETWEEN DATE '2023-12-01' AND DATE '{AS_OF}'"))
def _(s, d):
    return B.to_date_values(X(s, d), AS_OF, WS)


@query("measure_mom_orders", """WITH o AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS dt FROM orders),
 m AS (SELECT p, count(*) FILTER (WHERE dt BETWEEN DATE '1999-03-01' AND DATE '1999-03-30') AS a, count(*) FILTER (WHERE dt BETWEEN DATE '1999-02-01' AND DATE '1999-02-28') AS b FROM o
 WHERE dt BETWEEN DATE '1999-02-01' AND DATE '1999-03-30' GROUP BY 1)
 SELECT p AS priority, nullif(a,0) AS activities_mtd, nullif(b,0) AS previous_mtd, CASE WHEN b > 0 THEN CAST(a-b AS DOUBLE)/b*100 END AS mom_change_pct FROM m""")
def _(s, d):
    from tidewatch.sources.adapters import table

    orders = table(s, d, "orders").selectExpr("o_orderpriority as priority", "cast(o_orderdate as date) as activity_date", "1 as record_count")
    return B.mom_pct(orders, "1999-03-30", ["priority"])


@query("measure_by_environment", fact(f"""SELECT domain, {n("environment='PRD'")} AS production_activities, {n("environment='UAT'")} AS uat_activities, {n("environment='TEST'")} AS test_activities,
 {n("environment='DEV'")} AS development_activities, {pct(n("environment='PRD' AND is_failed=1"), n("environment='PRD'"))} AS production_failure_rate,
 {n("environment IS DISTINCT FROM 'PRD'")} AS non_production_activities FROM (SELECT f.*, a.invoke_type AS domain, environment FROM fact f JOIN act a USING (event_id) LEFT JOIN dim_ws USING (workspace_sk)) GROUP BY 1""".replace("f.*, a.invoke_type AS domain", "f.record_count, f.is_failed, f.invoke_type AS domain").replace("SELECT domain,", "SELECT domain AS invoke_type,")))
def _(s, d):
    return B.by_environment_values(X(s, d), dims(s, d).workspace, ["invoke_type"])


_cats = ", ".join(f"""{n(f"activity_category='{c}'")} AS {c.lower()}_activities""" for c in ("Pipeline", "Notebook", "Dataflow", "Lakehouse", "SemanticModel", "Report"))


@query("measure_by_category", fact(f"SELECT workspace_sk, {_cats} FROM fact LEFT JOIN dim_type USING (activity_type_sk) GROUP BY 1"))
def _(s, d):
    return B.by_category_values(X(s, d), dims(s, d).activity_type, by=WS)


_kinds = ", ".join(f"""{n(f"item_type='{c}'")} AS {c.lower()}_activities""" for c in ("Notebook", "Lakehouse", "SemanticModel", "Report"))


@query("measure_by_item_type", fact(f"SELECT workspace_sk, {_kinds} FROM fact LEFT JOIN dim_item USING (item_sk) GROUP BY 1"))
def _(s, d):
    return B.by_category_values(X(s, d), dims(s, d).item, ["Notebook", "Lakehouse", "SemanticModel", "Report"], WS, "item_type", "item_sk")


@query("measure_per_member", fact(f"SELECT date_sk, CAST({T} AS DOUBLE)/{dc('user_sk')} AS activities_per_user, CAST({T} AS DOUBLE)/{dc('workspace_sk')} AS activities_per_workspace FROM fact GROUP BY 1"))
def _(s, d):
    return B.per_member_avg(X(s, d), ["date_sk"])


@query("measure_top_user", fact(f"SELECT user_principal_name, {T} AS total_activities FROM fact JOIN dim_user USING (user_sk) GROUP BY 1"))
def _(s, d):
    return B.top_user_value(X(s, d), dims(s, d).user)


@query("user_rank", fact(f"SELECT *, CAST(dense_rank() OVER (ORDER BY total_activities DESC) AS INTEGER) AS user_rank FROM (SELECT user_principal_name, {T} AS total_activities FROM fact JOIN dim_user USING (user_sk) GROUP BY 1)"))
def _(s, d):
    return B.user_rank(X(s, d), dims(s, d).user)


@query("workspace_rank", fact(f"SELECT *, CAST(dense_rank() OVER (ORDER BY total_activities DESC) AS INTEGER) AS workspace_rank FROM (SELECT workspace_name, {T} AS total_activities FROM fact JOIN dim_ws USING (workspace_sk) GROUP BY 1)"))
def _(s, d):
    return B.workspace_rank(X(s, d), dims(s, d).workspace)


@query("measure_hours_split", fact(f"SELECT workspace_sk, {n('is_business_hours')} AS business_hours_activities, {n('NOT is_business_hours')} AS off_hours_activities FROM fact LEFT JOIN slots USING (time_sk) GROUP BY 1"))
def _(s, d):
    return B.hours_split(X(s, d), D.dim_time(s), WS)


@query("peak_hour", fact("""SELECT workspace_sk, CAST(first(hour_24 ORDER BY c DESC, hour_24 DESC) AS INTEGER) AS peak_hour FROM (SELECT workspace_sk, hour_24, count(*) AS c
 FROM fact JOIN slots USING (time_sk) GROUP BY 1,2) GROUP BY 1"""))
def _(s, d):
    return B.peak_hour(X(s, d), D.dim_time(s), WS)


@query("daily_series", fact(f"SELECT days.date_sk, full_date, {T} AS total_activities FROM days LEFT JOIN fact USING (date_sk) GROUP BY 1,2"))
def _(s, d):
    a = A(s, d)
    return B.daily_series(FA.fact_from_log(a), D.dim_date_for(a))


@query("measure_run_counts", g(f"""{n("invoke_type='Scheduled'")} AS scheduled_runs, {pct(f"coalesce({n('is_success=1')},0)", T)} AS completed_rate, {T} AS total_activities"""))
def _(s, d):
    return B.run_counts(X(s, d), WS)


@query("master_measures", fact("""SELECT workspace_name, count(*) AS total_activities, count(*) FILTER (WHERE status='Failed') AS failed_activities,
 CAST(count(*) FILTER (WHERE status<>'Failed') AS DOUBLE)/count(*) AS success_rate, avg(duration_seconds) AS avg_duration_seconds, sum(duration_seconds)/3600 AS total_duration_hours FROM act GROUP BY 1"""))
def _(s, d):
    from tidewatch.operators.reports import activities_master

    return FA.master_measures(activities_master(A(s, d), ordered=False), ["workspace_name"])


_MOVE = f"activity_date BETWEEN DATE '2024-01-17' AND DATE '{AS_OF}'"


def labels(s, d):
    k = dims(s, d)
    return {
        "workspace_sk": k.workspace.select("workspace_sk", "workspace_name"),
        "activity_type_sk": k.activity_type.select("activity_type_sk", "activity_type"),
        "user_sk": k.user.select("user_sk", "user_principal_name"),
        "item_sk": k.item.select("item_sk", "item_name"),
    }


@query("movers_workspaces_wow", fact(f"""SELECT t.*, workspace_name FROM (SELECT workspace_sk, {CHG} FROM fact WHERE {_MOVE} AND workspace_sk IS NOT NULL GROUP BY 1
 ORDER BY wow_change_pct DESC NULLS LAST, 1 LIMIT 15) t LEFT JOIN dim_ws USING (workspace_sk)"""))
def _(s, d):
    return B.movers(X(s, d), labels(s, d), AS_OF, "workspace_sk")


@query("movers_workspaces_dod_worst", fact(f"""SELECT t.*, workspace_name FROM (SELECT workspace_sk, {CHG} FROM fact WHERE {_MOVE} AND workspace_sk IS NOT NULL GROUP BY 1
 ORDER BY dod_change_pct ASC NULLS LAST, 1 LIMIT 15) t LEFT JOIN dim_ws USING (workspace_sk)"""))
def _(s, d):
    return B.movers(X(s, d), labels(s, d), AS_OF, "workspace_sk", order="dod_change_pct", best=False)


@query("movers_types_last_7", fact(f"""SELECT t.*, activity_type FROM (SELECT activity_type_sk, {CHG} FROM fact WHERE {_MOVE} GROUP BY 1
 ORDER BY activities_last_7 DESC NULLS LAST, 1 LIMIT 15) t LEFT JOIN dim_type USING (activity_type_sk)"""))
def _(s, d):
    return B.movers(X(s, d), labels(s, d), AS_OF, "activity_type_sk", order="activities_last_7")


@query("movers_users_last_7", fact(f"""SELECT t.*, user_principal_name FROM (SELECT user_sk, {CHG} FROM fact WHERE {_MOVE} AND user_sk IS NOT NULL GROUP BY 1
 ORDER BY activities_last_7 DESC NULLS LAST, 1 LIMIT 15) t LEFT JOIN dim_user USING (user_sk)"""))
def _(s, d):
    return B.movers(X(s, d), labels(s, d), AS_OF, "user_sk", order="activities_last_7")


_LEAD = f"""{MTD} AS activities_mtd, {YTD} AS activities_ytd, sum(duration_seconds)/3600 AS total_duration_hours, {n('is_long_running=1')} AS long_running_activities,
 {chg(MTD, PMTD)} AS mom_change_pct"""
for _key, _dim, _label, _order in (
    ("workspace_sk", "dim_ws", "workspace_name", "activities_mtd"), ("activity_type_sk", "dim_type", "activity_type", "activities_ytd"),
    ("user_sk", "dim_user", "user_principal_name", "activities_mtd"), ("item_sk", "dim_item", "item_name", "total_duration_hours"),
):

    @query(f"period_leaders_{_key[:-3]}", fact(f"""SELECT t.*, {_label} FROM (SELECT {_key}, {_LEAD} FROM fact WHERE {_key} IS NOT NULL GROUP BY 1
     ORDER BY {_order} DESC NULLS LAST, 1 LIMIT 15) t LEFT JOIN {_dim} USING ({_key})"""))
    def _(s, d, key=_key, order=_order):
        return B.period_leaders(X(s, d), labels(s, d), AS_OF, key, order=order)


@query("scorecard", g(f"""{pct(f'({T}-coalesce({FL},0))', T)} AS success_rate, coalesce({FL},0) AS failed_activities, {TODAY} AS activities_today, {YDAY} AS activities_yesterday,
 {chg(TODAY, YDAY)} AS dod_change_pct, CASE WHEN {pct(f'({T}-coalesce({FL},0))', T)} >= 99 THEN '#107C10' WHEN {pct(f'({T}-coalesce({FL},0))', T)} >= 95 THEN '#FFB900' ELSE '#E81123' END AS success_colour,
 CASE WHEN coalesce({FL},0) = 0 THEN '#107C10' WHEN {FL} <= 10 THEN '#FFB900' ELSE '#E81123' END AS failure_colour,
 CASE WHEN {chg(TODAY, YDAY)} > 0 THEN '▲' WHEN {chg(TODAY, YDAY)} < 0 THEN '▼' ELSE '―' END AS trend_mark,
 CASE WHEN coalesce({chg(TODAY, YDAY)}, 0) >= 0 THEN '#107C10' ELSE '#E81123' END AS trend_colour"""))
def _(s, d):
    return B.scorecard(X(s, d), AS_OF, WS)


@query("share_of_total", fact(f"SELECT *, CAST(total_activities AS DOUBLE)/sum(total_activities) OVER ()*100 AS share_percent FROM (SELECT workspace_sk, {T} AS total_activities, {FL} AS failed_activities, {n('is_failed=0')} AS successful_activities FROM fact GROUP BY 1)"))
def _(s, d):
    return RK.share_of_total(B.totals(X(s, d), WS), "total_activities")


@query("trailing_average", """SELECT *, round(avg(n) OVER (PARTITION BY o_orderpriority ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS avg_7d
 FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1,2)""")
def _(s, d):
    from pyspark.sql import functions as F

    from tidewatch.sources.adapters import table

    daily = table(s, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return RK.trailing_avg(daily, "o_orderpriority", "n", 7, "day", "avg_7d").withColumn("avg_7d", F.round("avg_7d", 6))


@query("page_of_parts", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total_rows FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def _(s, d):
    from tidewatch.sources.adapters import table

    return RK.page(table(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 50, 25)


@query("nearest_order_total", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_totalprice - 100000), o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(s, d):
    from pyspark.sql import functions as F

    from tidewatch.sources.adapters import table

    orders = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return RK.nearest_row(orders, "o_custkey", F.abs(F.col("o_totalprice") - 100000), ["o_orderkey"])
