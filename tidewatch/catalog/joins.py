"""As-of merge, attaches, inventory, compliance and quality."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import ACT, FACT, JOBS, act, fact, query, r2
from tidewatch.functions.labels import derive_report_columns
from tidewatch.operators import analysis as N
from tidewatch.operators import asof as S
from tidewatch.operators import compliance as C
from tidewatch.operators import facts as FA
from tidewatch.operators import inventory as I
from tidewatch.operators import quality as Q
from tidewatch.sources.adapters import activities as A, jobs as J, members, table, workspaces

# The two neighbours of an activity by DuckDB's own as-of joins, then the nearer one.
# Equal job times: the highest id counts backwards, the lowest forwards.
ASOF = f"""{ACT}, {JOBS},
 jb AS (SELECT item_id, job_start_time, max(job_instance_id) AS hi, min(job_instance_id) AS lo FROM jobs GROUP BY 1,2),
 nb AS (SELECT a.event_id, p.job_start_time AS pt, p.hi AS pid, n.job_start_time AS nt, n.lo AS nid FROM act a
  ASOF LEFT JOIN jb p ON a.item_id = p.item_id AND a.start_time >= p.job_start_time
  ASOF LEFT JOIN jb n ON a.item_id = n.item_id AND a.start_time <= n.job_start_time),
 near AS (SELECT event_id, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR date_diff('microsecond', pt, s) <= date_diff('microsecond', s, nt)) THEN pid ELSE nid END AS jid,
  CASE WHEN pt IS NOT NULL AND (nt IS NULL OR date_diff('microsecond', pt, s) <= date_diff('microsecond', s, nt)) THEN date_diff('microsecond', pt, s)
   ELSE date_diff('microsecond', s, nt) END AS gap, pt, pid, s FROM (SELECT nb.*, act.start_time AS s FROM nb JOIN act USING (event_id)))"""


def merged_cte(tol=300):
    return f"""{ASOF}, merged AS (SELECT a.event_id, a.item_id, a.workspace_id, a.activity_type, a.item_type, a.start_time, j.job_instance_id, j.job_start_time, j.job_status,
  CASE WHEN j.job_status='Failed' THEN 'Failed' ELSE coalesce(a.status,'Unknown') END AS status,
  coalesce(a.failure_reason, j.job_failure_reason) AS failure_reason, coalesce(a.error_message, a.failure_reason, j.job_failure_reason) AS error_message,
  coalesce(a.submitted_by, j.job_invoker) AS submitted_by, coalesce(a.end_time, j.job_end_time) AS end_time,
  CASE WHEN a.end_time IS NULL OR a.duration_seconds IS NULL
   THEN coalesce(greatest(0.0, CAST(date_diff('microsecond', a.start_time, coalesce(a.end_time, j.job_end_time)) AS DOUBLE)/1000000), 0.0) ELSE a.duration_seconds END AS duration_seconds,
  a.workspace_name, a.root_activity_id, a.invoke_type FROM act a LEFT JOIN near n ON a.event_id = n.event_id AND n.gap <= {tol * 1000000} LEFT JOIN jobs j ON n.jid = j.job_instance_id)"""


COLS = ["event_id", "item_id", "start_time", "job_instance_id", "job_start_time", "job_status", "status", "failure_reason", "error_message", "submitted_by", "end_time", "duration_seconds"]


@query("smart_merge", f"WITH {merged_cte()} SELECT {', '.join(COLS)} FROM merged")
def _(s, d):
    return S.smart_merge(A(s, d), J(s, d)).select(*COLS)


@query("smart_merge_hours", f"WITH {merged_cte(7200)} SELECT {', '.join(COLS)} FROM merged")
def _(s, d):
    return S.smart_merge(A(s, d), J(s, d), tolerance=7200).select(*COLS)


@query("asof_backward", f"WITH {ASOF} SELECT event_id, CASE WHEN date_diff('microsecond', pt, s) <= 60000000 THEN pid END AS job_instance_id FROM near")
def _(s, d):
    return S.asof_backward(A(s, d), J(s, d), ("start_time", "job_start_time"), "item_id", 60, "job_instance_id").select("event_id", "job_instance_id")


@query("asof_rank", f"WITH {ASOF} SELECT event_id, jid AS job_instance_id FROM near")
def _(s, d):
    return S.asof_rank(A(s, d), J(s, d), ("start_time", "job_start_time"), "item_id", "job_instance_id").select("event_id", "job_instance_id")


@query("merged_daily_metrics", f"""WITH {merged_cte()} SELECT CAST(start_time AS DATE) AS date, workspace_name, count(*) AS total_activities, count(*) FILTER (WHERE status='Failed') AS failed_activities,
 count(job_instance_id) AS matched_jobs, {r2("CAST(count(*) FILTER (WHERE status<>'Failed') AS DOUBLE)/count(*)*100")} AS success_rate, round(sum(duration_seconds), 3) AS total_duration_seconds
 FROM merged GROUP BY 1,2""")
def _(s, d):
    from tidewatch.functions.basics import percent, round_half_even

    merged = derive_report_columns(S.smart_merge(A(s, d), J(s, d)))
    n, bad = F.count(F.lit(1)), F.count_if("is_failed")
    return merged.groupBy("date", "workspace_name").agg(
        n.alias("total_activities"), bad.alias("failed_activities"), F.count("job_instance_id").alias("matched_jobs"),
        round_half_even(percent(n - bad, n)).alias("success_rate"), F.round(F.sum("duration_seconds"), 3).alias("total_duration_seconds"),
    )


@query("enrich_errors", f"""WITH {ASOF} SELECT a.event_id, coalesce(a.failure_reason, job_failure_reason) AS failure_reason, coalesce(a.error_message, job_failure_reason) AS error_message,
 coalesce(a.error_code, CASE WHEN job_failure_reason IS NOT NULL THEN 'Unknown' END) AS error_code, CASE WHEN job_status='Failed' THEN 'Failed' ELSE a.status END AS status
 FROM act a LEFT JOIN near n ON a.event_id=n.event_id AND gap <= 300000000 LEFT JOIN jobs ON jid=job_instance_id""")
def _(s, d):
    return S.enrich_errors(S.asof_nearest(A(s, d), J(s, d))).select("event_id", "failure_reason", "error_message", "error_code", "status")


@query("merge_stats", f"""WITH {merged_cte()}, b AS (SELECT count(*) FILTER (WHERE end_time IS NULL) AS missing_end_before, count(*) FILTER (WHERE duration_seconds=0) AS zero_duration_before FROM act),
 c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE end_time IS NULL) AS missing_end_after, count(*) FILTER (WHERE duration_seconds=0) AS zero_duration_after, count(job_status) AS matched FROM merged)
 SELECT *, missing_end_before-missing_end_after AS fixed_end_times, greatest(0, zero_duration_before-zero_duration_after) AS restored_durations, CAST(matched AS DOUBLE)/rows AS match_rate FROM b, c""")
def _(s, d):
    a = A(s, d)
    return N.merge_stats(a, S.smart_merge(a, J(s, d)))


@query("pre_merge_checks", f"""WITH {ACT} SELECT count(*) AS activities, count(*) FILTER (WHERE start_time IS NULL) AS null_starts, count(*) FILTER (WHERE end_time < start_time) AS ends_before_start,
 CAST(count(item_id) AS DOUBLE)/count(*) AS activity_key_coverage, count(activity_id)-count(DISTINCT activity_id) AS duplicate_ids, CAST(1 AS DOUBLE) AS job_key_coverage FROM act""")
def _(s, d):
    return Q.pre_merge_checks(A(s, d), J(s, d))


@query("post_merge_checks", f"WITH {merged_cte()} SELECT CAST(count(job_instance_id) AS DOUBLE)/count(*) AS match_rate, CAST(count(error_message) AS DOUBLE)/count(*) AS error_coverage, CAST(count(duration_seconds) AS DOUBLE)/count(*) AS duration_coverage FROM merged")
def _(s, d):
    return Q.post_merge_checks(S.smart_merge(A(s, d), J(s, d)))


_CHECKED = ["workspace_id", "workspace_name", "item_name", "status", "end_time", "failure_reason"]
_cc = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", true AS present, count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR)='') AS empty_rows, CAST(count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR)='') AS DOUBLE)/count(*)*100 AS empty_percent FROM act" for c in _CHECKED)


@query("column_checks", act(_cc + " UNION ALL SELECT 'no_such', false, NULL, NULL"))
def _(s, d):
    return Q.column_checks(A(s, d), [*_CHECKED, "no_such"])


@query("coverage", act(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE)/count(*) AS coverage FROM act" for c in _CHECKED)))
def _(s, d):
    return Q.coverage(A(s, d), _CHECKED)


# ---- attaches ----------------------------------------------------------------------
@query("attach_workspace", f"""WITH {ACT}, w AS (SELECT 'ws_'||n_nationkey AS workspace_id, n_name AS nm, 'cap_'||n_regionkey AS cap FROM nation)
 SELECT event_id, workspace_id, coalesce(nm, workspace_name) AS workspace_name, cap AS capacity_id FROM act LEFT JOIN w USING (workspace_id)""")
def _(s, d):
    ws = table(s, d, "nation").selectExpr("concat('ws_', n_nationkey) as id", "n_name as displayName", "concat('cap_', n_regionkey) as capacityId")
    return I.attach_workspace(A(s, d).select("event_id", "workspace_id", "workspace_name"), ws)


@query("workspace_name_lookup", f"""WITH {ACT}, w AS (SELECT 'ws_'||n_nationkey AS workspace_id, n_name AS nm FROM nation)
 SELECT event_id, coalesce(nm, CASE WHEN lower(workspace_name)<>'unknown' THEN workspace_name END, 'Unknown') AS workspace_name FROM act LEFT JOIN w USING (workspace_id)""")
def _(s, d):
    ws = table(s, d, "nation").selectExpr("concat('ws_', n_nationkey) as workspace_id", "n_name as workspace_name")
    return I.workspace_name(A(s, d).select("event_id", "workspace_id", "workspace_name"), ws).select("event_id", "workspace_name")


@query("workspace_key_lookup", fact("""SELECT a.event_id, coalesce(i.workspace_sk, n.sk, -1) AS workspace_sk FROM act a LEFT JOIN dim_ws i USING (workspace_id)
 LEFT JOIN (SELECT workspace_name, max(workspace_sk) AS sk FROM dim_ws GROUP BY 1) n ON a.workspace_name=n.workspace_name"""))
def _(s, d):
    from tidewatch.operators.dimensions import dim_workspace

    a = A(s, d)
    return I.workspace_sk(a.select("event_id", "workspace_id", "workspace_name"), dim_workspace(a)).select("event_id", "workspace_sk")


@query("attach_item", f"""WITH {ACT}, m AS (SELECT DISTINCT 'ws_'||(p_partkey % 25) AS workspace_id, 'item_'||p_partkey AS item_id, p_name, p_type, 'x|'||p_brand||'@corp.com' AS cb FROM part)
 SELECT event_id, coalesce(p_name, item_name) AS item_name, coalesce(p_type, item_type) AS item_type, CASE WHEN p_name IS NOT NULL THEN 'https://app.powerbi.com/groups/'||workspace_id||'/items/'||item_id END AS object_url,
 coalesce(split_part(split_part(cb,'|',2),'@',1), created_by) AS created_by FROM act LEFT JOIN m USING (workspace_id, item_id)""")
def _(s, d):
    items = table(s, d, "part").selectExpr(
        "concat('ws_', p_partkey % 25) as workspace_id", "concat('item_', p_partkey) as item_id", "p_name as display_name", "p_type as type",
        "concat('x|', p_brand, '@corp.com') as created_by",
    )
    return I.attach_item(A(s, d), items).select("event_id", "item_name", "item_type", "object_url", "created_by")


# ---- inventory and compliance ------------------------------------------------------
WSQL = """ws AS (SELECT 'W'||c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment='HOUSEHOLD' THEN 'PersonalGroup' ELSE 'Workspace' END AS type,
 CASE WHEN c_acctbal < 0 THEN 'Deleted' ELSE 'Active' END AS state, CASE WHEN c_nationkey < 20 THEN 'cap_'||c_nationkey END AS "capacityId",
 c_mktsegment='BUILDING' AS "isOnDedicatedCapacity" FROM customer)"""
MSQL = """mem AS (SELECT 'W'||o_custkey AS workspace_id, lower(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'grp-'||substr(o_orderpriority,1,1) END, 'GRP-'||substr(o_orderpriority,1,1))) AS principal,
 coalesce(CASE o_orderstatus WHEN 'F' THEN 'Admin' WHEN 'O' THEN 'Member' END, 'viewer') AS r, o_orderkey AS seq FROM orders),
 roles AS (SELECT workspace_id, principal, first(r ORDER BY seq) AS current_role FROM mem GROUP BY 1,2)"""
PREM = """(("capacityId" IS NOT NULL AND "capacityId" <> '') OR "isOnDedicatedCapacity")"""
REQ = [{"objectId": "GRP-1", "displayName": "Platform Admins", "role": "Admin"}, {"objectId": "grp-3", "displayName": "Auditors", "role": "Member"}]
RQSQL = "rq AS (SELECT * FROM (VALUES ('Platform Admins','grp-1','Admin'),('Auditors','grp-3','Member')) t(\"group\", principal, target_role))"
ACTION = "CASE WHEN lower(current_role)=lower(target_role) THEN 'already_compliant' WHEN current_role IS NOT NULL THEN 'role_mismatch' ELSE 'dry_run' END"
# Suppressed: workspaces of suppliers' numbers, by id, and of the AUTOMOBILE segment, by name.
SUP = "sup AS (SELECT 'id' AS kind, 'w'||s_suppkey AS token FROM supplier UNION ALL SELECT 'name', upper(c_name) FROM customer WHERE c_mktsegment='AUTOMOBILE')"
STAT = f"""{WSQL}, {SUP}, st AS (SELECT ws.*, CASE WHEN lower(id) IN (SELECT lower(token) FROM sup WHERE kind='id') OR lower(name) IN (SELECT lower(token) FROM sup WHERE kind='name') THEN 'suppressed' ELSE 'evaluated' END AS status FROM ws)"""


def rules(s, d):
    by_id = table(s, d, "supplier").selectExpr("'id' as kind", "concat('w', s_suppkey) as token")
    by_name = table(s, d, "customer").filter("c_mktsegment = 'AUTOMOBILE'").selectExpr("'name' as kind", "upper(c_name) as token")
    return by_id.unionByName(by_name)


@query("merge_inventory", f"""WITH {WSQL}, b AS (SELECT 'W'||s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name, s_suppkey % 5 = 0 AS ded FROM supplier)
 SELECT coalesce(ws.id, b.id) AS id, coalesce(nullif(b.name,''), ws.name, 'Unnamed') AS name, "capacityId", coalesce("isOnDedicatedCapacity", false) OR coalesce(ded, false) AS "isOnDedicatedCapacity",
 CASE WHEN ws.id IS NOT NULL THEN 'fabric' ELSE 'powerbi' END AS source FROM ws FULL JOIN b ON ws.id=b.id""")
def _(s, d):
    b = table(s, d, "supplier").selectExpr("concat('W', s_suppkey) as id", "if(s_suppkey % 3 = 0, '', s_name) as name", "s_suppkey % 5 = 0 as isOnDedicatedCapacity")
    return I.merge_inventory(workspaces(s, d).drop("type", "state"), b)


@query("workspace_scope", f"WITH {WSQL} SELECT * FROM ws WHERE state='Active' AND type<>'PersonalGroup' AND {PREM}")
def _(s, d):
    return C.scope(workspaces(s, d), premium_only=True)


@query("suppressed_workspaces", f"WITH {STAT} SELECT id, name FROM st WHERE status='suppressed'")
def _(s, d):
    return C.suppressed(workspaces(s, d), rules(s, d)).select("id", "name")


@query("workspace_status", f"WITH {STAT} SELECT * FROM st")
def _(s, d):
    return C.workspace_status(workspaces(s, d), rules(s, d))


@query("assess_access", f"WITH {WSQL}, {MSQL}, {RQSQL} SELECT ws.id, rq.*, current_role FROM ws, rq LEFT JOIN roles ON roles.workspace_id=ws.id AND roles.principal=rq.principal")
def _(s, d):
    return C.assess_access(workspaces(s, d).select("id"), REQ, members(s, d))


@query("requirement_status", f"WITH {WSQL}, {MSQL}, {RQSQL} SELECT ws.id, rq.*, current_role, {ACTION} AS action FROM ws, rq LEFT JOIN roles ON roles.workspace_id=ws.id AND roles.principal=rq.principal")
def _(s, d):
    return C.requirement_status(workspaces(s, d).select("id"), REQ, members(s, d))


SUMMARY = f"""{STAT}, {MSQL}, {RQSQL}, ac AS (SELECT id, bool_or({ACTION}<>'already_compliant') AS na, string_agg("group"||': '||{ACTION}, '; ' ORDER BY "group") AS txt
 FROM (SELECT id FROM st WHERE status='evaluated') w, rq LEFT JOIN roles ON roles.workspace_id=w.id AND roles.principal=rq.principal GROUP BY 1),
 sm AS (SELECT st.id AS workspace_id, name AS workspace_name, status, coalesce(na,false) AS needs_action, coalesce(txt,'') AS actions FROM st LEFT JOIN ac USING (id))"""


@query("access_summary", f"WITH {SUMMARY} SELECT * FROM sm")
def _(s, d):
    return C.access_summary(workspaces(s, d), rules(s, d), REQ, members(s, d))


@query("access_metrics", f"""WITH {SUMMARY} SELECT count(*) AS total_workspaces, count(*) FILTER (WHERE status='evaluated' AND NOT needs_action) AS compliant_workspaces,
 count(*) FILTER (WHERE status='evaluated' AND needs_action) AS workspaces_needing_action, count(*) FILTER (WHERE status='suppressed') AS suppressed_workspaces,
 count(*) FILTER (WHERE status='skipped') AS skipped_workspaces FROM sm""")
def _(s, d):
    return C.access_metrics(C.access_summary(workspaces(s, d), rules(s, d), REQ, members(s, d)))


@query("principal_audit", f"""WITH {WSQL}, {MSQL} SELECT id AS workspace_id, name AS workspace_name, current_role IS NOT NULL AS is_member, coalesce(current_role,'None') AS current_role, "capacityId" AS capacity_id
 FROM ws LEFT JOIN roles ON roles.workspace_id=ws.id AND principal='grp-2' WHERE {PREM}""")
def _(s, d):
    return C.principal_audit(workspaces(s, d), members(s, d), "GRP-2")


@query("config_problems", """SELECT 'weight' AS "column", 'missing column' AS problem, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'p_size', 'expected string, got int', NULL
 UNION ALL SELECT 'kind', 'null in required column', count(*) FILTER (WHERE p_type='PROMO') FROM part""")
def _(s, d):
    from pyspark.sql.types import StructType

    cfg = table(s, d, "part").selectExpr("p_size", "nullif(p_type, 'PROMO') as kind")
    return Q.check_config(cfg, StructType().add("p_size", "string").add("kind", "string").add("weight", "double"), ["kind", "p_size"])
