"""Registry and the shared parts of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(run, oracle)
        return fn

    return register


def r2(expr: str, digits: int = 2) -> str:
    scale = f"{10**digits}.0"
    return f"round_even(CAST(({expr}) AS DOUBLE)*{scale},0)/{scale}"


def sk(prefix: str, col: str) -> str:
    return f"('0x'||substr(md5('{prefix}|'||{col}),1,15))::BIGINT"


def export_sk(prefix: str, col: str) -> str:
    return f"(('0x'||substr(md5('{prefix}|'||{col}),1,8))::BIGINT % 2147483647)"


FAILED = "count(*) FILTER (WHERE status='Failed')"

ENV_CASE = """CASE WHEN lower({c}) LIKE '%dev%' THEN 'DEV' WHEN lower({c}) LIKE '%test%' OR lower({c}) LIKE '%qa%' THEN 'TEST'
 WHEN lower({c}) LIKE '%uat%' OR lower({c}) LIKE '%staging%' THEN 'UAT'
 WHEN lower({c}) LIKE '%prd%' OR lower({c}) LIKE '%prod%' OR lower({c}) LIKE '%live%' THEN 'PRD' ELSE 'Unknown' END"""

ACT = """
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
act0 AS (
 SELECT event_id AS eid, CAST(event_id AS VARCHAR) AS event_id, 'act_'||event_id AS activity_id,
  CASE event_type WHEN 'error' THEN 'ExecuteNotebook' WHEN 'purchase' THEN 'RunArtifact' WHEN 'signup' THEN 'ReadLakehouse'
   WHEN 'view' THEN 'ViewReport' ELSE 'CustomClick' END AS activity_type,
  CASE WHEN event_id % 50 <> 7 THEN 'item_'||k END AS item_id,
  'Item '||k AS item_name,
  (['Notebook','DataPipeline','Lakehouse','Report','SemanticModel','SparkJobDefinition','Warehouse','Custom'])[k % 8 + 1] AS item_type,
  CASE WHEN event_id % 40 <> 11 THEN 'ws_'||(k % 25) END AS workspace_id,
  'NATION_'||(k % 25)||([' DEV',' TEST',' UAT',' PROD',''])[(k % 25) % 5 + 1] AS workspace_name,
  CASE WHEN event_id % 60 <> 13 THEN
   CASE user_id % 10 WHEN 0 THEN '00000000-0000-0000-0000-'||lpad(CAST(user_id AS VARCHAR), 12, '0')
    WHEN 1 THEN 'svc_app_'||user_id ELSE 'user.'||user_id||'@corp'||(user_id % 3)||'.com' END END AS submitted_by,
  'user.'||((user_id*7) % 50) AS created_by, 'user.'||((user_id*3) % 20) AS last_updated_by,
  (['Finance','Sales','Operations','IT','Analytics'])[k % 5 + 1] AS domain,
  (['EMEA','Americas','APAC'])[k % 3 + 1] AS location,
  CAST(NULL AS VARCHAR) AS object_url,
  CASE WHEN event_type='error' THEN 'Failed' WHEN event_type='purchase' AND event_id % 11 = 0 THEN 'Cancelled'
   WHEN event_type='signup' AND event_id % 13 = 0 THEN 'InProgress' WHEN event_type='view' THEN 'Completed' ELSE 'Succeeded' END AS status,
  ts AS start_time,
  CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value*10) AS DOUBLE) END AS duration_seconds,
  (['Scheduled','Manual','OnDemand'])[event_id % 3 + 1] AS invoke_type,
  CASE WHEN event_type='error' AND event_id % 6 <> 0 THEN
   (['Connection timeout','Insufficient permissions','Out of memory','Schema mismatch','Source unavailable'])[event_id % 6] END AS failure_reason,
  CAST(NULL AS VARCHAR) AS error_message,
  CASE WHEN event_type='error' THEN 'E'||(event_id % 4) END AS error_code,
  CASE WHEN event_id % 8 <> 5 THEN 'root_'||(event_id // 3) END AS root_activity_id
 FROM ev),
act AS (SELECT *, start_time + to_seconds(CAST(duration_seconds AS BIGINT)) AS end_time FROM act0)
"""

JOBS = """
jobs AS (
 SELECT 'job_'||event_id AS job_instance_id, 'item_'||CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS item_id,
  ts + to_seconds(CAST((event_id*37) % 800 - 400 AS BIGINT)) AS job_start_time,
  CASE WHEN event_id % 7 <> 0 THEN ts + to_seconds(CAST((event_id*37) % 800 - 400 + event_id % 1000 AS BIGINT)) END AS job_end_time,
  CASE WHEN event_id % 5 = 0 THEN 'Failed' ELSE 'Completed' END AS job_status,
  CASE WHEN event_id % 5 = 0 THEN 'Job failed: '||(event_id % 4) END AS job_failure_reason,
  (['RunNotebook','Refresh'])[event_id % 2 + 1] AS job_type,
  'svc_'||(user_id % 10) AS job_invoker
 FROM events WHERE event_type IN ('purchase','error'))
"""

LABELS = """
lab AS (SELECT coalesce(workspace_name, workspace_id, 'Unknown') AS workspace, coalesce(item_name,'Unknown') AS item_name,
  coalesce(item_type,'Unknown') AS item_type, start_time, duration_seconds,
  CASE WHEN submitted_by LIKE 'user.%' THEN 'User '||regexp_extract(submitted_by,'user.([0-9]+)',1)
   WHEN submitted_by LIKE 'svc%' THEN 'Svc_App_'||substr(submitted_by,9) ELSE submitted_by END AS user_name,
  coalesce(failure_reason, error_message, error_code, 'Unknown Error') AS error_message, error_code, event_id
 FROM act WHERE status='Failed')
"""

FACT = f"""
ws_name AS (SELECT workspace_name, max({sk('workspace', 'workspace_id')}) AS sk FROM act WHERE workspace_id <> '' GROUP BY 1),
fact AS (SELECT a.event_id, a.activity_id, CAST(strftime(a.start_time,'%Y%m%d') AS INTEGER) AS date_sk,
  CAST(hour(a.start_time)*100 + (minute(a.start_time)//15)*15 AS INTEGER) AS time_sk, CAST(a.start_time AS DATE) AS activity_date,
  coalesce({sk('workspace', 'a.workspace_id')}, n.sk) AS workspace_sk, {sk('item', 'item_id')} AS item_sk, {sk('user', 'submitted_by')} AS user_sk,
  CASE activity_type WHEN 'ExecuteNotebook' THEN 14 WHEN 'RunArtifact' THEN 17 WHEN 'ReadLakehouse' THEN 39 WHEN 'ViewReport' THEN 68 ELSE 999 END AS activity_type_sk,
  CASE status WHEN 'Succeeded' THEN 1 WHEN 'Completed' THEN 2 WHEN 'Failed' THEN 3 WHEN 'Cancelled' THEN 4 WHEN 'InProgress' THEN 5 ELSE 8 END AS status_sk,
  root_activity_id, invoke_type, coalesce(duration_seconds, 0) AS duration_seconds,
  CASE WHEN lower(status) IN ('failed','cancelled','error') THEN 1 ELSE 0 END AS is_failed,
  CASE WHEN lower(status) IN ('succeeded','completed','success') THEN 1 ELSE 0 END AS is_success,
  CASE WHEN coalesce(duration_seconds,0) > 3600 THEN 1 ELSE 0 END AS is_long_running, 1 AS record_count
 FROM act a LEFT JOIN ws_name n ON a.workspace_name = n.workspace_name),
dim_ws AS (SELECT workspace_id, {sk('workspace', 'workspace_id')} AS workspace_sk, any_value(workspace_name) AS workspace_name,
  {ENV_CASE.format(c='any_value(workspace_name)')} AS environment FROM act WHERE workspace_id <> '' GROUP BY 1),
dim_item AS (SELECT item_id, {sk('item', 'item_id')} AS item_sk, any_value(item_name) AS item_name, any_value(item_type) AS item_type,
  CASE WHEN any_value(item_type) IN ('Notebook','DataPipeline','SparkJobDefinition') THEN 'Compute'
   WHEN any_value(item_type) IN ('Lakehouse','Warehouse') THEN 'Storage' WHEN any_value(item_type) IN ('Report','SemanticModel') THEN 'Analytics'
   ELSE 'Other' END AS item_category FROM act WHERE item_id <> '' GROUP BY 1),
dim_user AS (SELECT DISTINCT submitted_by AS user_principal_name, {sk('user', 'submitted_by')} AS user_sk,
  CASE WHEN submitted_by LIKE '%@%' THEN split_part(submitted_by,'@',2) END AS domain,
  CASE WHEN submitted_by LIKE '00000000-%' THEN 'ServicePrincipal' WHEN submitted_by LIKE '%app%' THEN 'System' ELSE 'User' END AS user_type
  FROM act WHERE submitted_by <> ''),
dim_type AS (SELECT * FROM (VALUES (14,'ExecuteNotebook','Compute'),(17,'RunArtifact','Compute'),(39,'ReadLakehouse','Lakehouse'),
  (68,'ViewReport','Analytics'),(999,'Unknown','Unknown')) t(activity_type_sk, activity_type, activity_category)),
dim_stat AS (SELECT * FROM (VALUES (1,'Succeeded'),(2,'Completed'),(3,'Failed'),(4,'Cancelled'),(5,'InProgress'),(8,'Unknown')) t(status_sk, status_code)),
days AS (SELECT CAST(d AS DATE) AS full_date, CAST(strftime(d,'%Y%m%d') AS INTEGER) AS date_sk FROM
  (SELECT unnest(generate_series(CAST(min(start_time) AS DATE), CAST(max(start_time) AS DATE), INTERVAL 1 DAY)) AS d FROM act)),
slots AS (SELECT h*100+m AS time_sk, h AS hour_24, CASE WHEN h BETWEEN 5 AND 11 THEN 'Morning' WHEN h BETWEEN 12 AND 16 THEN 'Afternoon'
  WHEN h BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS time_period, h BETWEEN 9 AND 16 AS is_business_hours
  FROM (SELECT unnest(range(24)) AS h), (SELECT unnest([0,15,30,45]) AS m))
"""


def act(sql: str) -> str:
    return f"WITH {ACT} {sql}"


def lab(sql: str) -> str:
    return f"WITH {ACT}, {LABELS} {sql}"


def fact(sql: str) -> str:
    return f"WITH {ACT}, {FACT} {sql}"
