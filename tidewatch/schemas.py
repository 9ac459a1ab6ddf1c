"""Target table schemas and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ACTIVITY = """
    event_id string, activity_id string, activity_type string, item_id string, item_name string, item_type string,
    workspace_id string, workspace_name string, submitted_by string, created_by string, last_updated_by string,
    domain string, location string, object_url string, status string, start_time timestamp, end_time timestamp,
    duration_seconds double"""

_RATES = "total_activities bigint, failed_activities bigint, success_rate_percent double, total_duration_seconds double, average_duration_seconds double"
_VERSIONED = "is_current boolean, effective_from date, effective_to date, version int"

TABLE_DDL: dict[str, str] = {
    "activities": _ACTIVITY,
    "jobs": """
        job_instance_id string, item_id string, job_start_time timestamp, job_end_time timestamp, job_status string,
        job_failure_reason struct<message: string, errorCode: string, messageParameters: map<string, string>>,
        job_type string, invoke_type string, root_activity_id string, job_invoker string""",
    "activities_master": """
        event_id string, activity_id string, workspace_id string, workspace_name string, item_id string, item_name string,
        item_type string, activity_type string, status string, invoke_type string, start_time timestamp, end_time timestamp,
        date date, hour int, duration_seconds double, duration_minutes double, submitted_by string, created_by string,
        last_updated_by string, domain string, location string, object_url string, is_simulated boolean, failure_reason string,
        error_message string, error_code string, root_activity_id string, job_instance_id string, is_failed boolean, is_success boolean""",
    "key_measurables": "metric string, value double, unit string, period string",
    "user_performance": f"user string, {_RATES}, daily_average_activities double, risk_level string",
    "domain_performance": f"domain string, {_RATES}, percentage_of_total_activities double",
    "failure_analysis": "item_id string, item_name string, item_type string, failure_count bigint, severity string",
    "daily_trends": f"date date, {_RATES}",
    "compute_analysis": """
        user string, item_name string, item_type string, total_runs bigint, successful_runs bigint, failed_runs bigint, unknown_runs bigint,
        failure_rate_percent double, avg_duration_seconds double, total_duration_seconds double, last_run_time timestamp""",
    "dim_date": """
        date_sk int, full_date date, day_of_week int, day_of_week_name string, day_of_month int, day_of_year int, week_of_year int,
        month_number int, month_name string, quarter int, year int, is_weekend boolean, is_weekday boolean, fiscal_year int, fiscal_quarter int""",
    "dim_time": "time_sk int, hour_24 int, hour_12 int, minute int, am_pm string, time_period string, is_business_hours boolean",
    "dim_workspace": f"""
        workspace_sk bigint, workspace_id string, workspace_name string, workspace_type string, capacity_id string, domain string,
        location string, environment string, {_VERSIONED}""",
    "dim_item": f"""
        item_sk bigint, item_id string, item_name string, item_type string, item_category string, platform string, is_fabric_native boolean,
        workspace_id string, workspace_name string, source_type string, source_database string, source_connection_id string, {_VERSIONED}""",
    "dim_user": f"""
        user_sk bigint, user_principal_name string, user_display_name string, user_type string, domain string, department string,
        risk_level string, activity_tier string, {_VERSIONED}""",
    "dim_activity_type": "activity_type_sk int, activity_type string, activity_category string, is_compute_activity boolean, is_fabric_native boolean, description string",
    "dim_status": "status_sk int, status_code string, status_category string, is_terminal boolean, severity int",
    "fact_activity": """
        event_id string, activity_id string, date_sk int, time_sk int, activity_date date, workspace_sk bigint, item_sk bigint, user_sk bigint,
        activity_type_sk int, status_sk int, job_instance_id string, root_activity_id string, invoke_type string, duration_seconds double,
        duration_minutes double, duration_hours double, is_failed int, is_success int, is_long_running int, record_count int,
        source_system string, extracted_at timestamp""",
    "fact_daily_metrics": """
        date_sk int, workspace_sk bigint, total_activities bigint, successful_activities bigint, failed_activities bigint,
        total_duration_seconds double, avg_duration_seconds double, max_duration_seconds double, min_duration_seconds double,
        long_running_count bigint, unique_users bigint, unique_items bigint, success_rate double, failure_rate double""",
    "fact_user_metrics": """
        activity_date date, date_sk int, user_sk bigint, total_activities bigint, failed_activities bigint, total_duration_seconds double,
        unique_workspaces bigint, unique_items bigint, unique_activity_types bigint, failure_rate double, activities_avg double, risk_score double""",
    "lineage_records": """
        `Workspace Name` string, `Workspace ID` string, `Item Name` string, `Item ID` string, `Item Type` string, `Shortcut Name` string,
        `Shortcut Path` string, `Source Type` string, `Source Connection` string, `Source Database` string, `Connection ID` string,
        `Full Definition` string,
        `Mirrored Tables` array<struct<schemaName: string, tableName: string, status: string, processedRows: bigint, lastSyncDateTime: string>>""",
}

PARTITIONS = {"activities": "date", "activities_master": "date", "fact_activity": "activity_date"}


def table_schemas() -> dict[str, StructType]:
    return {name: StructType.fromDDL(" ".join(ddl.split())) for name, ddl in TABLE_DDL.items()}


def create_table(spark: SparkSession, name: str, path: str | None = None, source: str = "parquet") -> DataFrame:
    return spark.catalog.createTable(name, path=path, source=source, schema=table_schemas()[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project onto a registered schema: missing columns become null, types are cast."""
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schemas()[name].fields
        ]
    )
