"""Derived report columns, flags, buckets, ratings and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import col, first_non_empty
from tidewatch.functions.enrich import display_user


def is_failed(status: Column | str = "status") -> Column:
    """Report-level failure: exactly ``Failed``. Null counts as not failed."""
    return F.coalesce(col(status) == "Failed", F.lit(False))


def derive_report_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "date": F.to_date("start_time"),
            "hour": F.hour("start_time"),
            "duration_minutes": F.col("duration_seconds") / 60,
            "is_failed": is_failed(),
            "is_success": ~is_failed(),
        }
    )


def fact_flags(status: Column | str, duration: Column | str, threshold: float = K.LONG_RUNNING_SECONDS) -> list[Column]:
    """0/1 failed, success and long-running flags as the fact table defines them."""
    text = F.lower(col(status))
    flag = lambda c, name: F.when(c, 1).otherwise(0).alias(name)
    return [
        flag(text.isin(K.FAILED_STATUSES), "is_failed"),
        flag(text.isin(K.SUCCESS_STATUSES), "is_success"),
        flag(col(duration) > threshold, "is_long_running"),
    ]


def date_time_keys(start: Column | str, end: Column | str) -> list[Column]:
    """yyyyMMdd and quarter-hour keys plus the date, from the start or else the end time."""
    event = F.coalesce(col(start), col(end))
    return [
        F.date_format(event, "yyyyMMdd").cast("int").alias("date_sk"),
        (F.hour(event) * 100 + F.floor(F.minute(event) / 15).cast("int") * 15).alias("time_sk"),
        F.to_date(event).alias("activity_date"),
    ]


def error_message(c: Column | str, nested: bool) -> Column:
    return col(c)["message"] if nested else col(c).cast("string")


def error_code(c: Column | str, nested: bool) -> Column:
    return col(c)["errorCode"] if nested else F.when(col(c).isNotNull(), "Unknown")


def analysis_labels(df: DataFrame) -> DataFrame:
    """The labelled view that the failure analyses work on."""
    return df.select(
        F.coalesce("workspace_name", "workspace_id", F.lit("Unknown")).alias("workspace"),
        F.coalesce("item_name", F.lit("Unknown")).alias("item_name"),
        F.coalesce("item_type", F.lit("Unknown")).alias("item_type"),
        F.col("activity_type").alias("invoke_type"),
        "start_time",
        "end_time",
        "duration_seconds",
        F.col("submitted_by").alias("user_id"),
        F.coalesce(display_user("submitted_by"), F.col("submitted_by")).alias("user_name"),
        F.coalesce("failure_reason", "error_message", "error_code", F.lit("Unknown Error")).alias("error_message"),
        "error_code",
        "status",
        "event_id",
    )


# -- fixed values: bucket edges in seconds and their labels --------------------------
REPORT_BUCKETS = [(60, "< 1 min"), (300, "1-5 min"), (900, "5-15 min"), (3600, "15-60 min"), (None, "> 1 hour")]
FAILURE_BUCKETS = [(30, "<30s"), (300, "30s-5m"), (3600, "5m-1h"), (None, ">1h")]


def duration_bucket(c: Column | str, bounds: Sequence[tuple[float | None, str]] = REPORT_BUCKETS, closed: str = "left") -> Column:
    """Label of the first bucket below its upper edge (``closed='right'`` includes the edge)."""
    chain = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for edge, label in bounds:
        if edge is None:
            return chain.otherwise(label)
        chain = chain.when(col(c) < edge if closed == "left" else col(c) <= edge, label)
    return chain


def user_risk(rate: Column | str, n: Column | str) -> Column:
    return (
        F.when((col(rate) < 70) | (col(n) > 100), "High")
        .when((col(rate) < 85) | (col(n) > 50), "Medium")
        .otherwise("Low")
    )


def severity(n: Column | str) -> Column:
    return F.when(col(n) > 10, "High").when(col(n) > 5, "Medium").otherwise("Low")


def rate_colour(c: Column | str) -> Column:
    return F.when(col(c) >= 99, K.GREEN).when(col(c) >= 95, K.YELLOW).otherwise(K.RED)


def failure_colour(c: Column | str) -> Column:
    count = F.coalesce(col(c), F.lit(0))
    return F.when(count == 0, K.GREEN).when(count <= 10, K.YELLOW).otherwise(K.RED)


def trend_mark(c: Column | str) -> Column:
    return F.when(col(c) > 0, K.TREND_UP).when(col(c) < 0, K.TREND_DOWN).otherwise(K.TREND_FLAT)


def trend_colour(c: Column | str) -> Column:
    """Blank compares as zero, so a missing change is green."""
    return F.when(F.coalesce(col(c), F.lit(0.0)) >= 0, K.GREEN).otherwise(K.RED)


def calendar_flags(date: Column | str, today: Column | str, environment: Column | str | None = None) -> list[Column]:
    flags = [
        (F.weekday(col(date)) >= 5).alias("is_weekend"),
        (col(date) == col(today)).alias("is_today"),
        F.datediff(col(today), col(date)).alias("days_ago"),
    ]
    if environment is not None:
        flags.append((col(environment) == "PRD").alias("is_production"))
    return flags


def label_or_unknown(*cols: Column | str) -> Column:
    return F.coalesce(first_non_empty(cols), F.lit("Unknown"))
