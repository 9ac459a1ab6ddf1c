"""Report marts over the star schema.

Facts are aggregated by key before any dimension is joined, so joins run on one row per
member, or on one per combination of members where distinct ones are counted over another level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.basics import percent, round_half_even
from tidewatch.operators.facts import Dims
from tidewatch.operators.ranking import top_k


def join_dims(fact: DataFrame, dims: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    """Join a (usually aggregated) fact to dimensions on their keys."""
    for key, dim in dims.items():
        fact = fact.join(dim, key, how)
    return fact


def _m(*names: str) -> list:
    """The named measures of the fact as aggregates."""
    made = {
        "activity_count": F.sum("record_count"), "failed": F.sum("is_failed"), "unique_users": F.countDistinct("user_sk"),
        "unique_items": F.countDistinct("item_sk"), "unique_workspaces": F.countDistinct("workspace_sk"), "total_duration": F.sum("duration_seconds"),
    }
    return [made[n].alias(n) for n in names]


def _failure_rate():
    return round_half_even(percent(F.col("failed"), F.col("activity_count")))


def _met(fact: DataFrame, *keys: str) -> DataFrame:
    """The fact's measures per combination of keys: a smaller fact of the same columns."""
    return fact.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("record_count", "is_failed", "duration_seconds")))


def _by(fact: DataFrame, key: str, *aggs) -> DataFrame:
    return fact.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def top_workspaces(fact: DataFrame, dims: Dims, k: int = 10) -> DataFrame:
    stats = top_k(_by(fact, "workspace_sk", *_m("activity_count", "unique_users", "total_duration", "failed")), [F.desc("activity_count"), "workspace_sk"], k)
    named = join_dims(stats, {"workspace_sk": dims.workspace.select("workspace_sk", "workspace_name", "environment")}, "left")
    return named.withColumns({"duration_hrs": round_half_even(F.col("total_duration") / 3600), "failure_rate": _failure_rate()})


def activity_types(fact: DataFrame, dims: Dims, k: int = 15) -> dict[str, DataFrame]:
    stats = join_dims(
        _by(fact, "activity_type_sk", *_m("activity_count", "failed")),
        {"activity_type_sk": F.broadcast(dims.activity_type.select("activity_type_sk", "activity_type", "activity_category"))},
    ).withColumn("success_rate", round_half_even(100 * (1 - F.col("failed") / F.col("activity_count"))))
    return {
        "top": top_k(stats, [F.desc("activity_count"), "activity_type_sk"], k),
        "with_failures": stats.filter("failed > 0").orderBy(F.desc("failed"), "activity_type_sk"),
    }


def daily_trend(daily: DataFrame, dim_date: DataFrame, k: int = 14) -> DataFrame:
    """Users are summed over workspaces, as the daily fact allows."""
    totals = daily.groupBy("date_sk").agg(
        F.sum("total_activities").alias("total_activities"), F.sum("unique_users").alias("unique_users"),
        F.sum("failed_activities").alias("failed_activities"),
    )
    named = join_dims(totals, {"date_sk": dim_date.select("date_sk", "full_date", "day_of_week_name")})
    return top_k(named, [F.desc("full_date")], k)


def failure_overview(fact: DataFrame, dims: Dims, k: int = 5) -> dict[str, DataFrame]:
    total, failed = F.count(F.lit(1)), F.count_if(F.col("is_failed") == 1)
    bad = fact.filter("is_failed = 1")
    count = lambda key: bad.groupBy(key).agg(F.count(F.lit(1)).alias("failures"))
    kinds = join_dims(count("activity_type_sk"), {"activity_type_sk": F.broadcast(dims.activity_type.select("activity_type_sk", "activity_type"))})
    return {
        "totals": fact.agg(
            total.alias("total_activities"), failed.alias("failed_activities"),
            F.coalesce(percent(total - failed, total), F.lit(0.0)).alias("success_rate"),
        ),
        "by_status": join_dims(count("status_sk"), {"status_sk": F.broadcast(dims.status.select("status_sk", "status_code"))}),
        "top_types": top_k(kinds, [F.desc("failures"), "activity_type"], k),
    }


def top_items(fact: DataFrame, dims: Dims, k: int = 10) -> DataFrame:
    stats = _by(fact, "item_sk", *_m("activity_count", "unique_users", "total_duration", "failed"))
    named = join_dims(stats, {"item_sk": dims.item.select("item_sk", "item_name", "item_type", "item_category")})
    return top_k(named, [F.desc("activity_count"), "item_sk"], k)


def by_hour(fact: DataFrame, dim_time: DataFrame) -> DataFrame:
    slots = _by(fact, "time_sk", *_m("activity_count"))
    named = join_dims(slots, {"time_sk": F.broadcast(dim_time.select("time_sk", "hour_24", "time_period"))})
    return named.groupBy("hour_24", "time_period").agg(F.sum("activity_count").alias("total_activities"))


def top_users(fact: DataFrame, dims: Dims, k: int = 10) -> DataFrame:
    stats = _by(fact, "user_sk", *_m("activity_count", "unique_items", "unique_workspaces", "failed"))
    named = join_dims(stats, {"user_sk": dims.user.select("user_sk", "user_principal_name", "domain", "user_type")})
    return top_k(named, [F.desc("activity_count"), "user_sk"], k)


def by_weekday(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    days = _by(fact, "date_sk", *_m("activity_count", "unique_users", "failed"))
    named = join_dims(days, {"date_sk": dim_date.select("date_sk", "day_of_week", "day_of_week_name", "is_weekend")})
    return named.groupBy("day_of_week", "day_of_week_name", "is_weekend").agg(
        F.sum("activity_count").alias("activity_count"), F.avg("unique_users").alias("unique_users"), F.sum("failed").alias("failed")
    )


def by_environment(fact: DataFrame, dims: Dims) -> DataFrame:
    env = dims.workspace.select("workspace_sk", "environment").distinct()
    stats = join_dims(_met(fact, "workspace_sk", "user_sk", "item_sk"), {"workspace_sk": env}).groupBy("environment").agg(*_m("activity_count", "unique_users", "unique_items", "unique_workspaces", "total_duration", "failed"))
    return stats.withColumns({"duration_hrs": round_half_even(F.col("total_duration") / 3600), "failure_rate": _failure_rate()})


def by_category(fact: DataFrame, dims: Dims) -> DataFrame:
    cat = dims.item.select("item_sk", "item_category").distinct()
    stats = join_dims(_met(fact, "item_sk", "user_sk"), {"item_sk": cat}).groupBy("item_category").agg(*_m("activity_count", "unique_items", "unique_users", "failed"))
    return stats.withColumn("failure_rate", _failure_rate())


def long_running(fact: DataFrame, dims: Dims, k: int = 10) -> DataFrame:
    """The k longest first, then two joins of k rows."""
    longest = top_k(
        fact.filter("is_long_running = 1").select("event_id", "item_sk", "workspace_sk", "duration_seconds"),
        [F.desc("duration_seconds"), "event_id"], k,
    )
    return join_dims(
        longest,
        {"item_sk": dims.item.select("item_sk", "item_name", "item_type"), "workspace_sk": dims.workspace.select("workspace_sk", "workspace_name")},
        "left",
    )


def collaboration(fact: DataFrame, dims: Dims, k: int = 10) -> DataFrame:
    stats = _by(fact, "workspace_sk", *_m("unique_users", "unique_items", "activity_count"))
    named = join_dims(stats, {"workspace_sk": dims.workspace.select("workspace_sk", "workspace_name", "environment")})
    best = top_k(named, [F.desc("unique_users"), "workspace_sk"], k)
    return best.withColumn("activities_per_user", round_half_even(F.try_divide("activity_count", "unique_users"), 1))


def monthly(fact: DataFrame, dim_date: DataFrame, k: int = 12) -> DataFrame:
    dated = join_dims(_met(fact, "date_sk", "user_sk", "item_sk"), {"date_sk": dim_date.select("date_sk", "year", "month_number", "month_name")})
    stats = dated.groupBy("year", "month_number", "month_name").agg(*_m("activity_count", "unique_users", "unique_items", "failed"))
    return top_k(stats, [F.desc("year"), F.desc("month_number")], k).withColumn("failure_rate", _failure_rate())


# ---- SQL samples over registered views ---------------------------------------------
def register_views(fact: DataFrame, dims: Dims, dim_date: DataFrame, dim_time: DataFrame, replace: bool = False) -> None:
    """Name the frames for SQL. Views of these names that the session has already are only replaced if told so."""
    views = {
        "fact_activity": fact, "dim_workspace": dims.workspace, "dim_item": dims.item, "dim_user": dims.user,
        "dim_activity_type": dims.activity_type, "dim_status": dims.status, "dim_date": dim_date, "dim_time": dim_time,
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name) if replace else df.createTempView(name)


def failure_rate_sql(spark: SparkSession, as_of: str, days: int = 7) -> DataFrame:
    """Only the days asked for are read, and they are summed per key before a name is looked up."""
    return spark.sql(
        """
        SELECT w.workspace_name, sum(f.failures) AS failures, sum(f.total) AS total, sum(f.failures) * 100.0D / sum(f.total) AS failure_rate
        FROM (
          SELECT workspace_sk, sum(is_failed) AS failures, sum(record_count) AS total
          FROM fact_activity
          WHERE activity_date >= date_sub(to_date(:as_of), :days)
          GROUP BY workspace_sk
        ) f
        JOIN dim_workspace w ON f.workspace_sk = w.workspace_sk
        GROUP BY w.workspace_name
        """,
        args={"as_of": as_of, "days": days},
    )


def longest_items_sql(spark: SparkSession, k: int = 10) -> DataFrame:
    return spark.sql(
        """
        SELECT i.item_name, i.item_type, w.workspace_name, sum(f.seconds) / 3600 AS total_hours, sum(f.seconds) / sum(f.timed) / 60 AS avg_minutes
        FROM (
          SELECT item_sk, workspace_sk, sum(duration_seconds) AS seconds, count(duration_seconds) AS timed
          FROM fact_activity
          GROUP BY item_sk, workspace_sk
        ) f
        JOIN dim_item i ON f.item_sk = i.item_sk
        JOIN dim_workspace w ON f.workspace_sk = w.workspace_sk
        GROUP BY i.item_name, i.item_type, w.workspace_name
        ORDER BY total_hours DESC, item_name, item_type, workspace_name
        LIMIT :k
        """,
        args={"k": k},
    )


def business_hours_sql(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT t.time_period, t.is_business_hours, count(*) AS activity_count, sum(f.is_failed) AS failures
        FROM fact_activity f JOIN dim_time t ON f.time_sk = t.time_sk
        GROUP BY t.time_period, t.is_business_hours
        """
    )
