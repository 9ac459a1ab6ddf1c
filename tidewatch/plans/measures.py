"""BI measures over the fact, each for any list of group columns.

The as-of date is an argument, so results repeat. A zero denominator gives null unless the
measure is defined to give zero. Measures of one family share one aggregate over one scan:
periods are conditional sums, not one filtered query each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.labels import failure_colour, rate_colour, trend_colour, trend_mark
from tidewatch.operators.ranking import dense_rank_desc, peak_hour as _peak_hour, top_k

def _sum(condition: Column | None = None) -> Column:
    """Sum of the record count under a condition; null when nothing matches."""
    rows = F.col("record_count")
    return F.sum(rows if condition is None else F.when(condition, rows))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole) * 100)


def total() -> Column:
    return _sum()


def failed() -> Column:
    return _sum(F.col("is_failed") == 1)


def totals(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return fact.groupBy(*by).agg(
        total().alias("total_activities"), failed().alias("failed_activities"),
        _sum(F.col("is_failed") == 0).alias("successful_activities"),
    )


def rates(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    bad = F.coalesce(failed(), F.lit(0))
    return fact.groupBy(*by).agg(_pct(total() - bad, total()).alias("success_rate"), _pct(failed(), total()).alias("failure_rate"))


def _distinct_with_blank(c: str) -> Column:
    return F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def active_counts(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A blank counts as one value."""
    return fact.groupBy(*by).agg(
        _distinct_with_blank("user_sk").alias("active_users"),
        _distinct_with_blank("workspace_sk").alias("active_workspaces"),
        _distinct_with_blank("item_sk").alias("active_items"),
    )


def durations(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    d = F.col("duration_seconds")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return fact.groupBy(*by).agg(
        zero(F.sum(d) / 3600).alias("total_duration_hours"), zero(F.sum(d) / 60).alias("total_duration_minutes"),
        zero(F.avg(d) / 60).alias("avg_duration_minutes"), F.avg(d).alias("avg_duration_seconds"),
        zero(F.max(d) / 3600).alias("max_duration_hours"),
    )


def long_running_rate(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    slow = _sum(F.col("is_long_running") == 1)
    return fact.groupBy(*by).agg(slow.alias("long_running_activities"), _pct(slow, total()).alias("long_running_rate"))


# ---- time intelligence -------------------------------------------------------------
class Periods:
    """Inclusive date ranges around an as-of date."""

    def __init__(self, as_of):
        day = F.lit(as_of).cast("date")
        month = F.trunc(day, "month")
        previous = F.add_months(month, -1)
        self.ranges = {
            "activities_today": (day, day),
            "activities_yesterday": (F.date_sub(day, 1), F.date_sub(day, 1)),
            "activities_last_7": (F.date_sub(day, 6), day),
            "activities_last_28": (F.date_sub(day, 27), day),
            "activities_previous_7": (F.date_sub(day, 13), F.date_sub(day, 7)),
            "activities_mtd": (month, day),
            "activities_previous_month": (previous, F.last_day(previous)),
            "activities_ytd": (F.trunc(day, "year"), day),
            "_previous_mtd": (previous, F.least(F.date_add(previous, F.dayofmonth(day) - 1), F.last_day(previous))),
        }

    def value(self, name: str) -> Column:
        first, last = self.ranges[name]
        return _sum(F.col("activity_date").between(first, last)).alias(name)

    def span(self, *names: str) -> Column:
        """Filter that covers the named ranges, so partitions outside are not read."""
        firsts, lasts = zip(*[self.ranges[n] for n in names])
        low = F.least(*firsts) if len(firsts) > 1 else firsts[0]
        high = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
        return F.col("activity_date").between(low, high)


def period_table(fact: DataFrame, as_of, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    p = Periods(as_of)
    return fact.filter(p.span(*names)).groupBy(*by).agg(*[p.value(n) for n in names])


def day_values(fact: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    return period_table(fact, as_of, ["activities_today", "activities_yesterday"], by)


def period_values(fact: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    return period_table(fact, as_of, ["activities_last_7", "activities_last_28", "activities_previous_7"], by)


def _change(new: str, old: str) -> Column:
    now = F.coalesce(F.col(new), F.lit(0))
    return F.when(F.col(old) > 0, F.try_divide(now - F.col(old), F.col(old)) * 100)


def change_pct(fact: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    names = ["activities_today", "activities_yesterday", "activities_last_7", "activities_previous_7"]
    return period_table(fact, as_of, names, by).withColumns(
        {
            "dod_change_pct": _change("activities_today", "activities_yesterday"),
            "wow_change_pct": _change("activities_last_7", "activities_previous_7"),
        }
    )


def to_date_values(fact: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    return period_table(fact, as_of, ["activities_mtd", "activities_previous_month", "activities_ytd"], by)


def mom_pct(fact: DataFrame, as_of, by: Sequence[str] = ()) -> DataFrame:
    table = period_table(fact, as_of, ["activities_mtd", "_previous_mtd"], by)
    return table.withColumn("mom_change_pct", _change("activities_mtd", "_previous_mtd")).withColumnRenamed("_previous_mtd", "previous_mtd")


# ---- by attribute ------------------------------------------------------------------
def by_environment_values(fact: DataFrame, dim_workspace: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts are pre-aggregated per workspace, then the environment is attached.

    A blank environment is not production, so it counts on the non-production side."""
    per_ws = fact.groupBy(*by, "workspace_sk").agg(total().alias("n"), F.coalesce(failed(), F.lit(0)).alias("f"))
    env = per_ws.join(dim_workspace.select("workspace_sk", "environment"), "workspace_sk", "left")
    n = lambda e: F.sum(F.when(F.col("environment") == e, F.col("n")))
    prd_failed = F.sum(F.when(F.col("environment") == "PRD", F.col("f")))
    return env.groupBy(*by).agg(
        n("PRD").alias("production_activities"), n("UAT").alias("uat_activities"), n("TEST").alias("test_activities"),
        n("DEV").alias("development_activities"), _pct(prd_failed, n("PRD")).alias("production_failure_rate"),
        F.sum(F.when(~F.col("environment").eqNullSafe("PRD"), F.col("n"))).alias("non_production_activities"),
    )


def by_category_values(fact: DataFrame, dim_activity_type: DataFrame, cats: Sequence[str] = tuple(K.MEASURE_CATEGORIES), by: Sequence[str] = (), attribute: str = "activity_category", key: str = "activity_type_sk") -> DataFrame:
    """One column per category. Pass the item dimension with ``attribute='item_type'`` and
    ``key='item_sk'`` to filter on item types instead."""
    per_key = fact.groupBy(*by, key).agg(total().alias("n"))
    named = per_key.join(dim_activity_type.select(key, attribute), key, "left")
    return named.groupBy(*by).agg(
        *[F.sum(F.when(F.col(attribute) == c, F.col("n"))).alias(f"{c.lower()}_activities") for c in cats]
    )


def per_member_avg(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    zero = lambda c: F.coalesce(F.try_divide(total(), c), F.lit(0.0))
    return fact.groupBy(*by).agg(
        zero(_distinct_with_blank("user_sk")).alias("activities_per_user"),
        zero(_distinct_with_blank("workspace_sk")).alias("activities_per_workspace"),
    )


def top_user_value(fact: DataFrame, dim_user: DataFrame) -> DataFrame:
    per_user = fact.filter("user_sk is not null").groupBy("user_sk").agg(total().alias("total_activities"))
    return per_user.join(dim_user.select("user_sk", "user_principal_name"), "user_sk").select("user_principal_name", "total_activities")


def user_rank(fact: DataFrame, dim_user: DataFrame) -> DataFrame:
    return dense_rank_desc(top_user_value(fact, dim_user), "total_activities", "user_rank")


def workspace_rank(fact: DataFrame, dim_workspace: DataFrame) -> DataFrame:
    per_ws = fact.filter("workspace_sk is not null").groupBy("workspace_sk").agg(total().alias("n"))
    named = per_ws.join(dim_workspace.select("workspace_sk", "workspace_name"), "workspace_sk")
    by_name = named.groupBy("workspace_name").agg(F.sum("n").alias("total_activities"))
    return dense_rank_desc(by_name, "total_activities", "workspace_rank")


def hours_split(fact: DataFrame, dim_time: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per_slot = fact.groupBy(*by, "time_sk").agg(total().alias("n"))
    named = per_slot.join(F.broadcast(dim_time.select("time_sk", "is_business_hours")), "time_sk", "left")
    return named.groupBy(*by).agg(
        F.sum(F.when(F.col("is_business_hours"), F.col("n"))).alias("business_hours_activities"),
        F.sum(F.when(~F.col("is_business_hours"), F.col("n"))).alias("off_hours_activities"),
    )


def peak_hour(fact: DataFrame, dim_time: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    per_slot = fact.filter("time_sk is not null").groupBy(*by, "time_sk").agg(total().alias("n"))
    hourly = per_slot.join(F.broadcast(dim_time.select("time_sk", "hour_24")), "time_sk").groupBy(*by, "hour_24").agg(F.sum("n").alias("total_activities"))
    return _peak_hour(hourly, by=by)


def daily_series(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Every calendar day, null where nothing happened."""
    daily = fact.groupBy("date_sk").agg(total().alias("total_activities"))
    return dim_date.select("date_sk", "full_date").join(daily, "date_sk", "left")


def run_counts(fact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ok = _sum(F.col("is_success") == 1)
    return fact.groupBy(*by).agg(
        _sum(F.col("invoke_type") == "Scheduled").alias("scheduled_runs"), _pct(F.coalesce(ok, F.lit(0)), total()).alias("completed_rate"),
        total().alias("total_activities"),
    )


# ---- movers and leaders ------------------------------------------------------------
def movers(fact: DataFrame, dims: dict[str, DataFrame], as_of, by: str, k: int = 15, order: str = "wow_change_pct", best: bool = True) -> DataFrame:
    """The k members of one dimension with the largest (or smallest) change, nulls last.

    ``dims`` maps the key column to (key, label) frames; only k rows are joined."""
    changed = change_pct(fact.filter(F.col(by).isNotNull()), as_of, [by])
    first = F.desc_nulls_last(order) if best else F.asc_nulls_last(order)
    return top_k(changed, [first, by], k).join(dims[by], by, "left")


def period_leaders(fact: DataFrame, dims: dict[str, DataFrame], as_of, by: str, k: int = 15, order: str = "activities_mtd") -> DataFrame:
    """MTD, YTD, MoM, hours and long-running counts per member, the k greatest by ``order``."""
    p = Periods(as_of)
    names = ["activities_mtd", "activities_ytd", "_previous_mtd"]
    table = (
        fact.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            *[p.value(n) for n in names],
            (F.sum("duration_seconds") / 3600).alias("total_duration_hours"),
            _sum(F.col("is_long_running") == 1).alias("long_running_activities"),
        )
        .withColumn("mom_change_pct", _change("activities_mtd", "_previous_mtd"))
        .drop("_previous_mtd")
    )
    return top_k(table, [F.desc_nulls_last(order), by], k).join(dims[by], by, "left")


def scorecard(fact: DataFrame, as_of, by: Sequence[str]) -> DataFrame:
    """Rates with their colours and trend marks."""
    table = fact.groupBy(*by).agg(
        _pct(total() - F.coalesce(failed(), F.lit(0)), total()).alias("success_rate"),
        F.coalesce(failed(), F.lit(0)).alias("failed_activities"),
        *[Periods(as_of).value(n) for n in ("activities_today", "activities_yesterday")],
    ).withColumn("dod_change_pct", _change("activities_today", "activities_yesterday"))
    return table.withColumns(
        {
            "success_colour": rate_colour("success_rate"), "failure_colour": failure_colour("failed_activities"),
            "trend_mark": trend_mark("dod_change_pct"), "trend_colour": trend_colour("dod_change_pct"),
        }
    )
