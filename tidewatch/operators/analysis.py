"""Interactive and failure analyses (workspace, user, error, duration, heat-map views)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import percent
from tidewatch.functions.labels import FAILURE_BUCKETS, duration_bucket, is_failed
from tidewatch.operators.quantiles import exact_quantiles, quantile_columns
from tidewatch.operators.ranking import grand_total, top_k
from tidewatch.session import cut_lineage

def rows_n() -> Column:
    return F.count(F.lit(1))


def _n(name: str = "activity_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _failed(name: str = "failures") -> Column:
    return F.count_if(is_failed()).alias(name)


def _drop_null(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


# ---- A24 to A29 --------------------------------------------------------------------
def overview(df: DataFrame) -> DataFrame:
    """Distinct counts and positive-duration statistics in one aggregate."""
    user = F.when(~F.col("submitted_by").isin("System", ""), F.col("submitted_by"))
    positive = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    return df.agg(
        _n("total_activities"),
        F.countDistinct("workspace_name").alias("unique_workspaces"),
        F.countDistinct("item_name").alias("unique_items"),
        F.countDistinct("item_type").alias("unique_item_types"),
        F.countDistinct("activity_type").alias("unique_activity_types"),
        F.countDistinct(user).alias("unique_users"),
        F.count(positive).alias("with_duration"),
        F.avg(positive).alias("avg_duration"),
        F.max(positive).alias("max_duration"),
        F.min(positive).alias("min_duration"),
    )


def status_breakdown(df: DataFrame) -> DataFrame:
    total = grand_total(df, rows_n())
    counts = df.groupBy(F.coalesce("status", F.lit("Unknown")).alias("status")).agg(_n())
    return counts.withColumn("share_percent", percent(F.col("activity_count"), total))


def workspace_activity(df: DataFrame, k: int = 20) -> DataFrame:
    counts = _drop_null(df, "workspace_name").groupBy("workspace_name").agg(
        _n(),
        F.countDistinct("item_name").alias("unique_items"),
        F.countDistinct("activity_type").alias("unique_activity_types"),
        F.countDistinct("submitted_by").alias("unique_users"),
    )
    return top_k(counts, [F.desc("activity_count"), "workspace_name"], k)


def failures_by(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    counts = _drop_null(df.filter(is_failed()), *cols).groupBy(*cols).agg(_n("failure_count"))
    return top_k(counts, [F.desc("failure_count"), *cols], k)


def user_activity(df: DataFrame, k: int = 20, by: str = "activity_count") -> DataFrame:
    """Most active users, or those with most failures with ``by='failures'``."""
    named = df.filter(F.col("submitted_by").isNotNull() & ~F.col("submitted_by").isin("System", ""))
    counts = named.groupBy("submitted_by").agg(_n(), _failed(), F.count_if(F.col("status") == "Succeeded").alias("successes"))
    if by == "failures":
        counts = counts.filter("failures > 0")
    return top_k(counts, [F.desc(by), "submitted_by"], k)


def failure_reasons(df: DataFrame, k: int = 15) -> DataFrame:
    failed = df.filter(is_failed() & F.col("failure_reason").isNotNull())
    total = grand_total(failed, rows_n())
    counts = failed.groupBy("failure_reason").agg(_n("failure_count"))
    return top_k(
        counts.withColumn("share_percent", percent(F.col("failure_count"), total)), [F.desc("failure_count"), "failure_reason"], k
    )


def time_duration(df: DataFrame, k: int = 15, longest: int = 10) -> dict[str, DataFrame]:
    """Newest days, durations by status, and the longest activities."""
    by_date = _drop_null(df, "start_time").groupBy(F.to_date("start_time").alias("date")).agg(
        _n(), _failed(), F.count_if(F.col("status") == "Succeeded").alias("successes")
    )
    timed = df.filter(F.col("duration_seconds") > 0)
    return {
        "by_date": top_k(by_date, [F.desc("date")], k),
        "by_status": timed.groupBy("status").agg(
            _n(), F.avg("duration_seconds").alias("avg_duration"), F.max("duration_seconds").alias("max_duration"),
            F.min("duration_seconds").alias("min_duration"),
        ),
        "longest": top_k(
            timed.select("event_id", "workspace_name", "item_name", "item_type", "status", "duration_seconds"),
            [F.desc("duration_seconds"), "event_id"], longest,
        ),
    }


# ---- A30 ---------------------------------------------------------------------------
def job_analysis(jobs: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    failed = F.col("job_status") == "Failed"
    minutes = F.timestamp_diff("MICROSECOND", F.col("job_start_time"), F.col("job_end_time")) / 60e6
    bad = jobs.filter(failed)
    return {
        "summary": jobs.agg(
            _n("total_runs"), F.count_if(failed).alias("failed_runs"),
            percent(rows_n() - F.count_if(failed), rows_n()).alias("success_percent"),
            F.avg(minutes).alias("avg_minutes"), F.max(minutes).alias("max_minutes"),
        ),
        "top_items": top_k(_drop_null(bad, "item_id").groupBy("item_id").agg(_n("failure_count")), [F.desc("failure_count"), "item_id"], k),
        "top_reasons": top_k(
            _drop_null(bad, "job_failure_reason").groupBy("job_failure_reason").agg(_n("failure_count")),
            [F.desc("failure_count"), "job_failure_reason"], k,
        ),
    }


# ---- A32 to A37 --------------------------------------------------------------------
def _kpis() -> list[Column]:
    return [
        _n("total_activities"),
        _failed("failed_activities"),
        percent(rows_n() - F.count_if(is_failed()), rows_n()).alias("success_rate"),
        (F.avg("duration_seconds") / 60).alias("avg_duration_minutes"),
        (F.sum("duration_seconds") / 3600).alias("total_duration_hours"),
    ]


def workspace_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("workspace_id", "workspace_name").agg(
        *_kpis(),
        F.countDistinct("submitted_by").alias("unique_users"),
        F.countDistinct("item_id").alias("unique_items"),
        F.min("start_time").alias("first_activity"),
        F.max("start_time").alias("last_activity"),
    )


def user_summary(df: DataFrame) -> DataFrame:
    """Per user, with the most used item type (alphabetically first on a tie).

    Item types are counted per user before the winner is picked, so no group is held whole.
    """
    used = _drop_null(df, "item_type").groupBy("submitted_by", "item_type").agg(_n("n"))
    favourite = used.groupBy("submitted_by").agg(F.min_by("item_type", F.struct(-F.col("n"), "item_type")).alias("most_used_item_type"))
    base = df.groupBy("submitted_by").agg(
        *_kpis(), F.countDistinct("workspace_id").alias("unique_workspaces"), F.countDistinct("item_id").alias("unique_items")
    )
    joined = base.join(favourite.withColumnRenamed("submitted_by", "_u"), F.col("submitted_by").eqNullSafe(F.col("_u")), "left")
    return joined.drop("_u")


def item_type_performance(df: DataFrame, probs: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    keys = ["item_type", "activity_type"]
    kept = _drop_null(df, *keys)
    base = kept.groupBy(*keys).agg(*_kpis(), F.max("duration_seconds").alias("max_duration"))
    names = {f"p{int(p * 100)}_duration": p for p in probs}
    return base.join(quantile_columns(kept, keys, "duration_seconds", names), keys, "left")


def heatmap_rows(df: DataFrame, rows: Sequence[str], cols: str) -> DataFrame:
    """Counts per cell as rows, for any number of columns; empty cells have no row."""
    return _drop_null(df, *rows, cols).groupBy(*rows, cols).agg(_n("count"))


def heatmap(df: DataFrame, rows: Sequence[str], cols: str, values: Sequence) -> DataFrame:
    """Zero-filled pivot of counts over the given values; :func:`heatmap_rows` where they aren't known."""
    return _drop_null(df, *rows, cols).groupBy(*rows).pivot(cols, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def hourly_pivot(df: DataFrame, types: Sequence[str]) -> DataFrame:
    return heatmap(df.withColumn("hour", F.hour("start_time")), ["hour"], "item_type", types)


def error_distribution(df: DataFrame) -> DataFrame:
    return df.filter(is_failed()).groupBy("error_code", "error_message").agg(
        _n("occurrence_count"),
        F.countDistinct("workspace_id").alias("affected_workspaces"),
        F.countDistinct("item_id").alias("affected_items"),
        F.min("start_time").alias("first_occurrence"),
        F.max("start_time").alias("last_occurrence"),
    )


def custom_report(df: DataFrame, dims: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """Any dimensions with any named aggregate expressions; the user extension point."""
    return _drop_null(df, *dims).groupBy(*dims).agg(*[c.alias(n) for n, c in metrics.items()])


# ---- A38, A39: over labelled failures ----------------------------------------------
def failure_stats(df: DataFrame, k: int = 10, newest: int = 20) -> dict[str, DataFrame]:
    count = lambda *c: df.groupBy(*c).agg(_n("failure_count"))
    item = ["workspace", "item_name", "item_type"]
    return {
        "summary": df.agg(
            _n("total_failures"), F.countDistinct("workspace").alias("unique_workspaces"), F.countDistinct("item_name").alias("unique_items")
        ),
        "top_items": top_k(count(*item), [F.desc("failure_count"), *item], k),
        "by_user": count("user_name").filter("user_name is not null"),
        "by_message": count("error_message"),
        "newest": top_k(
            df.select("event_id", "start_time", "workspace", "item_name", "user_name", "error_message"),
            [F.desc_nulls_last("start_time"), "event_id"], newest,
        ),
    }


# ---- fixed values: reported percentiles and thresholds in seconds -------------------
PERCENTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
QUICK_SECONDS, SLOW_SECONDS = 30, 300


def duration_percentiles(df: DataFrame, probs: Sequence[float] = tuple(PERCENTILES)) -> DataFrame:
    """Rows (prob, quantile) over positive durations, linearly interpolated."""
    return exact_quantiles(df.filter("duration_seconds > 0"), [], "duration_seconds", probs)


def duration_statistics(df: DataFrame) -> DataFrame:
    timed = df.filter("duration_seconds > 0")
    d = F.col("duration_seconds")
    median = exact_quantiles(timed, [], "duration_seconds", [0.5]).select("quantile").scalar()
    return timed.agg(
        _n("with_duration"), F.avg(d).alias("mean"), F.min(d).alias("min"), F.max(d).alias("max"),
        F.count_if(d <= QUICK_SECONDS).alias("quick_count"), F.count_if(d >= SLOW_SECONDS).alias("long_count"),
    ).withColumn("median", median)


def longest(df: DataFrame, k: int = 10) -> DataFrame:
    timed = df.filter("duration_seconds > 0").select("event_id", "workspace", "item_name", "item_type", "duration_seconds")
    return top_k(timed, [F.desc("duration_seconds"), "event_id"], k)


# ---- A41 to A49 --------------------------------------------------------------------
def mean_duration(df: DataFrame, by: str = "item_type") -> DataFrame:
    return _drop_null(df.filter("duration_seconds > 0"), by).groupBy(by).agg(F.avg("duration_seconds").alias("mean_duration"))


def hierarchy_counts(df: DataFrame, levels: Sequence[str] = ("workspace", "item_type", "item_name")) -> DataFrame:
    """Counts at every level of a hierarchy (rollup); null marks a collapsed level."""
    return df.rollup(*levels).agg(_n("failures"), F.grouping_id().cast("int").alias("level"))


def top_error_timeline(df: DataFrame, k: int = 5) -> DataFrame:
    counts = df.groupBy("error_message").agg(_n("n"))
    leading = top_k(counts, [F.desc("n"), "error_message"], k).select("error_message")
    daily = _drop_null(df, "start_time").groupBy(F.to_date("start_time").alias("date"), "error_message").agg(_n("failure_count"))
    return daily.join(leading, "error_message", "left_semi")


def factor_correlation(df: DataFrame, cats: Sequence[str], value: str = "duration_seconds") -> DataFrame:
    """Pearson correlation of a number with alphabetically encoded categories.

    Codes come from the distinct values alone (joined back by value); the correlation is an
    algebraic aggregate.
    """
    out = df.filter(F.col(value).isNotNull())
    for c in cats:
        out = out.join(encode_labels(out, c), c)
    return out.agg(*[F.corr(value, f"{c}_code").alias(c) for c in cats])


def encode_labels(df: DataFrame, c: str) -> DataFrame:
    """(value, value_code): the alphabetical position of each distinct value, from 0.

    The distinct values are sorted by range and written with the number of their range and their place in
    it; ranges are counted, and a range starts where those before it end.
    """
    from pyspark.sql import Window as W

    values = df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(values, "labels").select(c, F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, "_range").select(c, (F.col("_before") + F.col("_i")).cast("double").alias(f"{c}_code"))


def bipartite_weights(df: DataFrame, a: str = "workspace", b: str = "item_type", min_w: int = 1) -> DataFrame:
    return df.groupBy(a, b).agg(_n("weight")).filter(F.col("weight") > min_w)


#: Messages among which the bound of the co-occurrence search is found, and messages of a group that one cell pairs.
LEADING, PAIR_BLOCK = 64, 256


def error_cooccurrence(df: DataFrame, width: str = "1 hour", k: int = 10, leading: int = LEADING, block: int = PAIR_BLOCK) -> DataFrame:
    """The k most frequent pairs of different errors of one user in one time window, ties by message.

    A pair is at most as frequent as its rarer message. Pairs among the most frequent messages are counted first; the
    k-th of them is a bound, and rarer messages can't be in the answer. What is left of a user's window is dealt into
    blocks, and each two blocks are a group of their own, so that a window with very many messages is spread.
    """
    group = ["user_name", "w"]
    seen = (
        df.filter("user_name is not null and start_time is not null")
        .select("user_name", F.window("start_time", width)["start"].alias("w"), "error_message")
        .distinct()
    )
    seen = cut_lineage(seen, "seen-errors")
    counts = seen.groupBy("error_message").agg(_n("n"))
    first = top_k(counts, [F.desc("n"), "error_message"], leading).select("error_message")
    bound = top_k(_pairs(seen.join(first, "error_message"), group, block), [F.desc("pair_count")], k).agg(F.count(F.lit(1)).alias("c"), F.min("pair_count").alias("least")).first()
    kept = seen if bound["c"] < k else seen.join(counts.filter(F.col("n") >= bound["least"]), "error_message", "left_semi")
    return top_k(_pairs(kept, group, block), [F.desc("pair_count"), "error_message", "other_message"], k)


def _pairs(seen: DataFrame, group: list[str], block: int) -> DataFrame:
    """(error_message, other_message, pair_count): in how many groups two messages are. A cell pairs two blocks of a group."""
    blocks = seen.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = seen.join(blocks, group).withColumn("_own", F.pmod(F.xxhash64("error_message"), F.col("_blocks")).cast("int"))
    left = dealt.select(*group, "error_message", F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"))
    right = dealt.select(*group, F.col("error_message").alias("other"), F.explode(F.sequence(F.lit(0), "_own")).alias("_i"), F.col("_own").alias("_j"))
    met = left.join(right, [*group, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("error_message") < F.col("other")))
    named = met.select(F.least("error_message", "other").alias("error_message"), F.greatest("error_message", "other").alias("other_message"))
    return named.groupBy("error_message", "other_message").agg(_n("pair_count"))


def executive_metrics(df: DataFrame) -> DataFrame:
    d = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    days = F.datediff(F.max("start_time"), F.min("start_time")) + 1
    median = exact_quantiles(df.filter("duration_seconds > 0"), [], "duration_seconds", [0.5]).select("quantile").scalar()
    return df.agg(
        _n("total_failures"),
        F.countDistinct("workspace").alias("unique_workspaces"),
        F.countDistinct("user_name").alias("unique_users"),
        F.countDistinct("item_name").alias("unique_items"),
        days.alias("analysis_period_days"),
        F.try_divide(rows_n(), days).alias("daily_avg_failures"),
        F.coalesce(percent(F.count(d), rows_n()), F.lit(0.0)).alias("duration_coverage"),
        F.avg(d).alias("avg_failure_duration"),
        F.max(d).alias("max_failure_duration"),
    ).withColumn("median_failure_duration", median)


def duration_distribution(df: DataFrame) -> DataFrame:
    timed = df.filter("duration_seconds > 0")
    bucket = duration_bucket("duration_seconds", FAILURE_BUCKETS, closed="right")
    return timed.groupBy(bucket.alias("bucket")).agg(_n("failures"))


def user_impact(df: DataFrame) -> DataFrame:
    per_user = _drop_null(df, "user_name").groupBy("user_name").agg(_n("n"))
    bucket = (
        F.when(F.col("n") == 1, "1 failure").when(F.col("n") <= 5, "2-5 failures")
        .when(F.col("n") <= 10, "6-10 failures").otherwise(">10 failures")
    )
    return per_user.groupBy(bucket.alias("bucket")).agg(_n("users"))


def worst_performers(df: DataFrame) -> DataFrame:
    """The leading workspace, user and item type, one row each."""

    def worst(c: str, role: str) -> DataFrame:
        counts = _drop_null(df, c).groupBy(F.col(c).alias("name")).agg(_n("failures"))
        return top_k(counts, [F.desc("failures"), "name"], 1).withColumn("role", F.lit(role))

    return worst("workspace", "worst_workspace").unionByName(worst("user_name", "most_errors_user")).unionByName(worst("item_type", "worst_item_type"))


def top_with_share(df: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    total = grand_total(df, rows_n())
    counts = df.groupBy(*by).agg(_n("failure_count")).withColumn("share_percent", percent(F.col("failure_count"), total))
    return top_k(counts, [F.desc("failure_count"), *by], k)


def distinct_executions(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Executions rather than events: several events can share one root activity."""
    run = F.coalesce("root_activity_id", "event_id")
    return df.groupBy(*by).agg(_n("events"), F.countDistinct(run).alias("executions"))


# ---- A51, A52 ----------------------------------------------------------------------
def inventory_by_type(items: DataFrame) -> DataFrame:
    return items.groupBy("workspace_id", "item_type").agg(_n("items"))


def inventory_health(items: DataFrame, jobs: DataFrame, recent_since) -> DataFrame:
    """One row: item and job totals, a 0-3 score and its percentage.

    A point each for having items, items with jobs, and a job since ``recent_since``.
    """
    ran = jobs.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max("job_start_time").alias("last_run"), _n("runs"))
    known = items.select("item_id").distinct()
    facts = known.join(ran, "item_id", "left").agg(
        _n("total_items"),
        F.count("runs").alias("items_with_jobs"),
        F.count_if(F.col("last_run") >= F.lit(recent_since)).alias("items_with_recent_jobs"),
    )
    point = lambda c: F.when(F.col(c) > 0, 1).otherwise(0)
    score = point("total_items") + point("items_with_jobs") + point("items_with_recent_jobs")
    return facts.withColumn("health_score", score).withColumn("health_percent", F.col("health_score") / 3 * 100)


def workspace_health(workspaces: DataFrame, items: DataFrame, jobs: DataFrame, recent_since) -> DataFrame:
    """Per workspace: items, items with jobs, recent jobs, a score of 0-3 and what is amiss.

    Two points for items with jobs, one for items without, and one more for a recent job. ``workspaces`` has
    workspace_id and workspace_name, ``items`` item_id and workspace_id.
    """
    ran = jobs.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(_n("runs"), F.count_if(F.col("job_start_time") >= F.lit(recent_since)).alias("recent"))
    counts = items.select("workspace_id", "item_id").distinct().join(ran, "item_id", "left").groupBy("workspace_id").agg(
        _n("total_items"), F.count("runs").alias("monitorable_items"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent_jobs")
    )
    out = workspaces.join(counts, "workspace_id", "left").na.fill(0, ["total_items", "monitorable_items", "recent_jobs"])
    none, idle = F.col("total_items") == 0, F.col("monitorable_items") == 0
    base = F.when(none, 0).when(idle, 1).otherwise(2)
    return out.withColumn("health_score", base + F.when(F.col("recent_jobs") > 0, 1).otherwise(0)).withColumns({
        "health_percent": F.col("health_score") / 3 * 100,
        "issue": F.when(none, "no items").when(idle, "no items with jobs"),
    })


def health_recommendations(health: DataFrame) -> DataFrame:
    """(type, priority, affected, total) for what the workspaces' health calls for: activity, coverage, health."""
    h = health.agg(
        F.sum("recent_jobs").alias("jobs"), F.sum("monitorable_items").alias("covered"), F.sum("total_items").alias("items"),
        F.count_if(F.col("health_percent") < 50).alias("low"), _n("workspaces"),
    )
    row = lambda due, kind, priority, affected, total: F.when(
        due, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.col(affected).cast("bigint").alias("affected"), F.col(total).cast("bigint").alias("total"))
    )
    rows = F.array(
        row(F.coalesce("jobs", F.lit(0)) == 0, "activity", "high", "workspaces", "workspaces"),
        row(F.col("covered") < F.col("items") * 0.5, "coverage", "medium", "covered", "items"),
        row(F.col("low") > 0, "health", "medium", "low", "workspaces"),
    )
    return h.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def merge_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a merge repaired: end times, durations and the match rate, from two aggregates."""
    zero = F.coalesce(F.col("duration_seconds"), F.lit(-1.0)) == 0
    b = before.agg(F.count_if(F.col("end_time").isNull()).alias("e"), F.count_if(zero).alias("z"))
    a = after.agg(
        _n("rows"), F.count_if(F.col("end_time").isNull()).alias("missing_end_after"),
        F.count_if(zero).alias("zero_duration_after"), F.count("job_status").alias("matched"),
    )
    return (
        a.withColumn("missing_end_before", b.select("e").scalar())
        .withColumn("zero_duration_before", b.select("z").scalar())
        .withColumn("fixed_end_times", F.col("missing_end_before") - F.col("missing_end_after"))
        .withColumn("restored_durations", F.greatest(F.lit(0), F.col("zero_duration_before") - F.col("zero_duration_after")))
        .withColumn("match_rate", F.try_divide("matched", "rows"))
    )
