"""Fact tables and their aggregates."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import percent, round_half_even, spread_nulls, surrogate_key
from tidewatch.functions.labels import date_time_keys, fact_flags
from tidewatch.operators import dimensions as D
from tidewatch.operators.ranking import trailing_avg
from tidewatch.session import cut_lineage


class Dims(NamedTuple):
    workspace: DataFrame
    item: DataFrame
    user: DataFrame
    activity_type: DataFrame
    status: DataFrame


def build_dims(acts: DataFrame, lineage: DataFrame | None = None, as_of=None) -> Dims:
    spark = acts.sparkSession
    return Dims(
        D.dim_workspace(acts, as_of=as_of), D.dim_item(acts, lineage, as_of=as_of), D.dim_user(acts, as_of=as_of),
        D.dim_activity_type(spark), D.dim_status(spark),
    )


def stored(dims: Dims) -> Dims:
    """The growing dimensions as written tables, so that joins to them are planned by their
    true size: broadcast when small, shuffled otherwise. The three are written at once."""
    growing = ("workspace", "item", "user")
    with ThreadPoolExecutor(len(growing)) as pool:
        written = list(pool.map(lambda name: cut_lineage(getattr(dims, name), f"dim_{name}"), growing))
    return dims._replace(**dict(zip(growing, written, strict=True)))


def _current(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current") if "is_current" in dim.columns else dim


def resolve_keys(df: DataFrame, dims: Dims) -> DataFrame:
    """Add the five dimension keys, with the workspace name as a fallback for its id.

    The two reference dimensions are of fixed size and are broadcast. The growing ones are
    left to the planner, which broadcasts by measured size. Where it shuffles, rows without a key, and for
    the name lookup all rows whose id is known, are dealt evenly instead of meeting in one task.
    A name shared by several workspaces resolves to the greatest key, so no row is multiplied.
    """
    ws = _current(dims.workspace)
    by_id = ws.groupBy(F.col("workspace_id").alias("_id")).agg(F.max("workspace_sk").alias("_ws_by_id"))
    by_name = ws.filter("workspace_name is not null").groupBy("workspace_name").agg(F.max("workspace_sk").alias("_ws_by_name"))
    item = _current(dims.item).select(F.col("item_id").alias("_item"), "item_sk")
    user = _current(dims.user).select(F.col("user_principal_name").alias("_user"), "user_sk")
    kinds = F.broadcast(dims.activity_type.select("activity_type", F.col("activity_type_sk").alias("_type")))
    states = F.broadcast(dims.status.select(F.col("status_code").alias("_code"), F.col("status_sk").alias("_status")))
    unresolved = F.when(F.col("_ws_by_id").isNull(), F.col("workspace_name"))
    joined = (
        df.join(by_id, spread_nulls("workspace_id", "event_id") == F.col("_id"), "left")
        .join(by_name.withColumnRenamed("workspace_name", "_name"), spread_nulls(unresolved, "event_id") == F.col("_name"), "left")
        .join(item, spread_nulls("item_id", "event_id") == F.col("_item"), "left")
        .join(user, spread_nulls("submitted_by", "event_id") == F.col("_user"), "left")
        .join(kinds, "activity_type", "left")
        .join(states, F.coalesce("status", F.lit("Unknown")) == F.col("_code"), "left")
    )
    return joined.withColumns(
        {
            "workspace_sk": F.coalesce("_ws_by_id", "_ws_by_name"),
            "activity_type_sk": F.coalesce("_type", F.lit(K.UNKNOWN_ACTIVITY_TYPE_SK)),
            "status_sk": F.coalesce("_status", F.lit(K.UNKNOWN_STATUS_SK)),
        }
    ).drop("_id", "_ws_by_id", "_ws_by_name", "_name", "_item", "_user", "_type", "_code", "_status")


def hashed_keys(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The keys of :func:`resolve_keys` for dimensions built from these same activities.

    Growing-dimension keys are hashes of natural keys, so for such a fact the lookups are
    expressions and need no join: the bulk of the rows never moves. Only rows without a
    workspace id, kept apart, look their name up: in ``names``, or else in these activities.
    """
    present = F.coalesce(F.col("workspace_id") != "", F.lit(False))
    type_sk = F.create_map(*[F.lit(x) for i, t in enumerate(K.ACTIVITY_TYPES, 1) for x in (t[0], i)])
    status_sk = F.create_map(*[F.lit(x) for i, s in enumerate(K.STATUSES, 1) for x in (s[0], i)])
    find = lambda m, c, default: F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit(""))), F.lit(default))
    keyed = df.withColumns(
        {
            "item_sk": F.when(F.col("item_id") != "", surrogate_key("item", "item_id")),
            "user_sk": F.when(F.col("submitted_by") != "", surrogate_key("user", "submitted_by")),
            "activity_type_sk": find(type_sk, F.col("activity_type"), K.UNKNOWN_ACTIVITY_TYPE_SK),
            "status_sk": find(status_sk, F.coalesce("status", F.lit("Unknown")), K.UNKNOWN_STATUS_SK),
        }
    )
    by_name = workspace_names(df) if names is None else names
    direct = keyed.filter(present).withColumn("workspace_sk", surrogate_key("workspace", "workspace_id"))
    return direct.unionByName(keyed.filter(~present).join(by_name, "workspace_name", "left"))


def workspace_names(acts: DataFrame) -> DataFrame:
    """(workspace_name, workspace_sk) of all rows that name a workspace and have its id."""
    return (
        acts.filter(F.col("workspace_id") != "")
        .select("workspace_id", "workspace_name")
        .distinct()
        .groupBy("workspace_name")
        .agg(F.max(surrogate_key("workspace", "workspace_id")).alias("workspace_sk"))
    )


def fact_from_log(acts: DataFrame, extracted_at: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """:func:`fact_activity` over hashed keys: a scan, a projection and one small lookup.

    ``names`` are stored workspace names; a stream needs them, as its batches do not name all workspaces.
    """
    return shape_fact(hashed_keys(acts, names), extracted_at)


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def fact_activity(acts: DataFrame, dims: Dims, hwm=None, extracted_at: Column | None = None, source_system: str = "activity_log") -> DataFrame:
    """One row per event; with ``hwm`` only events that start later, plus those without a start."""
    df = acts
    if hwm is not None:
        mark = hwm if isinstance(hwm, Column) else F.lit(hwm)
        df = df.filter(F.col("start_time").isNull() | mark.isNull() | (F.col("start_time") > mark))
    return shape_fact(resolve_keys(df, dims), extracted_at, source_system)


def shape_fact(keyed: DataFrame, extracted_at: Column | None = None, source_system: str = "activity_log") -> DataFrame:
    d = F.coalesce("duration_seconds", F.lit(0.0))
    status = F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("Unknown"))
    cols = [
        "event_id", "activity_id", *date_time_keys("start_time", "end_time"), "workspace_sk", "item_sk", "user_sk",
        "activity_type_sk", "status_sk", _text(keyed, "job_instance_id"), _text(keyed, "root_activity_id"), _text(keyed, "invoke_type"),
        d.alias("duration_seconds"), (d / 60).alias("duration_minutes"), (d / 3600).alias("duration_hours"),
        *fact_flags(status, d), F.lit(1).alias("record_count"), F.lit(source_system).alias("source_system"),
    ]
    if extracted_at is not None:
        cols.append(extracted_at.alias("extracted_at"))
    return keyed.select(*cols)


def daily_metrics(fact: DataFrame) -> DataFrame:
    """Date by workspace; rows without either key are dropped."""
    return (
        fact.filter("date_sk is not null and workspace_sk is not null")
        .groupBy("date_sk", "workspace_sk")
        .agg(
            F.sum("record_count").alias("total_activities"),
            F.sum("is_success").alias("successful_activities"),
            F.sum("is_failed").alias("failed_activities"),
            F.sum("duration_seconds").alias("total_duration_seconds"),
            F.avg("duration_seconds").alias("avg_duration_seconds"),
            F.max("duration_seconds").alias("max_duration_seconds"),
            F.min("duration_seconds").alias("min_duration_seconds"),
            F.sum("is_long_running").alias("long_running_count"),
            F.countDistinct("user_sk").alias("unique_users"),
            F.countDistinct("item_sk").alias("unique_items"),
        )
        .withColumns(
            {
                "success_rate": round_half_even(percent(F.col("successful_activities"), F.col("total_activities"))),
                "failure_rate": round_half_even(percent(F.col("failed_activities"), F.col("total_activities"))),
            }
        )
    )


def user_metrics(fact: DataFrame, days: int = 7) -> DataFrame:
    """Date by user, with trailing averages; the risk score is the trailing failure rate."""
    daily = (
        fact.filter("activity_date is not null and user_sk is not null")
        .groupBy("activity_date", "date_sk", "user_sk")
        .agg(
            F.sum("record_count").alias("total_activities"),
            F.sum("is_failed").alias("failed_activities"),
            F.sum("duration_seconds").alias("total_duration_seconds"),
            F.countDistinct("workspace_sk").alias("unique_workspaces"),
            F.countDistinct("item_sk").alias("unique_items"),
            F.countDistinct("activity_type_sk").alias("unique_activity_types"),
        )
        .withColumn("failure_rate", F.try_divide("failed_activities", "total_activities") * 100)
    )
    daily = trailing_avg(daily, "user_sk", "total_activities", days, alias="activities_avg")
    return trailing_avg(daily, "user_sk", "failure_rate", days, alias="risk_score")


def key_completeness(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per dimension: fact rows without a key, and with a key the dimension lacks.

    One scan of the fact: its keys are unpivoted and counted before the join, which compares distinct
    keys only.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(key).cast("bigint").alias("key")) for n, (_, key) in dims.items()]))
    counted = fact.select(keys.alias("k")).groupBy("k.dimension", "k.key").agg(F.count(F.lit(1)).alias("n"))
    known = reduce(
        DataFrame.unionByName,
        [dim.select(F.lit(n).alias("dimension"), F.col(key).cast("bigint").alias("key")) for n, (dim, key) in dims.items()],
    ).distinct().withColumn("known", F.lit(True))
    orphan = F.col("key").isNotNull() & F.col("known").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counted.join(known, ["dimension", "key"], "left").groupBy("dimension").agg(
        F.sum("n").alias("fact_rows"), total(F.col("key").isNull()).alias("null_keys"), total(orphan).alias("orphan_rows")
    )


class StarSchema(NamedTuple):
    dim_date: DataFrame
    dim_time: DataFrame
    dims: Dims
    fact_activity: DataFrame
    fact_daily_metrics: DataFrame
    fact_user_metrics: DataFrame


def build_schema(acts: DataFrame, lineage: DataFrame | None = None, incremental: bool = False, existing: Dims | None = None, hwm=None, as_of=None) -> StarSchema:
    """The whole model; dimensions are written first, facts stay lazy. ``incremental`` extends ``existing`` dimensions and
    takes only events above ``hwm``."""
    spark: SparkSession = acts.sparkSession
    dims = build_dims(acts, lineage, as_of)
    if incremental and existing is not None:
        dims = dims._replace(
            workspace=D.upkeep(dims.workspace, existing.workspace, "workspace_id"),
            item=D.upkeep(dims.item, existing.item, "item_id"),
            user=D.upkeep(dims.user, existing.user, "user_principal_name"),
        )
    dims = stored(dims)
    fact = fact_activity(acts, dims, hwm if incremental else None)
    return StarSchema(D.dim_date_for(acts), D.dim_time(spark), dims, fact, daily_metrics(fact), user_metrics(fact))


def semantic_views(master: DataFrame) -> dict[str, DataFrame]:
    """Distinct dimension projections of the activities master, and its calendar."""
    pick = lambda *c: master.select(*c).distinct()
    return {
        "dim_user": pick("submitted_by"),
        "dim_item": pick("item_id", "item_name", "item_type", "workspace_name"),
        "dim_workspace": pick("workspace_id", "workspace_name", "domain", "location"),
        "dim_date": D.dim_date_for(master, "date"),
    }


def master_measures(master: DataFrame, by: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    failed = F.count_if(F.coalesce(F.col("is_failed"), F.lit(False)) if "is_failed" in master.columns else F.col("status") == "Failed")
    return master.groupBy(*by).agg(
        n.alias("total_activities"), failed.alias("failed_activities"),
        (F.try_divide(n - failed, n)).alias("success_rate"),
        F.avg("duration_seconds").alias("avg_duration_seconds"),
        (F.sum("duration_seconds") / 3600).alias("total_duration_hours"),
    )
