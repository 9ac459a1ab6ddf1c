"""Dimension builders and their upkeep."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions import enrich
from tidewatch.functions.basics import surrogate_key
from tidewatch.operators.ranking import first_per_key



def dim_date(spark: SparkSession, start, end, fiscal_month: int = 7) -> DataFrame:
    """One row per day. ``start`` and ``end`` are dates."""
    span = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return date_columns(span.select(F.explode(F.sequence("a", "b")).alias("full_date")), fiscal_month)


def dim_date_for(df: DataFrame, column: str = "start_time", fiscal_month: int = 7) -> DataFrame:
    """Calendar spanning a column's first to last day; one min/max aggregate, no collect."""
    span = df.agg(F.to_date(F.min(column)).alias("a"), F.to_date(F.max(column)).alias("b")).filter("a is not null")
    return date_columns(span.select(F.explode(F.sequence("a", "b")).alias("full_date")), fiscal_month)


def date_columns(days: DataFrame, fiscal_month: int = 7) -> DataFrame:
    d = F.col("full_date")
    month = F.month(d)
    late = month >= fiscal_month
    fiscal_no = F.when(late, month - fiscal_month + 1).otherwise(month + 13 - fiscal_month)
    weekday = F.weekday(d)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_sk"),
        d,
        (weekday + 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        month.alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        (weekday >= 5).alias("is_weekend"),
        (weekday < 5).alias("is_weekday"),
        F.when(late, F.year(d) + 1).otherwise(F.year(d)).alias("fiscal_year"),
        (F.floor((fiscal_no - 1) / 3) + 1).cast("int").alias("fiscal_quarter"),
    )


def dim_time(spark: SparkSession) -> DataFrame:
    """96 quarter-hour slots."""
    slot = spark.range(96).select(
        F.floor(F.col("id") / 4).cast("int").alias("hour_24"), (F.col("id") % 4 * 15).cast("int").alias("minute")
    )
    h = F.col("hour_24")
    return slot.select(
        (h * 100 + F.col("minute")).alias("time_sk"),
        h,
        F.when(h % 12 == 0, 12).otherwise(h % 12).alias("hour_12"),
        "minute",
        F.when(h < 12, "AM").otherwise("PM").alias("am_pm"),
        F.when(h.between(5, 11), "Morning").when(h.between(12, 16), "Afternoon").when(h.between(17, 20), "Evening").otherwise("Night").alias("time_period"),
        h.between(9, 16).alias("is_business_hours"),
    )


def dim_activity_type(spark: SparkSession) -> DataFrame:
    rows = [(i, name, cat, comp, nat, f"{cat} activity: {name}") for i, (name, cat, comp, nat) in enumerate(K.ACTIVITY_TYPES, 1)]
    rows.append((K.UNKNOWN_ACTIVITY_TYPE_SK, "Unknown", "Unknown", False, False, "Unknown or unmapped activity type"))
    return spark.createDataFrame(
        rows, "activity_type_sk int, activity_type string, activity_category string, is_compute_activity boolean, is_fabric_native boolean, description string"
    )


def dim_status(spark: SparkSession) -> DataFrame:
    rows = [(i, *s) for i, s in enumerate(K.STATUSES, 1)]
    return spark.createDataFrame(rows, "status_sk int, status_code string, status_category string, is_terminal boolean, severity int")


# ---- growing dimensions ------------------------------------------------------------
def _versioned(df: DataFrame, today: Column) -> DataFrame:
    return df.withColumns(
        {
            "is_current": F.lit(True),
            "effective_from": today,
            "effective_to": F.lit(None).cast("date"),
            "version": F.lit(1),
        }
    )


def _today(as_of) -> Column:
    return F.lit(as_of if as_of is not None else dt.datetime.now(dt.timezone.utc).date()).cast("date")


def _optional(df: DataFrame, name: str, default: str | None) -> Column:
    """A column of the input, its default where the input lacks it."""
    return F.col(name) if name in df.columns else F.lit(default).cast("string").alias(name)


def dim_workspace(acts: DataFrame, existing: DataFrame | None = None, as_of=None, order: str = "start_time") -> DataFrame:
    """One member per workspace id, described by its earliest event."""
    src = acts.filter("workspace_id <> ''").select(
        "workspace_id", "workspace_name",
        _optional(acts, "workspace_type", "Workspace").alias("workspace_type"),
        _optional(acts, "capacity_id", None).alias("capacity_id"),
        _optional(acts, "domain", "General").alias("domain"),
        _optional(acts, "location", "Global").alias("location"),
        order,
    )
    members = first_per_key(src, "workspace_id", order, ["workspace_name", "workspace_type", "capacity_id", "domain", "location"])
    name = F.coalesce(F.when(F.col("workspace_name") != "", F.col("workspace_name")), F.lit("Unknown"))
    dim = _versioned(members.withColumn("workspace_name", name).withColumn("environment", enrich.infer_environment("workspace_name")), _today(as_of))
    dim = dim.withColumn("workspace_sk", surrogate_key("workspace", "workspace_id"))
    return dim if existing is None else upkeep(dim, existing, "workspace_id")


def dim_item(acts: DataFrame, lineage: DataFrame | None = None, existing: DataFrame | None = None, as_of=None, order: str = "start_time") -> DataFrame:
    src = acts.filter("item_id <> ''").select("item_id", "item_name", "item_type", "workspace_id", "workspace_name", order)
    members = first_per_key(src, "item_id", order, ["item_name", "item_type", "workspace_id", "workspace_name"])
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("Unknown"))
    dim = members.withColumns({"item_name": known("item_name"), "item_type": known("item_type")}).withColumns(
        {
            "item_category": enrich.item_category("item_type"),
            "platform": enrich.platform("item_type"),
            "is_fabric_native": enrich.is_native("item_type"),
        }
    )
    if lineage is None:
        dim = dim.withColumns({c: F.lit(None).cast("string") for c in ("source_type", "source_database", "source_connection_id")})
    else:
        dim = attach_lineage(dim, lineage)
    dim = _versioned(dim, _today(as_of)).withColumn("item_sk", surrogate_key("item", "item_id"))
    return dim if existing is None else upkeep(dim, existing, "item_id")


def attach_lineage(items: DataFrame, lineage: DataFrame, order: str = "seq") -> DataFrame:
    """Source type, database and connection of the last lineage record per item."""
    fields = {"source_type": "Source Type", "source_database": "Source Database", "source_connection_id": "Connection ID"}
    present = [
        (F.col(f"`{c}`") if c in lineage.columns else F.lit(None)).cast("string").alias(n) for n, c in fields.items()
    ]
    named = lineage.filter(F.col("`Item ID`") != "").select(F.col("`Item ID`").alias("item_id"), *present, F.col(order).alias("_seq"))
    last = first_per_key(named, "item_id", "_seq", list(fields), last=True)
    return items.join(last, "item_id", "left")


def dim_user(acts: DataFrame, existing: DataFrame | None = None, as_of=None) -> DataFrame:
    """Every attribute is a function of the user name, so distinct names are enough."""
    upn = F.col("user_principal_name")
    members = acts.filter("submitted_by <> ''").select(F.col("submitted_by").alias("user_principal_name")).distinct()
    dim = members.select(
        upn,
        enrich.display_name(upn).alias("user_display_name"),
        enrich.user_type(upn).alias("user_type"),
        enrich.upn_domain(upn).alias("domain"),
        F.lit(None).cast("string").alias("department"),
        F.lit("Low").alias("risk_level"),
        F.lit("Regular").alias("activity_tier"),
    )
    dim = _versioned(dim, _today(as_of)).withColumn("user_sk", surrogate_key("user", "user_principal_name"))
    return dim if existing is None else upkeep(dim, existing, "user_principal_name")


def new_members(new: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key has no current row in ``dim``."""
    return new.join(dim.filter("is_current").select(key), key, "left_anti")


VERSION_COLUMNS = ("is_current", "effective_from", "effective_to", "version")


def upkeep(new: DataFrame, existing: DataFrame, key: str, mode: str = "insert_new", as_of=None) -> DataFrame:
    """Bring a dimension up to date.

    ``insert_new`` only appends members that are not there yet. ``scd2`` also closes the
    current row of a changed member and opens its next version; rerunning it with the same
    input changes nothing.
    """
    if mode == "insert_new":
        return existing.unionByName(new_members(new, existing, key), allowMissingColumns=True)
    tracked = [c for c in new.columns if c not in VERSION_COLUMNS and c != key and not c.endswith("_sk")]
    fingerprint = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in tracked])
    today = _today(as_of)
    incoming = new.select(key, fingerprint.alias("_new_print"))
    marked = existing.withColumn("_print", fingerprint).join(incoming, key, "left")
    changed = F.col("is_current") & F.col("_new_print").isNotNull() & (F.col("_print") != F.col("_new_print"))
    kept = marked.withColumns(
        {
            "effective_to": F.when(changed, F.date_sub(today, 1)).otherwise(F.col("effective_to")),
            "is_current": F.when(changed, False).otherwise(F.col("is_current")),
        }
    ).select(*existing.columns)
    current = existing.filter("is_current").select(key, fingerprint.alias("_old_print"), F.col("version").alias("_old_version"))
    opened = (
        new.withColumn("_new_print", fingerprint)
        .join(current, key, "left")
        .filter("_old_print is null or _old_print <> _new_print")
        .withColumns(
            {
                "version": F.coalesce(F.col("_old_version") + 1, F.lit(1)),
                "is_current": F.lit(True),
                "effective_from": today,
                "effective_to": F.lit(None).cast("date"),
            }
        )
        .select(*new.columns)
    )
    return kept.unionByName(opened, allowMissingColumns=True)
