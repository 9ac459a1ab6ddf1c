"""Attaching inventory metadata and consolidating inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import enrich
from tidewatch.functions.basics import blank_to_null, first_non_empty


def normalise_workspaces(df: DataFrame) -> DataFrame:
    """Accept ``id``/``workspace_id`` and ``displayName``/``workspace_name``; one row per id."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    flat = df.select(
        pick("workspace_id", "id").alias("workspace_id"),
        pick("workspace_name", "displayName", "name").alias("workspace_name"),
        pick("capacity_id", "capacityId").alias("capacity_id"),
    ).filter("workspace_id <> ''")
    return flat.groupBy("workspace_id").agg(F.max("workspace_name").alias("workspace_name"), F.max("capacity_id").alias("capacity_id"))


def attach_workspace(df: DataFrame, ws: DataFrame) -> DataFrame:
    """Workspace name and capacity from the lookup, keeping given values that it lacks.

    No broadcast hint: the planner broadcasts the lookup when its files are small enough,
    and splits skewed partitions otherwise.
    """
    lookup = normalise_workspaces(ws).select(
        "workspace_id", F.col("workspace_name").alias("_name"), F.col("capacity_id").alias("_capacity")
    )
    joined = df.join(lookup, "workspace_id", "left")
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "workspace_name": F.coalesce("_name", given("workspace_name")),
            "capacity_id": F.coalesce("_capacity", given("capacity_id")),
        }
    ).drop("_name", "_capacity")


def workspace_name(df: DataFrame, lookup: DataFrame, default: str = "Unknown") -> DataFrame:
    """Id lookup, else the given name unless it says "unknown", else the default."""
    known = lookup.select("workspace_id", blank_to_null("workspace_name").alias("_name"))
    given = F.trim("workspace_name")
    usable = F.when((given != "") & (F.lower(given) != "unknown"), given)
    return df.join(known, "workspace_id", "left").withColumn("workspace_name", F.coalesce("_name", usable, F.lit(default))).drop("_name")


def workspace_sk(df: DataFrame, dim: DataFrame, default: int = -1) -> DataFrame:
    """Id lookup, else name lookup, else the default key. Names resolve to their greatest key."""
    by_id = dim.select("workspace_id", F.col("workspace_sk").alias("_a"))
    by_name = dim.filter("workspace_name is not null").groupBy(F.col("workspace_name").alias("_n")).agg(F.max("workspace_sk").alias("_b"))
    return (
        df.join(by_id, "workspace_id", "left")
        .join(by_name, F.trim("workspace_name") == F.col("_n"), "left")
        .withColumn("workspace_sk", F.coalesce("_a", "_b", F.lit(default)))
        .drop("_a", "_b", "_n")
    )


def attach_item(df: DataFrame, items: DataFrame) -> DataFrame:
    """Name, type, URL, creator and modifier from item metadata, by workspace and item id.

    ``items`` has workspace_id, item_id, display_name, type and optional created_by /
    modified_by text.
    """
    meta = items.select(
        "workspace_id", "item_id", F.col("display_name").alias("_name"), F.col("type").alias("_type"),
        *[F.col(c).alias(f"_{c}") for c in ("created_by", "modified_by") if c in items.columns],
    ).withColumn("_found", F.lit(True))
    joined = df.join(meta, ["workspace_id", "item_id"], "left")
    kind = first_non_empty(["_type", "item_type"])
    changes = {
        "item_name": first_non_empty(["_name", "item_name"]),
        "item_type": kind,
        "object_url": F.coalesce(blank_to_null("object_url"), F.when(F.col("_found"), enrich.object_url("workspace_id", "item_id", kind))),
    }
    if "created_by" in items.columns:
        changes["created_by"] = F.coalesce(enrich.normalize_user("_created_by"), F.col("created_by"))
    if "modified_by" in items.columns:
        changes["last_updated_by"] = F.coalesce(enrich.normalize_user("_modified_by"), F.col("last_updated_by"))
    return joined.withColumns(changes).select(*df.columns)


def merge_inventory(a: DataFrame, b: DataFrame, sources: tuple[str, str] = ("fabric", "powerbi")) -> DataFrame:
    """One row per workspace id from two inventories.

    The later non-empty name and capacity win, the premium flag is true if either says so,
    and the first source that lists the workspace is named.
    """
    tagged = a.withColumn("_rank", F.lit(0)).unionByName(b.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    later = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("_rank")))
    return tagged.filter("id <> ''").groupBy("id").agg(
        F.coalesce(later("name"), F.lit("Unnamed")).alias("name"),
        later("capacityId").alias("capacityId"),
        F.coalesce(F.bool_or("isOnDedicatedCapacity"), F.lit(False)).alias("isOnDedicatedCapacity"),
        F.when(F.min("_rank") == 0, sources[0]).otherwise(sources[1]).alias("source"),
    )
