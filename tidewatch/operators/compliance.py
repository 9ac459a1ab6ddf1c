"""Workspace access compliance: scope, suppression, status, audit and metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import first_non_empty
from tidewatch.operators.ranking import first_per_key


def is_premium(capacity: str = "capacityId", dedicated: str = "isOnDedicatedCapacity") -> Column:
    has = (F.col(capacity) != "") & (F.col(capacity) != K.EMPTY_CAPACITY_ID)
    return F.coalesce(has, F.lit(False)) | F.coalesce(F.col(dedicated), F.lit(False))


def scope(ws: DataFrame, premium_only: bool = False, exclude_personal: bool = True, names: Sequence[str] = (), first_n: int | None = None) -> DataFrame:
    """Active workspaces in scope. ``names`` holds ids or names, in any case."""
    out = ws.filter(F.col("state").isNull() | (F.col("state") == "Active"))
    if exclude_personal and "type" in ws.columns:
        out = out.filter(F.col("type").isNull() | (F.col("type") != "PersonalGroup"))
    if premium_only:
        out = out.filter(is_premium())
    tokens = [n.lower() for n in names if n.strip()]
    if tokens:
        out = out.filter(F.lower("id").isin(tokens) | F.lower("name").isin(tokens))
    return out if first_n is None else out.orderBy("id").limit(first_n)


def suppressed(ws: DataFrame, rules: DataFrame) -> DataFrame:
    """Workspaces named by a rule. ``rules`` has one (kind, token) row per id or name."""
    tokens = rules.select(F.lower("token").alias("token"), "kind")
    ids, names = tokens.filter("kind = 'id'"), tokens.filter("kind = 'name'")
    hit = (
        ws.join(ids, F.lower(F.col("id")) == F.col("token"), "left_semi")
        .unionByName(ws.join(names, F.lower(F.col("name")) == F.col("token"), "left_semi"))
    )
    return hit.dropDuplicates(["id"])


def workspace_status(ws: DataFrame, rules: DataFrame) -> DataFrame:
    """evaluated, suppressed, or skipped (no id). A missing name never matches a rule."""
    tokens = lambda kind: rules.filter(F.col("kind") == kind).select(F.lower("token").alias(f"_{kind}")).distinct()
    marked = ws.join(tokens("id"), F.lower(F.col("id")) == F.col("_id"), "left").join(
        tokens("name"), F.lower(F.col("name")) == F.col("_name"), "left"
    )
    status = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "skipped")
        .when(F.col("_id").isNotNull() | F.col("_name").isNotNull(), "suppressed")
        .otherwise("evaluated")
    )
    return marked.withColumn("status", status).drop("_id", "_name")


def principal_of(members: DataFrame) -> Column:
    fields = [c for c in ("identifier", "objectId", "userObjectId", "graphId") if c in members.columns]
    return F.lower(first_non_empty(fields))


def member_roles(members: DataFrame, principals: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """The first listed role per workspace and principal, combined on the map side.

    With ``principals`` (a column of that name, lower case) only their rows count."""
    who = members.withColumn("principal", principal_of(members))
    if principals is not None:
        who = who.join(principals.select("principal").distinct(), "principal", "left_semi")
    role = first_non_empty(["groupUserAccessRight", "role"])
    named = who.filter("principal is not null and workspace_id is not null").select("workspace_id", "principal", role.alias("current_role"), order)
    return first_per_key(named, ["workspace_id", "principal"], order, ["current_role"])


Requirements = Sequence[dict] | DataFrame

#: Requirements that a workspace row meets at once.
REQUIREMENT_BLOCK = 1000


def requirement_rows(spark: SparkSession, requirements: Requirements) -> DataFrame:
    """(group, principal, target_role) of a configuration, or of a frame with objectId and optionally displayName and role."""
    if not isinstance(requirements, DataFrame):
        fields = ("objectId", "displayName", "role")
        requirements = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in requirements], "objectId string, displayName string, role string")
    given = lambda c, default: F.coalesce(c, default) if c in requirements.columns else default
    return requirements.select(
        given("displayName", F.col("objectId")).alias("group"), F.lower("objectId").alias("principal"), given("role", F.lit("Admin")).alias("target_role")
    )


def assess_access(ws: DataFrame, requirements: Requirements, members: DataFrame) -> DataFrame:
    """One row per workspace and requirement, with the current role if any.

    Requirements (``objectId``, ``displayName``, ``role``) are configuration or a table, of any number; the answer has a
    row for each of them and workspace. They are dealt into blocks, and a workspace meets each block by an equal key.
    """
    wanted = requirement_rows(ws.sparkSession, requirements)
    blocks = max(1, math.ceil(wanted.count() / REQUIREMENT_BLOCK))
    dealt = wanted.withColumn("_block", F.pmod(F.xxhash64("principal", "target_role"), F.lit(blocks)))
    every = ws.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")
    roles = member_roles(members, wanted).withColumnRenamed("workspace_id", "id")
    return every.join(roles, ["id", "principal"], "left")


def requirement_status(ws: DataFrame, requirements: Requirements, members: DataFrame) -> DataFrame:
    role, target = F.lower("current_role"), F.lower("target_role")
    action = F.when(role == target, "already_compliant").when(role.isNotNull(), "role_mismatch").otherwise("dry_run")
    return assess_access(ws, requirements, members).withColumn("action", action)


def access_summary(ws: DataFrame, rules: DataFrame, requirements: Requirements, members: DataFrame) -> DataFrame:
    """One row per workspace: status, whether action is needed, and the joined action text.

    The text gathers one entry per requirement of the configuration.
    """
    status = workspace_status(ws, rules)
    entry = F.struct("group", F.concat_ws(": ", "group", "action").alias("text"))
    actions = (
        requirement_status(status.filter("status = 'evaluated'").select("id"), requirements, members)
        .groupBy("id")
        .agg(F.bool_or(F.col("action") != "already_compliant").alias("needs_action"), F.array_sort(F.collect_list(entry)).alias("_a"))
        .select("id", "needs_action", F.array_join(F.transform("_a", lambda x: x["text"]), "; ").alias("actions"))
    )
    return status.join(actions, "id", "left").select(
        F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"), "status",
        F.coalesce("needs_action", F.lit(False)).alias("needs_action"), F.coalesce("actions", F.lit("")).alias("actions"),
    )


def access_metrics(summary: DataFrame) -> DataFrame:
    evaluated = F.col("status") == "evaluated"
    return summary.agg(
        F.count(F.lit(1)).alias("total_workspaces"),
        F.count_if(evaluated & ~F.col("needs_action")).alias("compliant_workspaces"),
        F.count_if(evaluated & F.col("needs_action")).alias("workspaces_needing_action"),
        F.count_if(F.col("status") == "suppressed").alias("suppressed_workspaces"),
        F.count_if(F.col("status") == "skipped").alias("skipped_workspaces"),
    )


def principal_audit(ws: DataFrame, members: DataFrame, principal: str) -> DataFrame:
    """Membership and role of one principal in every premium workspace."""
    one = ws.sparkSession.createDataFrame([(principal.lower(),)], "principal string")
    roles = member_roles(members, one).select(F.col("workspace_id").alias("id"), "current_role", F.lit(True).alias("_member"))
    return ws.filter(is_premium()).join(roles, "id", "left").select(
        F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"),
        F.coalesce("_member", F.lit(False)).alias("is_member"),
        F.when(F.col("_member"), F.col("current_role")).otherwise("None").alias("current_role"),
        F.col("capacityId").alias("capacity_id"),
    )
