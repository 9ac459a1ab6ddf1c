"""Flattening of scan payloads and item definitions into lineage records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.lineage import decode_payload

_REF = "array<struct<id: string, targetDatasetId: string>>"
_ARTIFACT = f"array<struct<id: string, name: string, upstreamDataflows: {_REF}, downstreamDataflows: {_REF}, datasourceUsages: {_REF}>>"
SCAN_SCHEMA = (
    "id string, name string, "
    f"lakehouses {_ARTIFACT}, warehouses {_ARTIFACT}, mirroredDatabases {_ARTIFACT}, kqlDatabases {_ARTIFACT}, "
    "shortcuts array<struct<itemId: string, itemName: string, name: string, path: string, "
    "target: struct<type: string, location: string, path: string, connectionId: string>>>, "
    f"datasets array<struct<id: string, name: string, expressions: {_REF}, upstreamDatasets: {_REF}, "
    f"tables: array<struct<name: string, columns: {_REF}, measures: {_REF}, source: array<struct<expression: string>>>>>>, "
    "reports array<struct<id: string, name: string, datasetId: string>>, "
    f"dataflows array<struct<objectId: string, name: string, datasourceUsages: {_REF}>>"
)

# -- fixed values: scan arrays and the item type each one holds -----------------------
ARTIFACT_ARRAYS = {
    "lakehouses": "Lakehouse",
    "warehouses": "Warehouse",
    "mirroredDatabases": "Mirroreddatabase",
    "kqlDatabases": "Kqldatabase",
}


def _n(c: Column) -> Column:
    return F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0))


def _record(df: DataFrame, kind: str, **fields: Column) -> DataFrame:
    base = {"workspace_id": F.col("ws_id"), "workspace_name": F.coalesce("ws_name", F.lit("Unknown")), "item_type": F.lit(kind)}
    named = {**base, **fields}
    named["item_name"] = F.coalesce(named["item_name"], F.lit("Unknown"))
    return df.select(*[c.alias(n) for n, c in named.items()])


def flatten_scan(df: DataFrame) -> DataFrame:
    """One record per artifact, shortcut, dataset, dataset table, report and dataflow.

    ``df`` has one row per workspace in :data:`SCAN_SCHEMA`; each array is one explode.
    """

    def each(array: str) -> DataFrame:
        return df.select(F.col("id").alias("ws_id"), F.col("name").alias("ws_name"), F.explode(array).alias("x"))

    x = F.col("x")
    parts = [
        _record(
            each(array), kind, item_id=x["id"], item_name=x["name"], source_type=F.lit("Scanner API"),
            upstream_count=_n(x["upstreamDataflows"]), downstream_count=_n(x["downstreamDataflows"]), datasource_count=_n(x["datasourceUsages"]),
        )
        for array, kind in ARTIFACT_ARRAYS.items()
    ]
    target = x["target"]
    parts.append(
        _record(
            each("shortcuts"), "Lakehouse Shortcut", item_id=x["itemId"], item_name=x["itemName"], shortcut_name=x["name"], shortcut_path=x["path"],
            source_type=F.coalesce(target["type"], F.lit("Unknown")), source_connection=F.coalesce(target["location"], target["path"]), connection_id=target["connectionId"],
        )
    )
    sets = each("datasets")
    parts.append(
        _record(sets, "SemanticModel", item_id=x["id"], item_name=x["name"], source_type=F.lit("Dataset"), table_count=_n(x["tables"]), expression_count=_n(x["expressions"]))
    )
    tables = sets.select("ws_id", "ws_name", x["id"].alias("i"), x["name"].alias("n"), F.explode(x["tables"]).alias("t"))
    t = F.col("t")
    parts.append(
        _record(
            tables, "DatasetTable", item_id=F.col("i"), item_name=F.col("n"), source_type=F.lit("Table"), table_name=t["name"],
            source_connection=F.try_element_at(t["source"], F.lit(1))["expression"], column_count=_n(t["columns"]), measure_count=_n(t["measures"]),
        )
    )
    parts.append(_record(each("reports"), "Report", item_id=x["id"], item_name=x["name"], source_type=F.lit("PowerBI"), source_connection=x["datasetId"], bound_dataset_id=x["datasetId"]))
    parts.append(_record(each("dataflows"), "Dataflow", item_id=x["objectId"], item_name=x["name"], source_type=F.lit("Dataflow"), datasource_count=_n(x["datasourceUsages"])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def flatten_mirror_status(df: DataFrame, array: str = "data") -> DataFrame:
    """Status entries of mirrored tables; ``df`` has item_id and the array of entries."""
    m = F.col("m")
    return df.select("item_id", F.explode(array).alias("m")).select(
        "item_id",
        F.coalesce(m["sourceSchemaName"], F.lit("dbo")).alias("schemaName"),
        m["sourceTableName"].alias("tableName"),
        m["status"].alias("status"),
        m["metrics"]["processedRows"].alias("processedRows"),
        m["metrics"]["lastSyncDateTime"].alias("lastSyncDateTime"),
    )


MIRROR_DEFINITION = "struct<properties: struct<source: struct<sourceType: string, type: string, connection: string, typeProperties: struct<database: string, connectionIdentifier: string, connection: string>>>>"


def build_lineage_records(
    mirrored: DataFrame | None = None,
    shortcuts: DataFrame | None = None,
    models: DataFrame | None = None,
    dataflows: DataFrame | None = None,
    reports: DataFrame | None = None,
) -> DataFrame:
    """One lineage record shape from the listings of each item kind.

    Every input has workspace_id, workspace_name, item_id, item_name, and:
    ``mirrored``: payload (base64 definition) and optional mirrored_tables;
    ``shortcuts``: item_kind (Lakehouse or KQLDatabase), name, path, target (JSON text);
    ``models`` and ``dataflows``: source_types (array), connections (JSON text);
    ``reports``: dataset_id, dataset_workspace_id.
    """
    null = F.lit(None).cast("string")

    def shape(df: DataFrame, kind: Column, **over: Column) -> DataFrame:
        cols = {
            "Workspace Name": F.col("workspace_name"), "Workspace ID": F.col("workspace_id"), "Item Name": F.col("item_name"), "Item ID": F.col("item_id"),
            "Item Type": kind, "Shortcut Name": null, "Shortcut Path": null, "Source Type": null, "Source Connection": null, "Source Database": null,
            "Connection ID": null, "Full Definition": null, **over,
        }
        return df.select(*[c.alias(n) for n, c in cols.items()])

    parts = []
    if mirrored is not None:
        d = mirrored.withColumn("_text", decode_payload("payload")).withColumn("_s", F.from_json("_text", MIRROR_DEFINITION)["properties"]["source"])
        s = F.col("_s")
        unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
        extra = {"Mirrored Tables": F.col("mirrored_tables")} if "mirrored_tables" in mirrored.columns else {}
        parts.append(
            shape(
                d.filter("_text is not null"), F.lit("MirroredDatabase"),
                **{
                    "Source Type": unknown(s["sourceType"]), "Source Connection": unknown(s["connection"]), "Source Database": unknown(s["typeProperties"]["database"]),
                    "Connection ID": unknown(s["typeProperties"]["connectionIdentifier"]), "Full Definition": F.col("_text"), **extra,
                },
            )
        )
    if shortcuts is not None:
        t = lambda f: F.get_json_object("target", f"$.{f}")
        parts.append(
            shape(
                shortcuts, F.concat(F.col("item_kind"), F.lit(" Shortcut")),
                **{
                    "Shortcut Name": F.col("name"), "Shortcut Path": F.col("path"), "Source Type": F.coalesce(t("type"), F.lit("Unknown")),
                    "Source Connection": F.coalesce(t("path"), t("location"), F.col("target")),
                    "Full Definition": F.to_json(F.struct("name", "path", "target")),
                },
            )
        )
    for df, kind, default in ((models, "SemanticModel", "Dataset"), (dataflows, "Dataflow", "Dataflow")):
        if df is not None:
            kinds = F.when(F.size("source_types") > 0, F.array_join("source_types", ", ")).otherwise(default)
            parts.append(shape(df, F.lit(kind), **{"Source Type": kinds, "Source Connection": F.col("connections"), "Full Definition": F.col("connections")}))
    if reports is not None:
        crossing = F.when(
            F.col("dataset_workspace_id").isNotNull() & F.col("workspace_id").isNotNull(), F.col("dataset_workspace_id") != F.col("workspace_id")
        )
        parts.append(
            shape(
                reports, F.lit("Report"),
                **{
                    "Source Type": F.lit("PowerBI"), "Source Connection": F.col("dataset_id"), "Source Database": F.col("dataset_workspace_id"),
                    "Connection ID": F.col("dataset_id"), "Bound Dataset ID": F.col("dataset_id"), "Cross Workspace": crossing,
                },
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
