"""Nodes and edges from lineage records.

A record has ``Workspace ID``, ``Workspace Name``, ``Item ID``, ``Item Name``, ``Item Type``,
``Shortcut Name``, ``Shortcut Path``, ``Source Type``, ``Source Connection``, ``Full
Definition``, optionally ``Source Database``, ``Connection ID``, ``Mirrored Tables``, and
``seq``, the arrival order that decides which of several descriptions wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import spread_nulls
from tidewatch.functions.lineage import base_type, connection_list, source_details, source_id, table_id
from tidewatch.operators.graph.model import Graph
from tidewatch.operators.ranking import first_per_key
from tidewatch.session import cut_lineage

DEFINITION_DDL = """struct<properties: struct<
  source: struct<type: string, typeProperties: struct<connection: string, database: string>>,
  mountedTables: array<struct<source: struct<typeProperties: struct<schemaName: string, tableName: string>>>>>>"""
MIRRORED_DDL = "array<struct<schemaName: string, tableName: string, status: string, processedRows: bigint, lastSyncDateTime: string>>"


def _opt(df: DataFrame, name: str, ddl: str = "string") -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(ddl)


def parsed(records: DataFrame) -> DataFrame:
    """Records with snake_case names, the connection as a struct and the effective kind.

    Records that are parsed already come back as they are. The connection is exploded from a list of one, so that its
    text is parsed once a record, however many expressions and filters name its fields."""
    if "conn" in records.columns:
        return records
    flat = records.select(
        "seq",
        F.col("`Workspace ID`").alias("workspace_id"),
        F.coalesce("`Workspace Name`", F.lit("Unknown")).alias("workspace_name"),
        F.col("`Item ID`").alias("item_id"),
        F.coalesce("`Item Name`", F.lit("Unknown")).alias("item_name"),
        F.coalesce("`Item Type`", F.lit("Unknown")).alias("raw_type"),
        _opt(records, "Source Type").alias("source_type"),
        _opt(records, "Source Database").alias("source_database"),
        F.coalesce(_opt(records, "Connection ID"), F.col("`Source Connection`")).alias("bound_id"),
        _opt(records, "Full Definition").alias("definition"),
        _opt(records, "Mirrored Tables", MIRRORED_DDL).alias("mirrored"),
        F.col("`Source Connection`").alias("_text"),
    )
    return _connected(flat)


def _connected(df: DataFrame) -> DataFrame:
    """``conn`` and ``kind`` of rows with the text ``_text`` of a connection."""
    parsed_text = F.explode_outer(F.slice(connection_list("_text"), 1, 1))
    kind = F.when(F.col("conn").isNotNull(), F.col("conn.type")).otherwise(F.coalesce("source_type", F.lit("Unknown")))
    return df.select(*(c for c in df.columns if c != "_text"), parsed_text.alias("conn")).withColumn("kind", kind)


def _connections(records: DataFrame) -> DataFrame:
    """(seq, kind, conn) of the records, those with equal texts and types as one row with the least ``seq``."""
    if "conn" in records.columns:
        return records.select("seq", "kind", "conn")
    texts = records.groupBy(F.col("`Source Connection`").alias("_text"), _opt(records, "Source Type").alias("source_type"))
    return _connected(texts.agg(F.min("seq").alias("seq"))).select("seq", "kind", "conn")


def item_ids(records: DataFrame) -> DataFrame:
    """item_id of the records that have one, each once, without parsing connections."""
    return records.select(F.col("item_id" if "conn" in records.columns else "`Item ID`").alias("item_id")).filter("item_id is not null").distinct()


def _first(df: DataFrame, key: str, *cols: str) -> DataFrame:
    return first_per_key(df.select(key, *cols, "seq"), key, "seq", cols)


def split_dependencies(p: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dependency rows of parsed records with ``is_internal``.

    A OneLake reference to an item that the data knows is internal; other OneLake
    references and the listed external kinds are external.
    """
    known = p.select("item_id") if known is None else known
    ids = known.filter("item_id is not null").select(F.col("item_id").alias("_known")).distinct()
    upstream = F.when((F.col("kind") == "OneLake") & F.col("conn").isNotNull(), F.col("conn.oneLake.itemId"))
    rows = p.filter(
        ((F.col("kind") == "OneLake") & F.col("conn").isNotNull()) | F.col("kind").isin(K.EXTERNAL_SOURCE_TYPES)
    ).withColumn("upstream_id", upstream)
    # The key is a column, since a sort would build an expression anew at each comparison.
    keyed = rows.withColumn("_key", spread_nulls("upstream_id", "seq"))
    return keyed.join(ids, F.col("_key") == F.col("_known"), "left").withColumn("is_internal", F.col("_known").isNotNull()).drop("_key", "_known")


def dependency_edges(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """DEPENDS_ON to known items, CONSUMES to external sources."""
    p = parsed(records).select("seq", "item_id", "kind", "conn", source_id("kind", "conn").alias("source"))
    deps = split_dependencies(p, item_ids(records) if known is None else known).filter("item_id is not null")
    inner = F.col("is_internal")
    edges = deps.select(
        F.col("item_id").alias("src"), F.when(inner, F.col("upstream_id")).otherwise(F.col("source")).alias("dst"),
        F.when(inner, "DEPENDS_ON").otherwise("CONSUMES").alias("rel"),
    )
    return dedupe_edges(edges)


def source_nodes(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """External sources of dependencies, and the ones that mirrored databases copy from.

    A source is described by its connection alone, so equal texts are parsed once."""
    p = parsed(records)
    described = _connections(records).select("seq", "kind", "conn", source_id("kind", "conn").alias("id"), source_details("kind", "conn").alias("d"))
    deps = split_dependencies(described, item_ids(records) if known is None else known).filter("not is_internal")
    rows = deps.select("seq", "id", "kind", "d.*")
    mirrored = _mirror_sources(p).select(
        "seq", "id", F.lit("Snowflake").alias("kind"), F.coalesce("connection", "database", F.lit("Snowflake")).alias("display_name"),
        F.col("connection").alias("location"), F.lit(None).cast("string").alias("container"), "database",
    )
    every = rows.select("seq", "id", "kind", "display_name", "location", "container", "database").unionByName(mirrored)
    return _first(every, "id", "kind", "display_name", "location", "container", "database").withColumnRenamed("kind", "type")


def shortcut_tables(records: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Table nodes behind ``Tables/...`` shortcuts, with USES_TABLE and PROVIDES_TABLE edges."""
    deps = split_dependencies(parsed(records), item_ids(records) if known is None else known).filter("is_internal and startswith(conn.oneLake.path, 'Tables/')")
    parts = F.split(F.trim(F.replace(F.col("conn.oneLake.path"), F.lit("Tables/"), F.lit("")), F.lit("/")), "/")
    rows = deps.withColumn("parts", parts).filter("parts[0] <> '' or size(parts) >= 2").select(
        "seq", "item_id", "upstream_id",
        F.when(F.size("parts") >= 2, F.element_at("parts", 1)).otherwise("dbo").alias("schema"),
        F.element_at("parts", -1).alias("name"),
        F.col("conn.oneLake.path").alias("full_path"),
    ).withColumn("table_id", table_id("shortcut", "upstream_id", "schema", "name"))
    nodes = _first(rows, "table_id", "name", "schema", "upstream_id", "full_path").withColumn("table_type", F.lit("shortcut"))
    ends = F.array(F.struct(F.col("item_id").alias("src"), F.lit("USES_TABLE").alias("rel")), F.struct(F.col("upstream_id").alias("src"), F.lit("PROVIDES_TABLE").alias("rel")))
    edges = rows.select(F.inline(ends), F.col("table_id").alias("dst")).select("src", "dst", "rel")
    return nodes, dedupe_edges(edges)


def mirrored_tables(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table nodes of mirrored databases, from status lists and mounted-table definitions."""
    p = _mirrored_databases(parsed(records))
    db = F.when(F.coalesce(F.col("source_database"), F.lit("Unknown")).isin("", "Unknown"), F.col("item_name")).otherwise(F.col("source_database"))
    listed = p.select("seq", "item_id", db.alias("database"), F.explode("mirrored").alias("m")).filter("m.tableName <> ''").select(
        "seq", "item_id", "database",
        F.coalesce("m.schemaName", F.lit("dbo")).alias("schema"), F.col("m.tableName").alias("name"), F.col("m.status").alias("status"),
        F.col("m.processedRows").alias("processed_rows"), F.col("m.lastSyncDateTime").alias("last_sync"),
    ).withColumns({"table_id": table_id("mirror", "item_id", "schema", "name"), "full_path": F.concat_ws(".", "schema", "name")})
    d = p.select("seq", "item_id", F.from_json("definition", DEFINITION_DDL)["properties"].alias("p"))
    source_db = F.col("p.source.typeProperties.database")
    mounted = d.select("seq", "item_id", source_db.alias("_db"), F.explode("p.mountedTables").alias("m")).select(
        "seq", "item_id", F.coalesce("_db", F.lit("Unknown")).alias("database"),
        F.coalesce("m.source.typeProperties.schemaName", F.lit("dbo")).alias("schema"),
        F.coalesce("m.source.typeProperties.tableName", F.lit("unknown")).alias("name"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("processed_rows", "bigint"), ("last_sync", "string"))],
        F.coalesce("_db", F.lit("")).alias("_d"),
    ).withColumns({"table_id": table_id("tbl", "_d", "schema", "name"), "full_path": F.concat_ws(".", "_d", "schema", "name")}).drop("_d")
    rows = listed.unionByName(mounted)
    nodes = _first(rows, "table_id", "name", "schema", "database", "full_path", "status", "processed_rows", "last_sync").withColumn("table_type", F.lit("mirrored"))
    edges = rows.select(F.col("item_id").alias("src"), F.col("table_id").alias("dst"), F.lit("MIRRORS").alias("rel"))
    return nodes, dedupe_edges(edges)


def _mirrored_databases(p: DataFrame) -> DataFrame:
    """Records of mirrored databases that are no dependency themselves."""
    dependency = F.col("kind").isin(K.EXTERNAL_SOURCE_TYPES) | ((F.col("kind") == "OneLake") & F.col("conn").isNotNull())
    return p.filter((F.col("raw_type") == "MirroredDatabase") & ~dependency)


def _mirror_sources(p: DataFrame) -> DataFrame:
    """(seq, item_id, id, connection, database): the Snowflake source in a mirrored database's definition."""
    s = F.from_json("definition", DEFINITION_DDL)["properties"]["source"]
    rows = _mirrored_databases(p).select("seq", "item_id", s.alias("s")).filter("s.type = 'Snowflake'").select(
        "seq", "item_id", F.nullif(F.col("s.typeProperties.connection"), F.lit("")).alias("connection"), F.nullif(F.col("s.typeProperties.database"), F.lit("")).alias("database")
    )
    signature = F.concat_ws("|", F.lit("Snowflake"), "connection", "database")
    return rows.withColumn("id", F.concat(F.lit("src_"), F.substring(F.md5(signature), 1, 12)))


def mirror_source_edges(records: DataFrame) -> DataFrame:
    """CONSUMES edges from mirrored databases to the Snowflake source of their definition."""
    rows = _mirror_sources(parsed(records)).filter("item_id is not null")
    return dedupe_edges(rows.select(F.col("item_id").alias("src"), F.col("id").alias("dst"), F.lit("CONSUMES").alias("rel")))


def report_edges(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """READS_FROM from reports to the models they are bound to (opt-in)."""
    p = parsed(records)
    ids = (item_ids(records) if known is None else known).filter("item_id is not null").select(F.col("item_id").alias("bound_id")).distinct()
    reports = p.filter((F.col("kind") == "PowerBI") & (F.col("raw_type") == "Report")).select("item_id", "bound_id")
    hits = reports.join(ids, "bound_id", "left_semi")
    return dedupe_edges(hits.select(F.col("item_id").alias("src"), F.col("bound_id").alias("dst"), F.lit("READS_FROM").alias("rel")))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "rel"])


def workspace_nodes(records: DataFrame) -> DataFrame:
    return _first(parsed(records), "workspace_id", "workspace_name")


def item_nodes(records: DataFrame) -> DataFrame:
    return _first(parsed(records), "item_id", "item_name", "raw_type", "workspace_id").select(
        "item_id", "item_name", base_type("raw_type").alias("item_type"), "workspace_id"
    )


def nodes(records: DataFrame) -> dict[str, DataFrame]:
    """The node tables: workspaces, items, sources, shortcut and mirrored tables."""
    return {
        "workspaces": workspace_nodes(records),
        "items": item_nodes(records),
        "sources": source_nodes(records),
        "shortcut_tables": shortcut_tables(records)[0],
        "mirrored_tables": mirrored_tables(records)[0],
    }


def build_graph(records: DataFrame, include_all: bool = False) -> Graph:
    """The whole graph. Records are parsed once and written to the shared folder, since
    every node and edge table reads them."""
    records = cut_lineage(parsed(records), "records")
    ws, it, so = workspace_nodes(records), item_nodes(records), source_nodes(records)
    st, st_edges = shortcut_tables(records)
    mt, mt_edges = mirrored_tables(records)

    def node(df, key, label, **cols):
        names = ("name", "type", "location", "database", "schema", "full_path", "table_type")
        return df.select(F.col(key).alias("id"), F.lit(label).alias("label"), *[(F.col(cols[n]) if n in cols else F.lit(None).cast("string")).alias(n) for n in names])

    table_cols = {"name": "name", "schema": "schema", "full_path": "full_path", "table_type": "table_type"}
    all_nodes = (
        node(ws, "workspace_id", "Workspace", name="workspace_name")
        .unionByName(node(it, "item_id", "Item", name="item_name", type="item_type"))
        .unionByName(node(so, "id", "Source", name="display_name", type="type", location="location", database="database"))
        .unionByName(node(st, "table_id", "Table", **table_cols))
        .unionByName(node(mt, "table_id", "Table", database="database", **table_cols))
    )
    contains = it.filter("workspace_id is not null").select(F.col("workspace_id").alias("src"), F.col("item_id").alias("dst"), F.lit("CONTAINS").alias("rel"))
    edges = dependency_edges(records).unionByName(contains).unionByName(st_edges).unionByName(mt_edges).unionByName(mirror_source_edges(records))
    if include_all:
        edges = edges.unionByName(report_edges(records))
    return Graph(all_nodes, dedupe_edges(edges))
