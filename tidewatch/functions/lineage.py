"""Lineage text handling: table paths, polymorphic connections, source identities.

A connection arrives as JSON text, as a Python literal, or as a list of either. It is
parsed into one wide struct holding every known shape; absent parts are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import constants as K
from tidewatch.functions.basics import blank_to_null, col

_BLOB = "struct<location: string, container: string, subpath: string, path: string, name: string>"
CONNECTION_TYPE = (
    "struct<type: string,"
    "oneLake: struct<workspaceId: string, itemId: string, path: string>,"
    f"adlsGen2: {_BLOB},"
    f"azureBlob: {_BLOB},"
    "amazonS3: struct<location: string, subpath: string, bucket: string, key: string, path: string>,"
    "oneDriveSharePoint: struct<location: string, driveId: string, subpath: string>,"
    "snowflake: struct<connection: string, database: string, schema: string, table: string, tableName: string>,"
    "typeProperties: struct<connection: string, database: string>>"
)


def decode_payload(c: Column | str) -> Column:
    """Base64 text to JSON text; null on bad base64 or bad JSON."""
    text = F.try_to_binary(col(c), F.lit("base64")).cast("string")
    return F.when(F.try_parse_json(text).isNotNull(), text)


def connection_list(c: Column | str) -> Column:
    """Array of structs of :data:`CONNECTION_TYPE`; a single object is an array of one, broken text is null.

    The JSON reader accepts single quotes, so a Python literal only needs its None, True and
    False in JSON spelling."""
    text = plain = F.trim(col(c))
    words = {"None": "null", "True": "true", "False": "false"}
    for word, spelled in words.items():
        plain = F.regexp_replace(plain, rf"([:\[,]\s*){word}\b", f"$1{spelled}")
    text = F.when(text.contains("None") | text.contains("True") | text.contains("False"), plain).otherwise(text)
    # An array schema reads a single object as an array of one and broken text as null.
    return F.from_json(text, f"array<{CONNECTION_TYPE}>")


def parse_connection(c: Column | str) -> Column:
    """Struct of :data:`CONNECTION_TYPE`; the first element of a list; null when unparsable."""
    return F.try_element_at(connection_list(c), F.lit(1))


def _nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def source_id(kind: Column | str, conn: Column | str) -> Column:
    """``src_`` and 12 MD5 characters of the kind and its identifying fields."""
    k, c = col(kind), col(conn)
    blob = F.coalesce(c["adlsGen2"], c["azureBlob"])
    snow = lambda f: F.coalesce(c["snowflake"][f], c["typeProperties"][f])
    fields = lambda *xs: F.concat_ws("|", k, *[blank_to_null(x) for x in xs])
    signature = (
        F.when(k == "OneLake", fields(c["oneLake"]["workspaceId"], c["oneLake"]["itemId"]))
        .when(k.isin("AdlsGen2", "AzureBlob"), fields(blob["location"], F.coalesce(blob["container"], blob["subpath"])))
        .when(k == "AmazonS3", fields(c["amazonS3"]["location"], c["amazonS3"]["subpath"]))
        .when(k == "OneDriveSharePoint", fields(c["oneDriveSharePoint"]["location"], c["oneDriveSharePoint"]["driveId"]))
        .when(k == "Snowflake", fields(snow("connection"), snow("database")))
        .otherwise(k)
    )
    hashed = F.concat(F.lit("src_"), F.substring(F.md5(signature), 1, 12))
    return F.when(c.isNull(), F.concat(F.lit("src_"), k, F.lit("_unknown"))).otherwise(hashed)


def source_details(kind: Column | str, conn: Column | str) -> Column:
    """display_name, location, container and database of an external source."""
    k, c = col(kind), col(conn)
    blob = F.coalesce(c["adlsGen2"], c["azureBlob"])
    container = F.coalesce(blob["container"], blob["subpath"], F.lit(""))
    is_blob = k.isin("AdlsGen2", "AzureBlob")
    s3, sp = c["amazonS3"], c["oneDriveSharePoint"]
    database = _nz(F.coalesce(c["snowflake"]["database"], c["typeProperties"]["database"]))
    lake = F.coalesce(blank_to_null(F.substring_index(_nz(c["oneLake"]["path"]), "/", -1)), F.lit("Item"))
    name = (
        F.when(c.isNull(), k)
        .when(is_blob, F.concat(F.lit("ADLS: "), F.coalesce(blank_to_null(container), _nz(blob["location"]))))
        .when(k == "AmazonS3", F.concat(F.lit("S3: "), _nz(s3["location"])))
        .when(k == "OneDriveSharePoint", F.concat(F.lit("SharePoint: "), F.coalesce(sp["subpath"], _nz(sp["location"]))))
        .when(k == "Snowflake", F.concat(F.lit("Snowflake: "), database))
        .when(k == "OneLake", F.concat(F.lit("OneLake: "), lake))
        .otherwise(k)
    )
    present = c.isNotNull()
    location = (
        F.when(present & is_blob, _nz(blob["location"]))
        .when(present & (k == "AmazonS3"), _nz(s3["location"]))
        .when(present & (k == "OneDriveSharePoint"), _nz(sp["location"]))
    )
    held = F.when(present & is_blob, container).when(present & (k == "AmazonS3"), _nz(s3["subpath"]))
    return F.struct(
        name.alias("display_name"),
        location.alias("location"),
        held.alias("container"),
        F.when(present & (k == "Snowflake"), database).alias("database"),
    )


def _strip_extension(name: Column) -> Column:
    chain = F
    for ext in K.TABLE_FILE_EXTENSIONS:
        chain = chain.when(F.lower(name).endswith(ext), F.substring(name, F.lit(1), F.length(name) - len(ext)))
    return chain.otherwise(name)


def table_from_path(c: Column | str) -> Column:
    """Struct(schema_name, table_name) of ``Tables/schema/table``, ``Tables/table`` or a
    file path; null when the text holds no table."""
    path = col(c)
    in_tables = path.contains("Tables/")
    rest = F.when(in_tables, F.substring_index(path, "Tables/", -1)).otherwise(path)
    parts = F.split(F.trim(rest, F.lit("/")), "/")
    last = F.element_at(parts, -1)
    schema = F.when(
        F.size(parts) >= 2, F.when(in_tables, F.element_at(parts, 1)).otherwise(F.try_element_at(parts, F.lit(-2)))
    )
    name = F.when(in_tables, last).otherwise(_strip_extension(last))
    found = F.when(in_tables, (F.size(parts) >= 2) | (last != "")).otherwise(path.contains("/"))
    return F.when(
        (path != "") & found, F.struct(schema.alias("schema_name"), name.alias("table_name"))
    )


def tables_from_connection(conn: Column | str) -> Column:
    """Array (0 or 1 entries) of tables that a parsed connection refers to.

    The steps are bound one after the other by ``transform``, so that no expression is
    repeated in the generated code."""
    c = col(conn)
    kind = c["type"]
    snow, s3 = c["snowflake"], c["amazonS3"]
    is_blob = kind.isin("AdlsGen2", "AzureBlob")
    blob = F.coalesce(c["azureBlob"], c["adlsGen2"])
    snow_table = F.coalesce(snow["table"], snow["tableName"])
    found = F.struct(
        kind.alias("kind"),
        F.when(kind == "OneLake", c["oneLake"]["path"])
        .when(kind == "Snowflake", snow_table)
        .when(is_blob, F.coalesce(blob["path"], blob["name"]))
        .when(kind == "AmazonS3", F.coalesce(s3["key"], s3["path"]))
        .alias("path"),
        F.when(kind == "Snowflake", snow["database"]).when(is_blob, blob["container"]).when(kind == "AmazonS3", s3["bucket"]).alias("database"),
        F.when(kind == "Snowflake", blank_to_null(snow["schema"])).alias("schema"),
        c["oneLake"]["itemId"].alias("item"),
    )

    def placed(x: Column) -> Column:
        database = F.when(x["kind"] == "Snowflake", _nz(x["database"])).otherwise(blank_to_null(x["database"]))
        return F.struct(x.alias("x"), F.concat_ws("/", database, x["schema"], x["path"]).alias("full_path"))

    def split(y: Column) -> Column:
        x = y["x"]
        parts = F.when(
            x["kind"] == "Snowflake", F.struct(x["schema"].alias("schema_name"), x["path"].alias("table_name"))
        ).otherwise(table_from_path(y["full_path"]))
        return F.struct(x.alias("x"), y["full_path"].alias("full_path"), parts.alias("parts"))

    def row(z: Column) -> Column:
        x = z["x"]
        lake = x["kind"] == "OneLake"
        database = F.when(x["kind"] == "Snowflake", blank_to_null(x["database"])).otherwise(x["database"])
        return F.struct(
            z["parts"]["table_name"].alias("table_name"), z["parts"]["schema_name"].alias("schema_name"), database.alias("database"),
            z["full_path"].alias("full_path"), F.when(lake, "shortcut").otherwise("external").alias("table_type"),
            F.when(lake, x["item"]).alias("source_item_id"),
        )

    named = F.transform(F.filter(F.array(found), lambda x: x["path"] != ""), placed)
    return F.transform(F.filter(F.transform(named, split), lambda z: z["parts"].isNotNull()), row)


def base_type(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(" Shortcut"), F.lit(""))


def table_id(kind: str, *cols: Column | str) -> Column:
    """Synthetic id such as ``shortcut_<item>_<schema>_<table>``: lower case, no spaces."""
    text = F.concat_ws("_", F.lit(kind), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))
