"""Round trips: benchmark tables are landed as files in the shared folder and read back."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.catalog.base import act, query
from tidewatch.catalog.graph import GR, rc
from tidewatch.operators import reports as R
from tidewatch.session import scratch_path
from tidewatch.sources import readers as RD
from tidewatch.sources import scan as SC
from tidewatch.sources import sinks as SK
from tidewatch.sources.adapters import activities as A, jobs as J, lineage_graph, lineage_records, table

RAW = {
    "event_id": "Id", "activity_type": "Activity", "item_id": "ItemId", "item_name": "ItemName", "item_type": "ItemType", "workspace_id": "WorkspaceId",
    "submitted_by": "SubmittedBy", "status": "Status", "start_time": "CreationTime", "end_time": "EndTime", "duration_seconds": "DurationSeconds",
}
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def land_csv(s, d):
    """Two folders of CSV with different headers: the workspace name under either spelling."""
    path = scratch_path(s, "landing")
    raw = A(s, d).select(
        *[(F.date_format(c, _ISO) if c.endswith("_time") else F.col(c)).alias(n) for c, n in RAW.items()], F.col("workspace_name"), F.col("event_id").cast("bigint").alias("k")
    )
    late = F.col("k") % 2 == 0
    raw.filter(late).drop("k").withColumnRenamed("workspace_name", "WorkspaceName").write.option("header", True).csv(f"{path}/daily/fabric_activities_1.csv")
    raw.filter(~late).drop("k").withColumnRenamed("workspace_name", "_workspace_name").write.option("header", True).csv(f"{path}/daily/fabric_activities_2.csv")
    return path


LOADED = ["event_id", "activity_id", "activity_type", "item_id", "item_type", "workspace_id", "workspace_name", "submitted_by", "status", "start_time", "end_time", "duration_seconds"]
_LSQL = "SELECT event_id, event_id AS activity_id, activity_type, item_id, item_type, workspace_id, workspace_name, submitted_by, status, start_time, end_time, coalesce(duration_seconds, 0) AS duration_seconds FROM act"


def ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@query("load_activities_csv", act(_LSQL))
def _(s, d):
    return ntz(RD.load_activities(s, land_csv(s, d)).select(*LOADED))


@query("load_gated_csv", act("SELECT count(*) AS rows, count(DISTINCT \"WorkspaceName\") AS workspaces FROM (SELECT workspace_name AS \"WorkspaceName\" FROM act WHERE eid % 2 = 0)"))
def _(s, d):
    path = land_csv(s, d)
    rows = RD.load_gated_csv(s, f"{path}/daily/*.csv", [*RAW.values(), "WorkspaceName"])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("WorkspaceName").alias("workspaces"))


@query("standardise_events", act("""SELECT event_id AS "Id", activity_type AS "Activity", workspace_id AS "WorkspaceId", strftime(start_time, '%Y-%m-%d %H:%M:%S UTC') AS "CreationTime", strftime(start_time, '%Y-%m-%d %H:%M:%S UTC') AS "StartTime",
 duration_seconds*1000 AS "Duration", duration_seconds*1000 AS "DurationMs", status AS "Status" FROM act"""))
def _(s, d):
    raw = A(s, d).select(
        F.col("event_id").alias("Id"), F.col("activity_type").alias("Operation"), F.col("workspace_id").alias("GroupId"), F.date_format("start_time", _ISO).alias("ActivityDateTime"),
        (F.col("duration_seconds") * 1000).cast("string").alias("DurationMs"), F.col("status").alias("Status"),
    )
    return RD.standardise_events(raw, drop_empty=True)


def land_arrays(df, path, rows, wrap="%s"):
    """Compressed JSON files of one array each, with a bounded number of rows a file; rows stay in the task that has them."""

    def arrays(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_arrays([pa.array([wrap % f"[{','.join(batch.column(0).slice(i, rows).to_pylist())}]"])], ["value"])

    body = df.select(F.to_json(F.struct(*df.columns)).alias("record")).mapInArrow(arrays, "value string")
    body.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return f"{path}/part-*"


@query("load_jobs_json", """SELECT CASE WHEN event_id % 9 <> 4 THEN 'job_'||event_id END AS job_instance_id, ts + to_seconds(CAST((event_id*37) % 800 - 400 AS BIGINT)) AS job_start_time, CASE WHEN event_id % 5 = 0 THEN 'Job failed: '||(event_id % 4) END AS reason FROM events WHERE event_type IN ('purchase','error')""")
def _(s, d):
    path = scratch_path(s, "jobs")
    j = J(s, d).select(
        F.when(F.regexp_extract("job_instance_id", "[0-9]+", 0).cast("bigint") % 9 != 4, F.col("job_instance_id")).alias("id"), F.col("item_id").alias("itemId"), F.date_format("job_start_time", _ISO).alias("startTimeUtc"), F.date_format("job_end_time", _ISO).alias("endTimeUtc"),
        F.col("job_status").alias("status"), F.when(F.col("job_failure_reason").isNotNull(), F.to_json(F.struct(F.col("job_failure_reason").alias("message"), F.lit("E1").alias("errorCode")))).alias("failureReason"),
    )
    # One JSON array per file, as the job history is landed. Some jobs have no id.
    folders = land_arrays(j, path, 500)
    back = RD.load_jobs(s, folders)
    return ntz(back.select("job_instance_id", "job_start_time", F.col("job_failure_reason.message").alias("reason")))


@query("snapshot_round_trip", act("SELECT CAST(start_time AS DATE) AS date, count(*) AS rows, count(end_time) AS with_end FROM act GROUP BY 1"))
def _(s, d):
    path = scratch_path(s, "snapshots")
    a = A(s, d)
    SK.write_snapshot(a, path, "20240101")
    SK.write_snapshot(a, path, "20240201", R.first_seen(a)["workspaces"], R.first_seen(a)["items"])
    return RD.load_snapshot(s, path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.count("end_time").alias("with_end"))


@query("workspace_lookup", "SELECT 'ws_'||n_nationkey AS workspace_id, n_name AS workspace_name, 'cap_'||n_regionkey AS capacity_id FROM nation")
def _(s, d):
    path = scratch_path(s, "workspaces")
    table(s, d, "nation").selectExpr("concat('ws_', n_nationkey) as id", "n_name as displayName", "concat('cap_', n_regionkey) as capacityId").write.parquet(path)
    return RD.load_workspaces(s, path)


def _lineage(s, d, fmt):
    path = scratch_path(s, "lineage")
    records = lineage_records(s, d).drop("seq")
    if fmt == "csv":
        records.write.option("header", True).option("escape", '"').csv(f"{path}/lineage.csv")
        return RD.load_lineage(s, f"{path}/lineage.csv")
    folders = land_arrays(records, path, 2000, '{"lineage": %s}')
    back = RD.load_lineage(s, folders)
    if back.groupBy("seq").count().filter("count > 1").isEmpty():
        return back
    raise ValueError("two records have one place")


_LC = "SELECT kind AS source_type, count(*) AS records, count(DISTINCT item_id) AS items FROM (SELECT item_id, kind FROM ex UNION ALL SELECT item_id, 'OneLake' FROM up) GROUP BY 1"
for _fmt in ("csv", "json"):

    @query(f"load_lineage_{_fmt}", rc(_LC))
    def _(s, d, fmt=_fmt):
        return _lineage(s, d, fmt).groupBy(F.col("`Source Type`").alias("source_type")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("`Item ID`").alias("items"))


@query("flatten_scan", """SELECT item_type, count(*) AS records, count(DISTINCT item_id) AS items, CAST(sum(n) AS BIGINT) AS nested FROM (
 SELECT 'Lakehouse' AS item_type, 'c'||c_custkey AS item_id, coalesce(k,0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey=c_custkey
 UNION ALL SELECT 'Report', 'r'||c_custkey, NULL FROM customer UNION ALL SELECT 'SemanticModel', 'm'||c_custkey, 1 FROM customer UNION ALL SELECT 'DatasetTable', 'm'||c_custkey, NULL FROM customer) GROUP BY 1""")
def _(s, d):
    orders = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("targetDatasetId"))).alias("ups"))
    c = table(s, d, "customer").join(orders, "c_custkey", "left")
    lake = "struct(concat('c', c_custkey) as id, c_name as name, ups as upstreamDataflows, cast(null as array<struct<id:string,targetDatasetId:string>>) as downstreamDataflows, cast(null as array<struct<id:string,targetDatasetId:string>>) as datasourceUsages)"
    ref = "cast(null as array<struct<id:string,targetDatasetId:string>>)"
    sets = f"struct(concat('m', c_custkey) as id, c_name as name, {ref} as expressions, {ref} as upstreamDatasets, array(struct('t' as name, {ref} as columns, {ref} as measures, cast(null as array<struct<expression:string>>) as source)) as tables)"
    empty = "cast(null as array<struct<id:string,name:string,upstreamDataflows:array<struct<id:string,targetDatasetId:string>>,downstreamDataflows:array<struct<id:string,targetDatasetId:string>>,datasourceUsages:array<struct<id:string,targetDatasetId:string>>>>)"
    payload = c.selectExpr(
        "c_mktsegment as id", "c_mktsegment as name", f"array({lake}) as lakehouses", f"{empty} as warehouses", f"{empty} as mirroredDatabases", f"{empty} as kqlDatabases",
        "cast(null as array<struct<itemId:string,itemName:string,name:string,path:string,target:struct<type:string,location:string,path:string,connectionId:string>>>) as shortcuts",
        f"array({sets}) as datasets", "array(struct(concat('r', c_custkey) as id, c_name as name, concat('m', c_custkey) as datasetId)) as reports",
        f"cast(null as array<struct<objectId:string,name:string,datasourceUsages:array<struct<id:string,targetDatasetId:string>>>>) as dataflows",
    )
    flat = SC.flatten_scan(payload)
    return flat.groupBy("item_type").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("item_id").alias("items"), F.sum(F.coalesce("upstream_count", "table_count")).alias("nested"))


@query("flatten_scan_all_kinds", """SELECT 'Warehouse' AS item_type, 'w'||s_suppkey AS item_id, s_name AS item_name, 'Scanner API' AS source_type, NULL::VARCHAR AS source_connection, NULL::VARCHAR AS shortcut_path, CAST(s_suppkey % 3 AS INTEGER) AS datasource_count FROM supplier
 UNION ALL SELECT 'Mirroreddatabase', 'm'||s_suppkey, 'Unknown', 'Scanner API', NULL, NULL, 0 FROM supplier UNION ALL SELECT 'Kqldatabase', 'k'||s_suppkey, s_name, 'Scanner API', NULL, NULL, 0 FROM supplier
 UNION ALL SELECT 'Lakehouse Shortcut', 'l'||s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'AmazonS3' ELSE 'Unknown' END, CASE WHEN s_suppkey % 2 = 0 THEN 's3://b'||s_nationkey ELSE 'Tables/x' END, 'Files/'||s_suppkey, NULL FROM supplier
 UNION ALL SELECT 'Dataflow', 'f'||s_suppkey, s_name, 'Dataflow', NULL, NULL, CAST(s_suppkey % 3 AS INTEGER) FROM supplier WHERE s_suppkey % 4 <> 0""")
def _(s, d):
    some = "transform(slice(sequence(0, 2), 1, cast(s_suppkey % 3 as int)), i -> named_struct('id', cast(i as string), 'targetDatasetId', cast(null as string)))"
    none = "cast(null as array<struct<id:string,targetDatasetId:string>>)"
    thing = lambda prefix, name, sources: f"array(named_struct('id', concat('{prefix}', s_suppkey), 'name', {name}, 'upstreamDataflows', {none}, 'downstreamDataflows', {none}, 'datasourceUsages', {sources}))"
    target = "named_struct('type', if(s_suppkey % 2 = 0, 'AmazonS3', null), 'location', if(s_suppkey % 2 = 0, concat('s3://b', s_nationkey), null), 'path', 'Tables/x', 'connectionId', 'c')"
    rows = table(s, d, "supplier").selectExpr(
        "cast(s_nationkey as string) as id", "cast(null as string) as name", f"{thing('w', 's_name', some)} as warehouses", f"{thing('m', 'cast(null as string)', none)} as mirroredDatabases",
        f"{thing('k', 's_name', none)} as kqlDatabases", f"array(named_struct('itemId', concat('l', s_suppkey), 'itemName', s_name, 'name', 'sc', 'path', concat('Files/', s_suppkey), 'target', {target})) as shortcuts",
        f"if(s_suppkey % 4 = 0, null, array(named_struct('objectId', concat('f', s_suppkey), 'name', s_name, 'datasourceUsages', {some}))) as dataflows",
    )
    schema = StructType.fromDDL(SC.SCAN_SCHEMA)
    whole = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return SC.flatten_scan(whole).select("item_type", "item_id", "item_name", "source_type", "source_connection", "shortcut_path", "datasource_count")


@query("lineage_record_flows", """SELECT 'Dataflow' AS kind, 'f'||s_suppkey AS item_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Sql, Web' ELSE 'Dataflow' END AS source_type, NULL::VARCHAR AS connection FROM supplier
 UNION ALL SELECT 'KQLDatabase Shortcut', 'k'||s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Unknown' ELSE 'AmazonS3' END, CASE s_suppkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 's3://b' ELSE 'p/q' END FROM supplier""")
def _(s, d):
    base = "cast(s_nationkey as string) as workspace_id", "s_name as workspace_name"
    flows = table(s, d, "supplier").selectExpr(*base, "concat('f', s_suppkey) as item_id", "s_name as item_name", "if(s_suppkey % 2 = 0, array('Sql', 'Web'), cast(array() as array<string>)) as source_types", "cast(null as string) as connections")
    target = """case s_suppkey % 3 when 0 then 'plain' when 1 then '{"type":"AmazonS3","location":"s3://b"}' else '{"type":"AmazonS3","path":"p/q","location":"s3://b"}' end as target"""
    cuts = table(s, d, "supplier").selectExpr(*base, "concat('k', s_suppkey) as item_id", "s_name as item_name", "'KQLDatabase' as item_kind", "'sc' as name", "'Tables' as path", target)
    rec = SC.build_lineage_records(shortcuts=cuts, dataflows=flows)
    return rec.select(F.col("`Item Type`").alias("kind"), F.col("`Item ID`").alias("item_id"), F.col("`Source Type`").alias("source_type"), F.col("`Source Connection`").alias("connection"))


@query("lineage_record_kinds", """SELECT 'Report' AS kind, count(*) AS records, count(*) FILTER (WHERE c_nationkey % 5 <> c_nationkey % 3) AS crossing FROM customer
 UNION ALL SELECT 'MirroredDatabase', count(*), 0 FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'Lakehouse Shortcut', count(*), 0 FROM part UNION ALL SELECT 'SemanticModel', count(*), 0 FROM part""")
def _(s, d):
    reports = table(s, d, "customer").selectExpr("concat('w', c_nationkey % 5) as workspace_id", "c_mktsegment as workspace_name", "concat('r', c_custkey) as item_id", "c_name as item_name", "concat('m', c_custkey) as dataset_id", "concat('w', c_nationkey % 3) as dataset_workspace_id")
    body = "to_json(named_struct('properties', named_struct('source', named_struct('sourceType', 'Snowflake', 'connection', concat('c', s_nationkey)))))"
    mirrored = table(s, d, "supplier").selectExpr("concat('w', s_nationkey) as workspace_id", "s_name as workspace_name", "concat('d', s_suppkey) as item_id", "s_name as item_name", f"if(s_suppkey % 3 = 0, 'not base64!', base64(encode({body}, 'utf-8'))) as payload")
    cuts = table(s, d, "part").selectExpr("p_brand as workspace_id", "p_brand as workspace_name", "concat('p', p_partkey) as item_id", "p_name as item_name", "'Lakehouse' as item_kind", "'sc' as name", "'Tables' as path", "to_json(named_struct('type', 'OneLake', 'path', p_type)) as target")
    models = table(s, d, "part").selectExpr("p_brand as workspace_id", "p_brand as workspace_name", "concat('p', p_partkey) as item_id", "p_name as item_name", "array('Sql', p_type) as source_types", "cast(null as string) as connections")
    rec = SC.build_lineage_records(mirrored=mirrored, shortcuts=cuts, models=models, reports=reports)
    return rec.groupBy(F.col("`Item Type`").alias("kind")).agg(F.count(F.lit(1)).alias("records"), F.count_if("`Cross Workspace`").alias("crossing"))


@query("mirror_status", "SELECT 'd'||(l_suppkey) AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'dbo' ELSE l_returnflag END AS \"schemaName\", 'T'||l_orderkey AS \"tableName\", CAST(l_quantity AS BIGINT) AS \"processedRows\" FROM lineitem")
def _(s, d):
    entry = "array(named_struct('sourceSchemaName', if(l_linenumber % 2 = 0, null, l_returnflag), 'sourceTableName', concat('T', l_orderkey), 'status', l_linestatus, 'metrics', named_struct('processedRows', cast(l_quantity as bigint), 'lastSyncDateTime', cast(null as string)))) as data"
    df = table(s, d, "lineitem").selectExpr("concat('d', l_suppkey) as item_id", entry)
    return SC.flatten_mirror_status(df).select("item_id", "schemaName", "tableName", "processedRows")


@query("report_csv_round_trip", act("SELECT item_type, count(*) AS failure_count FROM act WHERE status='Failed' GROUP BY 1"))
def _(s, d):
    out = SK.write_reports({"by_type": R.failure_breakdown(A(s, d))["by_type"]}, scratch_path(s, "reports"))
    return s.read.schema("item_type string, failure_count bigint").option("header", True).csv(out["by_type"])


@query("job_export_failed", """SELECT 'job_'||event_id AS job_instance_id FROM events WHERE event_type IN ('purchase','error') AND event_id % 5 = 0""")
def _(s, d):
    out = SK.export_jobs(J(s, d).withColumn("tags", F.array("job_type")), scratch_path(s, "jobs"))
    return s.read.option("header", True).csv(out["jobs_failed"]).select("job_instance_id")


@query("graph_export", f"WITH {GR} SELECT 'node' AS kind, count(*) AS rows FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges")
def _(s, d):
    path = SK.export_graph(lineage_graph(s, d), scratch_path(s, "graph"))
    return s.read.text(path).groupBy(F.get_json_object("value", "$.kind").alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("upsert_nodes", "SELECT 'c'||c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name)||'!' ELSE c_name END AS name, c_mktsegment AS type FROM customer UNION ALL SELECT 's'||s_suppkey, s_name, 'Supplier' FROM supplier")
def _(s, d):
    old = table(s, d, "customer").selectExpr("concat('c', c_custkey) as id", "c_name as name", "c_mktsegment as type")
    new = table(s, d, "customer").filter("c_custkey % 2 = 0").selectExpr("concat('c', c_custkey) as id", "concat(upper(c_name), '!') as name", "'x' as type")
    return SK.merge_nodes(old, new.unionByName(table(s, d, "supplier").selectExpr("concat('s', s_suppkey) as id", "s_name as name", "'Supplier' as type")), on_match=["name"])


@query("upsert_edges", "SELECT DISTINCT 'p'||l_partkey AS src, 's'||l_suppkey AS dst, 'CONSUMES' AS rel FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)")
def _(s, d):
    e = table(s, d, "lineitem").selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst", "'CONSUMES' as rel", "l_returnflag")
    known = table(s, d, "part").selectExpr("concat('p', p_partkey) as id").unionByName(table(s, d, "supplier").selectExpr("concat('s', s_suppkey) as id"))
    first = e.filter("l_returnflag = 'A'").drop("l_returnflag").distinct()
    return SK.merge_edges(first, e.drop("l_returnflag"), known)


@query("retention", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS rows FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) >= DATE '1998-06-01' - 180 GROUP BY 1")
def _(s, d):
    path = scratch_path(s, "retention")
    table(s, d, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).repartition("date").write.partitionBy("date").parquet(path)
    SK.apply_retention(s, path, 180, "1998-06-01")
    return s.read.schema("o_orderkey bigint, date date").parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
