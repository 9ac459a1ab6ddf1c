"""Queries for operators that the other modules do not run: key fallbacks, small conversions, tables and schemas."""

import uuid

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.catalog.base import act, query
from tidewatch.catalog.graph import GR
from tidewatch.functions import basics as B
from tidewatch.functions import enrich as E
from tidewatch.functions import labels as L
from tidewatch.operators.graph import build as GB
from tidewatch.operators.graph import governance as V
from tidewatch.operators.graph import traverse as T
from tidewatch.session import scratch_path
from tidewatch.sources import readers as RD
from tidewatch.sources import sinks as SK
from tidewatch.sources.adapters import activities as A, lineage_graph as G, lineage_records, table


def _parts(s, d, *exprs):
    return table(s, d, "part").selectExpr("p_partkey", *exprs)


# ---- E1-E3, E5: the first filled key ------------------------------------------------
@query("entity_keys", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'p'||p_partkey WHEN p_partkey % 3 = 1 THEN 'q'||p_partkey END AS item_id,
 CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS item_name, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS item_type FROM part""")
def _(s, d):
    rows = _parts(
        s, d, "if(p_partkey % 3 = 0, concat('p', p_partkey), '') as a", "if(p_partkey % 3 = 2, null, concat('q', p_partkey)) as b", "if(p_partkey % 2 = 0, p_name, null) as n", "p_brand as m",
        "if(p_partkey % 5 = 0, p_type, '') as k",
    )
    return rows.select("p_partkey", E.item_id(["a", "b"]).alias("item_id"), E.item_name(["n", "m"]).alias("item_name"), E.item_type(["k"]).alias("item_type"))


@query("users_of_structs", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'u'||c_custkey ELSE 'mail'||c_custkey END AS user_name FROM customer""")
def _(s, d):
    c = table(s, d, "customer").selectExpr(
        "c_custkey", "named_struct('displayName', if(c_custkey % 3 = 0, c_name, ''), 'userPrincipalName', if(c_custkey % 3 = 1, concat('live|u', c_custkey, '@corp.com'), null), 'email', concat('mail', c_custkey, '@x.org')) as u"
    )
    return c.select("c_custkey", E.user_from_struct("u").alias("user_name"))


# ---- E19-E21, E28: conversions -------------------------------------------------------
@query("text_conversions", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'none' END AS safe, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS kept, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_size END, -1) AS filled FROM part""")
def _(s, d):
    rows = _parts(s, d, "if(p_partkey % 2 = 0, concat(' ', p_name, ' '), null) as a", "if(p_partkey % 3 > 0, concat(p_brand, '  '), '  ') as b", "if(p_partkey % 4 > 0, p_size, null) as c")
    return rows.select("p_partkey", B.safe_string("a", "none").alias("safe"), B.string_or_null("b").alias("kept"), B.fill("c", -1).alias("filled"))


@query("error_fields", act("""SELECT event_id, failure_reason AS text_message, CASE WHEN failure_reason IS NOT NULL THEN 'Unknown' END AS text_code, failure_reason AS struct_message, error_code AS struct_code FROM act WHERE status = 'Failed'"""))
def _(s, d):
    a = A(s, d).filter("status = 'Failed'").withColumn("nested", F.struct(F.col("failure_reason").alias("message"), F.col("error_code").alias("errorCode")))
    return a.select(
        "event_id", L.error_message("failure_reason", False).alias("text_message"), L.error_code("failure_reason", False).alias("text_code"),
        L.error_message("nested", True).alias("struct_message"), L.error_code("nested", True).alias("struct_code"),
    )


# ---- S15, S16, S18, S22, S23: tables, catalog, schemas, reports of a snapshot ----------
@query("saved_table", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS customer_sk, o_orderstatus FROM orders")
def _(s, d):
    rows = table(s, d, "orders").selectExpr("o_orderkey", "if(o_orderkey % 4 > 0, cast(o_custkey as string), 'none') as customer_sk", "o_orderstatus")
    return s.read.parquet(SK.save_table(rows, scratch_path(s, "tables"), "orders", "o_orderstatus")).select("o_orderkey", "customer_sk", "o_orderstatus")


@query("published_tables", "SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1")
def _(s, d):
    path = scratch_path(s, "publish")
    # A name of its own, as the warehouse may hold the table of an application that is gone.
    own = f"tidewatch_customers_{uuid.uuid4().hex}"
    table(s, d, "customer").select("c_custkey", "c_mktsegment").write.parquet(f"{path}/{own}")
    (name,) = SK.publish_folder(s, path, [own])
    return s.table(name).groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query("run_summary_file", act("SELECT count(*) AS activities FROM act"))
def _(s, d):
    """The written summary is one document; what it counts is checked by the report's own query."""
    path = SK.write_run_summary(A(s, d), 28, scratch_path(s, "summary"))
    lines = s.read.text(path).agg(F.count("*").alias("documents")).scalar()
    return A(s, d).agg(F.count("*").alias("activities")).filter(lines == 1)


@query("conformed_rows", act("SELECT event_id, activity_type, CAST(NULL AS VARCHAR) AS root_activity_id, duration_seconds, 'bigint' AS key_type FROM act"))
def _(s, d):
    raw = A(s, d).select("event_id", "activity_type", F.col("duration_seconds").cast("string").alias("duration_seconds"), F.lit("7").alias("workspace_sk"))
    out = schemas.conform(raw, "fact_activity")
    kind = dict(out.dtypes)["workspace_sk"]
    return raw.select("event_id", "activity_type").join(out.select("event_id", "root_activity_id", "duration_seconds"), "event_id").withColumn("key_type", F.lit(kind))


@query("rebuilt_reports", act("SELECT 'rows' AS measure, count(*) AS n FROM act UNION ALL SELECT 'failed', count(*) FROM act WHERE status='Failed'"))
def _(s, d):
    path = scratch_path(s, "rebuild")
    A(s, d).write.parquet(path)
    master = RD.rebuild_reports(s, path)["activities_master"]
    return master.groupBy().agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "Failed").alias("failed")).unpivot([], ["rows", "failed"], "measure", "n")


# ---- U1, G5, G39, G56, G57: appends, report links, paths, chain report -----------------
@query("appended_rows", "SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS place FROM customer UNION ALL SELECT s_suppkey, NULL, 'n'||s_nationkey FROM supplier")
def _(s, d):
    return V.append(table(s, d, "customer").selectExpr("c_custkey as id", "c_name as name"), table(s, d, "supplier").selectExpr("s_suppkey as id", "concat('n', s_nationkey) as place"))


@query("report_links", "SELECT 'r'||c_custkey AS src, 'p'||c_custkey AS dst, 'READS_FROM' AS rel FROM customer WHERE c_custkey IN (SELECT p_partkey FROM part)")
def _(s, d):
    base = lineage_records(s, d)
    reports = table(s, d, "customer").select(
        (F.col("c_custkey") + 2_000_000_000_000).alias("seq"), F.lit("w").alias("Workspace ID"), F.lit("W").alias("Workspace Name"), F.concat(F.lit("r"), "c_custkey").alias("Item ID"), F.col("c_name").alias("Item Name"),
        F.lit("Report").alias("Item Type"), F.lit("PowerBI").alias("Source Type"), F.concat(F.lit("p"), "c_custkey").alias("Source Connection"), F.concat(F.lit("p"), "c_custkey").alias("Connection ID"),
    )
    return GB.report_edges(base.unionByName(reports, allowMissingColumns=True))


def mirrored_records(s, d):
    """A mirrored database per supplier with a Snowflake source and a mounted table; every third has an external kind of its own."""
    body = "to_json(named_struct('properties', named_struct('source', named_struct('type', 'Snowflake', 'typeProperties', named_struct('connection', concat('c', s_nationkey), 'database', concat('DB', s_nationkey))), 'mountedTables', array(named_struct('source', named_struct('typeProperties', named_struct('schemaName', 'sch', 'tableName', concat('T', s_suppkey))))))))"
    snow = "to_json(named_struct('type', 'Snowflake', 'snowflake', named_struct('connection', concat('x', s_suppkey), 'database', 'D')))"
    return table(s, d, "supplier").selectExpr(
        "s_suppkey as seq", "concat('w', s_nationkey) as `Workspace ID`", "'W' as `Workspace Name`", "concat('d', s_suppkey) as `Item ID`", "s_name as `Item Name`", "'MirroredDatabase' as `Item Type`",
        "if(s_suppkey % 3 = 0, 'Snowflake', 'MirroredDatabase') as `Source Type`", f"if(s_suppkey % 3 = 0, {snow}, cast(null as string)) as `Source Connection`", f"{body} as `Full Definition`",
    )


@query("mirrored_edges", """SELECT 'd'||s_suppkey AS src, 'src_'||substr(md5('Snowflake|c'||s_nationkey||'|DB'||s_nationkey),1,12) AS dst FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(s, d):
    return GB.mirror_source_edges(mirrored_records(s, d)).select("src", "dst")


@query("edges_have_both_ends", "SELECT rel, count(*) AS edges, 0 AS loose FROM (SELECT 'CONSUMES' AS rel FROM supplier UNION ALL SELECT 'CONTAINS' FROM supplier UNION ALL SELECT 'MIRRORS' FROM supplier WHERE s_suppkey % 3 <> 0) GROUP BY 1")
def _(s, d):
    """Every mirrored database consumes one source, by its definition or by its own kind; no edge lacks an end."""
    g = GB.build_graph(mirrored_records(s, d))
    ids = g.nodes.select("id").distinct()
    ends = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    whole = ends.groupBy("rel").agg(F.count("*").alias("sound"))
    return g.edges.groupBy("rel").agg(F.count("*").alias("edges")).join(whole, "rel", "left").select("rel", "edges", (F.col("edges") - F.coalesce("sound", F.lit(0))).cast("int").alias("loose"))


@query("mirrored_source_nodes", """SELECT DISTINCT 'src_'||substr(md5('Snowflake|c'||s_nationkey||'|DB'||s_nationkey),1,12) AS id, 'Snowflake' AS type, 'c'||s_nationkey AS location, 'DB'||s_nationkey AS database FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(s, d):
    return GB.source_nodes(mirrored_records(s, d)).filter("startswith(location, 'c')").select("id", "type", "location", "database")


@query("shortest_path_length", f"""WITH RECURSIVE {GR}, b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'c1' AS id, 0 AS n UNION SELECT y, n+1 FROM w JOIN b ON x=id WHERE n < 4)
 SELECT min(n) AS path_length FROM w WHERE id='s7' HAVING min(n) IS NOT NULL""")
def _(s, d):
    return T.shortest_path(G(s, d), "c1", "s7", 4).select("path_length")


@query("shortest_path_steps", f"""WITH RECURSIVE {GR}, b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'c1' AS id, ['c1'] AS path UNION ALL SELECT y, list_append(path, y) FROM w JOIN b ON x=id WHERE len(path) <= 3 AND NOT list_contains(path, y)),
 p AS (SELECT path FROM w WHERE id='s7' ORDER BY len(path), path LIMIT 1), st AS (SELECT unnest(range(len(path))) AS step, unnest(path) AS id, path FROM p)
 SELECT CAST(step AS INTEGER) AS step, st.id, name, label, type, (SELECT string_agg(DISTINCT rel, ',' ORDER BY rel) FROM edges WHERE (src=st.id AND dst=path[step]) OR (dst=st.id AND src=path[step])) AS relations FROM st JOIN nodes USING (id)""")
def _(s, d):
    g = G(s, d)
    steps = T.path_steps(g, T.shortest_path(g, "c1", "s7"))
    return steps.withColumn("relations", F.array_join("relations", ","))


@query("chain_report_sections", f"""WITH RECURSIVE {GR}, w AS (SELECT src AS id, 1 AS depth FROM dep WHERE dst NOT IN (SELECT src FROM dep) UNION ALL SELECT src, depth+1 FROM w JOIN dep ON dst=id),
 n AS (SELECT depth, count(*) AS c FROM w WHERE depth >= 2 GROUP BY 1) SELECT 'nodes' AS section, count(*) AS rows FROM items UNION ALL SELECT 'distribution', count(*) FROM n UNION ALL SELECT 'stats', 1""")
def _(s, d):
    report = V.chain_report(G(s, d))
    counts = [report[k].agg(F.lit(k).alias("section"), F.count("*").alias("rows")) for k in ("nodes", "distribution", "stats")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("named_structs", "SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey % 2 = 0) AS kept FROM customer GROUP BY 1")
def _(s, d):
    gathered = table(s, d, "customer").groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 100).alias("hundred")).agg(F.collect_list(F.struct(F.expr("if(c_custkey % 2 = 0, c_name, null)").alias("name"))).alias("c"))
    return gathered.groupBy("c_mktsegment").agg(F.sum(F.size(V.drop_null_structs(F.col("c")))).cast("bigint").alias("kept"))
