"""Lineage graph: construction, statistics, sources and tables."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import query, r2
from tidewatch.operators.graph import build as GB
from tidewatch.operators.graph import stats as GS
from tidewatch.operators.graph import tables as GT
from tidewatch.sources.adapters import lineage_graph as G, lineage_records as REC

GR = """
used AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
nodes AS (
 SELECT DISTINCT p_brand AS id, 'Workspace' AS label, p_brand AS name, NULL::VARCHAR AS type, NULL::VARCHAR AS location, NULL::VARCHAR AS database, NULL::VARCHAR AS schema, NULL::VARCHAR AS full_path, NULL::VARCHAR AS table_type FROM part
 UNION ALL SELECT DISTINCT c_mktsegment, 'Workspace', c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
 UNION ALL SELECT 'p'||p_partkey, 'Item', p_name, p_type, NULL, NULL, NULL, NULL, NULL FROM part
 UNION ALL SELECT 'c'||c_custkey, 'Item', c_name, 'Report', NULL, NULL, NULL, NULL, NULL FROM customer
 UNION ALL SELECT 's'||s_suppkey, 'Source', s_name, (['AdlsGen2','AmazonS3','Snowflake','OneDriveSharePoint','OneLake'])[s_suppkey % 5 + 1], 'nation_'||s_nationkey,
  CASE WHEN s_suppkey % 5 = 2 THEN 'DB'||s_nationkey END, NULL, NULL, NULL FROM supplier
 UNION ALL SELECT 't_'||lower(p_type)||'_tbl_'||p_size, 'Table', 'TBL_'||p_size, NULL, NULL, CASE WHEN p_size % 3 = 0 THEN 'DB'||(p_size % 7) END, p_type, 'Tables/'||p_type||'/TBL_'||p_size,
  CASE WHEN p_size % 3 = 0 THEN 'mirrored' ELSE 'shortcut' END FROM (SELECT DISTINCT p_type, p_size FROM part)),
edges AS (
 SELECT p_brand AS src, 'p'||p_partkey AS dst, 'CONTAINS' AS rel FROM part
 UNION ALL SELECT c_mktsegment, 'c'||c_custkey, 'CONTAINS' FROM customer WHERE c_acctbal >= 0
 UNION ALL SELECT 'p'||p_partkey, 'p'||(p_partkey//2), 'DEPENDS_ON' FROM part WHERE p_partkey >= 1
 UNION ALL SELECT 'p'||p_partkey, 'p'||(p_partkey//3), 'DEPENDS_ON' FROM part WHERE p_partkey >= 1 AND p_partkey//3 <> p_partkey//2
 UNION ALL SELECT 'c'||c_custkey, 'p'||c_custkey, 'DEPENDS_ON' FROM customer WHERE c_mktsegment='BUILDING'
 UNION ALL SELECT 'p'||l_partkey, 's'||l_suppkey, 'CONSUMES' FROM used
 UNION ALL SELECT 'p'||p_partkey, 't_'||lower(p_type)||'_tbl_'||p_size, 'PROVIDES_TABLE' FROM part
 UNION ALL SELECT DISTINCT 'p'||(p_partkey//5), 't_'||lower(p_type)||'_tbl_'||p_size, 'USES_TABLE' FROM part
 UNION ALL SELECT 'c'||c_custkey, 't_'||lower(p_type)||'_tbl_'||p_size, 'MIRRORS' FROM part JOIN customer ON p_partkey=c_custkey WHERE c_mktsegment='MACHINERY'
 UNION ALL SELECT 'c'||c_custkey, 'p'||c_custkey, 'READS_FROM' FROM customer WHERE c_mktsegment='FURNITURE'),
items AS (SELECT id AS item_id, name AS item_name, type AS item_type FROM nodes WHERE label='Item'),
srcs AS (SELECT id AS source_id, name AS source_name, type AS source_type, location, database FROM nodes WHERE label='Source'),
tabs AS (SELECT id AS table_id, name AS table_name, schema, database, full_path, table_type FROM nodes WHERE label='Table'),
home AS (SELECT dst AS item_id, src AS workspace_id, name AS workspace FROM edges JOIN nodes ON src=id WHERE rel='CONTAINS'),
dep AS (SELECT src, dst FROM edges WHERE rel='DEPENDS_ON'), con AS (SELECT src AS item_id, dst AS source_id FROM edges WHERE rel='CONSUMES'),
te AS (SELECT src AS item_id, dst AS table_id, rel FROM edges WHERE rel IN ('MIRRORS','USES_TABLE','PROVIDES_TABLE'))
"""


def gr(sql):
    return f"WITH {GR} {sql}"


#: The same tables, but each is built once and kept, however often a query names it.
STORED = GR.replace("nodes AS (", "nodes AS MATERIALIZED (").replace("edges AS (", "edges AS MATERIALIZED (").replace("home AS (", "home AS MATERIALIZED (")
KEPT = {"top_connected_items", "root_items", "consumers_of_source_type", "graph_with_tables", "unassigned_items"}


def reg(name, sql, fn):
    query(name, (f"WITH {STORED} {sql}" if name in KEPT else gr(sql)) if sql else None)(fn)


reg("graph_overview", """SELECT 'node' AS kind, label AS name, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY 2
 UNION ALL SELECT 'node','total',count(*) FROM nodes UNION ALL SELECT 'edge','total',count(*) FROM edges""", lambda s, d: GS.overview(*G(s, d)))
reg("items_by_type", "SELECT type, count(*) AS count FROM nodes WHERE label='Item' GROUP BY 1", lambda s, d: GS.count_by_type(G(s, d)))
reg("sources_by_type", "SELECT type, count(*) AS count FROM nodes WHERE label='Source' GROUP BY 1", lambda s, d: GS.count_by_type(G(s, d), "Source"))
reg("graph_connectivity", """SELECT label, count(*) AS node_count, avg(n) AS avg_connections, min(n) AS min_connections, max(n) AS max_connections FROM
 (SELECT id, label, coalesce(n,0) AS n FROM nodes LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) USING (id)) GROUP BY 1""",
    lambda s, d: GS.connectivity(*G(s, d)))
OUTC = "(SELECT src AS item_id, count(*) AS n FROM edges WHERE rel='{r}' GROUP BY 1)"
INC = "(SELECT dst AS item_id, count(*) AS n FROM edges WHERE rel='{r}' GROUP BY 1)"
reg("workspace_stats", f"""SELECT w.id AS workspace_id, w.name AS workspace_name, count(h.item_id) AS item_count, CAST(coalesce(sum(a.n),0) AS BIGINT) AS internal_deps, CAST(coalesce(sum(b.n),0) AS BIGINT) AS external_deps
 FROM nodes w LEFT JOIN home h ON h.workspace_id=w.id LEFT JOIN {OUTC.format(r='DEPENDS_ON')} a ON a.item_id=h.item_id LEFT JOIN {OUTC.format(r='CONSUMES')} b ON b.item_id=h.item_id
 WHERE w.label='Workspace' GROUP BY 1,2""", lambda s, d: GS.workspace_stats(G(s, d)))
reg("graph_workspace_summary", """SELECT workspace_id, workspace, count(*) AS item_count, count(s.src) AS items_with_dependencies, count(*)-count(s.src) AS standalone_items
 FROM home LEFT JOIN (SELECT DISTINCT src FROM dep) s ON s.src=item_id GROUP BY 1,2 ORDER BY 3 DESC, 1 LIMIT 20""", lambda s, d: GS.workspace_summary(G(s, d)))
reg("workspace_type_distribution", "SELECT workspace, item_type, count(*) AS count FROM home JOIN items USING (item_id) GROUP BY 1,2", lambda s, d: GS.type_distribution(G(s, d)))
reg("workspace_complexity", f"""SELECT *, {r2('CAST(total_relationships AS DOUBLE)/items')} AS avg_relationships_per_item FROM (SELECT workspace, count(*) AS items, CAST(coalesce(sum(n),0) AS BIGINT) AS total_relationships
 FROM home LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES','MIRRORS') UNION ALL SELECT dst FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES','MIRRORS')) GROUP BY 1) ON id=item_id
 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20)""", lambda s, d: GS.complexity(G(s, d)))
reg("isolated_workspaces", """SELECT workspace AS isolated_workspace, count(*) AS item_count FROM home h WHERE NOT EXISTS (SELECT 1 FROM dep JOIN home o ON o.item_id=dep.dst WHERE dep.src=h.item_id AND o.workspace_id<>h.workspace_id)
 AND NOT EXISTS (SELECT 1 FROM con WHERE con.item_id=h.item_id) GROUP BY 1""", lambda s, d: GS.isolated_workspaces(G(s, d)))
reg("top_connected_items", """SELECT item_id, workspace_id, workspace, incoming_connections, item_name, item_type FROM (SELECT item_id, n AS incoming_connections, workspace_id, workspace FROM
 (SELECT dst AS item_id, count(*) AS n FROM dep GROUP BY 1) JOIN home USING (item_id) ORDER BY n DESC, item_id LIMIT 10) JOIN items USING (item_id)""", lambda s, d: GS.top_connected(G(s, d)))
reg("top_sources", """SELECT source_id, source_name AS display_name, source_type, location, n AS consumer_count FROM (SELECT source_id, count(*) AS n FROM con GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) JOIN srcs USING (source_id)""",
    lambda s, d: GS.top_sources(G(s, d)))
HUB = """SELECT item_id, item_name, item_type, coalesce(i,0) AS incoming, coalesce(o,0) AS outgoing, coalesce(i,0)+coalesce(o,0) AS total_connections FROM items
 LEFT JOIN (SELECT dst AS item_id, count(*) AS i FROM edges GROUP BY 1) USING (item_id) LEFT JOIN (SELECT src AS item_id, count(*) AS o FROM edges GROUP BY 1) USING (item_id)"""
reg("hub_items", f"SELECT * FROM ({HUB}) ORDER BY total_connections DESC, item_id LIMIT 25", lambda s, d: GS.hubs(G(s, d)))
reg("degree_centrality", f"SELECT item_id, item_name, item_type, total_connections AS degree FROM ({HUB}) ORDER BY total_connections DESC, item_id LIMIT 30", lambda s, d: GS.degree_centrality(G(s, d)))
reg("item_centrality", """SELECT item_id, item_name, item_type, coalesce(o,0)+coalesce(i,0) AS internal_connections, coalesce(e,0) AS external_connections, coalesce(i,0) AS importance_score, workspace FROM items JOIN home USING (item_id)
 LEFT JOIN (SELECT src AS item_id, count(*) AS o FROM dep GROUP BY 1) USING (item_id) LEFT JOIN (SELECT dst AS item_id, count(*) AS i FROM dep GROUP BY 1) USING (item_id)
 LEFT JOIN (SELECT item_id, count(*) AS e FROM con GROUP BY 1) USING (item_id) ORDER BY importance_score DESC, item_id LIMIT 20""", lambda s, d: GS.centrality(G(s, d)))
reg("leaf_items", "SELECT i.*, workspace FROM items i LEFT JOIN home USING (item_id) WHERE item_id NOT IN (SELECT dst FROM dep)", lambda s, d: GS.leaves(G(s, d)))
reg("root_items", "SELECT i.*, workspace FROM items i LEFT JOIN home USING (item_id) WHERE item_id NOT IN (SELECT src FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES'))", lambda s, d: GS.roots(G(s, d)))
reg("items_with_sources", "SELECT * FROM items WHERE item_id IN (SELECT item_id FROM con)", lambda s, d: GS.has_edge(GT.items(G(s, d)), GT.rel(G(s, d), "CONSUMES")))
BOT = """SELECT item_id, item_name, item_type, i AS upstream_count, o AS downstream_count, i*o AS impact_score FROM items JOIN (SELECT dst AS item_id, count(*) AS i FROM dep GROUP BY 1) USING (item_id)
 JOIN (SELECT src AS item_id, count(*) AS o FROM dep GROUP BY 1) USING (item_id)"""
reg("bottleneck_items", f"{BOT} ORDER BY impact_score DESC, item_id LIMIT 20", lambda s, d: GS.bottlenecks(G(s, d)))
reg("bridge_items", f"SELECT item_id, item_name, item_type, upstream_count AS in_degree, downstream_count AS out_degree, impact_score AS bridge_score FROM ({BOT}) WHERE upstream_count > 1 AND downstream_count > 1 ORDER BY bridge_score DESC, item_id LIMIT 20",
    lambda s, d: GS.bridges(G(s, d)))
reg("workspace_density", f"""SELECT workspace, nodes, edges, CASE WHEN nodes > 1 THEN {r2('2.0*edges/(nodes*(nodes-1))', 4)} ELSE 0 END AS density FROM (SELECT h.workspace_id, any_value(h.workspace) AS workspace, count(DISTINCT h.item_id) AS nodes, count(x.src) AS edges
 FROM home h LEFT JOIN (SELECT src FROM dep JOIN home a ON a.item_id=src JOIN home b ON b.item_id=dst WHERE a.workspace_id=b.workspace_id) x ON x.src=h.item_id GROUP BY 1) ORDER BY density DESC, workspace LIMIT 20""",
    lambda s, d: GS.density(G(s, d)))
reg("type_cooccurrence", "SELECT a.item_type AS source_type, b.item_type AS target_type, count(*) AS occurrence_count FROM dep JOIN items a ON a.item_id=src JOIN items b ON b.item_id=dst GROUP BY 1,2 ORDER BY 3 DESC,1,2 LIMIT 30",
    lambda s, d: GS.type_cooccurrence(G(s, d)))
reg("workspace_maturity", f"""SELECT *, {r2('100.0*(items_with_deps+items_with_sources)/(2*item_count)', 1)} AS maturity_score FROM (SELECT workspace, count(*) AS item_count, count(d.src) AS items_with_deps, count(c.item_id) AS items_with_sources
 FROM home h LEFT JOIN (SELECT DISTINCT src FROM dep) d ON d.src=h.item_id LEFT JOIN (SELECT DISTINCT item_id FROM con) c ON c.item_id=h.item_id GROUP BY 1) ORDER BY maturity_score DESC, workspace LIMIT 20""",
    lambda s, d: GS.maturity(G(s, d)))
reg("source_diversity", """SELECT workspace, count(DISTINCT source_type) AS source_type_count, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types FROM con JOIN srcs USING (source_id) JOIN home USING (item_id)
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", lambda s, d: GS.source_diversity(G(s, d)).withColumn("source_types", F.array_join("source_types", ",")))
_DN = "(SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES') UNION ALL SELECT dst FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES')) GROUP BY 1)"
reg("graph_stats", f"""SELECT 'items_by_type' AS section, type AS name, count(*) AS count FROM nodes WHERE label='Item' GROUP BY 2 UNION ALL SELECT 'sources_by_type', type, count(*) FROM nodes WHERE label='Source' GROUP BY 2
 UNION ALL (SELECT 'top_items', id, n FROM {_DN} JOIN nodes USING (id) WHERE label='Item' ORDER BY n DESC, id LIMIT 10) UNION ALL (SELECT 'top_sources', id, n FROM {_DN} JOIN nodes USING (id) WHERE label='Source' ORDER BY n DESC, id LIMIT 10)""",
    lambda s, d: GS.graph_stats(G(s, d)))
reg("relation_counts", f"""SELECT items.*, coalesce(a.n,0) AS depends_on, coalesce(b.n,0) AS depended_by, coalesce(c.n,0) AS sources FROM items LEFT JOIN {OUTC.format(r='DEPENDS_ON')} a USING (item_id)
 LEFT JOIN {INC.format(r='DEPENDS_ON')} b USING (item_id) LEFT JOIN {OUTC.format(r='CONSUMES')} c USING (item_id)""",
    lambda s, d: GS.count_related(G(s, d), {"depends_on": ("DEPENDS_ON", "out"), "depended_by": ("DEPENDS_ON", "in"), "sources": ("CONSUMES", "out")}))

# ---- sources and tables ------------------------------------------------------------
reg("source_summary", "SELECT source_id, source_name, source_type, count(item_id) AS used_by_items FROM srcs LEFT JOIN con USING (source_id) GROUP BY 1,2,3", lambda s, d: GT.source_usage(G(s, d)))
reg("most_used_sources", """SELECT source_id, used_by_items, source_name, source_type, sample_consumers FROM (SELECT source_id, count(*) AS used_by_items, array_to_string(list_sort(list(DISTINCT item_name))[1:5], ',') AS sample_consumers
 FROM con JOIN items USING (item_id) GROUP BY 1) JOIN srcs USING (source_id) ORDER BY 2 DESC, 1 LIMIT 20""", lambda s, d: GT.source_usage(G(s, d), "most_used").withColumn("sample_consumers", F.array_join("sample_consumers", ",")))
reg("unused_sources", "SELECT source_id, source_name, source_type FROM srcs WHERE source_id NOT IN (SELECT source_id FROM con)", lambda s, d: GT.source_usage(G(s, d), "unused"))
reg("sources_by_workspace", """SELECT workspace, source_type, count(DISTINCT source_id) AS source_count, array_to_string(list_sort(list(DISTINCT source_name))[1:3], ',') AS sample_sources
 FROM con JOIN srcs USING (source_id) JOIN home USING (item_id) GROUP BY 1,2""", lambda s, d: GT.source_usage(G(s, d), "by_workspace").withColumn("sample_sources", F.array_join("sample_sources", ",")))
reg("items_by_source_count", "SELECT item_id, source_count, item_name, item_type FROM (SELECT item_id, count(*) AS source_count FROM con GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN items USING (item_id)", lambda s, d: GT.source_usage(G(s, d), "by_item"))
reg("consumers_of_source", "SELECT item_id, source_id, source_name, source_type, location, database, item_name, item_type, workspace_id, workspace FROM con JOIN srcs USING (source_id) JOIN items USING (item_id) JOIN home USING (item_id) WHERE source_id='s3'",
    lambda s, d: GT.source_consumers(G(s, d), source_id="s3"))
reg("consumers_of_source_type", "SELECT item_id, source_id, source_name, source_type, location, database, item_name, item_type, workspace_id, workspace FROM con JOIN srcs USING (source_id) JOIN items USING (item_id) JOIN home USING (item_id) WHERE source_type='Snowflake'",
    lambda s, d: GT.source_consumers(G(s, d), source_type="Snowflake"))
reg("items_using_table", """SELECT item_id, table_id, rel AS relationship, table_name, schema, database, item_name, item_type, workspace_id, workspace FROM te JOIN tabs USING (table_id) JOIN items USING (item_id) LEFT JOIN home USING (item_id)
 WHERE rel IN ('MIRRORS','USES_TABLE') AND lower(table_name) LIKE '%tbl_1%'""".replace("'%tbl_1%'", "'%tbl\\_1%' ESCAPE '\\'"), lambda s, d: GT.items_using_table(G(s, d), "TBL_1"))
reg("table_lineage", """SELECT tabs.*, r.item_id, r.relationship, r.item_name FROM tabs LEFT JOIN (SELECT table_id, item_id, rel AS relationship, item_name FROM te JOIN items USING (item_id)) r USING (table_id)""", lambda s, d: GT.table_lineage(G(s, d)))
reg("table_flows", """, pr AS (SELECT p.table_id, count(*) AS flow_count, count(*) FILTER (WHERE ph.workspace_id<>uh.workspace_id) AS crossing_count FROM te p JOIN te u ON p.table_id=u.table_id AND p.rel='PROVIDES_TABLE' AND u.rel='USES_TABLE'
 JOIN home ph ON ph.item_id=p.item_id JOIN home uh ON uh.item_id=u.item_id GROUP BY 1)
 SELECT table_id, item_id, CASE WHEN rel='PROVIDES_TABLE' THEN 'source' ELSE 'target' END AS role, workspace, item_name, flow_count, crossing_count, table_name, schema
 FROM te JOIN home USING (item_id) JOIN items USING (item_id) JOIN pr USING (table_id) JOIN tabs USING (table_id) WHERE rel<>'MIRRORS'""", lambda s, d: GT.table_flows(G(s, d)))
reg("table_summary", "SELECT count(*) AS total_tables, count(*) FILTER (WHERE table_type='shortcut') AS shortcut_tables, count(database) AS mirrored_tables FROM tabs", lambda s, d: GT.table_summary(G(s, d)))
reg("table_dependencies", """SELECT tabs.*, r.relationship, r.item_name, r.item_type, r.workspace FROM tabs LEFT JOIN (SELECT DISTINCT table_id, rel AS relationship, item_name, item_type, workspace FROM te JOIN items USING (item_id) LEFT JOIN home USING (item_id)) r
 USING (table_id) WHERE contains(lower(table_name), 'tbl_2')""", lambda s, d: GT.table_dependencies(G(s, d), "tbl_2"))
reg("tables_by_schema", """SELECT tabs.*, coalesce(c,0) AS consumer_count, coalesce(p,0) AS provider_count FROM tabs LEFT JOIN (SELECT table_id, count(*) FILTER (WHERE rel='USES_TABLE') AS c, count(*) FILTER (WHERE rel='PROVIDES_TABLE') AS p
 FROM te WHERE rel<>'MIRRORS' GROUP BY 1) USING (table_id)""", lambda s, d: GT.tables_by_schema(G(s, d)))
reg("schema_dependencies", """, t AS (SELECT table_id FROM tabs WHERE schema='PROMO'), pr AS (SELECT DISTINCT item_id FROM te JOIN t USING (table_id) WHERE rel='PROVIDES_TABLE')
 SELECT DISTINCT 'provider' AS role, item_name AS name, item_type AS type FROM pr JOIN items USING (item_id) UNION ALL SELECT DISTINCT 'consumer', item_name, item_type FROM te JOIN t USING (table_id) JOIN items USING (item_id) WHERE rel='USES_TABLE'
 UNION ALL SELECT DISTINCT 'external_source', source_name, source_type FROM con JOIN pr USING (item_id) JOIN srcs USING (source_id)""", lambda s, d: GT.schema_dependencies(G(s, d), "PROMO"))
reg("tables_per_database", "SELECT database, schema, count(*) AS table_count FROM tabs GROUP BY 1,2", lambda s, d: GT.tables_per(G(s, d)))
reg("tables_per_item", """SELECT item_id, table_count, sample_tables, item_name, item_type FROM (SELECT item_id, count(*) AS table_count, array_to_string(list_sort(list(DISTINCT table_name))[1:5], ',') AS sample_tables FROM te JOIN tabs USING (table_id)
 WHERE rel='MIRRORS' GROUP BY 1) JOIN items USING (item_id)""", lambda s, d: GT.tables_per(G(s, d), "item").withColumn("sample_tables", F.array_join("sample_tables", ",")))
reg("table_paths", "SELECT table_id, full_path, database, schema, table_name FROM tabs", lambda s, d: GT.tables_per(G(s, d), "path"))
reg("tables_of_database", "SELECT * FROM tabs WHERE contains(lower(database), 'db3')", lambda s, d: GT.tables_of_database(G(s, d), "DB3"))
reg("schema_coverage", "SELECT database, schema, count(DISTINCT table_id) AS table_count, count(DISTINCT item_id) AS consumer_count FROM tabs LEFT JOIN (SELECT * FROM te WHERE rel='MIRRORS') USING (table_id) GROUP BY 1,2", lambda s, d: GT.schema_coverage(G(s, d)))
reg("search_tables", """SELECT tabs.*, coalesce(n,0) AS consumer_count FROM tabs LEFT JOIN (SELECT table_id, count(DISTINCT item_id) AS n FROM te WHERE rel IN ('MIRRORS','USES_TABLE') GROUP BY 1) USING (table_id)
 WHERE contains(lower(table_name),'tbl_4') ORDER BY consumer_count DESC, table_id LIMIT 50""", lambda s, d: GT.search_tables(G(s, d), "tbl_4"))
reg("search_items", """SELECT * FROM (SELECT items.*, coalesce(n,0) AS table_count FROM items LEFT JOIN (SELECT item_id, count(DISTINCT table_id) AS n FROM te WHERE rel IN ('PROVIDES_TABLE','USES_TABLE') GROUP BY 1) USING (item_id)
 WHERE contains(lower(item_name),'ring') ORDER BY table_count DESC, item_name, item_id LIMIT 50) LEFT JOIN (SELECT item_id, workspace FROM home) USING (item_id)""", lambda s, d: GT.search_items(G(s, d), "ring"))
reg("table_page", "SELECT *, (SELECT count(*) FROM tabs) AS total_rows FROM tabs ORDER BY table_name, table_id LIMIT 20 OFFSET 40", lambda s, d: GT.table_page(G(s, d), 40, 20))
reg("tables_by_source_kind", """SELECT CASE WHEN item_type='Lakehouse' THEN 'Lakehouse' WHEN item_type='MirroredDatabase' OR database IS NOT NULL THEN 'Snowflake' ELSE 'Unknown' END AS source_kind, count(*) AS count
 FROM tabs LEFT JOIN (SELECT table_id, item_type FROM te JOIN items USING (item_id) WHERE rel='PROVIDES_TABLE' AND item_type IN ('Lakehouse','MirroredDatabase')) USING (table_id) GROUP BY 1""", lambda s, d: GT.tables_overview(G(s, d), "source_kind"))
reg("table_relation_counts", "SELECT rel, count(*) AS count FROM te GROUP BY 1", lambda s, d: GT.tables_overview(G(s, d), "relations"))
reg("orphan_tables", "SELECT * FROM tabs WHERE table_id NOT IN (SELECT table_id FROM te WHERE rel IN ('MIRRORS','USES_TABLE'))", lambda s, d: GT.tables_overview(G(s, d), "orphans"))
reg("high_dependency_tables", "SELECT table_id, count(DISTINCT item_id) AS consumer_count, any_value(table_name) AS table_name, any_value(database) AS database FROM te JOIN tabs USING (table_id) WHERE rel IN ('MIRRORS','USES_TABLE') GROUP BY 1 HAVING count(DISTINCT item_id) >= 5",
    lambda s, d: GT.tables_overview(G(s, d), "high_dependency"))
reg("cross_workspace_tables", "SELECT table_id, count(DISTINCT workspace_id) AS workspace_count, any_value(table_name) AS table_name FROM te JOIN tabs USING (table_id) JOIN home USING (item_id) WHERE rel IN ('MIRRORS','USES_TABLE') GROUP BY 1 HAVING count(DISTINCT workspace_id) >= 2",
    lambda s, d: GT.tables_overview(G(s, d), "cross_workspace"))
reg("item_footprint", """, f AS (SELECT item_id, count(*) FILTER (WHERE rel='USES_TABLE') AS u, count(*) FILTER (WHERE rel='PROVIDES_TABLE') AS p, array_to_string(list_sort(list(DISTINCT table_name) FILTER (WHERE rel='USES_TABLE'))[1:10], ',') AS su,
 array_to_string(list_sort(list(DISTINCT table_name) FILTER (WHERE rel='PROVIDES_TABLE'))[1:10], ',') AS sp FROM te JOIN tabs USING (table_id) WHERE rel<>'MIRRORS' GROUP BY 1)
 SELECT items.*, coalesce(u,0) AS tables_used_count, coalesce(p,0) AS tables_provided_count, nullif(su,'') AS sample_tables_used, nullif(sp,'') AS sample_tables_provided, coalesce(u,0)+coalesce(p,0) AS total_table_footprint FROM items LEFT JOIN f USING (item_id)""",
    lambda s, d: GT.item_footprint(G(s, d)).withColumns({c: F.array_join(c, ",") for c in ("sample_tables_used", "sample_tables_provided")}))
reg("graph_with_tables", "SELECT e.*, a.label AS src_label, b.label AS dst_label FROM edges e JOIN nodes a ON a.id=src JOIN nodes b ON b.id=dst WHERE rel IN ('DEPENDS_ON','MIRRORS','USES_TABLE','PROVIDES_TABLE')", lambda s, d: GT.graph_with_tables(G(s, d)))

# ---- construction from raw records -------------------------------------------------
RC = """used AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
up AS (SELECT p_partkey AS seq, 'p'||p_partkey AS item_id, 'p'||CASE WHEN p_partkey % 9 = 8 THEN -p_partkey-1 ELSE p_partkey//2 END AS upid, 'w'||(p_partkey % 7) AS wid, p_type, p_size FROM part),
inn AS (SELECT * FROM up WHERE upid NOT LIKE 'p-%'), outw AS (SELECT *, 'src_'||substr(md5('OneLake|'||wid||'|'||upid),1,12) AS sid FROM up WHERE upid LIKE 'p-%'),
ex AS (SELECT 1000000000 + l_partkey*1000000 + l_suppkey AS seq, 'p'||l_partkey AS item_id, CASE WHEN l_suppkey % 2 = 0 THEN 'AdlsGen2' ELSE 'Snowflake' END AS kind, l_suppkey,
 'src_'||substr(md5(CASE WHEN l_suppkey % 2 = 0 THEN 'AdlsGen2|https://acc'||(l_suppkey % 10)||'|box'||l_suppkey ELSE 'Snowflake|conn'||(l_suppkey % 5)||'|DB'||l_suppkey END),1,12) AS sid FROM used JOIN part ON l_partkey=p_partkey),
sh AS (SELECT *, 'shortcut_'||upid||'_'||lower(p_type)||'_tbl_'||p_size AS tid FROM inn)"""


def rc(sql):
    return f"WITH {RC} {sql}"


@query("build_workspace_nodes", rc("SELECT DISTINCT p_brand AS workspace_id, 'WS '||p_brand AS workspace_name FROM part"))
def _(s, d):
    return GB.workspace_nodes(REC(s, d))


@query("build_item_nodes", rc("SELECT 'p'||p_partkey AS item_id, p_name AS item_name, p_type AS item_type, p_brand AS workspace_id FROM part"))
def _(s, d):
    return GB.item_nodes(REC(s, d))


EDG = """SELECT DISTINCT item_id AS src, upid AS dst, 'DEPENDS_ON' AS rel FROM inn UNION ALL SELECT DISTINCT item_id, sid, 'CONSUMES' FROM (SELECT item_id, sid FROM outw UNION ALL SELECT item_id, sid FROM ex)"""


@query("build_dependency_edges", rc(EDG))
def _(s, d):
    return GB.dependency_edges(REC(s, d))


@query("build_source_nodes", rc("""SELECT DISTINCT sid AS id, 'OneLake' AS type, 'OneLake: TBL_'||p_size AS display_name, NULL::VARCHAR AS location, NULL::VARCHAR AS container, NULL::VARCHAR AS database FROM outw
 UNION ALL SELECT DISTINCT sid, kind, CASE WHEN kind='AdlsGen2' THEN 'ADLS: box'||l_suppkey ELSE 'Snowflake: DB'||l_suppkey END, CASE WHEN kind='AdlsGen2' THEN 'https://acc'||(l_suppkey % 10) END,
 CASE WHEN kind='AdlsGen2' THEN 'box'||l_suppkey END, CASE WHEN kind='Snowflake' THEN 'DB'||l_suppkey END FROM ex"""))
def _(s, d):
    return GB.source_nodes(REC(s, d))


@query("build_shortcut_tables", rc("SELECT tid AS table_id, first('TBL_'||p_size ORDER BY seq) AS name, first(p_type ORDER BY seq) AS schema, first(upid ORDER BY seq) AS upstream_id, first('Tables/'||p_type||'/TBL_'||p_size ORDER BY seq) AS full_path, 'shortcut' AS table_type FROM sh GROUP BY 1"))
def _(s, d):
    return GB.shortcut_tables(REC(s, d))[0]


@query("build_shortcut_edges", rc("SELECT DISTINCT item_id AS src, tid AS dst, 'USES_TABLE' AS rel FROM sh UNION ALL SELECT DISTINCT upid, tid, 'PROVIDES_TABLE' FROM sh"))
def _(s, d):
    return GB.shortcut_tables(REC(s, d))[1]


@query("build_graph_counts", rc(f""", e AS ({EDG} UNION ALL SELECT DISTINCT p_brand, 'p'||p_partkey, 'CONTAINS' FROM part UNION ALL SELECT DISTINCT item_id, tid, 'USES_TABLE' FROM sh UNION ALL SELECT DISTINCT upid, tid, 'PROVIDES_TABLE' FROM sh)
 SELECT rel, count(*) AS count FROM e GROUP BY 1"""))
def _(s, d):
    return GB.build_graph(REC(s, d)).edges.groupBy("rel").count()


@query("lineage_statistics", rc("""SELECT 'totals' AS section, 'workspaces' AS name, count(DISTINCT p_brand) AS count FROM part UNION ALL SELECT 'totals','items',count(*) FROM part
 UNION ALL SELECT 'totals','internal_edges',count(*) FROM inn UNION ALL SELECT 'totals','external_edges',(SELECT count(*) FROM outw)+(SELECT count(*) FROM ex)
 UNION ALL SELECT 'totals','mirrored_databases',0 UNION ALL SELECT 'totals','mirrored_database_records',0
 UNION ALL SELECT 'totals','workspaces_with_internal',count(DISTINCT p_brand) FROM inn JOIN part ON seq=p_partkey
 UNION ALL SELECT 'totals','workspaces_with_external',count(DISTINCT p_brand) FROM part WHERE 'p'||p_partkey IN (SELECT item_id FROM outw UNION ALL SELECT item_id FROM ex)
 UNION ALL SELECT 'items_by_type', p_type, count(*) FROM (SELECT p_type FROM up UNION ALL SELECT p_type FROM ex JOIN part ON item_id='p'||p_partkey) GROUP BY 2
 UNION ALL SELECT 'sources_by_type', kind, count(*) FROM ex GROUP BY 2 UNION ALL SELECT 'external_edges_by_type', kind, count(*) FROM (SELECT kind FROM ex UNION ALL SELECT 'OneLake' FROM outw) GROUP BY 2"""))
def _(s, d):
    return GS.lineage_statistics(REC(s, d))


# The records without the shipments of odd parts, and without the connections of some parts, so that some items have no dependency.
THIN = """, inn2 AS (SELECT inn.*, p_brand FROM inn JOIN part ON seq=p_partkey WHERE seq % 10 <> 3), out2 AS (SELECT outw.*, p_brand FROM outw JOIN part ON seq=p_partkey WHERE seq % 10 <> 3),
 ex2 AS (SELECT ex.*, p_brand FROM ex JOIN part ON item_id='p'||p_partkey WHERE p_partkey % 2 = 0),
 kinds AS (SELECT p_brand, item_id, kind FROM ex2 UNION ALL SELECT p_brand, item_id, 'OneLake' FROM out2),
 it AS (SELECT 'p'||p_partkey AS item_id, p_name AS item_name, p_type||CASE WHEN 'p'||p_partkey IN (SELECT item_id FROM ex2) THEN '' ELSE ' Shortcut' END AS item_type, p_brand FROM part)"""


def thin(s, d):
    rec, p = REC(s, d), F.col("seq") - 1_000_000_000
    some = rec.filter((F.col("seq") < 1_000_000_000) | (F.floor(p / 1_000_000) % 2 == 0))
    bare = (F.col("seq") < 1_000_000_000) & (F.col("seq") % 10 == 3)
    return some.withColumn("Source Connection", F.when(~bare, F.col("Source Connection"))).withColumn("Source Type", F.when(bare, F.lit("Unknown")).otherwise(F.col("Source Type")))


for _name, _part, _sql in (
    ("lineage_workspaces", "workspaces", """SELECT p_brand AS workspace_id, 'WS '||p_brand AS workspace_name, count(*) AS item_count, (SELECT count(*) FROM kinds k WHERE k.p_brand=it.p_brand) AS external_deps,
 (SELECT count(*) FROM inn2 k WHERE k.p_brand=it.p_brand) AS internal_deps FROM it GROUP BY p_brand"""),
    ("lineage_top_items", "top_items", "SELECT item_id, connections, item_name, item_type FROM (SELECT upid AS item_id, count(*) AS connections FROM inn2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) LEFT JOIN it USING (item_id)"),
    ("lineage_top_sources", "top_sources", "SELECT kind AS type, count(*) AS connections FROM kinds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    ("lineage_orphans", "orphans", "SELECT item_id, item_name, item_type FROM it WHERE item_id NOT IN (SELECT item_id FROM inn2 UNION ALL SELECT upid FROM inn2 UNION ALL SELECT item_id FROM kinds)"),
    ("lineage_workspace_pairs", "workspace_pairs", """SELECT 'WS '||u.p_brand AS source_workspace, 'WS '||i.p_brand AS target_workspace, count(*) AS edges FROM inn2 i JOIN it u ON u.item_id=i.upid
 WHERE u.p_brand<>i.p_brand GROUP BY 1,2 ORDER BY 3 DESC,1,2 LIMIT 20"""),
    ("lineage_source_names", "source_names", "SELECT DISTINCT kind AS type, CASE WHEN kind='AdlsGen2' THEN 'box' ELSE 'DB' END||l_suppkey AS name FROM ex2"),
):

    @query(_name, rc(f"{THIN} {_sql}"))
    def _(s, d, part=_part):
        return getattr(GS.lineage_details(thin(s, d)), part)
