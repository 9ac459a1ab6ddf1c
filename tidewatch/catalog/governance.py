"""Governance views over the lineage graph."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import REGISTRY
from tidewatch.catalog.graph import G, gr, reg
from tidewatch.operators.graph import governance as V
from tidewatch.operators.graph import tables as GT
from tidewatch.operators.graph.model import items
from tidewatch.operators.graph.search import NameIndex, entities
from tidewatch.session import scratch_path

_T = "SELECT src FROM dep UNION SELECT dst FROM dep UNION SELECT item_id FROM con"
reg("orphan_items", f"SELECT items.*, workspace FROM items LEFT JOIN home USING (item_id) WHERE item_id NOT IN ({_T})", lambda s, d: V.orphans(G(s, d)))
reg("orphan_items_with_mirrors", f"SELECT items.*, workspace FROM items LEFT JOIN home USING (item_id) WHERE item_id NOT IN ({_T} UNION SELECT item_id FROM te WHERE rel='MIRRORS')", lambda s, d: V.orphans(G(s, d), True))
X = ", x AS (SELECT src, dst, a.workspace AS source_workspace, b.workspace AS target_workspace FROM dep JOIN home a ON a.item_id=src JOIN home b ON b.item_id=dst WHERE a.workspace_id<>b.workspace_id)"
reg("cross_workspace_edges", f"{X} SELECT x.*, i.item_name AS source_item, i.item_type AS source_type, j.item_name AS target_item, j.item_type AS target_type FROM x JOIN items i ON i.item_id=src JOIN items j ON j.item_id=dst", lambda s, d: V.cross_workspace(G(s, d)))
reg("workspace_matrix", f"{X} SELECT source_workspace, target_workspace, count(*) AS dependency_count FROM x GROUP BY 1,2", lambda s, d: V.cross_workspace(G(s, d), "matrix"))
reg("workspace_clusters", f"""{X} SELECT workspace_a, workspace_b, count(*) AS connections FROM (SELECT source_workspace AS workspace_a, target_workspace AS workspace_b FROM x UNION ALL SELECT target_workspace, source_workspace FROM x)
 GROUP BY 1,2 HAVING count(*) >= 3 ORDER BY 3 DESC,1,2 LIMIT 20""", lambda s, d: V.cross_workspace(G(s, d), "clusters"))
reg("workspace_flows", f"""{X}, n AS (SELECT source_workspace, target_workspace, count(*) AS flow_count FROM x GROUP BY 1,2 ORDER BY 3 DESC,1,2 LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY source_workspace, target_workspace ORDER BY src, dst) AS rn FROM x)
 SELECT n.*, string_agg(src||'>'||dst, ',' ORDER BY src, dst) AS sample_flows FROM n JOIN r USING (source_workspace, target_workspace) WHERE rn <= 5 GROUP BY 1,2,3""",
    lambda s, d: V.cross_workspace(G(s, d), "flows").withColumn("sample_flows", F.array_join(F.transform("sample_flows", lambda x: F.concat_ws(">", x["from"], x["to"])), ",")))
reg("unassigned_items", "SELECT * FROM items WHERE item_id NOT IN (SELECT item_id FROM home)", lambda s, d: V.unassigned(G(s, d)))
reg("duplicate_items", """SELECT id1, id2, a.item_name, type_1, type_2, w1.workspace AS workspace_1, w2.workspace AS workspace_2 FROM (SELECT i.item_id AS id1, j.item_id AS id2, i.item_name, i.item_type AS type_1, j.item_type AS type_2
 FROM items i JOIN items j ON lower(i.item_name)=lower(j.item_name) AND i.item_id < j.item_id ORDER BY 1,2 LIMIT 30) a LEFT JOIN home w1 ON w1.item_id=id1 LEFT JOIN home w2 ON w2.item_id=id2""", lambda s, d: V.duplicate_items(G(s, d)))
reg("duplicate_groups", "SELECT lower(item_name) AS name, count(*) AS items, min(item_id) AS first_id, count(*)*(count(*)-1)//2 AS pairs FROM items GROUP BY 1 HAVING count(*) > 1", lambda s, d: V.duplicate_groups(items(G(s, d))))
reg("workspace_lineage", """, h AS (SELECT DISTINCT item_id FROM home WHERE contains(lower(workspace), 'brand#1')), r AS (SELECT src AS item_id, dst AS other_id, 'depends_on' AS relation FROM dep UNION ALL SELECT dst, src, 'depended_by' FROM dep)
 SELECT items.*, other_id, relation, other_name FROM items JOIN h USING (item_id) LEFT JOIN (SELECT r.*, i.item_name AS other_name FROM r JOIN items i ON i.item_id=other_id) q USING (item_id)""", lambda s, d: V.workspace_lineage(G(s, d), "Brand#1"))
reg("workspace_external", "SELECT item_id, source_id, item_name, item_type, source_name, source_type, location, database FROM con JOIN items USING (item_id) JOIN srcs USING (source_id) WHERE item_id IN (SELECT item_id FROM home WHERE contains(lower(workspace),'brand#2'))", lambda s, d: V.workspace_external(G(s, d), "Brand#2"))
reg("workspace_details", "SELECT item_id, workspace_id, workspace, item_name, item_type FROM home JOIN items USING (item_id) WHERE workspace='Brand#3'", lambda s, d: V.workspace_details(G(s, d), "Brand#3"))
reg("flow_summary", """SELECT 'consumers' AS section, source_type AS name, count(DISTINCT item_id) AS count FROM con JOIN srcs USING (source_id) GROUP BY 2
 UNION ALL SELECT CASE WHEN item_id IN (SELECT dst FROM dep) THEN 'intermediate' ELSE 'leaf' END, item_type, count(*) FROM items WHERE item_id IN (SELECT item_id FROM con) GROUP BY 1,2""", lambda s, d: V.flow_summary(G(s, d)))
reg("entity_search", """SELECT * FROM (SELECT 'item' AS entity_type, item_id AS id, item_name AS name, item_type AS type, NULL::VARCHAR AS location FROM items WHERE contains(lower(item_name),'0012')
 UNION SELECT 'source', source_id, source_name, source_type, location FROM srcs WHERE contains(lower(source_name),'0012') OR contains(lower(location),'0012')
 UNION SELECT 'table', table_id, table_name, 'Table', full_path FROM tabs WHERE contains(lower(table_name),'0012') OR contains(lower(full_path),'0012')) ORDER BY entity_type, id LIMIT 20""", lambda s, d: V.search(G(s, d), "0012"))


def found(q, k=20):
    return f"""SELECT * FROM (SELECT 'item' AS entity_type, item_id AS id, item_name AS name, item_type AS type, NULL::VARCHAR AS location FROM items WHERE contains(lower(item_name),'{q}')
 UNION SELECT 'source', source_id, source_name, source_type, location FROM srcs WHERE contains(lower(source_name),'{q}') OR contains(lower(location),'{q}')
 UNION SELECT 'table', table_id, table_name, 'Table', full_path FROM tabs WHERE contains(lower(table_name),'{q}') OR contains(lower(full_path),'{q}')) ORDER BY entity_type, id LIMIT {k}"""


def index(s, d):
    return NameIndex.build(entities(G(s, d)), scratch_path(s, "names"))


for _name, _q in (("indexed_entity_search", "nation_1"), ("indexed_path_search", "/tbl_4"), ("indexed_short_search", "_4"), ("indexed_absent_search", "no such name")):
    reg(_name, found(_q, 1000), lambda s, d, q=_q: V.search(G(s, d), q.upper(), 1000, index(s, d)))
reg("indexed_search_items", REGISTRY["search_items"].oracle.removeprefix(gr("")), lambda s, d: GT.search_items(G(s, d), "ring", index=index(s, d)))
reg("indexed_search_tables", REGISTRY["search_tables"].oracle.removeprefix(gr("")), lambda s, d: GT.search_tables(G(s, d), "tbl_4", index=index(s, d)))
_C = "(SELECT {k} AS item_id, count(*) AS n FROM edges WHERE rel='{r}' GROUP BY 1)"
reg("items_of_type", f"""SELECT items.*, coalesce(a.n,0) AS depends_on_count, coalesce(b.n,0) AS depended_by_count, coalesce(c.n,0) AS uses_table_count, coalesce(e.n,0) AS provides_table_count, coalesce(f.n,0) AS external_source_count,
 coalesce(a.n,0)+coalesce(b.n,0)+coalesce(f.n,0) AS total_connections, workspace FROM items LEFT JOIN {_C.format(k='src', r='DEPENDS_ON')} a USING (item_id) LEFT JOIN {_C.format(k='dst', r='DEPENDS_ON')} b USING (item_id)
 LEFT JOIN {_C.format(k='src', r='USES_TABLE')} c USING (item_id) LEFT JOIN {_C.format(k='src', r='PROVIDES_TABLE')} e USING (item_id) LEFT JOIN {_C.format(k='src', r='CONSUMES')} f USING (item_id)
 LEFT JOIN home USING (item_id) WHERE item_type='PROMO'""", lambda s, d: V.items_of_type(G(s, d), "PROMO"))
reg("analyze_item", """, ch AS (SELECT item_id FROM items WHERE lower(item_name)='red widget'), e AS (SELECT * FROM edges WHERE rel<>'CONTAINS'), r AS (SELECT src AS item_id, dst AS id, rel, 'out' AS direction FROM e UNION ALL SELECT dst, src, rel, 'in' FROM e)
 SELECT r.*, name, type, label FROM r JOIN ch USING (item_id) JOIN nodes USING (id)""", lambda s, d: V.analyze_item(G(s, d), "Red Widget"))
reg("label_samples", " UNION ALL ".join(f"(SELECT id, label, name FROM nodes WHERE label='{x}' ORDER BY id LIMIT 3)" for x in ("Workspace", "Item", "Source", "Table")), lambda s, d: V.label_samples(G(s, d)))
reg("common_parts", """SELECT 'p'||l_partkey AS dependency, 's'||l_suppkey AS item, n AS items, n = (SELECT count(*) FROM supplier) AS is_common FROM used JOIN (SELECT l_partkey, count(*) AS n FROM used GROUP BY 1) USING (l_partkey)""",
    lambda s, d: _common(s, d))


def _common(s, d):
    from tidewatch.operators.graph.traverse import common_and_unique
    from tidewatch.operators.ranking import grand_total
    from tidewatch.sources.adapters import table

    deps = table(s, d, "lineitem").selectExpr("concat('p', l_partkey) as dependency", "concat('s', l_suppkey) as item")
    return common_and_unique(deps, grand_total(table(s, d, "supplier"), F.count(F.lit(1))))
