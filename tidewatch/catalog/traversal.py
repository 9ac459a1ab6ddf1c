"""Traversals: recursive SQL checks them where the whole answer is enumerable."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import query
from tidewatch.catalog.graph import GR
from tidewatch.operators.graph import traverse as T
from tidewatch.operators.graph.model import Graph
from tidewatch.sources.adapters import lineage_graph as G, table


def rec(name, body, final):
    return f"WITH RECURSIVE {GR}, {name} AS ({body}) {final}"


def trail(start, depth, col="dst", key="src"):
    return f"""SELECT {start} AS seed, {start} AS id, 0 AS depth, [{start}] AS path UNION ALL SELECT seed, {col}, depth+1, list_append(path, {col}) FROM w JOIN dep ON {key}=id WHERE depth < {depth}"""


for _name, _fn, _col, _key, _seed in (("upstream_paths", T.upstream, "dst", "src", "p777"), ("downstream_paths", T.downstream, "src", "dst", "p20")):

    @query(_name, rec("w", trail(f"'{_seed}'", 5, _col, _key), "SELECT seed, w.id, depth, label, name, type, array_to_string(path,'>') AS path FROM w JOIN nodes ON nodes.id=w.id WHERE depth > 0"))
    def _(s, d, fn=_fn, seed=_seed):
        return fn(G(s, d), [seed], 5).withColumn("path", F.array_join("path", ">"))


@query("upstream_path_names", rec("w", trail("'p777'", 4), """SELECT seed, w.id, depth, (SELECT string_agg(name, '>' ORDER BY pos) FROM (SELECT unnest(path) AS pid, unnest(range(len(path))) AS pos) x JOIN nodes n ON n.id=x.pid) AS path_names FROM w WHERE depth > 0"""))
def _(s, d):
    g = G(s, d)
    found = T.path_names(T.upstream(g, ["p777"], 4), g)
    return found.select("seed", "id", "depth", F.array_join("path_names", ">").alias("path_names"))


@query("upstream_reach_with_sources", f"""WITH RECURSIVE {GR}, st AS (SELECT src, dst FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES')),
 w AS (SELECT 'p777' AS id, 0 AS depth UNION SELECT dst, depth+1 FROM w JOIN st ON src=id WHERE depth < 5) SELECT 'p777' AS seed, w.id, depth, label, name, type FROM w JOIN nodes ON nodes.id=w.id WHERE depth > 0""")
def _(s, d):
    return T.upstream(G(s, d), ["p777"], 5, "reach", ("DEPENDS_ON", "CONSUMES"))


def both(seed, depth):
    return f"""WITH RECURSIVE {GR}, st AS (SELECT src, dst FROM edges WHERE rel IN ('DEPENDS_ON','CONSUMES')),
 u AS (SELECT '{seed}' AS id, 0 AS depth UNION SELECT dst, depth+1 FROM u JOIN st ON src=id WHERE depth < {depth}),
 v AS (SELECT '{seed}' AS id, 0 AS depth UNION SELECT src, depth+1 FROM v JOIN dep ON dst=id WHERE depth < {depth}),
 m AS (SELECT id, min(depth) AS depth, 'upstream' AS direction FROM u WHERE id<>'{seed}' GROUP BY 1 UNION ALL SELECT id, min(depth), 'downstream' FROM v WHERE id<>'{seed}' GROUP BY 1)
 SELECT '{seed}' AS seed, m.id, depth, label, name, type, direction FROM m JOIN nodes ON nodes.id=m.id"""


@query("lineage_chain", both("p100", 5))
def _(s, d):
    return T.chain(G(s, d), "p100", 5)


def between(starts, ends, k):
    """Nodes by their distance to each end, then from each start always to the first node that is one nearer."""
    return f"""WITH RECURSIVE {GR}, un AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), a AS ({starts}), b AS ({ends}),
 lv AS (SELECT id AS e, id, 0 AS d FROM b UNION SELECT e, dst, d+1 FROM lv JOIN un ON src=id WHERE d < 15),
 ds AS MATERIALIZED (SELECT e, id, min(d) AS d FROM lv GROUP BY 1,2),
 best AS MATERIALIZED (SELECT a.id AS seed, ds.e, ds.d FROM a JOIN ds ON ds.id=a.id WHERE ds.d > 0 ORDER BY ds.d, a.id, ds.e LIMIT {k}),
 w AS (SELECT seed, e, seed AS id, d, [seed] AS path FROM best
  UNION ALL SELECT seed, e, nxt, d-1, list_append(path, nxt) FROM (SELECT w.seed, w.e, w.d, w.path, min(un.dst) AS nxt FROM w JOIN un ON un.src=w.id JOIN ds ON ds.e=w.e AND ds.id=un.dst AND ds.d=w.d-1 GROUP BY ALL))"""


@query("shortest_path", between("SELECT 'c1' AS id", "SELECT 's7' AS id", 1) + " SELECT len(path)-1 AS path_length, array_to_string(path,'>') AS path FROM w WHERE d=0")
def _(s, d):
    return T.shortest_path(G(s, d), "c1", "s7").withColumn("path", F.array_join("path", ">"))


for _name, _a, _b in (("shortest_between_names", "Customer#000000001", "Customer#000000002"), ("shortest_between_many_names", "#00000000", "red widget")):

    @query(_name, between(*(f"SELECT DISTINCT item_id AS id FROM items WHERE contains(lower(item_name), lower('{x}'))" for x in (_a, _b)), 5) + " SELECT seed, e AS id, len(path)-1 AS path_length, array_to_string(path,'>') AS path FROM w WHERE d=0")
    def _(s, d, a=_a, b=_b):
        return T.shortest_between_names(G(s, d), a, b).withColumn("path", F.array_join("path", ">"))


@query("removal_impact", f"""WITH RECURSIVE {GR}, w AS (SELECT item_id AS seed, item_id AS id FROM items WHERE item_name='red widget' UNION SELECT seed, src FROM w JOIN dep ON dst=id)
 SELECT i.item_id AS seed, count(DISTINCT w.id) FILTER (WHERE w.id<>w.seed) AS affected_count, nullif(array_to_string(list_sort(list(DISTINCT n.item_name) FILTER (WHERE w.id<>w.seed))[1:10], ','), '') AS sample_affected
 FROM items i JOIN w ON w.seed=i.item_id JOIN items n ON n.item_id=w.id WHERE i.item_name='red widget' GROUP BY 1""")
def _(s, d):
    return T.removal_impact(G(s, d), "red widget").withColumn("sample_affected", F.array_join("sample_affected", ","))


@query("source_failure_reach", f"""WITH RECURSIVE {GR}, w AS (SELECT DISTINCT source_id, src AS id FROM con JOIN dep ON dst=item_id UNION SELECT source_id, src FROM w JOIN dep ON dst=id)
 SELECT c.source_id, direct_consumer_count, coalesce(n,0) AS indirect_dependent_count, source_name AS external_source, source_type FROM (SELECT source_id, count(*) AS direct_consumer_count FROM con GROUP BY 1) c
 LEFT JOIN (SELECT source_id, count(*) AS n FROM w GROUP BY 1) USING (source_id) JOIN srcs USING (source_id)""")
def _(s, d):
    return T.source_failure_reach(G(s, d))


@query("item_impact", f"""WITH RECURSIVE {GR}, w AS (SELECT 'p12' AS id, 0 AS depth UNION SELECT src, depth+1 FROM w JOIN dep ON dst=id),
 r AS (SELECT 'uses' AS relationship, dst AS id, 0 AS depth FROM edges WHERE rel='USES_TABLE' AND src='p12' UNION ALL SELECT 'provides', dst, 0 FROM edges WHERE rel='PROVIDES_TABLE' AND src='p12'
 UNION ALL SELECT 'downstream', id, min(depth) FROM w WHERE depth > 0 GROUP BY 2) SELECT r.*, label, name, type FROM r JOIN nodes ON nodes.id=r.id""")
def _(s, d):
    return T.item_impact(G(s, d), "p12")


IMPACT = f"""WITH RECURSIVE {GR}, di AS (SELECT DISTINCT table_id, item_id FROM te JOIN tabs USING (table_id) WHERE rel IN ('MIRRORS','USES_TABLE') AND contains(lower(table_name), 'tbl_17')),
 w AS (SELECT table_id, item_id, 0 AS depth FROM di UNION SELECT table_id, src, depth+1 FROM w JOIN dep ON dst=item_id WHERE depth < 5),
 im AS (SELECT table_id, item_id, min(depth) AS depth FROM w GROUP BY 1,2), ti AS (SELECT im.*, item_name, item_type, workspace_id, workspace FROM im JOIN items USING (item_id) LEFT JOIN home USING (item_id))"""


@query("table_impact", f"{IMPACT} SELECT * FROM ti")
def _(s, d):
    return T.table_impact(G(s, d), "tbl_17")


@query("table_impact_summary", f"{IMPACT} SELECT count(DISTINCT table_id) AS tables_found, count(DISTINCT item_id) AS total_impacted_items, count(DISTINCT workspace_id) AS total_impacted_workspaces, max(depth) AS max_depth_found FROM ti")
def _(s, d):
    return T.table_impact_summary(T.table_impact(G(s, d), "tbl_17"))


UPW = "u AS (SELECT DISTINCT src AS id, 1 AS d FROM dep UNION SELECT src, d+1 FROM u JOIN dep ON dst=id)"
DNW = "v AS (SELECT DISTINCT dst AS id, 1 AS d FROM dep UNION SELECT dst, d+1 FROM v JOIN dep ON src=id)"


@query("node_depths", f"""WITH RECURSIVE {GR}, {UPW}, {DNW} SELECT items.*, coalesce(a,0) AS upstream_depth, coalesce(b,0) AS downstream_depth, coalesce(a,0)+coalesce(b,0) AS total_chain_depth FROM items
 LEFT JOIN (SELECT id AS item_id, max(d) AS a FROM u GROUP BY 1) USING (item_id) LEFT JOIN (SELECT id AS item_id, max(d) AS b FROM v GROUP BY 1) USING (item_id)""")
def _(s, d):
    return T.node_depths(G(s, d))


@query("dependency_depth", f"""WITH RECURSIVE {GR}, {UPW} SELECT * FROM (SELECT id AS item_id, max(d) AS dependency_depth FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN items USING (item_id) LEFT JOIN (SELECT item_id, workspace FROM home) USING (item_id)""")
def _(s, d):
    return T.dependency_depth(G(s, d))


CH = f"""WITH RECURSIVE {GR}, w AS (SELECT src AS id, 1 AS depth FROM dep WHERE dst NOT IN (SELECT src FROM dep) UNION ALL SELECT src, depth+1 FROM w JOIN dep ON dst=id),
 ln AS (SELECT depth, count(*) AS count FROM w WHERE depth >= 2 GROUP BY 1)"""


@query("chain_lengths", f"{CH} SELECT * FROM ln")
def _(s, d):
    return T.chain_lengths(G(s, d))


@query("chain_stats", f"{CH} SELECT max(depth) AS max_depth, CAST(sum(depth*count) AS DOUBLE)/sum(count) AS avg_depth, CAST(sum(count) AS BIGINT) AS chain_count FROM ln")
def _(s, d):
    return T.chain_stats(G(s, d))


@query("deep_chains", f"""WITH RECURSIVE {GR}, w AS (SELECT item_id AS id, [item_id] AS path FROM items WHERE item_id NOT IN (SELECT dst FROM dep) UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN dep ON src=id),
 b AS (SELECT path[1] AS terminal_id, id AS origin_id, len(path)-1 AS depth, path FROM w WHERE len(path) > 3 ORDER BY len(path) DESC, path LIMIT 50)
 SELECT terminal_id, origin_id, depth, array_to_string(path,'>') AS path, a.item_name AS terminal_name, a.item_type AS terminal_type, ah.workspace AS terminal_workspace, o.item_name AS origin_name, o.item_type AS origin_type, oh.workspace AS origin_workspace
 FROM b JOIN items a ON a.item_id=terminal_id JOIN items o ON o.item_id=origin_id LEFT JOIN home ah ON ah.item_id=terminal_id LEFT JOIN home oh ON oh.item_id=origin_id""")
def _(s, d):
    return T.deep_chains(G(s, d)).withColumn("path", F.array_join("path", ">"))


# Chains of 25 parts, and in each a pair of parts that use each other: longer than any bound, and cyclic.
LOOPS = """e AS (SELECT 'p'||p_partkey AS src, 'p'||(p_partkey+1) AS dst FROM part WHERE p_partkey % 25 <> 24 AND p_partkey+1 IN (SELECT p_partkey FROM part)
 UNION SELECT 'p'||(p_partkey+1), 'p'||p_partkey FROM part WHERE p_partkey % 25 = 10 AND p_partkey+1 IN (SELECT p_partkey FROM part)),
 t AS (SELECT src AS s, dst AS id, 1 AS depth, [src||'|'||dst] AS used FROM e UNION ALL SELECT s, dst, depth+1, list_append(used, src||'|'||dst) FROM t JOIN e ON src=id WHERE NOT list_contains(used, src||'|'||dst))"""


def loops(s, d):
    part = table(s, d, "part").select("p_partkey")
    node = lambda k: F.concat(F.lit("p"), F.col("p_partkey") + k)
    after = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey", "left_semi")
    on = after.filter("p_partkey % 25 <> 24").select(node(0).alias("src"), node(1).alias("dst"))
    back = after.filter("p_partkey % 25 = 10").select(node(1).alias("src"), node(0).alias("dst"))
    edges = on.union(back).withColumn("rel", F.lit("DEPENDS_ON"))
    g = G(s, d)
    extra = {c: F.lit(None).cast(g.nodes.schema[c].dataType) for c in g.nodes.columns}
    nodes = part.select(*[{"id": node(0), "label": F.lit("Item"), "name": node(0)}.get(c, e).alias(c) for c, e in extra.items()])
    return Graph(nodes, edges)


@query("node_depths_cyclic", f"""WITH RECURSIVE {LOOPS}, r AS (SELECT s AS a, id AS b, depth FROM t), u AS (SELECT a AS item_id, max(depth) AS x FROM r GROUP BY 1),
 b AS (SELECT src AS s, src AS z, dst AS q, 1 AS depth, [src||'|'||dst] AS used FROM e UNION ALL SELECT e.src, z, q, depth+1, list_append(used, e.src||'|'||e.dst) FROM b JOIN e ON e.dst=b.s WHERE NOT list_contains(used, e.src||'|'||e.dst)),
 v AS (SELECT q AS item_id, max(depth) AS y FROM b GROUP BY 1)
 SELECT 'p'||p_partkey AS item_id, coalesce(x,0) AS upstream_depth, coalesce(y,0) AS downstream_depth FROM part LEFT JOIN u ON u.item_id='p'||p_partkey LEFT JOIN v ON v.item_id='p'||p_partkey""")
def _(s, d):
    return T.node_depths(loops(s, d), mode="trail").select("item_id", "upstream_depth", "downstream_depth")


@query("chain_lengths_cyclic", f"WITH RECURSIVE {LOOPS} SELECT depth, count(*) AS count FROM t WHERE depth >= 2 AND id NOT IN (SELECT src FROM e) GROUP BY 1")
def _(s, d):
    return T.chain_lengths(loops(s, d), mode="trail")


# Parts that follow each other in orders: one strong component with most of the parts, and tails on both sides.
FOLLOW = """e AS (SELECT DISTINCT 'p'||a.l_partkey AS src, 'p'||b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1
  WHERE a.l_orderkey % 8 = 0 AND a.l_partkey<>b.l_partkey),
 reach AS (SELECT src AS s, dst AS id FROM e UNION SELECT s, dst FROM reach JOIN e ON id=src),
 comp AS (SELECT a.s AS node, least(a.s, min(a.id)) AS component FROM reach a JOIN reach b ON a.s=b.id AND a.id=b.s WHERE a.s<>a.id GROUP BY a.s),
 csize AS (SELECT component, count(*) AS component_size FROM comp GROUP BY 1),
 it AS (SELECT 'p'||p_partkey AS item_id, p_name AS item_name, p_type AS item_type FROM part),
 rep AS (SELECT item_id, coalesce(component, item_id) AS c, coalesce(component_size, 1) AS size FROM it LEFT JOIN comp ON node=item_id LEFT JOIN csize USING (component)),
 ce AS (SELECT a.c AS src, b.c AS dst, count(*) AS n FROM e JOIN rep a ON a.item_id=src JOIN rep b ON b.item_id=dst WHERE a.c<>b.c GROUP BY 1,2),
 up AS (SELECT DISTINCT src AS id, 1 AS d FROM ce UNION SELECT src, d+1 FROM up JOIN ce ON dst=id),
 dn AS (SELECT DISTINCT dst AS id, 1 AS d FROM ce UNION SELECT dst, d+1 FROM dn JOIN ce ON src=id),
 du AS (SELECT id AS c, max(d) AS a FROM up GROUP BY 1), dd AS (SELECT id AS c, max(d) AS b FROM dn GROUP BY 1)"""


def follow(s, d):
    line = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").filter("l_orderkey % 8 = 0")
    after = line.select("l_orderkey", F.col("l_partkey").alias("then"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    p = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    edges = line.join(after, ["l_orderkey", "l_linenumber"]).filter("l_partkey <> then").select(p("l_partkey").alias("src"), p("then").alias("dst")).distinct()
    g = G(s, d)
    return Graph(g.nodes.filter("label = 'Item' and id like 'p%'"), edges.withColumn("rel", F.lit("DEPENDS_ON")))


@query("strong_components", f"WITH RECURSIVE {FOLLOW} SELECT item_id, component, component_size, item_name, item_type FROM comp JOIN csize USING (component) JOIN it ON item_id=node")
def _(s, d):
    return T.item_components(follow(s, d))


@query("node_depths_components", f"""WITH RECURSIVE {FOLLOW} SELECT it.*, coalesce(a,0) AS upstream_depth, coalesce(b,0) AS downstream_depth, coalesce(a,0)+coalesce(b,0) AS total_chain_depth
 FROM it JOIN rep USING (item_id) LEFT JOIN du USING (c) LEFT JOIN dd USING (c)""")
def _(s, d):
    return T.node_depths(follow(s, d))


@query("dependency_depth_components", f"WITH RECURSIVE {FOLLOW} SELECT it.*, a AS dependency_depth FROM it JOIN rep USING (item_id) JOIN du USING (c) ORDER BY a DESC, item_id LIMIT 20")
def _(s, d):
    return T.dependency_depth(follow(s, d)).drop("workspace")


CW = f"""WITH RECURSIVE {FOLLOW}, w AS (SELECT src AS id, 1 AS depth, CAST(sum(n) AS BIGINT) AS k FROM ce WHERE dst NOT IN (SELECT src FROM ce) GROUP BY 1
 UNION ALL SELECT src, depth+1, CAST(sum(n*k) AS BIGINT) FROM w JOIN ce ON dst=id GROUP BY src, depth+1),
 ln AS (SELECT depth, CAST(sum(k*size) AS BIGINT) AS count FROM w JOIN rep ON item_id=id WHERE depth >= 2 GROUP BY 1)"""


@query("chain_lengths_components", f"{CW} SELECT * FROM ln")
def _(s, d):
    return T.chain_lengths(follow(s, d))


@query("chain_stats_components", f"{CW} SELECT max(depth) AS max_depth, CAST(sum(depth*count) AS DOUBLE)/sum(count) AS avg_depth, CAST(sum(count) AS BIGINT) AS chain_count FROM ln")
def _(s, d):
    return T.chain_stats(follow(s, d))


@query("deep_chains_components", f"""WITH RECURSIVE {FOLLOW}, w AS (SELECT DISTINCT src AS id, [src] AS path FROM ce WHERE src NOT IN (SELECT dst FROM ce) UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN ce ON src=id),
 b AS (SELECT path[1] AS terminal_id, id AS origin_id, len(path)-1 AS depth, path FROM w WHERE len(path) > 3 ORDER BY len(path) DESC, path LIMIT 50)
 SELECT terminal_id, origin_id, depth, array_to_string(path,'>') AS path FROM b""")
def _(s, d):
    return T.deep_chains(follow(s, d)).select("terminal_id", "origin_id", "depth", F.array_join("path", ">").alias("path"))


@query("source_reach_components", f"""WITH RECURSIVE {FOLLOW}, con AS (SELECT DISTINCT 's'||l_suppkey AS source, 'p'||l_partkey AS node FROM lineitem WHERE l_linenumber = 1)
 SELECT source, count(DISTINCT r.s) AS items FROM con JOIN reach r ON r.id=node GROUP BY 1""")
def _(s, d):
    from tidewatch.operators.graph.bitmaps import dependents_per_source

    direct = table(s, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"))
    return dependents_per_source(T.steps(follow(s, d), "up"), direct)


@query("cycles", """WITH RECURSIVE e AS (SELECT DISTINCT 'n'||c_nationkey AS src, 'n'||((c_nationkey*2+1) % 25) AS dst FROM customer UNION SELECT DISTINCT 'n'||s_nationkey, 'n'||((s_nationkey+7) % 25) FROM supplier),
 w AS (SELECT src AS s, dst AS id, [src, dst] AS path, [src||'|'||dst] AS used FROM e UNION ALL SELECT s, dst, list_append(path, dst), list_append(used, src||'|'||dst) FROM w JOIN e ON src=id
 WHERE len(used) < 5 AND NOT list_contains(used, src||'|'||dst)) SELECT array_to_string(path,'>') AS cycle_nodes, len(used) AS cycle_length FROM w WHERE id=s AND len(used) >= 2 ORDER BY len(used), path LIMIT 20""")
def _(s, d):
    e = table(s, d, "customer").selectExpr("concat('n', c_nationkey) as node", "concat('n', (c_nationkey * 2 + 1) % 25) as next")
    f = table(s, d, "supplier").selectExpr("concat('n', s_nationkey) as node", "concat('n', (s_nationkey + 7) % 25) as next")
    return T.cycles(e.union(f).distinct(), 5).withColumn("cycle_nodes", F.array_join("cycle_nodes", ">"))


@query("common_dependencies", f"""WITH RECURSIVE {GR}, w AS (SELECT x AS seed, x AS id, 0 AS d FROM (VALUES ('p500'),('p501'),('p750')) t(x) UNION SELECT seed, dst, d+1 FROM w JOIN dep ON src=id WHERE d < 5),
 q AS (SELECT DISTINCT seed, id FROM w WHERE d > 0), c AS (SELECT id, count(*) AS items FROM q GROUP BY 1) SELECT q.id AS dependency, seed AS item, items, items = 3 AS is_common FROM q JOIN c USING (id)""")
def _(s, d):
    return T.common_dependencies(G(s, d), ["p500", "p501", "p750"])
