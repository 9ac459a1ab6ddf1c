"""Governance views: orphans, crossings, assignments, search and item analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.graph.model import Graph, item_workspace, items, label, rel, with_workspace
from tidewatch.operators.graph.search import NameIndex, entities, matches
from tidewatch.operators.graph.stats import count_related, lacks_edge
from tidewatch.operators.graph.tables import consumption, sources
from tidewatch.operators.ranking import top_k, top_k_per_group
from tidewatch.session import cut_lineage


def orphans(g: Graph, with_mirrors: bool = False) -> DataFrame:
    """Items without dependencies in either direction and without sources; ``with_mirrors``
    also asks for no mirrored table."""
    ends = rel(g, "DEPENDS_ON").select(F.explode(F.array("src", "dst")).alias("item_id"))
    touched = ends.unionByName(rel(g, *(("CONSUMES", "MIRRORS") if with_mirrors else ("CONSUMES",))).select(F.col("src").alias("item_id")))
    return with_workspace(not_connected(items(g), touched), g).drop("workspace_id")


def not_connected(all_items: DataFrame, touched: DataFrame) -> DataFrame:
    return all_items.join(touched.select("item_id").distinct(), "item_id", "left_anti")


def crossings(g: Graph) -> DataFrame:
    """Dependencies between items of different workspaces."""
    home = item_workspace(g)
    side = lambda a, end: home.select(F.col("item_id").alias(end), F.col("workspace_id").alias(f"{a}_ws"), F.col("workspace").alias(f"{a}_workspace"))
    return rel(g, "DEPENDS_ON").join(side("source", "src"), "src").join(side("target", "dst"), "dst").filter("source_ws <> target_ws")


def cross_workspace(g: Graph, view: str = "edges", minimum: int = 3, k: int = 20, samples: int = 5) -> DataFrame:
    """``edges``, ``matrix``, ``clusters`` (coupled in either direction) or ``flows``."""
    x = crossings(g)
    pair = ["source_workspace", "target_workspace"]
    if view == "edges":
        name = lambda end, p: items(g).select(F.col("item_id").alias(end), F.col("item_name").alias(f"{p}_item"), F.col("item_type").alias(f"{p}_type"))
        return x.join(name("src", "source"), "src").join(name("dst", "target"), "dst").drop("source_ws", "target_ws")
    counts = x.groupBy(*pair).agg(F.count(F.lit(1)).alias("dependency_count"))
    if view == "matrix":
        return counts
    if view == "clusters":
        swapped = counts.select(F.col("target_workspace").alias("source_workspace"), F.col("source_workspace").alias("target_workspace"), "dependency_count")
        both = counts.unionByName(swapped).groupBy(F.col("source_workspace").alias("workspace_a"), F.col("target_workspace").alias("workspace_b")).agg(F.sum("dependency_count").alias("connections"))
        return top_k(both.filter(F.col("connections") >= minimum), [F.desc("connections"), "workspace_a", "workspace_b"], k)
    if view == "flows":
        best = top_k(counts, [F.desc("dependency_count"), *pair], k)
        few = top_k_per_group(x.join(best.select(*pair), pair, "left_semi").select(*pair, "src", "dst"), pair, ["src", "dst"], samples)
        flows = few.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to")))).alias("sample_flows"))
        return best.join(flows, pair).withColumnRenamed("dependency_count", "flow_count")
    raise ValueError(f"unknown view {view}")


def unassigned(g: Graph) -> DataFrame:
    return lacks_edge(items(g), rel(g, "CONTAINS"), side="dst")


def duplicate_groups(all_items: DataFrame) -> DataFrame:
    """Names that several items share, with how many pairs they form. Linear in the items,
    whatever the group sizes."""
    n = F.col("items")
    return (
        all_items.filter("item_name is not null").groupBy(F.lower("item_name").alias("name")).agg(F.count(F.lit(1)).alias("items"), F.min("item_id").alias("first_id"))
        .filter("items > 1").withColumn("pairs", (n * (n - 1) / 2).cast("bigint"))
    )


def duplicate_items(g: Graph, k: int = 30) -> DataFrame:
    """The first k pairs of items with the same name, by (id1, id2), with both workspaces.

    Pairs are not formed within a group. In id order, the pairs of an item are it and its
    followers. Every item that has a follower gives at least one pair, so the first k such
    items give the first k pairs; each is met with at most k followers of its name.
    """
    named = items(g).withColumn("name", F.lower("item_name")).filter("name is not null")
    last = named.groupBy("name").agg(F.max("item_id").alias("last_id"))
    heads = named.join(last, "name").filter(F.col("item_id") < F.col("last_id"))
    first = top_k(heads.select("name", F.col("item_id").alias("id1"), F.col("item_name"), F.col("item_type").alias("type_1")), ["id1"], k)
    # Followers: the k least ids above each head. Heads are at most k rows.
    tail = named.select("name", F.col("item_id").alias("id2"), F.col("item_type").alias("type_2"))
    pairs = top_k_per_group(first.join(tail, "name").filter("id2 > id1"), ["id1"], ["id2"], k)
    best = top_k(pairs, ["id1", "id2"], k)
    home = item_workspace(g)
    for i in ("1", "2"):
        best = best.join(home.select(F.col("item_id").alias(f"id{i}"), F.col("workspace").alias(f"workspace_{i}")), f"id{i}", "left")
    return best.drop("name")


def workspace_lineage(g: Graph, name: str) -> DataFrame:
    """Items of matching workspaces with what they depend on and what depends on them, one
    row per relation; items without any keep one row."""
    held = item_workspace(g).filter(matches("workspace", name)).select("item_id").distinct()
    names = items(g).select(F.col("item_id").alias("other_id"), F.col("item_name").alias("other_name"))
    edge = rel(g, "DEPENDS_ON")
    up = edge.select(F.col("src").alias("item_id"), F.col("dst").alias("other_id"), F.lit("depends_on").alias("relation"))
    down = edge.select(F.col("dst").alias("item_id"), F.col("src").alias("other_id"), F.lit("depended_by").alias("relation"))
    related = up.unionByName(down).join(held, "item_id", "left_semi").join(names, "other_id")
    return items(g).join(held, "item_id", "left_semi").join(related, "item_id", "left")


def workspace_external(g: Graph, name: str) -> DataFrame:
    held = item_workspace(g).filter(matches("workspace", name)).select("item_id")
    return consumption(g).join(held, "item_id", "left_semi").join(items(g), "item_id").join(sources(g), "source_id")


def workspace_details(g: Graph, name: str) -> DataFrame:
    return item_workspace(g).filter(F.col("workspace") == name).join(items(g), "item_id")


def flow_summary(g: Graph) -> DataFrame:
    """Consumers per source kind, and consuming items per type as leaf or intermediate."""
    per_kind = consumption(g).join(sources(g).select("source_id", "source_type"), "source_id").select("source_type", "item_id").distinct()
    by_source = per_kind.groupBy(F.col("source_type").alias("name")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("consumers").alias("section"), "name", "count")
    depended = rel(g, "DEPENDS_ON").select(F.col("dst").alias("item_id"), F.lit(True).alias("_d")).distinct()
    consuming = consumption(g).select("item_id").distinct().join(items(g), "item_id").join(depended, "item_id", "left")
    position = F.when(F.col("_d"), "intermediate").otherwise("leaf")
    by_item = consuming.groupBy(position.alias("section"), F.col("item_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return by_source.unionByName(by_item)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Old rows and new rows by column name; columns of one side only become null in the other."""
    return a.unionByName(b, allowMissingColumns=True)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.union(d)
    return out.distinct()


def union_samples(dfs: list[DataFrame], n: int = 3, key: str = "id") -> DataFrame:
    """The first n rows of each frame by key, appended."""
    out = top_k(dfs[0], [key], n)
    for d in dfs[1:]:
        out = out.unionByName(top_k(d, [key], n), allowMissingColumns=True)
    return out


def search(g: Graph, q: str, k: int = 20, index: NameIndex | None = None) -> DataFrame:
    """Items, sources and tables whose name or place contains the text; with an index only part of the names are read."""
    if index is not None:
        return top_k(index.find(q), ["entity_type", "id"], k)
    hit = matches("name", q) | matches("location", q)
    return top_k(entities(g).filter(hit), ["entity_type", "id"], k)


ITEM_RELATIONS = {
    "depends_on_count": ("DEPENDS_ON", "out"),
    "depended_by_count": ("DEPENDS_ON", "in"),
    "uses_table_count": ("USES_TABLE", "out"),
    "provides_table_count": ("PROVIDES_TABLE", "out"),
    "external_source_count": ("CONSUMES", "out"),
}


def items_of_type(g: Graph, kind: str) -> DataFrame:
    counted = count_related(g, ITEM_RELATIONS).filter(F.col("item_type") == kind)
    total = F.col("depends_on_count") + F.col("depended_by_count") + F.col("external_source_count")
    return with_workspace(counted.withColumn("total_connections", total), g).drop("workspace_id")


def analyze_item(g: Graph, name: str) -> DataFrame:
    """Every relation of the items of that name, one row per related entity."""
    chosen = items(g).filter(F.lower("item_name") == name.lower()).select("item_id")
    e = g.edges.filter(F.col("rel") != "CONTAINS")
    out = e.select(F.col("src").alias("item_id"), F.col("dst").alias("id"), "rel", F.lit("out").alias("direction"))
    into = e.select(F.col("dst").alias("item_id"), F.col("src").alias("id"), "rel", F.lit("in").alias("direction"))
    related = out.unionByName(into).join(chosen, "item_id", "left_semi")
    return related.join(g.nodes.select("id", "name", "type", "label"), "id", "left")


def drop_null_structs(c, field: str = "name"):
    """Remove entries without a name from a collected array of structs."""
    return F.filter(c, lambda x: x[field].isNotNull())


def chain_report(g: Graph, min_depth: int = 3, k: int = 50) -> dict[str, DataFrame]:
    """The frames of the chain-depth report, whose depths are walked once."""
    from tidewatch.operators.graph import traverse as T

    g = g._replace(edges=cut_lineage(g.edges.where("rel in ('DEPENDS_ON', 'CONTAINS')"), "report-edges"))
    lengths, known = cut_lineage(T.chain_lengths(g), "chain-lengths"), T.both_depths(g)
    nodes, chains = T.node_depths(g, known=known), T.deep_chains(g, min_depth, k, known=known)
    return {"stats": T.chain_stats(g, lengths=lengths), "distribution": lengths, "nodes": nodes, "chains": chains}


def lineage_report(g: Graph) -> dict[str, DataFrame]:
    """The frames of the overall lineage report."""
    from tidewatch.operators.graph import stats

    return {
        "overview": stats.overview(g.nodes, g.edges), "matrix": cross_workspace(g, "matrix"),
        "orphans": orphans(g), "types": stats.count_by_type(g), "sources": stats.count_by_type(g, "Source"), "hubs": stats.hubs(g),
    }


def label_samples(g: Graph, n: int = 3) -> DataFrame:
    return union_samples([label(g, x).select("id", "label", "name") for x in ("Workspace", "Item", "Source", "Table")], n)
