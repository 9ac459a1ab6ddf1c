"""Counts, degrees and distributions. Every side is counted by key before it is joined, so
a hub with a third of all edges costs one partial count per task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.basics import round_half_even, spread_nulls
from tidewatch.operators.graph.model import Graph, item_workspace, items, label, rel, with_workspace, workspaces
from tidewatch.operators.ranking import top_k, top_k_per_group
from tidewatch.session import cut_lineage



def count_edges(edges: DataFrame, by: str, key: str, alias: str) -> DataFrame:
    return edges.groupBy(F.col(by).alias(key)).agg(F.count(F.lit(1)).alias(alias))


def add_counts(df: DataFrame, key: str, *counts: DataFrame) -> DataFrame:
    """Left-join count tables on a key, zero where absent."""
    for c in counts:
        names = [n for n in c.columns if n != key]
        df = df.join(c, key, "left").na.fill(0, names)
    return df


def count_related(g: Graph, relations: dict[str, tuple[str, str]], key: str = "item_id") -> DataFrame:
    """Items with counts of several relations; ``relations`` maps a column name to
    (relation, side) with side ``out`` or ``in``. Each side is aggregated on its own, so
    counts never multiply."""
    counts = [count_edges(rel(g, r), "src" if side == "out" else "dst", key, name) for name, (r, side) in relations.items()]
    return add_counts(items(g), key, *counts)


def sample_names(df: DataFrame, keys: Sequence[str], name: str, k: int, alias: str) -> DataFrame:
    """The k alphabetically first distinct names per key, as an array."""
    some = top_k_per_group(df.select(*keys, name).filter(F.col(name).isNotNull()).distinct(), keys, [name], k)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias(alias))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per label and relation, and the two totals; each count is independent."""
    kinds = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    rels = edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    both = kinds.unionByName(rels)
    totals = both.groupBy("kind").agg(F.sum("count").alias("count")).select("kind", F.lit("total").alias("name"), "count")
    return both.unionByName(totals)


def count_by_type(g: Graph, kind: str = "Item") -> DataFrame:
    return label(g, kind).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def degrees(g: Graph, *relations: str) -> DataFrame:
    """id, incoming, outgoing over the named relations (all when none is named)."""
    edges = rel(g, *relations) if relations else g.edges.select("src", "dst")
    ends = F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends).groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(Graph(nodes, edges)).select("id", (F.col("incoming") + F.col("outgoing")).alias("connections"))
    return (
        nodes.select("id", "label").join(d, "id", "left").na.fill(0, ["connections"]).groupBy("label")
        .agg(F.count(F.lit(1)).alias("node_count"), F.avg("connections").alias("avg_connections"), F.min("connections").alias("min_connections"), F.max("connections").alias("max_connections"))
    )


def _per_workspace(g: Graph, *per_item: DataFrame) -> DataFrame:
    """Contained items with per-item counts, ready to sum per workspace."""
    return add_counts(item_workspace(g), "item_id", *per_item)


def workspace_stats(g: Graph) -> DataFrame:
    ranked = _per_workspace(
        g, count_edges(rel(g, "DEPENDS_ON"), "src", "item_id", "internal"), count_edges(rel(g, "CONSUMES"), "src", "item_id", "external")
    ).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("item_count"), F.sum("internal").alias("internal_deps"), F.sum("external").alias("external_deps"))
    return workspaces(g).withColumnRenamed("workspace", "workspace_name").join(ranked, "workspace_id", "left").na.fill(0)


def workspace_summary(g: Graph, k: int = 20) -> DataFrame:
    dependent = rel(g, "DEPENDS_ON").select(F.col("src").alias("item_id"), F.lit(1).alias("has")).distinct()
    stats = add_counts(item_workspace(g), "item_id", dependent).groupBy("workspace_id", "workspace").agg(
        F.count(F.lit(1)).alias("item_count"), F.sum("has").alias("items_with_dependencies")
    )
    stats = stats.withColumn("standalone_items", F.col("item_count") - F.col("items_with_dependencies"))
    return top_k(stats, [F.desc("item_count"), "workspace_id"], k)


def type_distribution(g: Graph) -> DataFrame:
    return item_workspace(g).join(items(g), "item_id").groupBy("workspace", "item_type").agg(F.count(F.lit(1)).alias("count"))


def complexity(g: Graph, k: int = 20) -> DataFrame:
    d = degrees(g, "DEPENDS_ON", "CONSUMES", "MIRRORS").select(F.col("id").alias("item_id"), (F.col("incoming") + F.col("outgoing")).alias("n"))
    stats = _per_workspace(g, d).groupBy("workspace").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("total_relationships"))
    stats = stats.withColumn("avg_relationships_per_item", round_half_even(F.col("total_relationships") / F.col("items")))
    return top_k(stats, [F.desc("total_relationships"), "workspace"], k)


def isolated_workspaces(g: Graph) -> DataFrame:
    """Items with no dependency into another workspace and no external source, counted."""
    home = item_workspace(g).select("item_id", "workspace_id")
    crossing = (
        rel(g, "DEPENDS_ON")
        .join(home.withColumnRenamed("workspace_id", "a"), F.col("src") == F.col("item_id")).drop("item_id")
        .join(home.withColumnRenamed("workspace_id", "b"), F.col("dst") == F.col("item_id")).drop("item_id")
        .filter("a <> b").select(F.col("src").alias("item_id"))
    )
    consuming = rel(g, "CONSUMES").select(F.col("src").alias("item_id"))
    calm = item_workspace(g).join(crossing.unionByName(consuming).distinct(), "item_id", "left_anti")
    return calm.groupBy(F.col("workspace").alias("isolated_workspace")).agg(F.count(F.lit(1)).alias("item_count"))


def top_connected(g: Graph, k: int = 10) -> DataFrame:
    """Most depended-on items. The k are chosen before anything is joined to them."""
    counts = count_edges(rel(g, "DEPENDS_ON"), "dst", "item_id", "incoming_connections")
    kept = counts.join(item_workspace(g), "item_id")
    return top_k(kept, [F.desc("incoming_connections"), "item_id"], k).join(items(g), "item_id", "left")


def top_sources(g: Graph, k: int = 10) -> DataFrame:
    counts = top_k(count_edges(rel(g, "CONSUMES"), "dst", "id", "consumer_count"), [F.desc("consumer_count"), "id"], k)
    return counts.join(label(g, "Source").select("id", "name", "type", "location"), "id", "left").select(
        F.col("id").alias("source_id"), F.col("name").alias("display_name"), F.col("type").alias("source_type"), "location", "consumer_count"
    )


def hubs(g: Graph, k: int = 25) -> DataFrame:
    d = degrees(g).withColumnRenamed("id", "item_id")
    ranked = add_counts(items(g), "item_id", d).withColumn("total_connections", F.col("incoming") + F.col("outgoing"))
    return top_k(ranked, [F.desc("total_connections"), "item_id"], k)


def degree_centrality(g: Graph, k: int = 30) -> DataFrame:
    return hubs(g, k).select("item_id", "item_name", "item_type", F.col("total_connections").alias("degree"))


def centrality(g: Graph, k: int = 20) -> DataFrame:
    counted = count_related(g, {"out_degree": ("DEPENDS_ON", "out"), "in_degree": ("DEPENDS_ON", "in"), "external_connections": ("CONSUMES", "out")})
    scored = counted.select(
        "item_id", "item_name", "item_type", (F.col("out_degree") + F.col("in_degree")).alias("internal_connections"),
        "external_connections", F.col("in_degree").alias("importance_score"),
    )
    return top_k(with_workspace(scored, g, "inner").drop("workspace_id"), [F.desc("importance_score"), "item_id"], k)


def has_edge(nodes: DataFrame, edges: DataFrame, key: str = "item_id", side: str = "src") -> DataFrame:
    return nodes.join(edges.select(F.col(side).alias(key)), key, "left_semi")


def lacks_edge(nodes: DataFrame, edges: DataFrame, key: str = "item_id", side: str = "src") -> DataFrame:
    return nodes.join(edges.select(F.col(side).alias(key)).distinct(), key, "left_anti")


def leaves(g: Graph) -> DataFrame:
    """Items that no item depends on."""
    return with_workspace(lacks_edge(items(g), rel(g, "DEPENDS_ON"), side="dst"), g).drop("workspace_id")


def roots(g: Graph) -> DataFrame:
    """Items without upstream items and sources."""
    return with_workspace(lacks_edge(items(g), rel(g, "DEPENDS_ON", "CONSUMES")), g).drop("workspace_id")


def bottlenecks(g: Graph, k: int = 20, minimum: int = 0) -> DataFrame:
    d = degrees(g, "DEPENDS_ON").select(F.col("id").alias("item_id"), F.col("incoming").alias("upstream_count"), F.col("outgoing").alias("downstream_count"))
    hit = d.filter((F.col("upstream_count") > minimum) & (F.col("downstream_count") > minimum)).withColumn("impact_score", F.col("upstream_count") * F.col("downstream_count"))
    named = hit.join(items(g), "item_id")
    return top_k(named, [F.desc("impact_score"), "item_id"], k)


def bridges(g: Graph, k: int = 20) -> DataFrame:
    return bottlenecks(g, k, minimum=1).select(
        "item_id", "item_name", "item_type", F.col("upstream_count").alias("in_degree"), F.col("downstream_count").alias("out_degree"), F.col("impact_score").alias("bridge_score")
    )


def density(g: Graph, k: int = 20) -> DataFrame:
    home = item_workspace(g)
    n = home.groupBy("workspace_id", "workspace").agg(F.count(F.lit(1)).alias("nodes"))
    ids = home.select("item_id", "workspace_id")
    inner = (
        rel(g, "DEPENDS_ON")
        .join(ids.select(F.col("item_id").alias("src"), F.col("workspace_id").alias("a")), "src")
        .join(ids.select(F.col("item_id").alias("dst"), F.col("workspace_id").alias("b")), "dst")
        .filter("a = b").groupBy(F.col("a").alias("workspace_id")).agg(F.count(F.lit(1)).alias("edges"))
    )
    value = F.when(F.col("nodes") > 1, round_half_even(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 4)).otherwise(0.0)
    return top_k(add_counts(n, "workspace_id", inner).withColumn("density", value).drop("workspace_id"), [F.desc("density"), "workspace"], k)


def type_cooccurrence(g: Graph, k: int = 30) -> DataFrame:
    kinds = items(g).select("item_id", "item_type")
    pairs = (
        rel(g, "DEPENDS_ON")
        .join(kinds.select(F.col("item_id").alias("src"), F.col("item_type").alias("source_type")), "src")
        .join(kinds.select(F.col("item_id").alias("dst"), F.col("item_type").alias("target_type")), "dst")
        .groupBy("source_type", "target_type").agg(F.count(F.lit(1)).alias("occurrence_count"))
    )
    return top_k(pairs, [F.desc("occurrence_count"), "source_type", "target_type"], k)


def maturity(g: Graph, k: int = 20) -> DataFrame:
    flag = lambda r, name: rel(g, r).select(F.col("src").alias("item_id"), F.lit(1).alias(name)).distinct()
    per_item = add_counts(item_workspace(g), "item_id", flag("DEPENDS_ON", "d"), flag("CONSUMES", "c"))
    stats = per_item.groupBy("workspace").agg(F.count(F.lit(1)).alias("item_count"), F.sum("d").alias("items_with_deps"), F.sum("c").alias("items_with_sources"))
    score = round_half_even(100.0 * (F.col("items_with_deps") + F.col("items_with_sources")) / (2 * F.col("item_count")), 1)
    return top_k(stats.withColumn("maturity_score", score), [F.desc("maturity_score"), "workspace"], k)


def source_diversity(g: Graph, k: int = 20) -> DataFrame:
    """Source kinds per workspace; kinds are a handful, so the set is small by nature."""
    kinds = label(g, "Source").select(F.col("id").alias("dst"), "type")
    pairs = (
        rel(g, "CONSUMES").join(kinds, "dst").select(F.col("src").alias("item_id"), "type").distinct()
        .join(item_workspace(g), "item_id").select("workspace", "type").distinct()
    )
    stats = pairs.groupBy("workspace").agg(F.count(F.lit(1)).alias("source_type_count"), F.array_sort(F.collect_list("type")).alias("source_types"))
    return top_k(stats, [F.desc("source_type_count"), "workspace"], k)


def graph_stats(g: Graph, k: int = 10) -> DataFrame:
    """Counts by item and source type, and the k items and sources with most edges, as rows."""
    form = lambda df, section, name, n: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), F.col(n).alias("count"))
    d = degrees(g, "DEPENDS_ON", "CONSUMES").withColumn("n", F.col("incoming") + F.col("outgoing"))
    best = lambda kind: top_k(d.join(label(g, kind).select("id"), "id", "left_semi"), [F.desc("n"), "id"], k)
    return (
        form(count_by_type(g, "Item"), "items_by_type", "type", "count")
        .unionByName(form(count_by_type(g, "Source"), "sources_by_type", "type", "count"))
        .unionByName(form(best("Item"), "top_items", "id", "n"))
        .unionByName(form(best("Source"), "top_sources", "id", "n"))
    )


def classified(records: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Parsed records, with ``internal`` and ``external`` and the upstream item of internal ones.

    Unlike the graph's edges these are all records: one that names a known item is internal, one with any other kind
    of connection is external. With ``by``, records that are alike in these columns and their connection's kind and
    item are one row, and ``n`` is their number.
    """
    from tidewatch.operators.graph.build import item_ids, parsed

    p = parsed(records)
    ids = item_ids(records).select(F.col("item_id").alias("_known"))
    lake = (F.col("kind") == "OneLake") & F.col("conn").isNotNull()
    named = ~F.coalesce(F.col("kind"), F.lit("")).isin("", "Unknown")
    p = p.withColumns({"lake": F.coalesce(lake, F.lit(False)), "named": named, "_item": F.when(lake, F.col("conn.oneLake.itemId"))})
    if by is not None:
        p = p.groupBy(*by, "kind", "lake", "named", "_item").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    p = p.withColumn("_key", spread_nulls("_item", "seq"))
    p = p.join(ids, F.col("_key") == F.col("_known"), "left").drop("_key", "_item")
    internal = F.col("_known").isNotNull()
    return p.withColumns({"internal": internal, "external": ~internal & (F.col("lake") | F.col("named"))}).withColumnRenamed("_known", "upstream_id")


def lineage_statistics(records: DataFrame) -> DataFrame:
    """Totals and distributions straight from lineage records, as (section, name, count) rows.

    Unlike the graph, edges are counted per record here. Mirrored databases are counted as
    distinct items and, apart, as records. Records are read once, into counts per item and kind of connection.
    """
    from tidewatch.functions.lineage import base_type
    from tidewatch.operators.graph.build import mirrored_tables

    p = cut_lineage(classified(records, ["workspace_id", "item_id", "raw_type"]), "lineage-counts")
    internal, external = F.col("internal"), F.col("external")
    mirror = F.col("raw_type") == "MirroredDatabase"
    records_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    totals = p.agg(
        F.countDistinct("workspace_id").alias("workspaces"), F.countDistinct("item_id").alias("items"),
        records_of(internal).alias("internal_edges"), records_of(external).alias("external_edges"),
        F.countDistinct(F.when(mirror, F.col("item_id"))).alias("mirrored_databases"), records_of(mirror).alias("mirrored_database_records"),
        F.countDistinct(F.when(internal, F.col("workspace_id"))).alias("workspaces_with_internal"), F.countDistinct(F.when(external, F.col("workspace_id"))).alias("workspaces_with_external"),
    )
    rows = [totals.unpivot([], totals.columns, "name", "count").withColumn("section", F.lit("totals"))]

    def section(df: DataFrame, name: str, key: Column, n: Column) -> None:
        rows.append(df.groupBy(key.alias("name")).agg(F.sum(n).alias("count")).withColumn("section", F.lit(name)))

    n = F.col("n")
    section(p.filter("item_id is not null"), "items_by_type", base_type("raw_type"), n)
    section(p.filter(F.col("named") & ~F.col("lake")), "sources_by_type", F.col("kind"), n)
    section(p.filter(external), "external_edges_by_type", F.col("kind"), n)
    tables = mirrored_tables(records)[0]
    section(tables, "tables_by_database", F.col("database"), F.lit(1))
    section(tables, "tables_by_schema", F.col("schema"), F.lit(1))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("section", "name", "count")


class LineageDetails(NamedTuple):
    """The lists that go with :func:`lineage_statistics`, each a frame of its own."""

    workspaces: DataFrame
    top_items: DataFrame
    top_sources: DataFrame
    orphans: DataFrame
    workspace_pairs: DataFrame
    source_names: DataFrame


def lineage_details(records: DataFrame, k: int = 10, pairs: int = 20) -> LineageDetails:
    """Per workspace its items and dependencies, the most used items and kinds of source, items without any dependency,
    the pairs of workspaces that depend on each other most, and the names of external sources by kind.

    An item's last record describes it. Dependencies are counted per record; ties go to the smaller name or id.
    """
    from tidewatch.operators.graph.build import parsed, source_nodes
    from tidewatch.operators.ranking import first_per_key

    whole = parsed(records)
    slim = classified(whole).select("seq", "workspace_id", "workspace_name", "item_id", "item_name", "raw_type", "kind", "upstream_id", "internal", "external")
    p = cut_lineage(slim, "lineage-records")
    last = lambda key, *cols: first_per_key(p.select(key, *cols, "seq"), key, "seq", cols, last=True)
    described = cut_lineage(last("item_id", "item_name", "raw_type", "workspace_id").withColumnRenamed("raw_type", "item_type"), "lineage-items")
    named = last("workspace_id", "workspace_name")
    sums = p.filter("workspace_id is not null").groupBy("workspace_id").agg(F.count_if("external").alias("external_deps"), F.count_if("internal").alias("internal_deps"))
    held = p.filter("item_id is not null").select("workspace_id", "item_id").distinct().groupBy("workspace_id").agg(F.count(F.lit(1)).alias("item_count"))
    spaces = add_counts(named.join(sums, "workspace_id"), "workspace_id", held)

    inner = p.filter("internal")
    used = count_edges(inner, "upstream_id", "item_id", "connections")
    top_items = top_k(used, [F.desc("connections"), "item_id"], k).join(described.drop("workspace_id"), "item_id", "left")
    top_sources = top_k(count_edges(p.filter("external"), "kind", "type", "connections"), [F.desc("connections"), "type"], k)

    touched = inner.select("item_id").unionByName(inner.select(F.col("upstream_id").alias("item_id"))).unionByName(p.filter("external").select("item_id"))
    orphans = described.drop("workspace_id").join(touched.distinct(), "item_id", "left_anti")

    # Records are counted per pair of items first, and per pair of workspaces before those are named.
    met = inner.filter("item_id is not null").groupBy("item_id", "upstream_id").agg(F.count(F.lit(1)).alias("n"))
    at = lambda item, name: described.select(F.col("item_id").alias(item), F.col("workspace_id").alias(name))
    across = met.join(at("upstream_id", "source_id"), "upstream_id").join(at("item_id", "target_id"), "item_id").filter("source_id <> target_id")
    counted = across.groupBy("source_id", "target_id").agg(F.sum("n").alias("edges"))
    name_of = lambda side: named.select(F.col("workspace_id").alias(f"{side}_id"), F.col("workspace_name").alias(f"{side}_workspace"))
    by_name = counted.join(name_of("source"), "source_id").join(name_of("target"), "target_id").groupBy("source_workspace", "target_workspace").agg(F.sum("edges").alias("edges"))
    workspace_pairs = top_k(by_name, [F.desc("edges"), "source_workspace", "target_workspace"], pairs)

    # The field that names a source of each kind.
    name = F.when(F.col("type") == "Snowflake", F.col("database")).when(F.col("type").isin("AdlsGen2", "AzureBlob"), F.col("container"))
    name = name.when(F.col("type").isin("AmazonS3", "OneDriveSharePoint"), F.col("location"))
    source_names = source_nodes(records).select("type", name.alias("name")).filter("name is not null").distinct()
    return LineageDetails(spaces, top_items, top_sources, orphans, workspace_pairs, source_names)
