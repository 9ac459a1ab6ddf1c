"""Sources and tables: usage, lineage, search and footprints.

Lists of related entities come as rows (one per relation), since an entity can have any
number of them; only fixed-size samples are arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.graph.model import Graph, item_workspace, items, label, rel, with_workspace
from tidewatch.operators.graph.search import NameIndex, matches
from tidewatch.operators.graph.stats import add_counts, count_edges, sample_names
from tidewatch.operators.ranking import page, top_k

TABLE_RELATIONS = ("MIRRORS", "USES_TABLE", "PROVIDES_TABLE")


def sources(g: Graph) -> DataFrame:
    return label(g, "Source").select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), "location", "database")


def tables(g: Graph) -> DataFrame:
    return label(g, "Table").select(F.col("id").alias("table_id"), F.col("name").alias("table_name"), "schema", "database", "full_path", "table_type")


def consumption(g: Graph) -> DataFrame:
    return rel(g, "CONSUMES").select(F.col("src").alias("item_id"), F.col("dst").alias("source_id"))


def table_edges(g: Graph, *rels: str) -> DataFrame:
    chosen = rels or TABLE_RELATIONS
    return g.edges.filter(F.col("rel").isin(*chosen)).select(F.col("src").alias("item_id"), F.col("dst").alias("table_id"), "rel")


def source_usage(g: Graph, view: str = "summary", k: int = 20, samples: int = 5) -> DataFrame:
    """``summary``, ``most_used``, ``unused``, ``by_workspace`` or ``by_item``."""
    used = consumption(g)
    counts = used.groupBy("source_id").agg(F.count(F.lit(1)).alias("used_by_items"))
    if view == "summary":
        return add_counts(sources(g).select("source_id", "source_name", "source_type"), "source_id", counts)
    if view == "unused":
        return sources(g).select("source_id", "source_name", "source_type").join(used.select("source_id").distinct(), "source_id", "left_anti")
    if view == "most_used":
        best = top_k(counts, [F.desc("used_by_items"), "source_id"], k)
        names = used.join(best.select("source_id"), "source_id", "left_semi").join(items(g), "item_id")
        return best.join(sources(g).select("source_id", "source_name", "source_type"), "source_id").join(sample_names(names, ["source_id"], "item_name", samples, "sample_consumers"), "source_id", "left")
    if view == "by_workspace":
        pairs = used.join(item_workspace(g), "item_id").select("workspace", "source_id").distinct().join(sources(g), "source_id")
        counted = pairs.groupBy("workspace", "source_type").agg(F.count(F.lit(1)).alias("source_count"))
        return counted.join(sample_names(pairs, ["workspace", "source_type"], "source_name", 3, "sample_sources"), ["workspace", "source_type"])
    if view == "by_item":
        per_item = used.groupBy("item_id").agg(F.count(F.lit(1)).alias("source_count"))
        return top_k(per_item, [F.desc("source_count"), "item_id"], k).join(items(g), "item_id")
    raise ValueError(f"unknown view {view}")


def source_consumers(g: Graph, source_id: str | None = None, source_type: str | None = None) -> DataFrame:
    """Consumers of one source or of one kind of source."""
    chosen = sources(g)
    if source_id is not None:
        chosen = chosen.filter(F.col("source_id") == source_id)
    if source_type is not None:
        chosen = chosen.filter(F.col("source_type") == source_type)
    return consumption(g).join(chosen, "source_id").join(items(g), "item_id").join(item_workspace(g), "item_id")


def items_using_table(g: Graph, name: str) -> DataFrame:
    """Items that mirror or use a table whose name contains the text."""
    hit = tables(g).filter(matches("table_name", name)).select("table_id", "table_name", "schema", "database")
    found = table_edges(g, "MIRRORS", "USES_TABLE").join(hit, "table_id").join(items(g), "item_id")
    return with_workspace(found, g).withColumnRenamed("rel", "relationship")


def table_lineage(g: Graph) -> DataFrame:
    """Every table with one row per related item; tables without any keep one null row."""
    related = table_edges(g).join(items(g).select("item_id", "item_name"), "item_id")
    return tables(g).join(related, "table_id", "left").withColumnRenamed("rel", "relationship")


def table_flows(g: Graph) -> DataFrame:
    """Tables that are both provided and used: one row per provider (``source``) and user
    (``target``), with the number of flows through the table and of those that cross
    workspaces.

    A flow is any (source, target) pair of a table. Pairs are counted, not listed: a table
    with many of both would give their product. Rows are linear in the edges.
    """
    sides = table_edges(g, "PROVIDES_TABLE", "USES_TABLE").join(item_workspace(g), "item_id")
    source, target = F.col("rel") == "PROVIDES_TABLE", F.col("rel") == "USES_TABLE"
    per_ws = sides.groupBy("table_id", "workspace_id").agg(F.count_if(source).alias("p"), F.count_if(target).alias("u"))
    flows = per_ws.groupBy("table_id").agg(F.sum("p").alias("p"), F.sum("u").alias("u"), F.sum(F.col("p") * F.col("u")).alias("same"))
    flows = flows.filter("p > 0 and u > 0").select("table_id", (F.col("p") * F.col("u")).alias("flow_count"), (F.col("p") * F.col("u") - F.col("same")).alias("crossing_count"))
    named = sides.select("table_id", "item_id", F.when(source, "source").otherwise("target").alias("role"), "workspace").join(items(g).select("item_id", "item_name"), "item_id")
    return named.join(flows, "table_id").join(tables(g).select("table_id", "table_name", "schema"), "table_id")


def table_summary(g: Graph) -> DataFrame:
    return tables(g).agg(
        F.count(F.lit(1)).alias("total_tables"), F.count_if(F.col("table_type") == "shortcut").alias("shortcut_tables"),
        F.count("database").alias("mirrored_tables"),
    )


def table_dependencies(g: Graph, name: str) -> DataFrame:
    """Providers, consumers and mirrors of matching tables, one row each."""
    hit = tables(g).filter(matches("table_name", name))
    related = with_workspace(table_edges(g).join(items(g), "item_id"), g).select("table_id", F.col("rel").alias("relationship"), "item_name", "item_type", "workspace")
    return hit.join(related.distinct(), "table_id", "left")


def tables_by_schema(g: Graph, schema: str | None = None) -> DataFrame:
    chosen = tables(g) if schema is None else tables(g).filter(F.col("schema") == schema)
    counts = table_edges(g, "USES_TABLE", "PROVIDES_TABLE").groupBy("table_id").agg(
        F.count_if(F.col("rel") == "USES_TABLE").alias("consumer_count"), F.count_if(F.col("rel") == "PROVIDES_TABLE").alias("provider_count")
    )
    return add_counts(chosen, "table_id", counts)


def schema_dependencies(g: Graph, schema: str) -> DataFrame:
    """Providers, consumers and the providers' external sources of a schema, as rows."""
    hit = tables(g).filter(F.col("schema") == schema).select("table_id")
    edges = table_edges(g, "USES_TABLE", "PROVIDES_TABLE").join(hit, "table_id", "left_semi")
    named = edges.select("item_id", "rel").distinct().join(items(g), "item_id")
    form = lambda df, role, name, kind: df.select(F.lit(role).alias("role"), F.col(name).alias("name"), F.col(kind).alias("type")).distinct()
    providers = named.filter("rel = 'PROVIDES_TABLE'")
    ext = consumption(g).join(providers.select("item_id").distinct(), "item_id", "left_semi").select("source_id").distinct().join(sources(g), "source_id")
    return (
        form(providers, "provider", "item_name", "item_type")
        .unionByName(form(named.filter("rel = 'USES_TABLE'"), "consumer", "item_name", "item_type"))
        .unionByName(form(ext, "external_source", "source_name", "source_type"))
    )


def tables_per(g: Graph, by: str = "database") -> DataFrame:
    """``database`` (database and schema), ``item`` (mirroring items with 5 samples) or ``path``."""
    if by == "database":
        return tables(g).groupBy("database", "schema").agg(F.count(F.lit(1)).alias("table_count"))
    if by == "item":
        pairs = table_edges(g, "MIRRORS").join(tables(g).select("table_id", "table_name"), "table_id")
        counts = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("table_count"))
        return counts.join(sample_names(pairs, ["item_id"], "table_name", 5, "sample_tables"), "item_id").join(items(g), "item_id")
    return tables(g).select("table_id", "full_path", "database", "schema", "table_name")


def tables_of_database(g: Graph, database: str) -> DataFrame:
    return tables(g).filter(matches("database", database))


def schema_coverage(g: Graph) -> DataFrame:
    mirrors = table_edges(g, "MIRRORS").select("table_id", "item_id")
    joined = tables(g).select("table_id", "database", "schema").join(mirrors, "table_id", "left")
    return joined.groupBy("database", "schema").agg(F.countDistinct("table_id").alias("table_count"), F.countDistinct("item_id").alias("consumer_count"))


def search_tables(g: Graph, q: str, k: int = 50, index: NameIndex | None = None) -> DataFrame:
    """Tables whose name contains the text, most used first."""
    found = tables(g)
    hit = found.filter(matches("table_name", q)) if index is None else found.join(index.find(q, "table", True).select(F.col("id").alias("table_id")), "table_id", "left_semi")
    counts = table_edges(g, "MIRRORS", "USES_TABLE").groupBy("table_id").agg(F.countDistinct("item_id").alias("consumer_count"))
    return top_k(add_counts(hit, "table_id", counts), [F.desc("consumer_count"), "table_id"], k)


def search_items(g: Graph, q: str, k: int = 50, index: NameIndex | None = None) -> DataFrame:
    """Items whose name contains the text, those with most tables first."""
    found = items(g)
    hit = found.filter(matches("item_name", q)) if index is None else found.join(index.find(q, "item", True).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    counts = table_edges(g, "USES_TABLE", "PROVIDES_TABLE").groupBy("item_id").agg(F.countDistinct("table_id").alias("table_count"))
    best = top_k(add_counts(hit, "item_id", counts), [F.desc("table_count"), "item_name", "item_id"], k)
    return with_workspace(best, g).drop("workspace_id")


def table_page(g: Graph, offset: int, limit: int) -> DataFrame:
    return page(tables(g), ["table_name", "table_id"], offset, limit)


def tables_overview(g: Graph, view: str = "relations", minimum: int = 5, min_workspaces: int = 2) -> DataFrame:
    """``source_kind``, ``relations``, ``orphans``, ``high_dependency`` or ``cross_workspace``."""
    used = table_edges(g, "MIRRORS", "USES_TABLE")
    if view == "source_kind":
        provided = table_edges(g, "PROVIDES_TABLE").join(items(g).filter(F.col("item_type").isin("Lakehouse", "MirroredDatabase")), "item_id").select("table_id", "item_type")
        kind = F.when(F.col("item_type") == "Lakehouse", "Lakehouse").when((F.col("item_type") == "MirroredDatabase") | F.col("database").isNotNull(), "Snowflake").otherwise("Unknown")
        return tables(g).join(provided, "table_id", "left").groupBy(kind.alias("source_kind")).agg(F.count(F.lit(1)).alias("count"))
    if view == "relations":
        return table_edges(g).groupBy("rel").agg(F.count(F.lit(1)).alias("count"))
    if view == "orphans":
        return tables(g).join(used.select("table_id").distinct(), "table_id", "left_anti")
    if view == "high_dependency":
        counts = used.groupBy("table_id").agg(F.countDistinct("item_id").alias("consumer_count")).filter(F.col("consumer_count") >= minimum)
        return counts.join(tables(g).select("table_id", "table_name", "database"), "table_id")
    if view == "cross_workspace":
        counts = used.select("table_id", "item_id").distinct().join(item_workspace(g), "item_id").groupBy("table_id").agg(F.countDistinct("workspace_id").alias("workspace_count"))
        return counts.filter(F.col("workspace_count") >= min_workspaces).join(tables(g).select("table_id", "table_name"), "table_id")
    raise ValueError(f"unknown view {view}")


def item_footprint(g: Graph, item_id: str | None = None, samples: int = 10) -> DataFrame:
    """Used and provided tables of one item (or of all) with sample names."""
    chosen = items(g) if item_id is None else items(g).filter(F.col("item_id") == item_id)
    edges = table_edges(g, "USES_TABLE", "PROVIDES_TABLE")
    if item_id is not None:
        edges = edges.filter(F.col("item_id") == item_id)
    named = edges.join(tables(g).select("table_id", "table_name"), "table_id")
    counts = edges.groupBy("item_id").agg(F.count_if(F.col("rel") == "USES_TABLE").alias("tables_used_count"), F.count_if(F.col("rel") == "PROVIDES_TABLE").alias("tables_provided_count"))
    out = add_counts(chosen, "item_id", counts)
    for r, alias in (("USES_TABLE", "sample_tables_used"), ("PROVIDES_TABLE", "sample_tables_provided")):
        out = out.join(sample_names(named.filter(F.col("rel") == r), ["item_id"], "table_name", samples, alias), "item_id", "left")
    return out.withColumn("total_table_footprint", F.col("tables_used_count") + F.col("tables_provided_count"))


def graph_with_tables(g: Graph) -> DataFrame:
    """Edges between items and tables, with both labels, for a graph that shows the table layer."""
    kinds = g.nodes.select("id", "label")
    return (
        g.edges.filter(F.col("rel").isin("DEPENDS_ON", *TABLE_RELATIONS))
        .join(kinds.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src")
        .join(kinds.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    )
