"""The graph as two DataFrames.

``nodes``: id, label (Workspace, Item, Source, Table), name, type, location, database,
schema, full_path, table_type.
``edges``: src, dst, rel, with rel one of CONTAINS, DEPENDS_ON, CONSUMES, MIRRORS,
USES_TABLE, PROVIDES_TABLE, READS_FROM. DEPENDS_ON points from the consumer to its upstream.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def rel(g: Graph, *names: str) -> DataFrame:
    return g.edges.filter(F.col("rel").isin(*names)).select("src", "dst")


def label(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("label") == name)


def items(g: Graph) -> DataFrame:
    return label(g, "Item").select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), F.col("type").alias("item_type"))


def workspaces(g: Graph) -> DataFrame:
    return label(g, "Workspace").select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace"))


def item_workspace(g: Graph) -> DataFrame:
    """item_id, workspace_id, workspace for every contained item."""
    held = rel(g, "CONTAINS").select(F.col("src").alias("workspace_id"), F.col("dst").alias("item_id"))
    return held.join(workspaces(g), "workspace_id")


def with_workspace(df: DataFrame, g: Graph, how: str = "left") -> DataFrame:
    return df.join(item_workspace(g), "item_id", how)
