"""Which sources reach which items, as bits: counts over a transitive closure without its rows.

Sources are numbered densely. An item's sources are rows (node, block, w0 .. w3): a block is 256 consecutive sources, a
bit each of four longs, and blocks without a bit have no row. So there are at most items x sources / 256 rows
where pairs would be items x sources, and sources that reach the same items share rows.

Strong components become one node first. Then nodes are taken layer by layer, by the length of their longest chain:
everything that a layer depends on is finished, so each edge is joined once for all blocks, with a bitwise or that
tasks combine before the shuffle.

Where many sources reach many items, the rows still grow with their product. So they are not made where the edges, as pairs of
numbers, fit into a task: :mod:`tidewatch.operators.graph.slices` counts there. Larger graphs are counted in passes of as many
blocks as make about as many rows as the graph itself has; what a pass has written is removed after it.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.analysis import encode_labels
from tidewatch.operators.graph.components import condensed, strong_components
from tidewatch.operators.graph.slices import counted_in_slices
from tidewatch.session import cut_lineage, scratch_group

WORDS = ["w0", "w1", "w2", "w3"]
BITS = 64
#: Layers whose frames are merged into one, so that plans don't grow with the depth of the graph.
MERGE = 8
#: Edges up to which a task gets the whole graph, eight bytes each.
IN_TASK = 20_000_000


def _ored(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "block").agg(*(F.bit_or(w).alias(w) for w in WORDS))


def source_bits(direct: DataFrame, numbers: DataFrame) -> DataFrame:
    """(node, block, words) of the sources that a node consumes itself."""
    no = F.col("source_code").cast("long")
    word = F.shiftright(no, 6).bitwiseAND(F.lit(len(WORDS) - 1))
    bit: Column = F.expr(f"shiftleft(1L, cast(cast(source_code as bigint) % {BITS} as int))")
    rows = direct.join(numbers, "source").select("node", F.shiftright(no, 8).alias("block"), *(F.when(word == i, bit).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(WORDS)))
    return _ored(rows)


class Layers(NamedTuple):
    """A graph ready for passes: edges (node, next, d), depths (node, d), members, sizes and nodes that depend on themselves."""

    edges: DataFrame
    depths: DataFrame
    members: DataFrame | None
    sizes: DataFrame
    round_trip: DataFrame
    deepest: int


def layers(edges: DataFrame) -> Layers:
    """Nodes that share a strong component are one node, named as its least member; ``sizes`` (node, size) lists those."""
    from tidewatch.operators.graph.traverse import walk_depths

    edges = cut_lineage(edges, "bit-edges")
    depths, cyclic = walk_depths(edges)
    members = strong_components(edges.join(cyclic, "node", "left_semi").join(cyclic.select(F.col("node").alias("next")), "next", "left_semi")) if not cyclic.isEmpty() else None
    sizes = edges.select("node", F.lit(1).cast("long").alias("size")).limit(0)
    round_trip = edges.where("node = next").select("node").distinct()
    if members is not None:
        edges = cut_lineage(condensed(edges, members), "bit-condensed")
        depths, _ = walk_depths(edges.select("node", "next"))
        sizes = cut_lineage(members.groupBy(F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("size")), "bit-sizes")
        # Members of a component depend on each other, and a node may depend on itself: what they consume reaches them too.
        round_trip = sizes.select("node").unionByName(round_trip.join(members, "node", "left_anti"))
    layered = cut_lineage(edges.select("node", "next").join(depths, "node").sortWithinPartitions("d"), "bit-layers")
    return Layers(layered, depths, members, sizes, round_trip, layered.agg(F.max("d")).first()[0] or 0)


def reached_bits(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bits of the sources that nodes depend on through at least one edge (node, next), as (node, block, words), and node sizes."""
    graph = layers(edges)
    return _passed(graph, own, "bits"), graph.sizes


def _passed(graph: Layers, own: DataFrame, label: str) -> DataFrame:
    """(node, block, words) of what nodes depend on; ``own`` has what they consume."""
    if graph.members is not None:
        own = _ored(own.join(graph.members, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component"))
    own = cut_lineage(own, f"{label}-own")
    found: list[DataFrame] = [] if graph.members is None else [own.join(graph.round_trip, "node", "left_semi")]
    below = [own]
    for d in range(1, graph.deepest + 1):
        known = reduce(DataFrame.unionByName, below).withColumnRenamed("node", "next")
        passed = graph.edges.where(F.col("d") == d).select("node", "next").join(known, "next").select("node", "block", *WORDS)
        layer = cut_lineage(_ored(passed), f"{label}-layer")
        found.append(layer)
        below.append(layer)
        if len(below) > MERGE:
            below = [cut_lineage(reduce(DataFrame.unionByName, below), f"{label}-below")]
    rows = reduce(DataFrame.unionByName, found) if found else own.limit(0)
    return rows if graph.members is None else _ored(rows)


def _dependents(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source_code, items) of a pass. Bits are counted column by column where the rows are: a block gives 256 sums."""
    weighted = rows.join(sizes, "node", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    words = weighted.select("block", "size", F.posexplode(F.array(*WORDS)).alias("word", "bits")).where("bits <> 0")
    sums = words.groupBy("block", "word").agg(F.array(*(F.sum(F.col("size") * F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(1))) for b in range(BITS))).alias("n"))
    counted = sums.select("block", "word", F.posexplode("n").alias("bit", "items")).where("items > 0")
    return counted.select((F.col("block") * len(WORDS) * BITS + F.col("word") * BITS + F.col("bit")).cast("double").alias("source_code"), "items")


def dependents_per_source(edges: DataFrame, direct: DataFrame, rows_a_pass: int | None = None) -> DataFrame:
    """(source, items): the nodes that depend, through one edge or more, on a node of ``direct`` (node, source).

    ``direct`` is read more than once. With ``rows_a_pass``, the number of (node, block) rows that a pass may make, and for
    graphs that are too large for a task, sources are counted in passes, by default of as many rows as were given.
    """
    numbers = cut_lineage(encode_labels(direct, "source"), "source-numbers")
    graph = layers(edges)
    sources, n = numbers.count(), graph.edges.count()
    if rows_a_pass is None and n <= IN_TASK:
        found = cut_lineage(counted_in_slices(graph, n, direct, numbers, sources), "bit-counts")
    else:
        found = _counted_in_passes(graph, direct, numbers, sources, rows_a_pass or n + direct.count())
    return found.join(numbers, "source_code").select("source", "items")


def _counted_in_passes(graph: Layers, direct: DataFrame, numbers: DataFrame, sources: int, rows_a_pass: int) -> DataFrame:
    own = cut_lineage(source_bits(direct, numbers), "bit-sources")
    blocks = (sources - 1) // (len(WORDS) * BITS) + 1
    step = max(1, rows_a_pass // max(1, graph.depths.count()))
    counts: list[DataFrame] = []
    for first in range(0, blocks, step):
        with scratch_group(own.sparkSession, "bit-pass") as label:
            some = own.where((F.col("block") >= first) & (F.col("block") < first + step))
            counts.append(cut_lineage(_dependents(_passed(graph, some, label), graph.sizes), "bit-counts"))
    return reduce(DataFrame.unionByName, counts) if counts else numbers.select("source_code", F.lit(0).cast("long").alias("items")).limit(0)
