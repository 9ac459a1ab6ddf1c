"""Reachability, paths, depths and cycles over DEPENDS_ON.

Seeded traversals expand a frontier step by step; each step is one distributed join whose
result is written to the shared checkpoint folder, so plans stay short and a lost executor
costs one step. Depth and chain measures over all items need no seeds: rounds of joins over
edges stored once carry one row per item, never one per (item, item) pair, until nothing grows
any more.

Where items depend on each other in circles, these measures are taken between strong components: the
edges inside one don't count, its items share their depth, and it stands in a chain as its
least item. A component with nothing above it is a root. ``mode='trail'`` instead follows every trail
(no edge twice) of items that reach a cycle, of which there can be exponentially many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewatch.operators.graph.components import condensed, strong_components, turned
from tidewatch.operators.graph.model import Graph, item_workspace, items, rel, with_workspace
from tidewatch.operators.ranking import top_k, top_k_per_group
from tidewatch.session import cut_lineage, scratch_path

#: Rows up to which the nodes of a round are sent to all tasks, so that the edges they meet are not shuffled, and stored edges are kept as they are.
FEW = 200_000


def steps(g: Graph, direction: str, relations: tuple[str, ...] = ("DEPENDS_ON",)) -> DataFrame:
    """Edges as (node, next): ``up`` follows src to dst, ``down`` the reverse, ``any`` both."""
    e = rel(g, *relations) if relations else g.edges.select("src", "dst")
    up = e.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    down = e.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    return {"up": up, "down": down}[direction] if direction != "any" else up.unionByName(down).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, mode: str = "shortest") -> DataFrame:
    """Rows (seed, id, depth) below the seeds; ``seeds`` has seed and node.

    ``shortest`` keeps the least depth per (seed, id) and drops visited nodes; ``reach``
    keeps every depth at which a node occurs. ``depth=None`` goes on until nothing is new.
    """
    if depth is None and mode != "shortest":
        raise ValueError("unbounded depth needs mode='shortest'")
    frontier = seeds.select("seed", "node").distinct()
    visited = frontier
    found: list[DataFrame] = []
    level = 0
    while depth is None or level < depth:
        level += 1
        nxt = frontier.join(edges, "node").select("seed", F.col("next").alias("node")).distinct()
        if mode == "shortest":
            nxt = nxt.join(visited, ["seed", "node"], "left_anti")
        frontier = cut_lineage(nxt, "reach")
        if frontier.isEmpty():
            break
        found.append(frontier.withColumn("depth", F.lit(level)))
        if mode == "shortest":
            visited = visited.unionByName(frontier)
    if not found:
        return frontier.withColumn("depth", F.lit(0)).withColumnRenamed("node", "id")
    return _union(found).withColumnRenamed("node", "id")


def paths(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows (seed, id, depth, path) for every trail from the seeds: no edge is used twice.

    The number of trails is the answer's own size; for reachability use :func:`reach`.
    Trails end by themselves, so ``depth=None`` follows all of them to their end.
    """
    frontier = seeds.select("seed", "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("used")).distinct()
    found: list[DataFrame] = []
    level = 0
    while depth is None or level < depth:
        level += 1
        key = F.concat_ws("\u0001", "node", "next")
        nxt = (
            frontier.join(edges, "node")
            .filter(~F.array_contains("used", key))
            .select("seed", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.array_append("used", key).alias("used"))
        )
        frontier = cut_lineage(nxt, "paths")
        if frontier.isEmpty():
            break
        found.append(frontier.drop("used").withColumn("depth", F.lit(level)))
    if not found:
        return frontier.drop("used").withColumn("depth", F.lit(0)).withColumnRenamed("node", "id")
    return _union(found).withColumnRenamed("node", "id")


def _seed(nodes: DataFrame | list[str], g: Graph) -> DataFrame:
    if isinstance(nodes, DataFrame):
        return nodes.select(F.col(nodes.columns[0]).alias("seed"), F.col(nodes.columns[0]).alias("node"))
    chosen = g.nodes.filter(F.col("id").isin(nodes))
    return chosen.select(F.col("id").alias("seed"), F.col("id").alias("node"))


def _named(df: DataFrame, g: Graph) -> DataFrame:
    return df.join(g.nodes.select("id", "label", "name", "type"), "id", "left")


def path_names(df: DataFrame, g: Graph) -> DataFrame:
    """Replace the ids of ``path`` by names: one join on the exploded positions."""
    keyed = df.withColumn("_row", F.xxhash64("seed", F.array_join("path", "\u0001")))
    names = (
        keyed.select("seed", "_row", F.posexplode("path").alias("pos", "id"))
        .join(g.nodes.select("id", "name"), "id", "left")
        .groupBy("seed", "_row")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("path_names"))
    )
    return keyed.join(names, ["seed", "_row"]).drop("_row")


def _walk(g: Graph, nodes, depth: int, mode: str, direction: str, relations=("DEPENDS_ON",)) -> DataFrame:
    edges = steps(g, direction, relations)
    seeds = _seed(nodes, g)
    found = paths(edges, seeds, depth) if mode == "paths" else reach(edges, seeds, depth, mode)
    return _named(found, g)


def upstream(g: Graph, seeds, depth: int = 5, mode: str = "paths", relations: tuple[str, ...] = ("DEPENDS_ON",)) -> DataFrame:
    return _walk(g, seeds, depth, mode, "up", relations)


def downstream(g: Graph, seeds, depth: int = 5, mode: str = "paths") -> DataFrame:
    return _walk(g, seeds, depth, mode, "down")


def chain(g: Graph, seed: str, depth: int = 5) -> DataFrame:
    """Both directions by least depth; upstream also crosses into external sources."""
    up = upstream(g, [seed], depth, "shortest", ("DEPENDS_ON", "CONSUMES")).withColumn("direction", F.lit("upstream"))
    down = downstream(g, [seed], depth, "shortest").withColumn("direction", F.lit("downstream"))
    return up.unionByName(down)


def _expanded(frontier: DataFrame, visited: DataFrame, edges: DataFrame, front: bool, labels: int | None) -> DataFrame:
    """One step from (seed, node, path): the nodes that a seed reaches first now, each with the alphabetically first path.

    ``front`` paths grow at their end and begin with the seed, others begin at the node. A node that ``labels`` seeds have
    reached, the nearest first and then by name, is closed to others; None keeps all.
    """
    grown = F.array_append("path", F.col("next")) if front else F.array_prepend("path", F.col("next"))
    new = frontier.join(edges, "node").select("seed", F.col("next").alias("node"), grown.alias("path"))
    new = new.join(visited, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
    if labels is None:
        return new
    rank = F.row_number().over(W.partitionBy("node").orderBy("seed"))
    taken = visited.groupBy("node").agg(F.count(F.lit(1)).alias("taken"))
    near = new.withColumn("rank", rank).where(F.col("rank") <= labels).join(taken, "node", "left")
    return near.where(F.col("rank") + F.coalesce("taken", F.lit(0)) <= labels).select("seed", "node", "path")


def paths_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int = 15, k: int = 1) -> DataFrame:
    """(seed, id, path_length, path) of the k shortest pairs of a start and another node among the ends; both have a column id.

    Breadth first from both sides: each step moves the side with fewer rows, until the frontiers share nodes. A pair's
    distance is the sum of the two depths at which that first happens, and its path the one of the two halves that
    is alphabetically first. The search ends when k pairs have met: their distances are the least, and equal ones are
    settled by id. A node passes on the k + 1 starts that are nearest to it, equal ones by id: a start that isn't among them
    has k better ones at that node for any other end, so no pair of the first k runs through there. Ends alike.
    Edges may repeat.
    """
    sides = []
    for nodes in (starts, ends):
        seeds = cut_lineage(nodes.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path")), "path-seeds")
        n = seeds.count()
        sides.append({"frontier": seeds, "visited": seeds.select("seed", "node"), "rows": n, "depth": 0, "labels": k + 1 if n > k + 1 else None})
    kept: list[DataFrame] = []
    had = starts.select(F.col("id").alias("seed"), F.col("id").alias("end")).limit(0)
    n = 0
    while n < k and sides[0]["depth"] + sides[1]["depth"] < depth and all(s["rows"] for s in sides):
        front = sides[0]["rows"] <= sides[1]["rows"]
        side = sides[0 if front else 1]
        side["frontier"] = cut_lineage(_expanded(side["frontier"], side["visited"], edges, front, side["labels"]), "path-frontier")
        side["visited"] = side["visited"].unionByName(side["frontier"].select("seed", "node"))
        side["rows"], side["depth"] = side["frontier"].count(), side["depth"] + 1
        meet = sides[0]["frontier"].join(sides[1]["frontier"].select("node", F.col("seed").alias("end"), F.col("path").alias("tail")), "node").where("seed <> end")
        meet = meet.join(had, ["seed", "end"], "left_anti")
        whole = F.concat("path", F.slice("tail", 2, F.greatest(F.size("tail"), F.lit(1))))
        pairs = meet.select("seed", "end", whole.alias("path")).groupBy("seed", "end").agg(F.min("path").alias("path"))
        found = cut_lineage(top_k(pairs, ["seed", "end"], k - n).withColumn("path_length", F.size("path") - 1), "path-pairs")
        kept.append(found)
        had = had.unionByName(found.select("seed", "end"))
        n += found.count()
    empty = had.withColumn("path", F.array("seed")).withColumn("path_length", F.lit(0)).limit(0)
    return _union(kept or [empty]).select("seed", F.col("end").alias("id"), "path_length", "path")


def _undirected(g: Graph) -> DataFrame:
    """All edges both ways, as they come: to find those that repeat would move all of them."""
    there = g.edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    return cut_lineage(there.unionByName(turned(there)), "undirected")


def shortest_path(g: Graph, a: str, b: str, depth: int = 15) -> DataFrame:
    """One shortest undirected path over any relation: the alphabetically first of equals."""
    edges = _undirected(g)
    one = lambda i: g.nodes.filter(F.col("id") == i).select("id").distinct()
    return paths_between(edges, one(a), one(b), depth).select("path_length", "path")


def path_steps(g: Graph, path: DataFrame) -> DataFrame:
    """A path's steps: (step, id, name, label, type, relations), the relations being those to the node before it."""
    at = path.select(F.posexplode("path").alias("step", "id"), "path")
    at = at.select("step", "id", F.get("path", F.col("step") - 1).alias("prev"))
    e = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("prev"), "rel")
    near = e.unionByName(e.select(F.col("prev").alias("id"), F.col("id").alias("prev"), "rel"))
    known = at.filter("prev is not null").join(near, ["id", "prev"]).groupBy("step").agg(F.sort_array(F.collect_set("rel")).alias("relations"))
    return at.join(g.nodes.select("id", "name", "label", "type"), "id", "left").join(known, "step", "left").drop("prev")


def shortest_between_names(g: Graph, a: str, b: str, depth: int = 15, k: int = 5) -> DataFrame:
    """The k shortest pairs among items whose names contain the two texts, with their paths."""
    edges = _undirected(g)
    like = lambda text: items(g).filter(F.lower("item_name").contains(text.lower())).select(F.col("item_id").alias("id")).distinct()
    return paths_between(edges, like(a), like(b), depth, k)


def removal_impact(g: Graph, name: str, samples: int = 10) -> DataFrame:
    """Items affected when the items of that name go away: a count and sample names."""
    from tidewatch.operators.graph.stats import sample_names

    gone = items(g).filter(F.col("item_name") == name).select(F.col("item_id").alias("seed"))
    hit = _named(reach(steps(g, "down"), _seed(gone, g), None), g)
    counts = hit.groupBy("seed").agg(F.countDistinct("id").alias("affected_count"))
    out = gone.join(counts, "seed", "left").na.fill(0, ["affected_count"])
    return out.join(sample_names(hit, ["seed"], "name", samples, "sample_affected"), "seed", "left")


def source_failure_reach(g: Graph) -> DataFrame:
    """Direct consumers and indirect dependents of every external source, without a row per (source, item).

    See :mod:`tidewatch.operators.graph.bitmaps`: an item holds which sources it depends on as bits.
    """
    from tidewatch.operators.graph.bitmaps import dependents_per_source

    direct = cut_lineage(rel(g, "CONSUMES").select(F.col("src").alias("node"), F.col("dst").alias("source")), "consumers")
    edges = steps(g, "up")
    indirect = dependents_per_source(edges, direct).select(F.col("source").alias("seed"), F.col("items").alias("indirect_dependent_count"))
    counts = direct.groupBy(F.col("source").alias("seed")).agg(F.count(F.lit(1)).alias("direct_consumer_count")).join(indirect, "seed", "left").na.fill(0)
    return counts.join(g.nodes.select(F.col("id").alias("seed"), F.col("name").alias("external_source"), F.col("type").alias("source_type")), "seed").withColumnRenamed("seed", "source_id")


# ---- item and table impact ---------------------------------------------------------
def item_impact(g: Graph, item_id: str, depth: int | None = None) -> DataFrame:
    """Tables used, tables provided and items downstream of one item, as rows."""
    t = lambda r, name: (
        g.edges.filter((F.col("rel") == r) & (F.col("src") == item_id))
        .select(F.lit(name).alias("relationship"), F.col("dst").alias("id"), F.lit(0).alias("depth"))
    )
    down = reach(steps(g, "down"), _seed([item_id], g), depth).select(F.lit("downstream").alias("relationship"), "id", "depth")
    return _named(t("USES_TABLE", "uses").unionByName(t("PROVIDES_TABLE", "provides")).unionByName(down), g)


def table_impact(g: Graph, name: str, depth: int = 5) -> DataFrame:
    """Direct consumers (depth 0) and everything below them, per matching table.

    All tables and consumers travel in one frontier, the table id being the seed.
    """
    from tidewatch.operators.graph.tables import matches, table_edges, tables

    hit = tables(g).filter(matches("table_name", name)).select("table_id")
    direct = table_edges(g, "MIRRORS", "USES_TABLE").join(hit, "table_id", "left_semi").select(F.col("table_id").alias("seed"), F.col("item_id").alias("node")).distinct()
    below = reach(steps(g, "down"), direct, depth, "shortest")
    both = direct.select("seed", F.col("node").alias("id"), F.lit(0).alias("depth")).unionByName(below.select("seed", "id", "depth"))
    rows = both.withColumnsRenamed({"seed": "table_id", "id": "item_id"}).join(items(g), "item_id")
    return with_workspace(rows, g)


def table_impact_summary(impact: DataFrame) -> DataFrame:
    return impact.agg(
        F.countDistinct("table_id").alias("tables_found"), F.countDistinct("item_id").alias("total_impacted_items"),
        F.countDistinct("workspace_id").alias("total_impacted_workspaces"), F.max("depth").alias("max_depth_found"),
    )


# ---- depth over all items ----------------------------------------------------------
def _kept(df: DataFrame, path: str, k: int) -> DataFrame:
    """The frame of round k, written beside those of the other rounds."""
    df.write.parquet(f"{path}/round={k}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/round={k}")


def _all_rounds(state: DataFrame, path: str) -> DataFrame:
    """The rows of all rounds, as one scan, with ``round``."""
    return state.sparkSession.read.schema(StructType([*state.schema.fields, StructField("round", IntegerType())])).parquet(path)


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def walk_depths(edges: DataFrame, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, d), the longest walk from each node that reaches no cycle, and (node) of those that do.

    A node ends one round after the last of its next nodes. A round meets the nodes that ended in the one before with the edges
    that lead to them, so an edge is met once; edges that were met are left out whenever they are most of those
    stored, if these are many. Nodes that never end reach a cycle. ``depth`` cuts walks off, and then every node has one. Nodes without a next
    one are absent. ``w`` in ``edges``, if there, is an edge's length, else 1; other columns keep graphs apart that are walked at once.
    """
    edges = cut_lineage(edges if "w" in edges.columns else edges.withColumn("w", F.lit(1)), "depth-edges")
    apart = [c for c in edges.columns if c not in ("node", "next", "w")]
    key, path = ["node", *apart], scratch_path(edges.sparkSession, "depths")
    goes_on = edges.select(F.col("node").alias("next"), *apart, F.lit(True).alias("open")).distinct()
    flagged = edges.join(goes_on, ["next", *apart], "left")
    last = F.max(F.when(F.col("open").isNull(), F.col("w")))
    state = _kept(flagged.groupBy(*key).agg(F.lit(0).cast("bigint").alias("hit"), F.count("open").alias("n"), last.alias("d")), path, 1)
    nodes, ended, left = state.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    of = state.where("n > 0").select(*(F.col(c).alias(f"of_{c}") for c in key), "n", F.col("d").alias("least"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key])
    waiting = cut_lineage(flagged.where("open").join(of, same).select(*key, "next", "w", "n", "least"), "depth-open") if left and ended else None
    k, since, stored, met_since, carried, finished = 1, 1, left, 0, 0, ended
    while left and ended and (depth is None or k < depth):
        done = state.where("hit = n").select(F.col("node").alias("next"), *apart, F.col("d").alias("ahead"))
        met = waiting.join(_few(done, ended), ["next", *apart]).select(*key, F.lit(1).cast("bigint").alias("hit"), "n", F.greatest("least", F.col("ahead") + F.col("w")).alias("d"))
        both = met.unionByName(state.where("hit > 0 and hit < n").select(*key, "hit", "n", "d"))
        k += 1
        state = _kept(both.groupBy(*key).agg(F.sum("hit").alias("hit"), F.max("n").alias("n"), F.max("d").alias("d")), path, k)
        part = F.col("hit") < F.col("n")
        ended, hits, now = state.agg(F.count_if(~part), F.coalesce(F.sum("hit"), F.lit(0)), F.coalesce(F.sum(F.when(part, F.col("hit"))), F.lit(0))).first()
        left, met_since, carried, finished = left - (hits - carried), met_since + hits - carried, now, finished + ended
        if left and stored > FEW and 2 * met_since > stored:
            gone = _all_rounds(state, path).where((F.col("round") >= since) & (F.col("round") < k) & (F.col("hit") == F.col("n"))).select(F.col("node").alias("next"), *apart)
            waiting = cut_lineage(waiting.join(gone, ["next", *apart], "left_anti").select(*waiting.columns), "depth-open")
            since, stored, met_since = k, left, 0
    written = _all_rounds(state, path)
    plain = written.where("hit = n").select(*key, "d")
    if finished == nodes:
        return plain, plain.limit(0).drop("d")
    of = plain.select(*(F.col(c).alias(f"of_{c}") for c in key))
    others = cut_lineage(written.where("round = 1 and n > 0").select(*key).join(of, same, "left_anti"), "depths-open")
    if depth is None:
        return plain, others
    return plain.unionByName(others.withColumn("d", F.lit(depth))), others.limit(0)


def _components_among(edges: DataFrame, *looped: DataFrame) -> DataFrame:
    """Strong components among the nodes that are in each of ``looped``."""
    for nodes in looped:
        edges = edges.join(nodes.select("node"), "node", "left_semi").join(nodes.select(F.col("node").alias("next")), "next", "left_semi")
    return strong_components(edges.select("node", "next"))


def _to_members(depths: DataFrame, members: DataFrame) -> DataFrame:
    """Rows named by a component, once for each of its members; others as they are."""
    of = members.select(F.col("component"), F.col("node").alias("_member"))
    return depths.join(of, depths["node"] == of["component"], "left").withColumn("node", F.coalesce("_member", "node")).drop("component", "_member")


def longest_walks(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, d): the longest chain from each node, counting edges between strong components."""
    edges = cut_lineage(edges, "chain-edges")
    plain, cyclic = walk_depths(edges, depth)
    if cyclic.isEmpty():
        return plain
    members = _components_among(edges, cyclic)
    return _to_members(walk_depths(condensed(edges, members).drop("n"))[0], members)


def _trails_within(edges: DataFrame, cyclic: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """(node, at, t, n): the n trails of t edges from a node of a component to ``at``, inside it; and the edges between components.

    A trail that leaves a component never returns, so these are all parts of a trail in which an edge might be used
    again. ``cyclic`` are the nodes that never end, up and down. A node with an edge to itself is a component.
    """
    members = _components_among(edges, *(cyclic.where(F.col("way") == w) for w in ("up", "down")))
    own = edges.where("node = next").select("node", F.col("node").alias("component")).distinct().join(members, "node", "left_anti")
    members = cut_lineage(members.unionByName(own), "trail-members")
    other = members.select(F.col("node").alias("next"), F.col("component").alias("to"))
    placed = edges.join(members, "node", "left").join(other, "next", "left")
    inside = F.coalesce(F.col("component") == F.col("to"), F.lit(False))
    placed = cut_lineage(placed.select("node", "next", inside.alias("inside")), "trail-edges")
    found = paths(placed.where("inside").select("node", "next"), members.select(F.col("node").alias("seed"), "node"), depth)
    trails = found.groupBy(F.col("seed").alias("node"), F.col("id").alias("at"), F.col("depth").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(trails, "trails"), placed.where("not inside").select("node", "next")


def _hops(trails: DataFrame, between: DataFrame) -> DataFrame:
    """(node, next, w, n): the n trails of w edges from a node to the first one outside its component."""
    across = between.groupBy(F.col("node").alias("at"), "next").agg(F.count(F.lit(1)).alias("m"))
    leaving = trails.join(across, "at").select("node", "next", (F.col("t") + 1).alias("w"), (F.col("n") * F.col("m")).alias("n"))
    return across.select(F.col("at").alias("node"), "next", F.lit(1).alias("w"), F.col("m").alias("n")).unionByName(leaving)


def trail_depths(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, d, way): the longest trail from each node ``up`` the edges and ``down`` them.

    Every trail inside a component is followed. What a trail does between components has no cycle, and is walked.
    """
    edges = cut_lineage(edges, "chain-edges")
    plain, cyclic = walk_depths(_both_ways(edges))
    found = plain
    if not cyclic.isEmpty():
        trails, between = _trails_within(edges, cyclic, depth)

        def ways(trails: DataFrame, between: DataFrame) -> DataFrame:
            most = trails.groupBy("node", "at").agg(F.max("t").alias("t"), F.lit(1).alias("n"))
            ends = most.groupBy("node").agg(F.lit(None).cast("string").alias("next"), F.max("t").alias("w"))
            return _hops(most, between).drop("n").unionByName(ends)

        back = trails.select(F.col("at").alias("node"), F.col("node").alias("at"), "t")
        up, down = ways(trails, between), ways(back, turned(between))
        both = up.withColumn("way", F.lit("up")).unionByName(down.withColumn("way", F.lit("down"))).join(cyclic, ["node", "way"], "left_semi")
        # Only nodes that reach a cycle are walked again; the others end a walk with the depth they have.
        known = plain.select(F.col("node").alias("next"), "way", F.col("d").alias("ahead"))
        rest = both.join(known, ["next", "way"], "left").select(
            "node", "way", F.when(F.col("ahead").isNull(), F.col("next")).alias("next"), (F.col("w") + F.coalesce("ahead", F.lit(0))).alias("w")
        )
        found = plain.unionByName(walk_depths(rest)[0])
    return found if depth is None else found.withColumn("d", F.least("d", F.lit(depth)))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.withColumn("way", F.lit("up")).unionByName(turned(edges).withColumn("way", F.lit("down")))


def both_depths(g: Graph) -> tuple[DataFrame, DataFrame]:
    """:func:`walk_depths` of both directions, for measures that share them as ``known``."""
    return walk_depths(_both_ways(steps(g, "up")))


def node_depths(g: Graph, depth: int | None = None, mode: str = "walk", known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Longest upstream and downstream chain per item, cycles or not. ``mode='trail'`` follows every trail on cycles.

    Both directions are walked in the same rounds. ``known`` are the walks of :func:`both_depths`, if they are there and have no bound.
    """
    edges = steps(g, "up")
    if mode == "trail":
        d = trail_depths(edges, depth)
    else:
        d, cyclic = walk_depths(_both_ways(edges), depth) if known is None else known
        if not cyclic.isEmpty():
            edges = cut_lineage(edges, "edges")
            members = _components_among(edges, *(cyclic.where(F.col("way") == w) for w in ("up", "down")))
            d = _to_members(walk_depths(_both_ways(condensed(edges, members).drop("n")))[0], members)
    at = lambda way: F.coalesce(F.max(F.when(F.col("way") == way, F.col("d"))), F.lit(0))
    found = d.groupBy(F.col("node").alias("item_id")).agg(at("up").alias("upstream_depth"), at("down").alias("downstream_depth"))
    out = items(g).join(found, "item_id", "left").na.fill(0, ["upstream_depth", "downstream_depth"])
    return out.withColumn("total_chain_depth", F.col("upstream_depth") + F.col("downstream_depth"))


def item_components(g: Graph) -> DataFrame:
    """Items that depend on each other in circles: item_id, component (its least item) and component_size."""
    members = strong_components(steps(g, "up"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return members.join(size, "component").join(items(g).withColumnRenamed("item_id", "node"), "node").withColumnRenamed("node", "item_id")


def dependency_depth(g: Graph, k: int = 20, depth: int | None = None, mode: str = "walk") -> DataFrame:
    """Items by longest chain to a root."""
    found = trail_depths(steps(g, "up"), depth).where("way = 'up'") if mode == "trail" else longest_walks(steps(g, "up"), depth)
    d = found.select(F.col("node").alias("item_id"), F.col("d").alias("dependency_depth"))
    best = top_k(d, [F.desc("dependency_depth"), "item_id"], k)
    return with_workspace(best.join(items(g), "item_id"), g).drop("workspace_id")


def _chain_rounds(edges: DataFrame, weights: DataFrame | None = None, inner: DataFrame | None = None) -> DataFrame | None:
    """(depth, count) of the chains of two or more edges (node, next, n) that end at a root; None if there is a cycle.

    Chains are counted, not listed, from all starts at once: a round has one row per node with a chain of so many edges to it.
    These nodes become fewer each round, and edges from others are left out whenever half of them are gone; where none goes there is a
    cycle. ``weights`` (node, size) count a start repeatedly. ``w`` in ``edges``, if there, is an edge's length; such edges have no cycle,
    and ``inner`` (node) are the nodes that are no roots.
    """
    single = "w" not in edges.columns
    edges = edges.withColumn("w", F.lit(1)) if single else edges
    goes_on = (edges if inner is None else inner).select(F.col("node").alias("next"), F.lit(False).alias("root")).distinct()
    flagged = edges.join(goes_on, "next", "left").select("node", "next", "n", "w", F.coalesce("root", F.lit(True)).alias("root"))
    edges, path = cut_lineage(flagged, "chain-edges"), scratch_path(edges.sparkSession, "chain-counts")
    first = edges if weights is None else edges.join(weights, "node", "left").withColumn("n", F.col("n") * F.coalesce("size", F.lit(1)))
    state, k = _kept(first.groupBy("next", "root", F.col("w").alias("depth")).agg(F.sum("n").alias("count")), path, 1), 1
    before, held = None, None if edges.count() > FEW else 0
    while now := state.where("not root").count():
        if single and now == before:
            return None
        at = state.where("not root").select(F.col("next").alias("node"), "depth", "count")
        if held is None or (held > FEW and 2 * now < held):
            edges = cut_lineage(edges.join(_few(at.select("node"), now), "node", "left_semi").select(*edges.columns), "chain-edges")
            held = now
        step = edges.join(_few(at, now), "node").select("next", "root", (F.col("depth") + F.col("w")).alias("depth"), (F.col("n") * F.col("count")).alias("count"))
        before, k = now, k + 1
        state = _kept(step.groupBy("next", "root", "depth").agg(F.sum("count").alias("count")), path, k)
    total = _all_rounds(state, path).where("root and depth >= 2").groupBy("depth").agg(F.sum("count").alias("count"))
    return total.select(F.col("depth").cast("int").alias("depth"), F.col("count").cast("bigint").alias("count"))


def chain_lengths(g: Graph, depth: int | None = None, mode: str = "walk") -> DataFrame:
    """(depth, count) of chains of two or more edges that end at a root, however long.

    With cycles a chain is a start and the edges between components that it takes; every item of a component is a
    start. ``mode='trail'`` lists the trails of starts that reach a cycle.
    """
    edges = cut_lineage(steps(g, "up"), "chain-edges")
    if mode == "trail":
        _, cyclic = walk_depths(_both_ways(edges))
        if cyclic.isEmpty():
            found = _chain_rounds(edges.withColumn("n", F.lit(1)))
        else:
            trails, between = _trails_within(edges, cyclic, depth)
            # No trail starts at null.
            looped = cyclic.where("way = 'up'").select(F.col("node").alias("next"))
            unnamed = between.where("node is null").join(looped, "next", "left_anti").select("node", "next")
            found = _chain_rounds(_hops(trails, between.where("node is not null").unionByName(unnamed)), inner=edges)
    else:
        found = _chain_rounds(edges.withColumn("n", F.lit(1)))
        if found is None:
            members = strong_components(edges)
            sizes = members.groupBy(F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("size"))
            found = _chain_rounds(cut_lineage(condensed(edges, members), "condensed"), cut_lineage(sizes, "component-sizes"))
    return found if depth is None else found.where(F.col("depth") <= depth)


def chain_stats(g: Graph, depth: int | None = None, mode: str = "walk", lengths: DataFrame | None = None) -> DataFrame:
    """Greatest and mean length and number of chains; ``lengths`` are those of :func:`chain_lengths`, if they are known."""
    lengths = chain_lengths(g, depth, mode) if lengths is None else lengths
    return lengths.agg(
        F.max("depth").alias("max_depth"), (F.sum(F.col("depth") * F.col("count")) / F.sum("count")).alias("avg_depth"), F.sum("count").alias("chain_count")
    )


def deep_chains(
    g: Graph, min_depth: int = 3, k: int = 50, depth: int | None = None, mode: str = "walk", known: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """The k deepest upstream chains of items that nothing depends on, ids breaking ties.

    Chains are not enumerated. Knowing how far each node still reaches, a prefix is kept
    only if it can be completed to its target length, so the first k prefixes per length
    hold the first k chains: at most k rows per length at any step. A strong component is one place of a
    chain; with ``mode='trail'`` starts that reach a cycle have their trails listed. ``known`` is as in :func:`node_depths`.
    """
    edges = cut_lineage(steps(g, "up"), "chain-edges")
    far, cyclic = walk_depths(edges, depth) if known is None else (frame.where("way = 'up'").drop("way") for frame in known)
    looped = not cyclic.isEmpty()
    if looped and mode != "trail":
        members = _components_among(edges, cyclic)
        edges, looped = cut_lineage(condensed(edges, members).drop("n"), "condensed"), False
        far = walk_depths(edges)[0]
    longest = far.agg(F.max("d")).first()[0] or 0
    ahead = edges.join(far.select(F.col("node").alias("next"), F.col("d").alias("far")), "next", "left").na.fill(0, ["far"])
    ahead = cut_lineage(ahead, "ahead").select(F.col("node").alias("at"), "next", "far")
    top = edges.select(F.col("next").alias("node")).distinct()
    start = far.join(top, "node", "left_anti")
    lengths = F.explode(F.sequence(F.lit(min_depth), F.lit(max(longest, min_depth))))
    # The first k starts of each depth hold those of every goal.
    start = cut_lineage(top_k_per_group(start.where(F.col("d") >= min_depth).select("node", "d"), ["d"], ["node"], k), "chain-starts")
    frontier = start.select("node", "d", lengths.alias("goal")).filter("d >= goal").select("goal", "node", F.array("node").alias("path"))
    frontier = top_k_per_group(frontier, ["goal"], ["path"], k)
    for i in range(1, longest + 1):
        open_ends = frontier.where(F.col("goal") >= i)
        open_ends = F.broadcast(open_ends) if k * longest**2 <= FEW else open_ends
        grown = open_ends.join(ahead, (F.col("node") == F.col("at")) & (F.col("far") >= F.col("goal") - i))
        grown = grown.select("goal", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        frontier = frontier.where(F.col("goal") < i).unionByName(grown)
        frontier = cut_lineage(top_k_per_group(frontier, ["goal"], ["path"], k), "chains")
    if looped:
        seeds = cyclic.join(top, "node", "left_anti").select(F.col("node").alias("seed"), "node")
        trails = paths(edges, seeds, depth).filter(F.col("depth") >= min_depth).select(F.col("depth").alias("goal"), F.col("id").alias("node"), "path")
        frontier = frontier.unionByName(trails)
    best = top_k(frontier, [F.desc("goal"), "path"], k)
    out = best.select(F.element_at("path", 1).alias("terminal_id"), F.col("node").alias("origin_id"), F.col("goal").alias("depth"), "path")
    home = item_workspace(g)
    for end in ("terminal", "origin"):
        it = items(g).toDF(f"{end}_id", f"{end}_name", f"{end}_type")
        ws = home.select(F.col("item_id").alias(f"{end}_id"), F.col("workspace").alias(f"{end}_workspace"))
        out = out.join(it, f"{end}_id", "left").join(ws, f"{end}_id", "left")
    return out


# ---- cycles ------------------------------------------------------------------------
def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after dropping, until none goes, nodes with no way in or no way out."""
    core = cut_lineage(edges, "core")
    before = core.count()
    while before:
        kept = core.join(core.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
        core = cut_lineage(kept.join(kept.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("node", "next"), "core")
        before, last = core.count(), before
        if before == last:
            break
    return core


def cycles(edges: DataFrame, depth: int = 5, k: int = 20) -> DataFrame:
    """Closed trails of 2..depth edges from each of their nodes, shortest first.

    Each is searched once, from its least node through greater ones, then turned to every
    start. ``edges`` has node and next.
    """
    core = cyclic_core(edges)
    frontier = core.select(F.col("node").alias("seed"), F.col("node")).distinct().select(
        "seed", "node", F.array("node").alias("path"), F.array().cast("array<string>").alias("used")
    )
    found: list[DataFrame] = []
    for level in range(1, depth + 1):
        key: Column = F.concat_ws("\u0001", "node", "next")
        nxt = (
            frontier.join(core, "node")
            .filter((F.col("next") >= F.col("seed")) & ~F.array_contains("used", key))
            .select("seed", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.array_append("used", key).alias("used"))
        )
        frontier = cut_lineage(nxt, "cycle")
        if frontier.isEmpty():
            break
        if level >= 2:
            found.append(frontier.filter("node = seed").select("path", F.lit(level).alias("cycle_length")))
    if not found:
        return core.select(F.array("node").alias("cycle_nodes"), F.lit(0).alias("cycle_length")).filter(F.lit(False))
    n = F.col("cycle_length")
    turned = _union(found).select("path", "cycle_length", F.explode(F.sequence(F.lit(0), n - 1)).alias("r")).select(
        F.concat(F.slice("path", F.col("r") + 1, n - F.col("r")), F.slice("path", F.lit(1), F.col("r") + 1)).alias("cycle_nodes"), "cycle_length"
    )
    return top_k(turned.distinct(), ["cycle_length", "cycle_nodes"], k)


def common_dependencies(g: Graph, seeds: list[str], depth: int = 5) -> DataFrame:
    """Upstream items of all seeds (``is_common``), and those of each alone."""
    found = reach(steps(g, "up"), _seed(seeds, g), depth)
    return common_and_unique(found.select(F.col("id").alias("dependency"), F.col("seed").alias("item")), len(set(seeds)))


def common_and_unique(deps: DataFrame, n: int) -> DataFrame:
    """Each (item, dependency) with whether all ``n`` items share the dependency."""
    shared = deps.groupBy("dependency").agg(F.countDistinct("item").alias("items"))
    return deps.distinct().join(shared, "dependency").withColumn("is_common", F.col("items") == n)
