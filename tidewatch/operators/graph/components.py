"""Strong components of a directed graph, and the acyclic graph that is left when each becomes one node.

Rounds of joins, none holding a component in one task:

* Trimming. Nodes with no way in or no way out, round by round, are alone.
* Colours. Every node takes the greatest number among its own and those of all nodes that lead to it; the nodes of a
  colour that lead back to its source are the source's component. Nodes are numbered by hash, so that few repetitions are needed
  whatever the order of the names; rounds then move and compare numbers only, and a node passes its colour on in the round after
  it has changed.
* Chains. These rounds grow with the length of the ways inside a component. Where they don't end soon, long thin parts
  are cut short first: a node with a single next node reaches what that one reaches, so pointers along such nodes are
  doubled until they leave the chain, and edges into a chain lead to its end; a closed ring of such nodes is a
  component. On the turned graph, nodes with a single previous one are treated alike. What is left takes rounds in
  proportion to the distance between branching nodes, whatever the size of the component.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: Rounds that share one plan before their state is written, and steps after which chains are cut short.
ROUNDS_A_STEP, SOON = 4, 8

Solver = Callable[[DataFrame], DataFrame]


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("next").alias("node"), F.col("node").alias("next"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (node, next) that are in a component of two or more.

    Two nodes share a component when each leads to the other. The least name of its members names it. Nodes that
    are absent are alone.
    """
    named = cut_lineage(edges.where("node <> next").select("node", "next").distinct(), "components")
    core, names = _numbered(named)
    found = _coloured(core, SOON)
    if found is None:
        found = _without_chains(core, lambda e: _without_chains(turned(e), _coloured))
    found = cut_lineage(found.join(names, "node").select(F.col("name").alias("node"), "rep"), "component-names")
    least = found.groupBy("rep").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(found.join(least.drop("n"), "rep").select("node", "component"), "components")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges between numbers, and (node, name) of each number; numbers follow the hash of the name."""
    nodes = edges.select("node").unionByName(edges.select(F.col("next").alias("node"))).distinct()
    placed = nodes.orderBy(F.xxhash64("node"), "node").select(F.monotonically_increasing_id().alias("id"), F.col("node").alias("name"))
    names = cut_lineage(placed, "component-numbers")
    a, b = names.select(F.col("name").alias("node"), F.col("id").alias("a")), names.select(F.col("name").alias("next"), F.col("id").alias("b"))
    core = edges.join(a, "node").join(b, "next").select(F.col("a").alias("node"), F.col("b").alias("next"))
    return cut_lineage(core, "component-edges"), names.withColumnRenamed("id", "node")


def condensed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(node, next, n): the edges between components, which are named by ``members``; n edges run from one to the other."""
    a = members.select("node", F.col("component").alias("a"))
    b = members.select(F.col("node").alias("next"), F.col("component").alias("b"))
    named = edges.join(a, "node", "left").join(b, "next", "left")
    named = named.select(F.coalesce("a", "node").alias("node"), F.coalesce("b", "next").alias("next"))
    return named.where("node <> next").groupBy("node", "next").agg(F.count(F.lit(1)).alias("n"))


def _still_inside(at: DataFrame) -> int:
    """Pointers that have not left their chain."""
    return at.join(at.select(F.col("node").alias("to")), "to", "left_semi").count()


def _without_chains(edges: DataFrame, solve: Solver) -> DataFrame:
    """(node, rep) of the components, found on a graph whose chains of nodes with one next node are cut short."""
    ones = edges.groupBy("node").agg(F.min("next").alias("to"), F.count(F.lit(1)).alias("n")).where("n = 1")
    at = cut_lineage(ones.select("node", "to", F.col("node").alias("least")), "chain")
    levels, reach, inside = [at], 1, _still_inside(at)
    if not inside:
        return solve(edges)
    before = 0
    # Once as many stay inside as a doubling before, all of them lead to rings; these are walked around when a pointer
    # reaches as far as there are nodes.
    while inside and (inside != before or reach < inside):
        on = at.select(F.col("node").alias("to"), F.col("to").alias("on"), F.col("least").alias("beyond"))
        step = at.join(on, "to", "left").select("node", F.coalesce("on", "to").alias("to"), F.least("least", F.coalesce("beyond", "least")).alias("least"))
        at, reach = cut_lineage(step, "chain"), 2 * reach
        levels.append(at)
        before, inside = inside, _still_inside(at)
    on_chain = at.select("node")
    leads_to_ring = at.join(on_chain.select(F.col("node").alias("to")), "to", "left_semi")
    ring = leads_to_ring.join(leads_to_ring.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("rep"))
    exits = at.join(leads_to_ring.select("node"), "node", "left_anti").select("node", F.col("to").alias("end"))
    outer = cut_lineage(edges.join(on_chain, "node", "left_anti"), "chain-outer")
    short = outer.join(leads_to_ring.select(F.col("node").alias("next")), "next", "left_anti")
    short = short.join(exits.select(F.col("node").alias("next"), "end"), "next", "left").select("node", F.coalesce("end", "next").alias("next"))
    rest = cut_lineage(solve(cut_lineage(short.where("node <> next").distinct(), "chain-short")), "chain-rest")

    # A node of a chain is in the component of the chain's end when a node of that component leads into the chain before it.
    def rep(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.join(rest.select(F.col("node").alias(c), F.col("rep").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))

    entry = outer.join(exits.select(F.col("node").alias("next"), "end"), "next")
    entry = rep(rep(entry, "node", "r1"), "end", "r2").where("r1 = r2").select(F.col("next").alias("node"), F.col("r2").alias("rep")).distinct()
    marked = cut_lineage(entry, "chain-marks")
    for level in levels:
        moved = marked.join(level.select("node", "to"), "node").select(F.col("to").alias("node"), "rep")
        marked = cut_lineage(marked.unionByName(moved.join(on_chain, "node", "left_semi")).distinct(), "chain-marks")
    source = marked.select(F.col("rep").alias("node"), "rep")
    return rest.unionByName(ring).unionByName(marked).unionByName(source).distinct()


def _trimmed(core: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """Edges left after dropping, until none goes or the rounds are used up, nodes with no way in or no way out; their number.

    A round names its edges four times, so each is written rather than joined with the next.
    """
    n = core.count()
    while n and rounds != 0:
        core = core.join(core.select(F.col("node").alias("next")).distinct(), "next", "left_semi")
        core = cut_lineage(core.join(core.select(F.col("next").alias("node")).distinct(), "node", "left_semi").select("node", "next"), "core")
        before, n = n, core.count()
        if n == before:
            break
        rounds = None if rounds is None else rounds - 1
    return core, n


def _until_still(state: DataFrame, grow: Callable[[DataFrame, int], DataFrame], label: str, steps: int | None) -> DataFrame | None:
    """Rounds of ``grow`` until one changes nothing; it marks what changes with the number of its round in ``at``.

    None if the steps, each of several rounds, are used up first.
    """
    k = 0
    while steps is None or k < steps * ROUNDS_A_STEP:
        for _ in range(ROUNDS_A_STEP):
            k += 1
            state = grow(state, k)
        state = cut_lineage(state, label)
        if state.where(F.col("at") == k).isEmpty():
            return state.drop("at")
    return None


def _coloured(edges: DataFrame, steps: int | None = None) -> DataFrame | None:
    """(node, rep) of the components of two or more nodes, by colours, as many at once as there are colours.

    None if anything but the number of repetitions takes more than the steps.
    """
    found = edges.select("node", F.col("node").alias("rep")).limit(0)
    core, n = _trimmed(edges, steps)
    while n:
        own = core.select("node").distinct().select("node", F.col("node").alias("colour"), F.lit(0).alias("at"))

        def spread(state: DataFrame, k: int, core: DataFrame = core) -> DataFrame:
            passed = core.join(state.where(F.col("at") == k - 1), "node").select(F.col("next").alias("node"), "colour", F.lit(None).cast("int").alias("at"))
            mine = F.max(F.when(F.col("at").isNotNull(), F.col("colour")))
            both = state.unionByName(passed).groupBy("node").agg(F.max("colour").alias("colour"), mine.alias("mine"), F.max("at").alias("at"))
            return both.select("node", "colour", F.when(F.col("colour") > F.col("mine"), k).otherwise(F.col("at")).alias("at"))

        coloured = _until_still(own, spread, "colours", steps)
        if coloured is None:
            return None
        coloured = coloured.select("node", F.col("colour").alias("of"))
        other = coloured.select(F.col("node").alias("next"), F.col("of").alias("to"))
        same = cut_lineage(core.join(coloured, "node").join(other, "next").where("of = to").select("node", "next", "of"), "colour-edges")

        def back(state: DataFrame, k: int, same: DataFrame = same) -> DataFrame:
            new = state.where(F.col("at") == k - 1).select(F.col("node").alias("next"))
            led = same.join(new, "next").select("node", F.col("of").alias("rep"), F.lit(k).alias("at"))
            return state.unionByName(led).groupBy("node", "rep").agg(F.min("at").alias("at"))

        roots = coloured.where("node = of").select("node", F.col("of").alias("rep"), F.lit(0).alias("at"))
        members = _until_still(roots, back, "colour-members", steps)
        if members is None:
            return None
        found = found.unionByName(members)
        gone = members.select("node")
        left = core.join(gone, "node", "left_anti").join(gone.select(F.col("node").alias("next")), "next", "left_anti").select("node", "next")
        core, n = _trimmed(cut_lineage(left, "core"), steps)
    return found
