import itertools
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewatch.operators.graph import bitmaps as BM
from tidewatch.operators.graph import build as GB
from tidewatch.operators.graph import components as CO
from tidewatch.operators.graph import governance as V
from tidewatch.operators.graph import search as SE
from tidewatch.operators.graph import stats as GS
from tidewatch.operators.graph import traverse as T
from tidewatch.operators.graph.model import Graph

NODE = "id string, label string, name string, type string, location string, database string, schema string, full_path string, table_type string"


def graph(df, deps, extra=(), labels=None):
    ids = sorted({x for e in [*deps, *[(a, b) for a, b, _ in extra]] for x in e})
    labels = labels or {}
    nodes = df([(i, labels.get(i, "Item"), f"n{i}", "T", None, None, None, None, None) for i in ids], NODE)
    edges = df([(a, b, "DEPENDS_ON") for a, b in deps] + list(extra), "src string, dst string, rel string")
    return Graph(nodes, edges)


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]


def test_upstream_and_downstream_paths(df):
    g = graph(df, DIAMOND)
    up = rows(T.upstream(g, ["a"], 5).withColumn("p", F.array_join("path", ">")), "depth", "p")
    assert up == [(1, "a>b"), (1, "a>c"), (2, "a>b>d"), (2, "a>c>d"), (3, "a>b>d>e"), (3, "a>c>d>e")]
    assert rows(T.downstream(g, ["d"], 1, "shortest"), "id") == [("b",), ("c",)]
    assert rows(T.downstream(g, ["a"], 5, "shortest"), "id") == []
    names = T.path_names(T.upstream(g, ["d"], 5), g).first()["path_names"]
    assert names == ["nd", "ne"]


def test_depths_chains_on_diamond(df):
    g = graph(df, DIAMOND)
    assert rows(T.node_depths(g), "item_id", "upstream_depth", "downstream_depth") == [("a", 3, 0), ("b", 2, 1), ("c", 2, 1), ("d", 1, 2), ("e", 0, 3)]
    assert rows(T.chain_lengths(g)) == [(2, 2), (3, 2)]
    got = rows(T.deep_chains(g, 2).withColumn("p", F.array_join("path", ">")), "depth", "p")
    assert got == [(2, "a>b>d"), (2, "a>c>d"), (3, "a>b>d>e"), (3, "a>c>d>e")]
    assert rows(T.deep_chains(g, 3, k=1), "origin_id", "depth") == [("e", 3)]


def brute_paths(edges, start, limit):
    out, todo = [], [(start, (start,))]
    while todo:
        n, p = todo.pop()
        for a, b in edges:
            if a == n and len(p) <= limit:
                out.append(p + (b,))
                todo.append((b, p + (b,)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_depth_measures_against_brute_force(df, seed):
    """A hub that a third of all nodes depend on."""
    rnd = random.Random(seed)
    n = 24
    edges = {(i, 0) for i in range(1, n, 3)} | {(i, rnd.randrange(i)) for i in range(1, n) for _ in range(2)}
    deps = [(f"x{a:02d}", f"x{b:02d}") for a, b in sorted(edges)]
    g = graph(df, deps)
    every = {i: brute_paths(deps, f"x{i:02d}", 10) for i in range(n)}
    got = {r["item_id"]: r["upstream_depth"] for r in T.node_depths(g).collect()}
    for i in range(n):
        assert got[f"x{i:02d}"] == max([len(p) - 1 for p in every[i]], default=0)
    has_out = {a for a, _ in deps}
    ends = [len(p) - 1 for p in itertools.chain(*every.values()) if p[-1] not in has_out and len(p) > 2]
    assert dict(rows(T.chain_lengths(g))) == {k: ends.count(k) for k in set(ends)}
    depended = {b for _, b in deps}
    chains = sorted([(-(len(p) - 1), p) for i in range(n) if f"x{i:02d}" not in depended for p in every[i] if len(p) > 3])[:7]
    best = [(-r["depth"], tuple(r["path"])) for r in T.deep_chains(g, 3, k=7).collect()]
    assert sorted(best) == chains


def test_cycles_and_trails(df):
    edges = df([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("x", "a")], "node string, next string")
    got = rows(T.cycles(edges, 5).withColumn("p", F.array_join("cycle_nodes", ">")), "cycle_length", "p")
    found = {p for _, p in got}
    assert {"a>b>a", "b>a>b", "a>b>c>a", "b>c>a>b", "c>a>b>c"} <= found
    want = set()
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")]
    for k in range(2, 6):
        for combo in itertools.permutations(pairs, min(k, 4)):
            if len(combo) == k and all(combo[i][1] == combo[i + 1][0] for i in range(k - 1)) and combo[0][0] == combo[-1][1]:
                want.add(">".join([c[0] for c in combo] + [combo[-1][1]]))
    assert found == want
    g = graph(df, [("a", "b"), ("b", "a"), ("c", "a")])
    assert dict(rows(T.node_depths(g, mode="trail"), "item_id", "upstream_depth")) == {"a": 2, "b": 2, "c": 3}
    assert T.cycles(df([("a", "b")], "node string, next string")).count() == 0


def test_shortest_path(df):
    g = graph(df, DIAMOND + [("z", "z2")])
    r = T.shortest_path(g, "e", "a").first()
    assert (r["path_length"], r["path"]) == (3, ["e", "d", "b", "a"])
    assert T.shortest_path(g, "a", "z").count() == 0
    assert rows(T.shortest_between_names(g, "na", "nd"), "seed", "id", "path_length") == [("a", "d", 2)]


def test_source_reach_against_brute_force(df):
    extra = [("b", "S", "CONSUMES"), ("e", "S", "CONSUMES"), ("d", "S2", "CONSUMES")]
    g = graph(df, DIAMOND, extra, {"S": "Source", "S2": "Source"})
    # Below e: d, b, c, a; b is itself a direct consumer.
    assert rows(T.source_failure_reach(g), "source_id", "direct_consumer_count", "indirect_dependent_count") == [("S", 2, 4), ("S2", 1, 3)]


def test_removal_and_common(df):
    g = graph(df, DIAMOND)
    r = T.removal_impact(g, "nd").first()
    assert (r["affected_count"], r["sample_affected"]) == (3, ["na", "nb", "nc"])
    assert rows(T.common_dependencies(g, ["b", "c"]), "item", "dependency", "is_common") == [("b", "d", True), ("b", "e", True), ("c", "d", True), ("c", "e", True)]


def test_duplicates_against_brute_force(df):
    """One name holds most items; the first k pairs are still exact."""
    names = ["Hot" if i % 3 else f"N{i % 5}" for i in range(40)]
    ids = [f"i{i:02d}" for i in range(40)]
    nodes = df([(i, "Item", n, "T", None, None, None, None, None) for i, n in zip(ids, names)], NODE)
    g = Graph(nodes, df([], "src string, dst string, rel string"))
    pairs = sorted((a, b) for a, b in itertools.combinations(ids, 2) if names[ids.index(a)] == names[ids.index(b)])
    assert rows(V.duplicate_items(g, 17), "id1", "id2") == pairs[:17]
    assert sum(r["pairs"] for r in V.duplicate_groups(nodes.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))).collect()) == len(pairs)


def test_orphans_and_counts(df):
    extra = [("W", "a", "CONTAINS"), ("o", "T1", "MIRRORS")]
    g = graph(df, DIAMOND, extra, {"W": "Workspace", "T1": "Table"})
    assert rows(V.orphans(g), "item_id") == [("o",)]
    assert rows(V.orphans(g, True), "item_id") == []
    assert rows(V.unassigned(g), "item_id") == [("b",), ("c",), ("d",), ("e",), ("o",)]
    assert dict(rows(GS.overview(*g).filter("kind = 'edge'"), "name", "count")) == {"DEPENDS_ON": 5, "CONTAINS": 1, "MIRRORS": 1, "total": 7}
    assert rows(GS.bottlenecks(g), "item_id", "impact_score") == [("b", 1), ("c", 1), ("d", 2)]


REC = "`Workspace ID` string, `Workspace Name` string, `Item ID` string, `Item Name` string, `Item Type` string, `Shortcut Name` string, `Shortcut Path` string, `Source Type` string, `Source Connection` string, `Source Database` string, `Connection ID` string, `Full Definition` string, `Mirrored Tables` array<struct<schemaName: string, tableName: string, status: string, processedRows: bigint, lastSyncDateTime: string>>, seq bigint"


def record(seq, item, kind, conn=None, source=None, db=None, cid=None, definition=None, mirrored=None):
    return ("w", "WS", item, item.upper(), kind, "sc", "p", source, conn, db, cid, definition, mirrored, seq)


def test_graph_from_records(df):
    lake = lambda i, p: '{"type":"OneLake","oneLake":{"workspaceId":"w","itemId":"%s","path":"%s"}}' % (i, p)
    definition = '{"properties":{"source":{"type":"Snowflake","typeProperties":{"connection":"c","database":"DB"}},"mountedTables":[{"source":{"typeProperties":{"tableName":"My T"}}}]}}'
    recs = df(
        [
            record(1, "a", "Lakehouse Shortcut", lake("b", "Tables/EDW/DIM")), record(2, "a", "Lakehouse Shortcut", lake("b", "Tables/EDW/DIM")),
            record(3, "b", "Lakehouse", lake("elsewhere", "Files/x")), record(4, "b", "Lakehouse", "{'type': 'AmazonS3', 'amazonS3': {'location': 's3://b', 'subpath': None}}"),
            record(5, "m", "MirroredDatabase", "Unknown", "Unknown", definition=definition, mirrored=[("dbo", "T1", "ok", 5, None), (None, "T2", None, None, None), ("dbo", None, None, None, None)]),
            record(6, "r", "Report", "b", "PowerBI", cid="b"), record(7, "q", "Report", "nowhere", "PowerBI", cid="nowhere"),
        ],
        REC,
    )
    g = GB.build_graph(recs, include_all=True)
    got = dict(rows(g.edges.groupBy("rel").count()))
    assert got == {"CONTAINS": 5, "DEPENDS_ON": 1, "CONSUMES": 3, "USES_TABLE": 1, "PROVIDES_TABLE": 1, "MIRRORS": 3, "READS_FROM": 1}
    assert rows(g.nodes.filter("label = 'Table'"), "id") == [("mirror_m_dbo_t1",), ("mirror_m_dbo_t2",), ("shortcut_b_edw_dim",), ("tbl_db_dbo_my_t",)]
    assert rows(GB.item_nodes(recs), "item_id", "item_type")[0] == ("a", "Lakehouse")
    stats = {(r["section"], r["name"]): r["count"] for r in GS.lineage_statistics(recs).collect()}
    assert stats[("totals", "internal_edges")] == 2 and stats[("totals", "mirrored_databases")] == 1


def brute_components(edges):
    """Tarjan's algorithm with a stack of its own: members of components of two or more to their least name."""
    out_edges, names = {}, set()
    for a, b in edges:
        out_edges.setdefault(a, []).append(b)
        names |= {a, b}
    index, low, stack, held, found = {}, {}, [], set(), {}
    for root in sorted(names):
        if root in index:
            continue
        todo = [(root, iter(out_edges.get(root, [])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while todo:
            v, rest = todo[-1]
            w = next((w for w in rest), None)
            if w is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    at = stack.index(v)
                    members, stack = stack[at:], stack[:at]
                    held -= set(members)
                    found.update({m: min(members) for m in members if len(members) > 1})
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                held.add(w)
                todo.append((w, iter(out_edges.get(w, []))))
            elif w in held:
                low[v] = min(low[v], index[w])
    return found


def components(df, edges):
    return {r["node"]: r["component"] for r in CO.strong_components(df(edges, "node string, next string")).collect()}


def random_edges(seed, n, m):
    rnd = random.Random(seed)
    return [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("soon", [0, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(df, monkeypatch, seed, soon):
    """With no early end (0) all chains are cut short first."""
    monkeypatch.setattr(CO, "SOON", soon)
    edges = random_edges(seed, 60, 75) + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("r2", "t0"), ("t0", "t1"), ("t1", "r7"), ("n1", "n1"), ("u0", "u1"), ("u1", "r0")]
    assert components(df, edges) == brute_components(edges)


def test_a_component_of_five_thousand_nodes(df):
    """A dense component inside tails: components and all depth measures end, and equal brute force on the condensed graph."""
    edges = sorted(set(random_edges(3, 5000, 25_000)) | {(f"a{i}", f"n{i}") for i in range(300)} | {(f"a{i}", f"a{i + 1}") for i in range(0, 300, 3)} | {("n5", "z0"), ("z0", "z1"), ("z1", "z2")})
    members = brute_components(edges)
    assert len(members) > 4800 and components(df, edges) == members
    name = lambda x: members.get(x, x)
    above = {}
    for a, b in edges:
        if name(a) != name(b):
            above.setdefault(name(a), set()).add(name(b))
    depth = {}

    def deep(x):
        if x not in depth:
            depth[x] = 1 + max(map(deep, above[x])) if x in above else 0
        return depth[x]

    g = graph(df, edges)
    got = {r["item_id"]: r["upstream_depth"] for r in T.node_depths(g).collect()}
    assert got == {x: deep(name(x)) for x in {v for e in edges for v in e}}
    best = T.dependency_depth(g, 5).collect()
    assert sorted((-r["dependency_depth"], r["item_id"]) for r in best) == sorted((-d, x) for x, d in got.items())[:5]
    assert T.chain_stats(g).first()["max_depth"] == max(got.values()) == T.deep_chains(g, 2, k=1).first()["depth"]


def test_a_long_ring_takes_few_rounds(df, monkeypatch):
    edges = [(f"n{i}", f"n{(i + 1) % 1500}") for i in range(1500)] + [("in", "n3"), ("n7", "out"), ("out", "far")]
    steps = []
    real = CO.cut_lineage
    monkeypatch.setattr(CO, "cut_lineage", lambda frame, label="step": (steps.append(label), real(frame, label))[1])
    assert components(df, edges) == {f"n{i}": "n0" for i in range(1500)}
    assert len(steps) < 120


def test_condensed_edges_are_counted(df):
    edges = df([("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "d")], "node string, next string")
    members = CO.strong_components(edges)
    assert rows(CO.condensed(edges, members), "node", "next", "n") == [("a", "c", 2), ("c", "d", 1)]
    g = graph(df, [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "b")])
    assert rows(T.item_components(g), "item_id", "component", "component_size") == [("a", "a", 2), ("b", "a", 2)]
    # Two starts in the component with two ways out each, and x with one way in: (2 + 2) + 2 of length 2 and 3.
    assert rows(T.chain_lengths(g)) == [(2, 4), (3, 2)]
    assert rows(T.node_depths(g), "item_id", "upstream_depth", "downstream_depth") == [("a", 2, 1), ("b", 2, 1), ("c", 1, 2), ("d", 0, 3), ("x", 3, 0)]


def test_source_counts_on_cycles_equal_brute_force(df):
    edges = sorted(set(random_edges(5, 80, 130)))
    rnd = random.Random(2)
    direct = sorted({(f"n{rnd.randrange(80)}", f"s{rnd.randrange(700):03d}") for _ in range(900)})
    below = {}
    for a, b in edges:
        below.setdefault(b, set()).add(a)

    def reached(starts):
        seen, todo = set(), list(starts)
        while todo:
            for y in below.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    want = {}
    for s in {s for _, s in direct}:
        n = len(reached([i for i, x in direct if x == s]))
        if n:
            want[s] = n
    got = BM.dependents_per_source(df(edges, "node string, next string"), df(direct, "node string, source string"))
    assert dict(rows(got, "source", "items")) == want


def test_source_bits_have_a_row_per_block_not_per_pair(df):
    """Ten times the edges multiply the pairs, not the rows: those stay below nodes x blocks."""
    for m in (300, 3000):
        edges = df([(f"n{b:03d}", f"n{a:03d}") for a, b in {tuple(sorted((random.Random(i).randrange(200), random.Random(-i).randrange(200)))) for i in range(m)} if a < b], "node string, next string")
        direct = df([(f"n{i % 200:03d}", f"s{i:04d}") for i in range(1000)], "node string, source string")
        from tidewatch.operators.analysis import encode_labels

        found, _ = BM.reached_bits(edges, BM.source_bits(direct, encode_labels(direct, "source")))
        assert found.count() <= 200 * 4


def test_paths_between_equal_brute_force(df):
    rnd = random.Random(9)
    names = [f"v{i:02d}" for i in range(40)]
    pairs = sorted({tuple(sorted((rnd.choice(names), rnd.choice(names)))) for _ in range(55)})
    both = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    near = {}
    for a, b in both:
        near.setdefault(a, []).append(b)

    def best(a, b):
        level = {a: (a,)}
        seen = {a}
        while level:
            if b in level:
                return level[b]
            grown = {}
            for p in level.values():
                for y in near.get(p[-1], ()):
                    if y not in seen:
                        grown[y] = min(grown.get(y, p + (y,)), p + (y,))
            seen |= set(grown)
            level = grown
        return None

    edges = df(sorted(both), "node string, next string")
    starts, ends = names[:12], names[6:30]
    every = sorted((len(p) - 1, a, b, p) for a in starts for b in ends if a != b and (p := best(a, b)))
    one = lambda xs: df([(x,) for x in xs], "id string")
    for k in (1, 7, 40):
        got = [(r["path_length"], r["seed"], r["id"], tuple(r["path"])) for r in T.paths_between(edges, one(starts), one(ends), 15, k).collect()]
        assert sorted(got) == every[:k]
    far = max(every)
    got = T.paths_between(edges, one([far[1]]), one([far[2]]), 15, 1).first()
    assert tuple(got["path"]) == far[3]
    assert T.paths_between(edges, one([far[1]]), one([far[2]]), far[0] - 1, 1).count() == 0
    assert T.paths_between(edges, one([]), one(ends), 15, 3).count() == 0


def test_two_sided_search_holds_fewer_rows(df, monkeypatch):
    """On a tree of fan-out 4 the frontiers of both sides stay far below those of a search from one side."""
    edges = [(f"t{i:05d}", f"t{(i - 1) // 4:05d}") for i in range(1, 5461)]
    seen = []
    real = T.cut_lineage

    def spy(frame, label="step"):
        out = real(frame, label)
        if label == "path-frontier":
            seen.append(out.count())
        return out

    monkeypatch.setattr(T, "cut_lineage", spy)
    g = graph(df, edges)
    r = T.shortest_path(g, "t01365", "t00000").first()
    assert r["path_length"] == 6
    assert sum(seen) < sum(4**k for k in range(1, 7)) / 10, "rows of a search from the root alone"


NAMES = ["Sales Lakehouse", "sales report", "Salesforce", "SALE", "Überblick", "a", "ab", "ab", None, "日本語の表", "x" * 300, "tab\tle", "100% done_x"]


def name_rows(df):
    return df([("item" if i % 2 else "table", f"i{i:02d}", n, "T", f"Tables/{n}/{i}" if i % 3 == 0 else None) for i, n in enumerate(NAMES * 4)], "entity_type string, id string, name string, type string, location string")


def test_index_finds_what_a_scan_finds(df, tmp_path, monkeypatch):
    monkeypatch.setattr(SE, "BLOCK_BITS", 3)
    frame = name_rows(df)
    index = SE.NameIndex.build(frame, str(tmp_path / "index"))
    for q in ("sale", "SALES", "les", "lakehouse", "über", "BLICK", "日本語", "本語の表", "ab", "a", "", "x" * 40, "Tables/", "le\t", "b\tl", "100%", "_x", "nothing here", "sales  report"):
        for kind, names_only in ((None, False), ("item", True), ("table", False)):
            hit = SE.matches("name", q) if names_only else SE.matches("name", q) | F.coalesce(SE.matches("location", q), F.lit(False))
            want = frame.filter(hit if kind is None else hit & (F.col("entity_type") == kind))
            assert rows(index.find(q, kind, names_only), "entity_type", "id") == rows(want, "entity_type", "id"), (q, kind)


def test_index_reads_the_partitions_of_its_trigrams(df, tmp_path):
    index = SE.NameIndex.build(name_rows(df), str(tmp_path / "index"))
    spread = index.candidates("lakehouse")
    pruned = re.findall(r"PartitionFilters: \[([^\]]*)\]", spread._jdf.queryExecution().executedPlan().toString())
    scans = [x for x in pruned if "bucket" in x]
    assert len(scans) == len([x for x in pruned if x]) and all("IN" in x for x in scans)
    assert len({SE._bucket(x) for x in SE.grams("lakehouse")}) <= 7
    assert rows(SE.NameIndex(df([], "a int").sparkSession, str(tmp_path / "index")).find("lakehouse"), "name") == [("Sales Lakehouse",)] * 4


def test_index_of_nothing(df, tmp_path):
    index = SE.NameIndex.build(name_rows(df).limit(0), str(tmp_path / "index"))
    assert index.find("sales").count() == 0 and index.find("a").count() == 0


def test_connections_are_parsed_once_a_record(df):
    from tidewatch.operators.graph import build as GB

    lake = '{"type": "OneLake", "oneLake": {"workspaceId": "w", "itemId": "%s", "path": "Tables/s/t"}}'
    text = [("a", lake % "b"), ("b", lake % "gone"), ("b", "{'type': 'Snowflake', 'snowflake': {'connection': 'x', 'database': None}}"), ("c", "broken"), (None, lake % "a"), ("c", lake % "a")]
    raw = df([(i, "w", "W", item, item, "Lakehouse", "Unknown", t) for i, (item, t) in enumerate(text)], "seq bigint, `Workspace ID` string, `Workspace Name` string, `Item ID` string, `Item Name` string, `Item Type` string, `Source Type` string, `Source Connection` string")
    edges = GB.dependency_edges(raw)
    assert [(r.src, r.rel) for r in edges.orderBy("src", "rel").collect()] == [("a", "DEPENDS_ON"), ("b", "CONSUMES"), ("b", "CONSUMES"), ("c", "DEPENDS_ON")]
    for frame in (edges, GB.shortcut_tables(raw)[1]):
        assert str(frame._jdf.queryExecution().optimizedPlan()).count("from_json(") == 1
    assert "from_json(" not in str(GB.item_ids(raw)._jdf.queryExecution().optimizedPlan())


def test_alike_records_are_counted_together(df):
    from tidewatch.operators.graph import stats as GS

    raw = df([(i, "w", "W", "a", "A", "Report", "Snowflake", "{'type': 'Snowflake'}") for i in range(3)], "seq bigint, `Workspace ID` string, `Workspace Name` string, `Item ID` string, `Item Name` string, `Item Type` string, `Source Type` string, `Source Connection` string")
    assert [tuple(r) for r in GS.classified(raw, ["item_id"]).select("item_id", "kind", "n", "internal", "external").collect()] == [("a", "Snowflake", 3, False, True)]
    found = {(r.section, r.name): r["count"] for r in GS.lineage_statistics(raw).collect()}
    assert found["totals", "external_edges"] == 3 and found["totals", "internal_edges"] == 0 and found["items_by_type", "Report"] == 3


def test_sources_are_counted_in_passes_that_leave_nothing(spark, df):
    import glob

    from tidewatch.session import _scratch_root

    edges = df([("a", "b"), ("b", "c")], "node string, next string")
    direct = df([(n, f"{n}{i:03}") for n in "bc" for i in range(200)], "node string, source string")
    found = BM.dependents_per_source(edges, direct, rows_a_pass=1)
    assert rows(found, "source", "items") == [(f"{n}{i:03}", 1 if n == "b" else 2) for n in "bc" for i in range(200)]
    root = _scratch_root(spark).removeprefix("file:")
    assert glob.glob(f"{root}/bit-counts*") and not glob.glob(f"{root}/bit-pass*")


def written(monkeypatch, module, label):
    """Rows of each frame that is written under the label from now on."""
    seen, cut = [], module.cut_lineage

    def counted(df, name="step", *rest):
        out = cut(df, name, *rest)
        if name == label:
            seen.append(out.count())
        return out

    monkeypatch.setattr(module, "cut_lineage", counted)
    return seen


def test_a_node_passes_on_the_nearest_starts(df, monkeypatch):
    one = lambda ids: df([(i,) for i in ids], "id string")
    starts, ends = [f"a{i:02d}" for i in range(30)], [f"b{i:02d}" for i in range(30)]
    links = [(s, "h") for s in starts] + [(e, "t") for e in ends] + [("h", "m"), ("m", "t"), ("h", "m")]
    edges = df(links + [(b, a) for a, b in links], "node string, next string")
    held = written(monkeypatch, T, "path-frontier")
    got = rows(T.paths_between(edges, one(starts), one(ends), 15, 2), "seed", "id", "path_length", "path")
    assert got == [("a00", "b00", 4, ["a00", "h", "m", "t", "b00"]), ("a00", "b01", 4, ["a00", "h", "m", "t", "b01"])]
    assert max(held) <= 3 * 63, "more than k + 1 starts at a node"


def brute_trails(deps, start):
    """Every trail from a node: no edge, known by its ends, is used twice; equal edges count apart."""
    out, todo = [], [(start, ())]
    while todo:
        at, used = todo.pop()
        for a, b in deps:
            if a == at and (a, b) not in used:
                out.append((b, len(used) + 1))
                todo.append((b, (*used, (a, b))))
    return out


@pytest.mark.parametrize(("seed", "depth", "few"), [(1, None, 0), (3, 3, 1000)])
def test_trails_equal_brute_force(df, monkeypatch, seed, depth, few):
    """Circles in a row, an edge of an item to itself, equal edges and tails on both sides; many rows (few = 0) or few."""
    monkeypatch.setattr(T, "FEW", few)
    rnd = random.Random(seed)
    deps = [("a", "b"), ("b", "a"), ("b", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("d", "f"), ("f", "g"), ("g", "g"), ("g", "h"), ("h", "i"), ("s", "t"), ("t", "a"), ("s", "c"), ("u", "v"), ("v", "i")]
    deps += [(x, y) for x, y in zip(rnd.choices("stuab", k=3), rnd.choices("cfhiv", k=3), strict=True)]
    deps = deps if seed < 3 else [*deps, ("i", "z"), ("z", "z"), ("z", "i")]
    g = graph(df, deps)
    names = sorted({x for e in deps for x in e})
    every = {x: brute_trails(deps, x) for x in names}
    back = {x: brute_trails([(b, a) for a, b in deps], x) for x in names}
    longest = lambda ts: max([k for _, k in ts], default=0)
    cut = lambda n: n if depth is None else min(n, depth)
    assert rows(T.node_depths(g, depth, "trail"), "item_id", "upstream_depth", "downstream_depth") == [(x, cut(longest(every[x])), cut(longest(back[x]))) for x in names]
    has_out = {a for a, _ in deps}
    ends = [k for ts in every.values() for b, k in ts if b not in has_out and k >= 2]
    assert dict(rows(T.chain_lengths(g, depth, "trail"))) == {k: ends.count(k) for k in set(ends) if k == cut(k)}


def landed(monkeypatch):
    """The folders and files that frames are written to, in order."""
    from pyspark.sql import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (write(self, path, *a, **b), seen.append(path))[0])
    return seen


def test_trails_outside_components_are_not_listed(spark, df, monkeypatch):
    """Of a chain with a pair in its middle, only the trails inside the pair are listed."""
    n = 24
    g = graph(df, [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(n)] + [("x13", "x12")])
    seen = landed(monkeypatch)
    got = {r["item_id"]: (r["upstream_depth"], r["downstream_depth"]) for r in T.node_depths(g, mode="trail").collect()}
    assert got["x00"] == (n, 0) and got["x12"] == (n - 12, 14) and got["x13"] == (n - 11, 13) and got[f"x{n}"] == (0, n)
    lists = [spark.read.parquet(p) for p in seen]
    assert sum(x.count() for x in lists if "used" in x.columns) <= 20
    seen.clear()
    assert dict(rows(T.chain_lengths(g, mode="trail")))[n] == 1
    assert sum(x.count() for x in map(spark.read.parquet, seen) if "used" in x.columns) <= 20


def test_rounds_of_depths_hold_each_item_once(spark, df, monkeypatch):
    """A binary tree: the rounds of depths hold an item once a way, and those of chain counts fewer items each time."""
    monkeypatch.setattr(T, "FEW", 30)
    n = 255
    g = graph(df, [(f"x{i}", f"x{i // 2}") for i in range(1, n + 1)])
    seen = landed(monkeypatch)
    got = {r["item_id"]: (r["upstream_depth"], r["downstream_depth"]) for r in T.node_depths(g).collect()}
    assert got["x0"] == (0, 8) and got["x255"] == (8, 0) and got["x1"] == (1, 7)
    states = [x for x in map(spark.read.parquet, seen) if "d" in x.columns]
    assert sum(x.count() for x in states) <= 2 * 2 * (n + 1)
    seen.clear()
    assert dict(rows(T.chain_lengths(g))) == {k: 2 ** (k - 1) for k in range(2, 9)}
    states = [x for x in map(spark.read.parquet, seen) if "count" in x.columns]
    assert sum(x.count() for x in states) <= 2 * (n + 1)


def test_depths_with_null_ends(df):
    """A null end is a root, and edges of a null item are chains of one that no item depends on."""
    edges = df([("a", None), ("a", "b"), ("b", None), (None, "a"), (None, "c"), ("c", "c"), ("d", "c")], "node string, next string")
    plain, cyclic = T.walk_depths(edges)
    assert rows(plain) == [("a", 2), ("b", 1)]
    assert rows(cyclic) == [("c",), ("d",), (None,)]
    assert rows(T.walk_depths(edges, 2)[0], "node", "d") == [("a", 2), ("b", 1), ("c", 2), ("d", 2), (None, 2)]
    assert rows(T.walk_depths(edges.where("coalesce(next, '') <> 'c'"))[0]) == [("a", 2), ("b", 1), (None, 3)]


def test_report_counts_its_chains_once(df, monkeypatch):
    calls, count = [], T.chain_lengths
    monkeypatch.setattr(T, "chain_lengths", lambda *a, **b: (calls.append(a), count(*a, **b))[1])
    report = V.chain_report(graph(df, DIAMOND), 2)
    assert len(calls) == 1
    assert rows(report["distribution"]) == [(2, 2), (3, 2)] and rows(report["stats"]) == [(3, 2.5, 4)]
    assert report["nodes"].count() == 5 and report["chains"].count() == 4


def test_component_rounds_move_numbers_of_changed_nodes(df, monkeypatch):
    seen, real = {}, CO.cut_lineage
    monkeypatch.setattr(CO, "cut_lineage", lambda frame, label="step": seen.setdefault(label, []).append(kept := real(frame, label)) or kept)
    edges = [(f"n{i}", f"n{(i + 1) % 12}") for i in range(12)] + [("in", "n3"), ("n7", "out"), ("m0", "m1"), ("m1", "m0"), ("m1", "m1"), (None, "n1"), ("n2", None)]
    assert components(df, edges) == {f"n{i}": "n0" for i in range(12)} | {"m0": "m0", "m1": "m0"}
    for label in ("core", "colours", "colour-edges", "colour-members"):
        assert seen[label] and all(t in ("bigint", "int") for frame in seen[label] for _, t in frame.dtypes)


def test_report_walks_its_depths_once(df, monkeypatch):
    """And a length keeps as many starts as chains are asked for, not a row per start and length."""
    walks, starts, walk, cut = [], [], T.walk_depths, T.cut_lineage
    monkeypatch.setattr(T, "walk_depths", lambda *a, **b: (walks.append(a), walk(*a, **b))[1])

    def spy(frame, label="step"):
        kept = cut(frame, label)
        if label == "chain-starts":
            starts.append(kept.count())
        return kept

    monkeypatch.setattr(T, "cut_lineage", spy)
    edges = [(f"a{i}", "b") for i in range(9)] + [("b", "c"), ("c", "d"), ("e0", "c"), ("e1", "c")]
    report = V.chain_report(graph(df, edges), 2, k=3)
    assert len(walks) == 1 and starts == [3 + 2]
    assert rows(report["chains"], "terminal_id", "origin_id", "depth") == [("a0", "d", 3), ("a1", "d", 3), ("a2", "d", 3)]
    assert rows(report["nodes"].where("item_id = 'c'"), "upstream_depth", "downstream_depth") == [(1, 2)]


def test_sources_are_counted_without_rows_of_bits(df, monkeypatch):
    """Within the bound of edges no frame of bits is written; beyond it, and with a bound of rows, passes give the same."""
    labels, cut = [], BM.cut_lineage
    monkeypatch.setattr(BM, "cut_lineage", lambda frame, label="step": (labels.append(label), cut(frame, label))[1])
    rnd = random.Random(4)
    edges = df([*{(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(75)}, ("n1", None), (None, "n2")], "node string, next string")
    direct = df([*((f"n{rnd.randrange(70)}", f"s{rnd.randrange(300):03d}") for _ in range(400)), ("n3", None), (None, "s001"), ("n4", "s004"), ("n4", "s004")], "node string, source string")
    found = rows(BM.dependents_per_source(edges, direct), "source", "items")
    assert len(found) > 100 and not [x for x in labels if x == "bit-sources" or x.endswith("-layer")]
    monkeypatch.setattr(BM, "IN_TASK", 10)
    assert rows(BM.dependents_per_source(edges, direct), "source", "items") == found
    assert "bit-sources" in labels


def test_slices_of_a_graph_equal_brute_force():
    """Layers are cut into pieces, one node has more edges than are joined at once, and some nodes stand for several."""
    import numpy as np
    import pyarrow as pa

    from tidewatch.operators.graph.slices import EDGES, TRIPS, _Graph

    rnd, ends, kept, n = np.random.default_rng(3), [40, 70, 90], 90, 150
    starts, pairs = [0, *ends], set()
    for node in range(40, n):
        layer = min(sum(node >= e for e in ends), 3)
        pairs |= {(node, int(rnd.integers(starts[layer - 1], starts[layer])))} | {(node, int(x)) for x in rnd.integers(0, starts[layer], 60 if node in (75, 140) else rnd.integers(0, 3))}
    src, to = np.array(sorted(pairs), np.int32).T
    trips = {5: 1, 50: 6, 88: 3}
    consumers = [(int(rnd.integers(0, kept)), int(rnd.integers(0, 128))) for _ in range(90)]
    graph = _Graph(len(src), np.array(ends), 2)
    graph.at_once = 7
    buffers = lambda a, b, kind: (pa.py_buffer(np.ascontiguousarray(a, np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(b, kind).tobytes()))
    graph.add(EDGES, *buffers(src, to, np.int32))
    graph.add(TRIPS, *buffers([*trips], [*trips.values()], np.int64))
    for _ in range(2):  # the second slice starts from no bits
        graph.begin()
        graph.consume(*(np.array(x, np.int32) for x in zip(*consumers, strict=True)))
        got = graph.counts().reshape(-1)
        has = [set() for _ in range(n)]
        for node, s in consumers:
            has[node].add(s)
        want = np.zeros(128, int)
        for node in range(n):
            reached = set().union(*(has[b] for a, b in pairs if a == node)) | (has[node] if node in trips else set())
            has[node] |= reached
            for s in reached:
                want[s] += trips.get(node, 1)
        assert (got == want).all() and want.max() > 20


def test_counts_per_bit_equal_unpacked_bits():
    import numpy as np

    from tidewatch.operators.graph.slices import _per_bit

    for n in (0, 1, 254, 255, 256, 1000):
        words = np.random.default_rng(n).integers(0, 2**64, (n, 3), dtype=np.uint64)
        assert (_per_bit(words) == np.unpackbits(words.view(np.uint8).reshape(n, 24), axis=1, bitorder="little").sum(axis=0).reshape(3, 64)).all()


def test_parts_of_records_are_not_broadcast(spark, tmp_path):
    """However small the file, its rows may be millions: the planner's estimate is the file's size."""
    from tidewatch.sources import adapters as AD

    spark.range(50).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(100).selectExpr("id % 60 as l_partkey", "id % 7 as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    records = AD.lineage_records(spark, str(tmp_path))
    assert "Broadcast" not in records._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in GB.item_ids(records)._jdf.queryExecution().sparkPlan().toString()
    made = GB.source_nodes(records)
    assert records.count() == 50 + len({(i % 60, i % 7) for i in range(100) if i % 60 < 50}) and made.where("type <> 'OneLake'").count() == 7


def test_equal_connections_are_parsed_once(df):
    """The first of the records that are alike describes the source; null texts, types and orders are kept apart."""
    ddl = "seq bigint, `Workspace ID` string, `Workspace Name` string, `Item ID` string, `Item Name` string, `Item Type` string, `Source Type` string, `Source Connection` string"
    snow, blob = "{'type': 'Snowflake', 'snowflake': {'database': 'D', 'schema': %r}}", "[{'type': 'AzureBlob', 'azureBlob': {'location': 'L', 'container': None, 'subpath': %r}}]"
    texts = [snow % "a", snow % "b", blob % "x", blob % "y", None, "broken", '{"type": "OneLake", "oneLake": {"itemId": "i1"}}', '{"type": "OneLake", "oneLake": {"itemId": "gone", "path": "Tables/T%d"}}']
    data = [(None if i % 11 == 3 else 100 - i, "w", "W", f"i{i % 9}", "I", "Report", ("Snowflake", None, "PowerBI")[i % 3], (texts[i % 8] or "").replace("%d", str(i % 5)) or None) for i in range(80)]
    raw = df(data, ddl)
    assert rows(GB.source_nodes(raw)) == rows(GB.source_nodes(GB.parsed(raw))) and GB.source_nodes(raw).count() > 4
    assert GB._connections(raw).count() == len({(r[6], r[7]) for r in data}) < 80
