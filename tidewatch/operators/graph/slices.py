"""Counting what depends on each source, slice by slice of the sources, inside tasks.

A slice is a few words of 64 sources. Its bits for all nodes that others depend on fit into a task, and so do the edges, as pairs of
numbers: a group of tasks' worth of slices gets the graph once and then the consumers of its slices, one slice after the other. So
what is shuffled is the graph once per group and the consumers once, not the bits of every edge.

Nodes are numbered by layer, those that nothing depends on last: a layer's bits are finished by one pass over its edges, and
bits of the last ones are counted and not kept. Edges that lead to no bit of the slice are left out of a layer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ranking import numbered
from tidewatch.session import cut_lineage

if TYPE_CHECKING:
    from tidewatch.operators.graph.bitmaps import Layers

BITS = 64
#: Bytes of the bits that a task holds, most words of a slice, and bytes of the rows that are joined at once.
HELD, WIDEST, AT_ONCE = 1 << 26, 8, 1 << 21
#: Edges of a packed row, and consumers that a task collects before it packs them.
CHUNK, COLLECTED = 1 << 16, 1 << 20
#: Packed rows: (slice, at, a, b). Edges come first, then nodes that depend on themselves, then the consumers of slice 0 and on.
EDGES, TRIPS = -2, -1
PACKED = "slice int, at int, a binary, b binary"
#: One bit in each byte of a word, and rows whose such bits can be added before a byte overflows.
ONES, ROWS = np.uint64(0x0101010101010101), 255


def _packed(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [*zip(*((s, at, a.tobytes(), b.tobytes()) for s, at, a, b in rows), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "at", "a", "b"])


def _collected(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The two columns of the batches, some ``most`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
        n += batch.num_rows
        if n >= most:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _pack_pairs(kind: int, b_type: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _collected(batches, CHUNK):
            yield _packed([(kind, int(a[0]), a.astype(np.int32), b.astype(b_type))])

    return run


def _pack_consumers(width: int) -> Callable:
    """Rows (node, source code) of a task, by slice: nodes, and places of the sources in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, code in _collected(batches, COLLECTED):
            of = code // (width * BITS)
            order = np.argsort(of, kind="stable")
            node, of, place = node[order].astype(np.int32), of[order], (code - of * (width * BITS))[order].astype(np.int32)
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            firsts = [0, *cuts.tolist()]
            yield _packed([(int(of[f]), 0, a, b) for f, a, b in zip(firsts, np.split(node, cuts), np.split(place, cuts), strict=True)])

    return run


def _per_bit(rows: np.ndarray) -> np.ndarray:
    """How many rows (n, words) have each bit: (words, 64). One bit of each byte at a time is added for up to 255 rows."""
    n, width = rows.shape
    if not n:
        return np.zeros((width, BITS), np.int64)
    groups = -(-n // ROWS)
    deep = -(-n // groups)
    x = np.zeros((deep * groups, width), np.uint64)
    x[:n] = rows
    x = x.reshape(deep, groups * width)
    out = np.empty((width, 8, 8), np.int64)
    for b in range(8):
        lanes = ((x >> np.uint64(b)) & ONES).sum(axis=0, dtype=np.uint64).astype("<u8")
        out[:, :, b] = lanes.reshape(groups, width).view(np.uint8).reshape(groups, width, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(width, BITS)


class _Graph:
    """The edges of a task, sorted by node, with the bits of one slice at a time."""

    def __init__(self, edges: int, ends: np.ndarray, width: int):
        self.src, self.next, self.n = np.empty(edges, np.int32), np.empty(edges, np.int32), 0
        self.ends, self.kept, self.width = ends, int(ends[-1]) if len(ends) else 0, width
        self.trips: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.at_once = max(1, AT_ONCE // (8 * width))
        self.ready = False

    def add(self, kind: int, a: pa.Buffer, b: pa.Buffer) -> None:
        if kind == TRIPS:
            self.trips.append(np.frombuffer(a, np.int32))
            self.sizes.append(np.frombuffer(b, np.int64))
            return
        k = a.size // 4
        self.src[self.n : self.n + k], self.next[self.n : self.n + k] = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
        self.n += k

    def begin(self) -> None:
        if not self.ready:
            self.ready = True
            if self.n != len(self.src):
                raise RuntimeError(f"{self.n} of {len(self.src)} edges have come")
            self.trip_nodes = np.concatenate([np.empty(0, np.int32), *self.trips])
            self.trip_sizes = np.concatenate([np.empty(0, np.int64), *self.sizes])
            self.is_trip = np.zeros(self.kept, bool)
            self.is_trip[self.trip_nodes] = True
            self.pieces = [*self._pieces()]
            self.bits, self.active = np.empty((self.kept, self.width), np.uint64), np.empty(self.kept, bool)
        self.bits.fill(0)
        self.active.fill(False)

    def _pieces(self) -> Iterator[tuple[int, int]]:
        """Ranges of edges: layers, and parts of them that share no node."""
        cuts = [0, *np.searchsorted(self.src, self.ends.astype(np.int32)).tolist(), self.n]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while lo < hi:
                end = min(lo + self.at_once, hi)
                if end < hi:
                    first = int(np.searchsorted(self.src[lo:hi], self.src[end]))
                    end = lo + (first or int(np.searchsorted(self.src[lo:hi], self.src[end], "right")))
                yield lo, end
                lo = end

    def consume(self, nodes: np.ndarray, places: np.ndarray) -> None:
        words = nodes.astype(np.int64) * self.width + (places >> 6)
        np.bitwise_or.at(self.bits.reshape(-1), words, np.uint64(1) << (places & (BITS - 1)).astype(np.uint64))
        self.active[nodes] = True

    def _joined(self, to: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The bits behind edges, by or from one of ``firsts`` to the next; a single node's edges may be more than are joined at once."""
        if len(to) <= self.at_once:
            return np.bitwise_or.reduceat(np.take(self.bits, to, axis=0), firsts, axis=0)
        parts = (np.bitwise_or.reduce(np.take(self.bits, to[i : i + self.at_once], axis=0), axis=0) for i in range(0, len(to), self.at_once))
        return reduce(np.bitwise_or, parts)[None]

    def counts(self) -> np.ndarray:
        """(words, 64): nodes that depend on each source of the slice; a node that stands for a component counts as its members."""
        total = np.zeros((self.width, BITS), np.int64)
        for lo, hi in self.pieces:
            src, to = self.src[lo:hi], self.next[lo:hi]
            met = self.active[to]
            n = int(np.count_nonzero(met))
            if not n:
                continue
            if n < hi - lo:
                src, to = src[met], to[met]
            new = np.empty(n, bool)
            new[0], new[1:] = True, src[1:] != src[:-1]
            firsts = np.flatnonzero(new)
            nodes, rows = src[firsts], self._joined(to, firsts)
            if nodes[0] >= self.kept:
                total += _per_bit(rows)
                continue
            total += _per_bit(rows[~self.is_trip[nodes]] if len(self.trip_nodes) else rows)
            self.bits[nodes] |= rows
            self.active[nodes] = True
        for i in range(0, len(self.trip_nodes), self.at_once):
            nodes, sizes = self.trip_nodes[i : i + self.at_once], self.trip_sizes[i : i + self.at_once]
            met = self.active[nodes]
            rows, sizes = self.bits[nodes[met]], sizes[met]
            for b in range(int(sizes.max(initial=0)).bit_length()):
                total += _per_bit(rows[(sizes >> b) & 1 == 1]) << b
        return total


def _count(edges: int, ends: list[int], width: int) -> Callable:
    """Counts of slices, for rows (g, packed row) sorted by group and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, graph = None, None, None

        def finished() -> pa.RecordBatch:
            n = graph.counts().reshape(-1)
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array((held * width * BITS + some).astype(np.float64)), pa.array(n[some])], ["source_code", "items"])

        for batch in batches:
            for g, s, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if held is not None and (g, s) != (group, held):
                    yield finished()
                    held = None
                if g != group:
                    group, graph = g, None  # the graph before goes first
                    graph = _Graph(edges, np.array(ends, np.int64), width)
                if s < 0:
                    graph.add(s, a.as_buffer(), b.as_buffer())
                    continue
                if held is None:
                    held = s
                    graph.begin()
                graph.consume(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.int32))
        if held is not None:
            yield finished()

    return run


def _placed(graph: Layers) -> tuple[DataFrame, list[int]]:
    """(node, n, kept, trips): nodes by number, and the numbers at which layers of kept ones end.

    Kept are nodes that others depend on, and those that depend on themselves, of which ``trips`` is the size, else 0.
    """
    long = lambda x: F.lit(x).cast("long")
    row = lambda df, node="node", d=long(0), kept=True, trips=long(0): df.select(F.col(node).alias("node"), d.alias("d"), F.lit(kept).alias("kept"), trips.alias("trips"))
    marks = [row(graph.depths, d=F.col("d").cast("long"), kept=False), row(graph.edges, "next"), row(graph.round_trip, trips=long(1)), row(graph.sizes, trips=F.col("size"))]
    known = reduce(DataFrame.unionByName, marks).where("node is not null")
    nodes = known.groupBy("node").agg(F.max("d").alias("d"), F.max("kept").alias("kept"), F.max("trips").alias("trips"))
    nodes = cut_lineage(numbered(nodes, [F.desc("kept"), "d", "node"], "n", "bit-order"), "bit-places")
    sizes = nodes.where("kept").groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    return nodes, np.cumsum([r["n"] for r in sizes]).tolist()


def counted_in_slices(graph: Layers, edges: int, direct: DataFrame, numbers: DataFrame, sources: int, width: int | None = None) -> DataFrame:
    """(source_code, items): the nodes that depend, through one edge or more, on a node of ``direct`` (node, source).

    ``edges`` is the number of the graph's edges, ``width`` the words of a slice; by default as many as leave each core some slices.
    """
    spark = direct.sparkSession
    nodes, ends = _placed(graph)
    cores, words = spark.sparkContext.defaultParallelism, -(-sources // BITS)
    width = width or max(1, min(WIDEST, HELD // (8 * (ends[-1] if ends else 1)), -(-words // (4 * cores))))
    slices = -(-words // width)
    groups = max(1, min(2 * cores, slices))

    # Numbers of nodes are never sent to the driver: a file of them is small for its rows.
    ids = nodes.select("node", F.col("n").cast("int").alias("n")).hint("merge")
    named = lambda name, a: ids.select(F.col("node").alias(name), F.col("n").alias(a))
    pairs = graph.edges.select("node", "next").join(named("node", "a"), "node").join(named("next", "b"), "next").select("a", "b")
    packed = cut_lineage(pairs.orderBy("a").mapInArrow(_pack_pairs(EDGES, np.int32), PACKED), "bit-packed")
    trips = nodes.where("trips > 0").select(F.col("n").alias("a"), F.col("trips").alias("b")).mapInArrow(_pack_pairs(TRIPS, np.int64), PACKED)

    consumers = direct
    if graph.members is not None:
        consumers = direct.join(graph.members, "node", "left").select(F.coalesce("component", "node").alias("node"), "source")
    coded = consumers.join(numbers.select("source", F.col("source_code").cast("long").alias("code")), "source")
    kept = nodes.where("kept").select("node", F.col("n").cast("int").alias("n")).hint("merge")
    consumed = coded.join(kept, "node").select("n", "code").mapInArrow(_pack_consumers(width), PACKED)

    every: Column = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = packed.unionByName(trips).select(every.alias("g"), "*").unionByName(consumed.select((F.col("slice") % groups).alias("g"), "*"))
    dealt = dealt.repartitionById(groups, "g").sortWithinPartitions("g", "slice", "at")
    return dealt.mapInArrow(_count(edges, ends, width), "source_code double, items bigint")
