"""Embedding near-dedup by an inverted multi-index.

Vectors are normalised in double precision and cut in halves. Each half has a codebook of its own (k-means on a bounded,
documented sample of rows), and a vector's cell is the pair of its nearest centroids. The size of the product grid
grows with the number of rows, so that cells stay small. A vector looks for partners in the cells nearest to it, in
the order of the multi-sequence algorithm: by the sum of the two halves' distances, ascending, found with a heap
over the two sorted lists. How many cells are visited is calibrated: it is the number after which ``TARGET`` of the
pairs of a sample have met, of its true pairs and of pairs made to lie right at the threshold, which are the hardest.

Equal vectors of one label form a class that is represented once; the links of its members are its own size and the
sizes of linked classes. In a cell, visitors and residents are compared in blocks of bounded size by matrix products in
double precision; a large cell is split into blocks, and every pair of blocks is a task of its own. A task adds up the
links of each vector and gives out only links that join components, never all pairs.

Defined cases: rows whose label is null, and vectors that are null, empty, zero, or hold null or non-finite
components, link with nothing; vectors of different lengths never link; those of one component link by their sign; rows without id are left out; repeated rows
count as vectors of their own; an empty table gives an empty result; other columns are not needed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import bounded_sample, components, need_integers, small_batches, table
from tidewatch.session import cut_lineage

THRESHOLD = 0.93
#: Rows that the codebooks are fitted on, and queries that the number of visited cells is calibrated on.
FIT_ROWS, FIT_QUERIES = 8000, 1500
TARGET = 0.99
#: Rows that a cell has on average over all labels; the codebooks grow with the square root of the number of cells.
#: With this many centroids a half, cells have that size up to 2.5 billion vectors; beyond it cells grow.
CELL_ROWS, MOST_CENTROIDS = 600, 2048
BLOCK = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of a half; fewer if there are fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))


def traversal(a: np.ndarray, b: np.ndarray, most: int) -> list[int]:
    """Cells i * len(b) + j by ascending a[i] + b[j], at most so many: the multi-sequence algorithm."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, out, pushed = [(a[ia[0]] + b[ib[0]], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(int(ia[i]) * len(b) + int(ib[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (a[ia[p]] + b[ib[q]], p, q))
    return out


class Index:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, rows: int, threshold: float) -> None:
        half = sample.shape[1] // 2
        k = int(min(MOST_CENTROIDS, max(4, np.ceil(np.sqrt(rows / CELL_ROWS)))))
        self.half, self.books = half, [kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)]
        self.visits = self._calibrate(sample, labels, threshold)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visited(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.distances(x)
        return [traversal(p, q, self.visits) for p, q in zip(a, b, strict=True)]

    def _calibrate(self, x: np.ndarray, labels: np.ndarray, threshold: float) -> int:
        """Cells to visit until the target share of pairs is met, from either of their ends."""
        total = len(self.books[0]) * len(self.books[1])
        some, pairs = x[:FIT_QUERIES], []
        for k in range(0, len(some), 250):
            q, r = np.nonzero((some[k : k + 250] @ x.T >= threshold) & (labels[k : k + 250, None] == labels))
            pairs += [(i + k, j) for i, j in zip(q.tolist(), r.tolist(), strict=True) if i + k != j]
        side = np.random.default_rng(5).normal(size=some.shape)
        side -= (side * some).sum(axis=1)[:, None] * some
        made = threshold * some + np.sqrt(1 - threshold**2) * _normalised(side)
        own = np.array(pairs[:20_000], dtype=np.int64).reshape(-1, 2)
        need = [self._steps(some, made)] + [self._steps(x[own[:, 0]], x[own[:, 1]])] * bool(len(own))
        return int(min(total, max(np.sort(n)[int(np.ceil(TARGET * len(n))) - 1] for n in need)))

    def _steps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells visited before the two meet: the rank of one's home among the other's distances."""
        out = []
        for p, q in ((x, y), (y, x)):
            (a, b), home = self.distances(p), self.cells(q)
            i, j = np.divmod(home, len(self.books[1]))
            reach = a[np.arange(len(p)), i] + b[np.arange(len(p)), j]
            out.append(np.array([(np.add.outer(a[k], b[k]) <= reach[k]).sum() for k in range(len(p))]))
        return np.minimum(*out)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in rows]) if len(rows) else np.zeros((0, 1))


def _normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _spread(shared):
    """Each class in its own cell as a resident, and as a visitor in all the cells that it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for rows in batches:
            if not len(rows):
                continue
            x = _normalised(_matrix(rows["embedding"]))
            home, visits = index.cells(x), index.visited(x)
            n = [len(v) for v in visits]
            at = np.repeat(np.arange(len(rows)), n)
            own = rows.assign(cell=home, home=home, resident=True)
            trips = rows.iloc[at].assign(cell=[c for v in visits for c in v], home=np.repeat(home, n), resident=False)
            yield pd.concat([own, trips])[["label", "cell", "home", "resident", "node", "members", "embedding"]]

    return run


def _compare(threshold: float, shared):
    """Links of a block of visitors with a block of residents of a cell: counts per end, and edges that join components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        left, right = rows[~rows["resident"]], rows[rows["resident"]]
        if len(left) and len(right):
            index = shared.value
            x, y = _normalised(_matrix(left["embedding"])), _normalised(_matrix(right["embedding"]))
            a, b = left["node"].to_numpy(), right["node"].to_numpy()
            met = (x @ y.T >= threshold) & (a[:, None] != b)
            if met.any():
                # A pair that meets at both ends is counted where the smaller end visits.
                r = np.flatnonzero(met.any(axis=0))
                places = left["home"].to_numpy()
                back = np.stack([np.isin(places, v) for v in index.visited(y[r])], axis=1)
                met[:, r] &= ~back | (a[:, None] < b[r])
            for node, add in ((a, met @ right["members"].to_numpy()), (b, left["members"].to_numpy() @ met)):
                out += [(int(node[i]), int(add[i]), -1, -1) for i in np.flatnonzero(add)]
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            q, r = np.nonzero(met)
            for i, j in zip(a[q].tolist(), b[r].tolist(), strict=True):
                if (p := find(i)) != (s := find(j)):
                    root[max(p, s)] = min(p, s)
                    out.append((-1, 0, i, j))
        return pd.DataFrame(out, columns=["node", "links", "src", "dst"]).astype("int64")

    return run


def _pairs(classes: DataFrame, dim: int, rows: int, threshold: float) -> DataFrame:
    """Counts and joining edges of the classes of one vector length: (node, links, src, dst), -1 where a column is not meant."""
    spark = classes.sparkSession
    own = classes.where(F.size("embedding") == dim)
    some = bounded_sample(own, F.xxhash64("node"), FIT_ROWS, "node").select("label", "embedding").toPandas()
    index = Index(_normalised(_matrix(some["embedding"])), some["label"].to_numpy(), rows, threshold)
    shared = spark.sparkContext.broadcast(index)
    schema = f"label bigint, cell bigint, home bigint, resident boolean, node bigint, members bigint, embedding {classes.schema['embedding'].dataType.simpleString()}"
    spread = cut_lineage(own.mapInPandas(_spread(shared), schema), "cells")
    sizes = spread.groupBy("label", "cell").agg(F.count_if("resident").alias("r"), F.count_if(~F.col("resident")).alias("v")).where("r > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = spread.join(sizes, ["label", "cell"]).withColumns({"nr": blocks("r"), "nv": F.greatest(blocks("v"), F.lit(1))})
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("resident"), F.col("nr")).otherwise(F.col("nv"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("resident"), F.col("nv")).otherwise(F.col("nr")) - 1))
    placed = placed.withColumn("mine", mine).withColumn("other", other)
    placed = placed.withColumns({"rb": F.when(F.col("resident"), F.col("mine")).otherwise(F.col("other")), "vb": F.when(F.col("resident"), F.col("other")).otherwise(F.col("mine"))})
    slim = placed.select("label", "cell", "rb", "vb", "home", "resident", "node", "members", "embedding")
    return slim.groupBy("label", "cell", "rb", "vb").applyInPandas(_compare(threshold, shared), "node bigint, links bigint, src bigint, dst bigint")


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row with an id, an integer: ``id``, ``n_links``, ``component_id`` and ``kept``."""
    need_integers(vectors, id)
    spark = small_batches(vectors.sparkSession, 2000)
    # Single precision is shipped as it is; all arithmetic on it is in double precision.
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.FloatType)
    kind = "array<float>" if single else "array<double>"
    v, i, y = F.col(f"`{embedding}`").cast(kind), F.col(f"`{id}`"), F.col(f"`{label}`")
    every = vectors.where(i.isNotNull()).select(i.cast("long").alias("id"), F.when(y.isNotNull(), F.xxhash64(y)).alias("label"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = every.where(fine).withColumn("embedding", F.when(F.size("embedding") == 1, F.transform("embedding", F.signum).cast(kind)).otherwise(F.col("embedding")))
    classes = cut_lineage(good.groupBy("label", "embedding").agg(F.min("id").alias("node"), F.count("*").alias("members")), "classes")
    dims = [(r["d"], r["n"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()]
    empty = spark.createDataFrame([], "node bigint, links bigint, src bigint, dst bigint")
    found = empty
    for d, n in dims:
        if d > 1 and n > 1:
            found = found.unionByName(_pairs(classes, d, n, threshold))
    found = cut_lineage(found, "embedding-links")
    links = found.where("src = -1").groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(found.where("src <> -1").select("src", "dst"), "embedding")
    known = classes.join(links, "node", "left").join(merged, classes["node"] == merged["id"], "left")
    known = known.select("label", "embedding", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component_id", "node").alias("component_id"))
    linked = good.join(known, ["label", "embedding"]).select("id", (F.col("members") - 1 + F.col("links")).alias("n_links"), "component_id")
    alone = every.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.93 within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
