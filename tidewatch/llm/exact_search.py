"""Exact top-k search: tiled matrix products, partial selection per tile, and a tree of merges.

Components become integers, ``floor(scale * x)``, and a score is their inner product. Tasks pack their vectors into tiles
of at most ``TILE`` rows, which are written once; the number of a row in its tile is its identity, so a query leaves out
itself and nothing else. Tiles are dealt to shards, queries to blocks, each of bounded size, and a cell of the grid of
blocks and shards is one task: it multiplies slices of its queries with its tiles and selects the best of each product.
A query then has one list of at most k entries per shard; lists are merged ``FAN`` at a time until one is left. A cell
does work in proportion to block x shard and moves only block + shard, so the grid costs little beside its products.

Products are exact: a slice and a tile whose sums stay below 2^53 are multiplied in double precision, others in 64-bit
integers, and sums beyond those raise an error, as a score is a long.

Defined cases: vectors that are null or hold null or non-finite components take no part, and only vectors of equal
length are compared (empty ones with a score of 0); rows without id take no part, as nothing could name them; repeated
rows are candidates of each other and queries of their own; ties go to the smaller id; with fewer candidates than k all
are returned; an empty table or no query gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import need_integers, table
from tidewatch.session import cut_lineage

K = 10
#: Rows of a tile, and of the slice of queries that is multiplied with it at once.
TILE, SLICE = 4096, 256
#: Queries of a block and candidates of a shard, at most on average; both fit a task at any width in use.
BLOCK_QUERIES, SHARD_ROWS = 16_384, 65_536
#: Shards that a small table is cut into at least, if it has as many tiles.
LEAST_SHARDS = 16
#: Lists that a merge joins.
FAN = 16

TILE_SCHEMA = "tile bigint, dim int, n int, ids binary, rows binary, width int"
LIST = "array<struct<minus:bigint,id:bigint>>"


def narrow(x: np.ndarray) -> np.ndarray:
    """The values in the smallest of three integer types."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _matrix(r) -> np.ndarray:
    return np.frombuffer(r.rows, f"<i{r.width}").reshape(r.n, r.dim)


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, v, task) as tiles of vectors of one length."""
    held: dict[int, list[pd.DataFrame]] = {}
    made = 0

    def flush(dim: int) -> pd.DataFrame:
        nonlocal made
        rows = pd.concat(held.pop(dim))
        x = narrow(np.array([list(v) for v in rows["v"]], dtype=np.int64).reshape(len(rows), dim))
        made += 1
        return pd.DataFrame({
            "tile": [(int(rows["task"].iloc[0]) << 32) + made], "dim": [dim], "n": [len(rows)], "ids": [rows["id"].to_numpy("<i8").tobytes()], "rows": [x.tobytes()], "width": [x.itemsize],
        }).astype({"dim": "int32", "n": "int32", "width": "int32"})

    for batch in batches:
        for dim, rows in batch.groupby(batch["v"].map(len)):
            while len(rows):
                own = held.setdefault(int(dim), [])
                take = TILE - sum(map(len, own))
                own.append(rows.iloc[:take])
                rows = rows.iloc[take:]
                if sum(map(len, own)) == TILE:
                    yield flush(int(dim))
        while sum(len(f) for own in held.values() for f in own) > 4 * TILE:
            yield flush(next(iter(held)))
    for dim in list(held):
        yield flush(dim)


def _queries(every: int):
    """The rows of tiles that are queries: their place, id and vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                ids, x = np.frombuffer(r.ids, "<i8"), _matrix(r)
                own = np.flatnonzero(ids % every == 0)
                yield pd.DataFrame({"tile": r.tile, "place": own.astype("int32"), "dim": r.dim, "query": ids[own], "v": [x[i].astype("<i8").tobytes() for i in own]}).astype({"dim": "int32"})

    return run


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    bound = int(np.abs(q).max()) * int(np.abs(x).max()) * q.shape[1]
    if bound < 1 << 53:
        return q.astype(np.float64) @ x.astype(np.float64).T
    if bound >= 1 << 63:
        raise OverflowError("an inner product would not fit 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best of every row, ties going to the smaller column."""
    n = scores.shape[1]
    if n <= k:
        return np.ones(scores.shape, dtype=bool)
    edge = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above, equal = scores > edge, scores == edge
    room = k - above.sum(axis=1, keepdims=True)
    # Only rows with more ties than room need their ties counted from the left.
    tied = np.flatnonzero(equal.sum(axis=1) > room.ravel())
    equal[tied] &= np.cumsum(equal[tied], axis=1) <= room[tied]
    return above | equal


def _cell(k: int):
    """Best k of a shard for the queries of a block."""

    def run(queries: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        queries = queries.sort_values(["tile", "place"], ignore_index=True)
        for r in tiles.itertuples(index=False):
            ids = np.frombuffer(r.ids, "<i8")
            order = np.argsort(ids, kind="stable")
            x, ids = _matrix(r)[order], ids[order]
            where = np.empty(len(order), dtype=np.int64)
            where[order] = np.arange(len(order))
            of = queries[queries["dim"] == r.dim]
            for i in range(0, len(of), SLICE):
                part = of.iloc[i : i + SLICE]
                q = np.frombuffer(b"".join(part["v"]), "<i8").reshape(len(part), r.dim)
                s = product(q, x)
                own = np.flatnonzero((part["tile"] == r.tile).to_numpy())
                home = where[part["place"].to_numpy()[own]]
                keep = select(s, k + 1)  # room for the query itself
                keep[own, home] = False
                a, b = np.nonzero(keep)
                out.append(pd.DataFrame({"row": part.index.to_numpy()[a], "minus": -s[a, b].astype(np.int64), "id": ids[b]}))
        best = pd.concat([pd.DataFrame({"row": [], "minus": [], "id": []}, dtype="int64"), *out]).sort_values(["row", "minus", "id"], ignore_index=True)
        best = best[best.groupby("row").cumcount() < k]
        lists = [(row, list(zip(g["minus"].tolist(), g["id"].tolist(), strict=True))) for row, g in best.groupby("row")]
        shard = tiles["shard"].iloc[0] if len(tiles) else 0
        found = queries.iloc[[row for row, _ in lists]][["tile", "place", "query"]].assign(shard=shard)
        return found.assign(top=pd.Series([[{"minus": m, "id": i} for m, i in t] for _, t in lists], index=found.index, dtype=object))

    return run


def _best(lists: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.flatten(lists)), 1, k)


def search(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score): the k best of all rows for each row whose id is divisible by ``every``."""
    need_integers(vectors, id)
    v = F.col(f"`{embedding}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    points = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("id"), ints.alias("v"), F.spark_partition_id().alias("task"))
    tiles = cut_lineage(points.mapInPandas(_tiles, TILE_SCHEMA), "search-tiles")
    queries = cut_lineage(tiles.mapInPandas(_queries(every), "tile bigint, place int, dim int, query bigint, v binary"), "search-queries")
    size = tiles.agg(F.sum("n").alias("n"), F.count("*").alias("tiles")).first()
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    shards = max(1, math.ceil((size["n"] or 0) / SHARD_ROWS), min(size["tiles"], LEAST_SHARDS))
    dealt = tiles.withColumns({"shard": F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = queries.withColumns({"block": F.pmod(F.xxhash64("tile", "place"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    cells = asked.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard"))
    lists = cells.applyInPandas(_cell(k), f"tile bigint, place int, query bigint, shard int, top {LIST}")
    row = ["tile", "place", "query"]
    while shards > 1:
        shards = math.ceil(shards / FAN)
        lists = cut_lineage(lists, "search-lists").groupBy(*row, F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(_best(F.collect_list("top"), k).alias("top"))
    hits = lists.select(F.col("query").alias("query_id"), F.posexplode("top").alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.minus")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth."""
    return search(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM p a JOIN p b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
