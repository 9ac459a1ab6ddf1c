"""Centroid clustering over subvector dictionaries, exact in integers.

Components become integers, ``floor(scale * x)``. Tasks cut their vectors into chunks of at most ``CHUNK``, and every chunk
into blocks of dimensions. The distinct subvectors of a block are its dictionary; a vector is a code per block. Nothing is
lost: codes and dictionaries give the integers back. Blocks are as wide as pays: a chunk is encoded with each of
``WIDTHS`` and keeps the form in which a round does the least work. Chunks are written once and read in every round.

A round computes, per chunk, the squared distance of each distinct subvector to that part of each centroid, once, and a
vector's distances are the sums of what its codes name. The new sums are counted by code too: how often a cluster has a
code, times the subvector. A chunk sends one row per cluster, so no round shuffles vectors, and the driver only sees
the k centroids. Chunks keep dictionaries of bounded size whatever the table's size, and none is broadcast.

Defined cases: only vectors of exactly ``width`` components take part, none null or non-finite; rows without id are
clustered, but start no centroid while enough others have one. Ties go to the smaller centroid, equal draws to the
smaller vector. With fewer vectors than k there are as many centroids as vectors; an empty table gives an empty result;
repeated rows count repeatedly; other columns are not read. Values whose squared distances don't fit 64 bits raise
an error, as the result is a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import need_integers, table
from tidewatch.session import cut_lineage

CHUNK = 16_384
#: Dimensions of a block that are tried.
WIDTHS = (1, 2, 4, 8)
#: Components stay below this, so that 64 squared differences fit 63 bits.
LARGEST = 1 << 27

CHUNK_SCHEMA = "ids binary, known binary, dims array<int>, sizes array<int>, entries binary, codes binary"


def integers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles (exact below 2^53)."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def clean(vectors: DataFrame, id: str, embedding: str, width: int | None, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(f"`{embedding}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    fine = fine if width is None else fine & (F.size(v) == width)
    big = F.exists(v, lambda x: F.abs(x.cast("double")) * float(scale) >= float(LARGEST))
    checked = F.when(big, F.raise_error(F.lit(f"a component exceeds {LARGEST // scale}: distances would not fit 64 bits"))).otherwise(integers(v, scale))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id}`").alias("id"), checked.cast("array<double>").alias("v"))


# ---- dictionaries ------------------------------------------------------------------
def encode(x: np.ndarray) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Widths, dictionaries and codes of the blocks of an integer matrix, in the cheapest of the forms tried."""
    best = None
    for w in WIDTHS:
        dims = [min(w, x.shape[1] - i) for i in range(0, x.shape[1], w)]
        books, codes, at = [], [], 0
        for d in dims:
            part = np.ascontiguousarray(x[:, at : at + d])
            whole = part.view([("", part.dtype)] * d).ravel() if d > 1 else part.ravel()
            _, first, code = np.unique(whole, return_index=True, return_inverse=True)
            books.append(part[first])
            codes.append(code.ravel().astype("<u2"))
            at += d
        cost = sum(len(b) * b.shape[1] for b in books) + len(x) * len(dims)
        if best is None or cost < best[0]:
            best = (cost, dims, books, codes)
        if any(len(b) > len(x) // 2 for b in books):
            break  # wider blocks repeat even less
    return best[1:] if best else ([], [], [])


def decode(row) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Dictionaries and codes of a chunk's row."""
    n, books, codes, at = len(row.known), [], [], 0
    entries = np.frombuffer(row.entries, "<i4").astype(np.int64)
    held = np.frombuffer(row.codes, "<u2").reshape(len(row.dims), n)
    for k, (d, size) in enumerate(zip(row.dims, row.sizes, strict=True)):
        books.append(entries[at : at + d * size].reshape(size, d))
        codes.append(held[k])
        at += d * size
    return books, codes


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (id, known, v) as encoded chunks; several may come from one task, the last one being smaller."""
    held: list[pd.DataFrame] = []

    def flush() -> pd.DataFrame:
        rows = pd.concat(held)
        held.clear()
        x = np.stack(rows["v"].to_numpy()).astype("<i4")
        dims, books, codes = encode(x)
        return pd.DataFrame({
            "ids": [rows["id"].to_numpy("<i8").tobytes()], "known": [rows["known"].to_numpy(bool).tobytes()], "dims": [dims], "sizes": [[len(b) for b in books]], "entries": [b"".join(b.tobytes() for b in books)], "codes": [b"".join(c.tobytes() for c in codes)],
        })

    for batch in batches:
        while len(batch):
            take = CHUNK - sum(map(len, held))
            held.append(batch.iloc[:take])
            batch = batch.iloc[take:]
            if sum(map(len, held)) == CHUNK:
                yield flush()
    if held:
        yield flush()


# ---- rounds ------------------------------------------------------------------------
def distances(books: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid): per block those of its dictionary, summed up by code."""
    total, at = np.zeros((len(codes[0]), len(centroids)), dtype=np.int64), 0
    for book, code in zip(books, codes, strict=True):
        diff = book[:, None, :] - centroids[None, :, at : at + book.shape[1]]
        total += (diff * diff).sum(axis=2)[code]
        at += book.shape[1]
    return total


def _sums(centroids: np.ndarray):
    """Per chunk and cluster, the count and the sums of its vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                books, codes = decode(r)
                near, k = distances(books, codes, centroids).argmin(axis=1), len(centroids)
                n = np.bincount(near, minlength=k)
                parts = [np.bincount(near * len(b) + c, minlength=k * len(b)).reshape(k, len(b)) @ b for b, c in zip(books, codes, strict=True)]
                total = np.concatenate(parts, axis=1)
                own = np.flatnonzero(n)
                yield pd.DataFrame({"cluster": own, "n": n[own], "sums": total[own].tolist()})

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                d = distances(*decode(r), centroids)
                near = d.argmin(axis=1)
                ids = pd.array(np.frombuffer(r.ids, "<i8"), dtype="Int64")
                ids[~np.frombuffer(r.known, bool)] = pd.NA
                yield pd.DataFrame({"id": ids, "cluster": near.astype("int32"), "distance": d[np.arange(len(d)), near]})

    return run


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component, in Python's exact integers."""
    out = centroids.copy()
    for r in sums:
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def fit(chunks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    width = centroids.shape[1]
    for _ in range(rounds):
        part = chunks.mapInPandas(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
        total = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width))).alias("sums"))
        centroids = moved(centroids, total.collect())
    return centroids


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digests of ``seed:id``, in their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(
    vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3",
) -> DataFrame:
    """Per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    need_integers(vectors, id)
    spark = vectors.sparkSession
    points = clean(vectors, id, embedding, width, scale)
    centroids = first_centroids(points, k, seed)
    schema = "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    chunks = cut_lineage(points.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "v").mapInPandas(_chunks, CHUNK_SCHEMA), "cluster-chunks")
    centroids = fit(chunks, centroids, rounds)
    placed = cut_lineage(chunks.mapInPandas(_assign(centroids), "id bigint, cluster int, distance bigint"), "cluster-assigned")
    found = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    # At most k rows, as there is one per centroid.
    told = {c: (found[c], hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in found}
    pick = lambda at, kind: reduce(lambda e, c: e.when(F.col("cluster") == c, F.lit(told[c][at]).cast(kind)), told, F.when(F.lit(False), F.lit(None).cast(kind)))
    return placed.select("id", "cluster", "distance", pick(0, "bigint").alias("cluster_inertia"), F.lit(sum(found.values())).cast("bigint").alias("inertia"), pick(1, "string").alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after ten rounds from eight centroids."""
    return cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _oracle(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    ints = f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {ints} AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM p ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT p.r, p.vec_id, p.v, q.c, CAST({square} AS BIGINT) AS d, row_number() OVER (PARTITION BY p.r ORDER BY d, q.c) AS k FROM p, c{i} q) WHERE k = 1)")
        if i < rounds:
            mean = "CAST(CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END AS BIGINT)"
            steps.append(f"m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, {mean} AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, v FROM c{rounds}) q USING (c)"""


ORACLE_SQL = _oracle()
