import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidewatch.llm import centroid_clustering as m


def by_hand(rows, k=8, rounds=10, width=64, scale=1024, seed="3"):
    """rows: (id, vector), in Python integers."""
    ok = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    points = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if ok(v)]
    draw = sorted(((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in points))[:k]
    centres = [v for *_, v in draw]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in points]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(points, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in points]
    inertia = {j: sum(d for _, d, o in last if o == j) for j in range(len(centres))}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), told[j]) for i, d, j in last), key=str)


def result(frame, **more):
    return sorted(map(tuple, m.cluster(frame, **more).collect()), key=str)


def test_query_equals_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, m.query(spark, sf).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)
    assert got == sorted(con.execute(m.ORACLE_SQL).fetchall(), key=str)
    assert got == by_hand(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [0.5, -0.25, 0.0, -0.0]) for i in range(40)]
    rows += [(None, [1.0] * 4), (2**62 + 1, [2.0] * 4), (3, [1.0] * 4), (200, None), (201, []), (202, [1.0] * 5), (203, [None, 1.0, 1.0, 1.0]), (204, [float("nan")] + [1.0] * 3), (205, [float("inf")] * 4)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, `a.b` int").repartition(3)
    assert result(frame, width=4) == by_hand(rows, width=4)
    few = frame.where("vec_id in (1, 2, 200)")
    assert result(few, width=4) == by_hand([r for r in rows if r[0] in (1, 2, 200)], width=4)
    assert result(frame.where("false"), width=4) == [] and result(frame.where("vec_id between 200 and 205"), width=4) == []
    named = frame.withColumnsRenamed({"vec_id": "my.id", "embedding": "my.v"})
    assert result(named, id="my.id", embedding="my.v", width=4) == by_hand(rows, width=4)


def test_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(50)]
    assert result(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), width=4) == by_hand(rows, width=4)


def test_values_that_do_not_fit_raise(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        m.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), width=4).collect()


def test_dictionaries_are_lossless_and_distances_exact():
    rng = np.random.default_rng(5)
    for x in (rng.integers(-9, 9, size=(500, 10)), np.repeat(rng.integers(-(2**26), 2**26, size=(4, 10)), 90, axis=0), rng.integers(-(2**20), 2**20, size=(300, 7)), np.zeros((5, 3), dtype=int)):
        dims, books, codes = m.encode(x.astype("<i4"))
        assert sum(dims) == x.shape[1] and all(len(np.unique(b, axis=0)) == len(b) for b in books)
        assert (np.concatenate([b[c] for b, c in zip(books, codes, strict=True)], axis=1) == x).all()
        centres = rng.integers(-(2**26), 2**26, size=(3, x.shape[1]))
        expect = ((x[:, None, :].astype(object) - centres[None].astype(object)) ** 2).sum(axis=2)
        assert (m.distances([b.astype(np.int64) for b in books], codes, centres) == expect).all()


def test_repeated_vectors_share_wide_codes():
    x = np.repeat(np.random.default_rng(5).integers(-500, 500, size=(4, 16)), 200, axis=0).astype("<i4")
    assert max(m.encode(x)[0]) == max(m.WIDTHS)
